"""A corpus pipeline: toxicity filter, line dedup, near-dedup, repeated strings, packing.

Each stage works on all that the one before it kept. All but the last return the columns
of documents; n_chars follows the text. Columns beyond those of documents are kept as they are, whatever their names. Null ids and
texts, blank and very long texts, ties and repeated rows are allowed in each stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, near, packing, repeats, toxicity
from tidemark.llm.common import durable, table, temp_name

#: Bytes of a passage of 50 words, at five a word with its blank.
PASSAGE = 250


def _with_n_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on the stage's documents and drops those it predicts to be toxic (score >= 0.7). Null and blank texts stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of which an earlier document or line has a copy within one edit.

    A document that loses lines and has none left that isn't blank goes: all of it stands in earlier ones. So does each repeated row beyond the
    first. One that was null or blank before stays.
    """
    out = lines.dedup_lines(docs)
    n_removed, text = F.col(f"`{temp_name(docs, 'n_removed')}`"), F.coalesce(F.col("text"), F.lit(""))
    out = out.where((n_removed == 0) | text.rlike("[^ \\r\\n]"))
    return _with_n_chars(out.select(*[F.col(f"`{c}`") for c in docs.columns]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, that with the smallest id. Texts without words all stay, but for repeated rows."""
    return near.keep_first(docs, 0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all bytes covered by a string of PASSAGE bytes that also starts elsewhere. Null texts stay null, shorter ones as they are."""
    return _with_n_chars(repeats.remove_repeats(docs, PASSAGE))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows; one row for each piece. Null and empty texts have one piece of 0 bytes in bin "none"."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", cut_repeats), ("best-fit packing", pack)]
#: The classifier, Order MinHash and best-fit packing are not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
