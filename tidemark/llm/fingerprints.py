"""Canonical exact digests of texts, with byte comparison inside equal buckets. DataFrame functions only."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Neighbouring documents that are dealt out together, and such blocks that form a section.
BLOCK, SECTION = 64, 4096


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again; runs of white space become one space, none at the ends.

    The Unicode steps are static methods of the ICU library that Spark itself ships,
    called through the SQL function reflect; ASCII texts need only lower().
    """
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(text.rlike("[^\\x00-\\x7F]"), compose(fold(compose(text)))).otherwise(F.lower(text))
    return F.btrim(F.regexp_replace(folded, "[\\s\\x1c-\\x1f\\x85\\p{Z}]+", " "), F.lit(" "))


def wide_hash(text: Column, bits: int = 128) -> tuple[Column, Column]:
    """Two xxhash64 values with different seeds; fewer bits only make buckets collide in tests."""
    one, two = F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)
    return (one, two) if bits >= 128 else (F.shiftrightunsigned(one, 64 - bits), F.lit(0).cast("long"))


def _hex(one: Column, two: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0")))


def _blocks(ids: DataFrame, k: Column, quantiles: int) -> Column:
    """A number that rises with k, of which one holds about BLOCK rows: k is cut at quantiles, and each part into equal widths.

    So ids may be as uneven as they like from part to part; the cuts are at most `quantiles` numbers in an expression.
    """
    shares = [F.lit(i / quantiles) for i in range(1, quantiles)]
    low, high, n, cuts = ids.agg(F.min(k), F.max(k), F.count(k), F.approx_percentile(k, F.array(*shares), F.lit(100 * quantiles))).first()
    if not n:
        return F.lit(0).cast("long")
    edges = sorted({low, *(cuts or []), high + 1})
    many = max(1, math.ceil(n / BLOCK / (len(edges) - 1)))  # blocks of a part

    def part(i: int, j: int) -> Column:
        if j - i > 1:
            middle = (i + j) // 2
            return F.when(k < F.lit(Decimal(edges[middle])), part(i, middle)).otherwise(part(middle, j))
        width = max(1, -(-(edges[i + 1] - edges[i]) // many))
        return F.lit(i * many).cast("long") + F.floor((k.cast("decimal(38,0)") - F.lit(Decimal(edges[i]))) / F.lit(Decimal(width))).cast("long")

    return part(0, len(edges) - 1)


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, block, nth, next): next is the text of the next row by (id, text hash), after the last of the first.

    Rows go to blocks of consecutive ids, each text once; a block's last row gets the first
    text of the next block that isn't empty, so 1 text in BLOCK moves a second time.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("k", F.col("id").try_cast("long"))
    ids = src.select("id", "k")
    for quantiles in (64, 1024):
        block = _blocks(ids, F.col("k"), quantiles)
        most = ids.where("k is not null").groupBy(block.alias("b")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= 32 * BLOCK:
            break
    # Rows without an id come before all others, by the hash of their text.
    nulls = math.ceil(ids.where("k is null").count() / BLOCK)
    share = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
    of_null = F.least(F.floor(share * nulls), F.lit(nulls - 1)).cast("long") - nulls
    rows = src.withColumn("block", F.when(F.col("k").isNull(), of_null).otherwise(block)).select("id", "text", "block", "k")
    in_block = Window.partitionBy("block").orderBy(F.col("k").asc_nulls_first(), F.xxhash64("text"))
    rows_ = rows.repartition("block").select("id", "text", "block", F.row_number().over(in_block).alias("nth"), F.lead("text").over(in_block).alias("next"))
    # The block before each: within sections, then over the sections, of which there is one for 262,144 rows.
    blocks = rows.select("block").distinct().withColumn("section", F.floor(F.col("block") / SECTION))
    inner = Window.partitionBy("section").orderBy("block")
    blocks = blocks.withColumn("before", F.lag("block").over(inner))
    sections = blocks.groupBy("section").agg(F.max("block").alias("top"))
    over = Window.orderBy("section")
    whole = Window.orderBy("section").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sections = sections.select("section", F.coalesce(F.lag("top").over(over), F.max("top").over(whole)).alias("top_before"))
    before = blocks.join(sections, "section").select("block", F.coalesce("before", "top_before").alias("to"))
    heads = rows_.where("nth = 1").select("block", "text").join(before, "block").select(F.col("to").alias("block"), F.col("text").alias("head"))
    return rows_.join(heads, "block", "left").select("id", "text", "block", "nth", F.coalesce("next", "head").alias("next"))


def edit_and_fingerprint(docs: DataFrame, bits: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text and its edited text: the last floor(n / 2) code points
    replaced by as many first ones of the next text by ascending id (after the last: of the first).

    A fingerprint is 32 hex digits of the canonical text's wide hash. Texts whose wide
    hashes are equal are compared byte by byte, map-side first and then by (hash, text);
    if different texts share a hash, the second and later ones (by text) get the suffix "-k". So fingerprints
    are equal exactly if canonical texts are. As the digest is exact, a likeness is 1 or 0.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty. Ids are whole numbers; null ids, and others that are none, come first; rows with one id are ordered by
    a hash of their text and each gets a row (they stay in one block, the only group that can't be cut). A single row is its own next. An empty table gives no rows. Other columns are ignored.
    """
    rows = _with_next(docs, id_col, text_col)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.expr("substring(next, 1, char_length(text) div 2)"))
    rows = rows.withColumn("edited", F.when(half > 0, edited).otherwise(F.col("text")))
    canon = rows.select("id", "block", "nth", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), canonical(F.col("next")).alias("x"))
    (h1, h2), (e1, e2) = wide_hash(F.col("c"), bits), wide_hash(F.col("e"), bits)
    likeness = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    keys = durable(canon.select("id", "block", "nth", "n_chars", "edited_sha256", h1.alias("h1"), h2.alias("h2"), e1.alias("e1"), e2.alias("e2"), likeness("c", "e").alias("near_edited"), likeness("c", "x").alias("near_next")))
    ordinals = _compare_buckets(rows, keys, bits)
    mark = F.lit("")
    out, marks = keys, {0: mark, 1: mark}
    if ordinals is not None:
        for kind in (0, 1):
            own = ordinals.where(F.col("kind") == kind).select("block", "nth", F.concat(F.lit("-"), "ordinal").alias(f"mark{kind}"))
            out = out.join(own, ["block", "nth"], "left")
            marks[kind] = F.coalesce(F.col(f"mark{kind}"), F.lit(""))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.concat(_hex(F.col("h1"), F.col("h2")), marks[0]).alias("fingerprint"), F.concat(_hex(F.col("e1"), F.col("e2")), marks[1]).alias("edited_fingerprint"), "near_edited", "near_next")


def _compare_buckets(rows: DataFrame, keys: DataFrame, bits: int) -> DataFrame | None:
    """(block, nth, kind, ordinal over 0) of texts that share a hash with another text; None if there are none.

    Only texts whose hash another row has are compared. Their places go back to the blocks, where
    the texts already are, so that the others aren't shuffled again.
    """
    own = keys.select("block", "nth", F.lit(0).alias("kind"), "h1", "h2")
    both = own.unionByName(keys.select("block", "nth", F.lit(1).alias("kind"), F.col("e1").alias("h1"), F.col("e2").alias("h2")))
    multi = both.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    flagged = both.join(multi, ["h1", "h2"], "left_semi").groupBy("block").agg(F.collect_set(F.col("nth") * 2 + F.col("kind")).alias("places"))
    picked = rows.join(flagged, "block").select("block", "nth", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.array_contains("places", F.col("nth") * 2).alias("in")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"), F.array_contains("places", F.col("nth") * 2 + 1).alias("in")))).alias("s")).where("s.in").select("block", "nth", "s.kind", canonical(F.col("s.t")).alias("c"))
    h1, h2 = wide_hash(F.col("c"), bits)
    picked = picked.select("block", "nth", "kind", h1.alias("h1"), h2.alias("h2"), "c")
    texts = picked.select("h1", "h2", "c").distinct()
    clashes = durable(texts.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    if clashes.isEmpty():
        return None
    ranked = texts.join(clashes, ["h1", "h2"]).withColumn("ordinal", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("c")) - 1).where("ordinal > 0")
    return durable(picked.join(ranked, ["h1", "h2", "c"]).select("block", "nth", "kind", F.col("ordinal").cast("string").alias("ordinal")))
