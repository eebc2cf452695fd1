"""Contiguous shards of near-equal byte size from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Bytes that each row counts besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts each row into one of n_shards runs of consecutive ids with near-equal bytes.

    Rows are range-partitioned by id; each partition's total is added up to the bytes
    that stand before it, and the global sequence is cut where the middle of a row
    passes a multiple of total / n_shards. Only (id, size, crc) is shuffled, never a
    text; the totals are one row for each partition.

    Returns id, size (UTF-8 bytes + 16), text_crc32 (unsigned; of "" for null), shard,
    slot (gapless from 0 in each shard, in id order). Null ids come first; rows with
    one id stay neighbours, in the order of (crc, size), and each gets its own slot. A null text
    counts 16 bytes. A row larger than a target makes its shard larger and may leave
    others empty. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("crc"))
    order = [F.col("id").asc_nulls_first(), F.col("crc"), F.col("size")]
    rows = durable(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    at = Window.partitionBy("part").orderBy(*order)
    rows = rows.select("*", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, -1)).alias("in_part"), F.row_number().over(at).alias("nth"))
    # One row for each partition, so its size has a bound whatever the input.
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_size").over(Window.partitionBy()).alias("total"))
    rows = rows.join(F.broadcast(parts), "part")
    middle = 2 * (F.col("bytes_before") + F.coalesce("in_part", F.lit(0))) + F.col("size")
    rows = rows.select("id", "size", "crc", (F.col("rows_before") + F.col("nth")).alias("rank"), F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / (2 * F.col("total")))).cast("int").alias("shard"))
    firsts = rows.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # n_shards rows
    return rows.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))
