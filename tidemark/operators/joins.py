"""Joins that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the values of the newest right row of its key at or before its time.

    A tagged union, so both sides are shuffled once and no pair is made. A key's rows are dealt by slices of time (days; of numbers runs of a million),
    so that a hot key is many tasks; a slice gets the last right row of the slices before it from a table of one row for each
    key and slice. Of right rows at one instant the one with the largest values counts.
    """
    kind = left.schema[left_time].dataType.typeName()
    slice_of = slice_of or ((lambda t: F.date_trunc("day", t)) if kind.startswith("timestamp") or kind == "date" else (lambda t: F.floor(t / 1_000_000)))
    lefts = left.select(F.struct(*left.columns).alias("row_"), *by, F.col(left_time).alias("at_"), F.lit(1).alias("side_"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("v_"))
    rights = right.select(F.lit(None).cast(lefts.schema["row_"].dataType).alias("row_"), *by, F.col(right_time).alias("at_"), F.lit(0).alias("side_"), F.struct(*values).alias("v_"))
    both = lefts.union(rights).withColumn("slice_", slice_of(F.col("at_")))
    w = Window.partitionBy(*by, "slice_").orderBy("at_", "side_", "v_").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("v_", F.last("v_", ignorenulls=True).over(w)).where("side_ = 1")
    last = both.groupBy(*by, "slice_").agg(F.max(F.when(F.col("side_") == 0, F.struct("at_", "v_"))).alias("last_"))
    earlier = Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("slice_").alias("slice_of_"), F.last("last_", ignorenulls=True).over(earlier).alias("before_"))
    same = [out[c].eqNullSafe(before[f"{c}_of"]) for c in by] + [out["slice_"].eqNullSafe(before["slice_of_"])]
    out = out.join(before, same, "left").withColumn("v_", F.coalesce("v_", F.col("before_.v_")))
    return out.select("row_.*", *[F.col(f"v_.{v}").alias(v) for v in values])


def within(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high, by buckets of `width`: a range goes to each bucket that it touches, a point to one."""
    p = points.withColumn("bucket_", F.floor(F.col(at) / width))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "bucket_").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("bucket_")


def stamp_by_file(df: DataFrame, stamps: DataFrame, path_col: str = "path", to: str = "ingest_ns") -> DataFrame:
    """Rows with the ingest time of their file. One row of stamps for each file; Spark broadcasts it when its size allows."""
    return df.join(stamps.select(F.col("path").alias(path_col), F.col("ingest_ns").alias(to)), path_col)


def sessions(events: DataFrame, by: list[str], time: str, gap: str) -> DataFrame:
    """Sessions of each key: runs whose events are less than gap apart."""
    return events.groupBy(*by, F.session_window(F.col(time), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).drop("w")
