"""Rollups and time-range queries of metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = {"1m": 60, "5m": 300, "1h": 3600}
#: Buckets count from Monday 2000-01-03, as seconds since the epoch.
ORIGIN = 946_857_600


def parse_steps(text: str) -> list[int]:
    """Seconds of a list such as 1m,5m,1h."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)([mh])", part)
        if not m or not int(m[1]):
            raise ValueError(f"bad step {part!r}")
        out.append(int(m[1]) * (60 if m[2] == "m" else 3600))
    return out


def bucket(ts, seconds: int) -> F.Column:
    """The start of the bucket that holds ts; keeps the type of ts."""
    return F.window(ts, f"{seconds} seconds", f"{seconds} seconds", f"{ORIGIN % seconds} seconds").start


def rollup(metrics: DataFrame, seconds: int) -> DataFrame:
    """avg, min, max, count and sum by bucket and name; labels are dropped. Partial sums are built map-side."""
    return metrics.where("ts is not null").groupBy(bucket(F.col("ts"), seconds).alias("bucket"), "__name__").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"))


def reroll(rollups: DataFrame, seconds: int) -> DataFrame:
    """A coarser rollup of a finer one."""
    return rollups.groupBy(bucket(F.col("bucket"), seconds).alias("bucket"), "__name__").agg((F.sum("sum") / F.sum("count")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"), F.sum("sum").alias("sum"))


def pick_step(start_s: float, end_s: float, step: str = "") -> str:
    """The rollup for a range: the step asked for, else 1h from 7 days on, 5m from a day, 1m from an hour, else none."""
    if step:
        return step if step in STEPS else ""
    span = end_s - start_s
    return "1h" if span >= 7 * 86400 else "5m" if span >= 86400 else "1m" if span >= 3600 else ""


def range_query(metrics: DataFrame, start: str, end: str, rollups: DataFrame | None = None) -> DataFrame:
    """Rows with start <= ts < end in time order; given rollups, their averages stand beside the raw rows (totals then count both)."""
    cut = lambda df, c: df.where((F.col(c) >= F.lit(start).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz")))
    out = cut(metrics, "ts").select("__name__", "labels", "value", "timestamp_ms", "ts")
    if rollups is not None:
        out = out.union(cut(rollups, "bucket").select("__name__", F.lit("{}"), F.col("avg"), F.lit(0).cast("long"), F.col("bucket")))
    return out.orderBy("ts", "__name__", "labels")


def count_and_sum(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value_sum"))


def by_name(df: DataFrame) -> DataFrame:
    """avg, min, max and count of each name."""
    return df.groupBy("__name__").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("count"))


def structured_rows(df: DataFrame) -> DataFrame:
    """Rows as the structured answer writes them: null text is empty, a null value 0."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) if t in ("double", "bigint") else F.col(c) for c, t in df.dtypes])


def bounds(df: DataFrame, column: str = "ts") -> DataFrame:
    """min and max; Parquet answers from its footers where aggregates are pushed down."""
    return df.agg(F.min(column).alias("min_ts"), F.max(column).alias("max_ts"))
