"""Schemas of metrics, rollups and logs, and how the driver's tables map onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "`__name__` string, labels string, value double, timestamp_ms bigint, ts timestamp_ntz"
ROLLUP = "bucket timestamp_ntz, `__name__` string, avg double, min double, max double, count bigint, sum double"
LOGS = "message string, format string, template string, count bigint"
#: Column with the nanosecond at which a log row was ingested.
INGEST_NS = "__ingest_ts_ns"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A typed relation without rows, for a tenant without files."""
    return spark.createDataFrame([], schema)


def ms_of(ts) -> F.Column:
    """Milliseconds since the epoch of a zone-less timestamp (session zone UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def metrics_of_events(events: DataFrame) -> DataFrame:
    """events as metrics: the type is the name, the user a label."""
    return events.select(F.col("event_type").alias("__name__"), F.concat(F.lit('user_id="'), F.col("user_id").cast("string"), F.lit('"')).alias("labels"), F.col("value"), ms_of(F.col("ts")).alias("timestamp_ms"), F.col("ts"))


def logs_of_documents(docs: DataFrame) -> DataFrame:
    """documents as a log artifact, ingested a millisecond apart from 2024 on."""
    ns = F.lit(1704067200000000000) + F.col("doc_id") * F.lit(1000000)
    return docs.select(F.col("text").alias("message"), F.col("lang").alias("format"), F.col("source"), ns.alias(INGEST_NS))


def stamp(df: DataFrame, ingested_at: str) -> DataFrame:
    """The five metric columns of a window, stamped with the instant of ingestion."""
    return df.select("__name__", "labels", "value", "timestamp_ms", F.lit(ingested_at).cast("timestamp_ntz").alias("ts"))
