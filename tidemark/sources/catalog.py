"""Segments of a tenant's store: listing, pruning by time, and reading."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import LOGS, METRICS, empty
from ..operators.union import union_by_name
from .files import Files

_TENANT = re.compile(r"[a-z0-9][a-z0-9._-]{0,62}")
_ARTIFACT = re.compile(r"[a-z][a-z0-9-]{1,63}")


@dataclass(frozen=True)
class Segment:
    tier: int
    path: str
    bytes: int
    min_ts: int
    max_ts: int
    compacted: bool = False
    schema: str = ""  # as JSON, where known


def check_tenant(name: str) -> str:
    if not _TENANT.fullmatch(name):
        raise ValueError(f"bad tenant {name!r}")
    return name


def check_artifact(name: str) -> str:
    if not _ARTIFACT.fullmatch(name):
        raise ValueError(f"bad artifact {name!r}")
    return name


def confined(root: str, path: str) -> str:
    """The real path, which must be inside root, links followed."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([real, top]) != top:
        raise PermissionError(f"{path} is outside the tenant's folder")
    return real


def prune(segments: list[Segment], start: int | None = None, end: int | None = None) -> list[Segment]:
    """Segments that may hold rows of [start, end); retired ones are out."""
    return [s for s in segments if not s.compacted and (start is None or s.max_ts >= start) and (end is None or s.min_ts < end)]


def recent_floor(start: int, now: int, lookback: int) -> int:
    """The start to prune by: an open start looks back only so far, if a lookback is set."""
    return now - lookback if not start and lookback else start


def hot_only(segments: list[Segment], start: int, end: int, snapshot: Segment | None, skew: int = 60_000) -> list[Segment]:
    """The snapshot alone if it covers the range (up to a skew), else all."""
    if snapshot and start >= snapshot.min_ts - skew and end <= snapshot.max_ts + skew:
        return [snapshot]
    return [*segments, *([snapshot] if snapshot else [])]


def present(spark: SparkSession, segments: list[Segment]) -> list[Segment]:
    """Those whose folder is still there: a merge or retention of another process may have taken one since the listing."""
    files = Files(spark)
    return [s for s in segments if files.exists(s.path)]


def read_metrics(spark: SparkSession, segments: list[Segment]) -> DataFrame:
    """One scan over all files that are there; files that go during the scan are passed over."""
    segments = present(spark, segments)
    if not segments:
        return empty(spark, METRICS)
    return spark.read.schema(METRICS).option("ignoreMissingFiles", "true").parquet(*[s.path for s in segments])


def read_logs(spark: SparkSession, segments: list[Segment]) -> DataFrame:
    """Files combined by name: one scan for each distinct schema, then an aligned union. Schemas come from the catalog; a footer is read only where it has none."""
    segments = present(spark, segments)
    if not segments:
        return empty(spark, LOGS)
    by_schema: dict[str, list[str]] = {}
    for s in segments:
        by_schema.setdefault(s.schema or spark.read.parquet(s.path).schema.json(), []).append(s.path)
    read = lambda schema, paths: spark.read.schema(StructType.fromJson(json.loads(schema))).option("ignoreMissingFiles", "true").parquet(*paths)
    return union_by_name([read(*x) for x in by_schema.items()])


def bytes_on_disk(segments: list[Segment]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in segments:
        out[s.tier] = out.get(s.tier, 0) + s.bytes
    return out


def stat(spark: SparkSession, path: str, tier: int, size: int, column: str = "ts") -> Segment:
    """A segment's row of the catalog, in milliseconds."""
    t = F.unix_millis(F.col(column).cast("timestamp"))
    df = spark.read.parquet(path)
    low, high = df.agg(F.min(t), F.max(t)).first()
    return Segment(tier, path, size, low or 0, high or 0, schema=df.schema.json())


def tenant_views(spark: SparkSession, metrics: list[Segment], logs: dict[str, list[Segment]], materialized: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The views of the SQL API: metrics, logs, one for each log artifact, and the materialized tables."""
    frames = {name.replace("-", "_"): read_logs(spark, segs) for name, segs in logs.items()}
    views = {"metrics": read_metrics(spark, metrics), **{n: frames.get(n, empty(spark, LOGS)) for n in ("logs_raw", "logs_template", "logs_summary")}, **frames}
    views["logs"] = union_by_name(list(frames.values())) if frames else empty(spark, LOGS)
    return views | {f"mat_{n.replace('-', '_')}": spark.read.parquet(*p) for n, p in (materialized or {}).items()}
