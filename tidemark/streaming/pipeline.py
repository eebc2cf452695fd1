"""Pipelines on Structured Streaming: source, parse, processors, windows, fan-out."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsers import fill_absent, k8s_path_labels, parse_exposition, parse_log
from ..operators.logs import mine, summary

Step = Callable[[DataFrame], DataFrame]
_SIZES = {"": 1, "b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}


def parse_bytes(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmg]?i?b?)\s*", text.lower())
    if not m or m[2] not in _SIZES:
        raise ValueError(f"bad size {text!r}")
    return int(float(m[1]) * _SIZES[m[2]])


def expand_env(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; a name without value and default is an error."""
    env = dict(os.environ) if env is None else env

    def put(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[3] is None:
            raise KeyError(m[1])
        return m[3]

    return re.sub(r"\$\{([A-Za-z_]\w*)(:-([^}]*))?\}", put, text)


@dataclass
class Branch:
    name: str
    steps: list[Step] = field(default_factory=list)
    sink: Callable[[DataFrame, int], None] = lambda df, epoch: None


@dataclass
class Pipeline:
    """One source; each micro-batch is a window of arrival time that goes to all branches."""

    name: str
    source: Callable[[SparkSession], DataFrame]
    parse: Step
    branches: list[Branch]
    on_error: str = "block"
    max_age: str = "30 seconds"


def fan_out(branches: list[Branch], on_error: str = "block") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the window is kept while each branch transforms and writes it. drop goes on after a failing branch, block stops."""

    def run(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            for b in branches:
                out = df
                try:
                    for step in b.steps:
                        out = step(out)
                    b.sink(out, epoch)
                except Exception:
                    if on_error != "drop":
                        raise
        finally:
            df.unpersist()

    return run


def start(spark: SparkSession, p: Pipeline, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Runs a pipeline as a query of its own; drain reads what there is and ends."""
    w = p.parse(p.source(spark)).writeStream.queryName(p.name).option("checkpointLocation", checkpoint).foreachBatch(fan_out(p.branches, p.on_error))
    return (w.trigger(availableNow=True) if drain else w.trigger(processingTime=p.max_age)).start()


def parse_logs(kind: str = "auto", labels: dict[str, str] | None = None, with_path: bool = False) -> Step:
    """Lines (value) to (message, format, template-ready fields); producer labels, then those of the file's path, fill missing fields."""

    def run(df: DataFrame) -> DataFrame:
        row = parse_log(F.col("value"), kind)
        if labels:
            row = fill_absent(row, F.create_map(*[F.lit(x) for kv in sorted(labels.items()) for x in kv]))
        if with_path:
            row = fill_absent(row, k8s_path_labels(F.col("_metadata.file_path")))
        df = df.select(row.alias("fields"))
        return df.select(F.col("fields")["message"].alias("message"), F.col("fields")["format"].alias("format"), F.map_filter("fields", lambda k, _: ~k.isin("message", "format")).alias("fields"))

    return run


def parse_metrics(strict: bool = True) -> Step:
    return lambda df: parse_exposition(df, "value", strict)


def with_template(column: str = "message") -> Step:
    return lambda df: mine(df, column)


def summarize(group_by: list[str], aggregates: list[str]) -> Step:
    return lambda df: summary(df, group_by, aggregates)


def quick(path: str, sink: Callable[[DataFrame, int], None]) -> Pipeline:
    """Lines to template counts: parse, mine, count by template."""
    from ..sources.sinks import read_lines

    return Pipeline("quick", lambda s: read_lines(s, path, stream=True), parse_logs("auto"), [Branch("summary", [with_template(), summarize(["template"], ["count"])], sink)])


def event_windows(df: DataFrame, time: str, late: str, size: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Tumbling or sliding event-time windows behind a watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, size, slide or size), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))


def event_sessions(df: DataFrame, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
