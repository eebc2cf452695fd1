"""LogQL subset: a stream selector and line filters, compiled to DataFrame predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import matches, render_labels
from ..model import INGEST_NS

#: The label that every stream has besides those from columns.
JOB = "tidemark"
DEFAULT_LIMIT, MAX_LIMIT = 100, 5000
#: Columns that are labels of a stream only if they are text; lines and times never are.
_NOT_LABELS = {"message", "count", "ts", INGEST_NS}


class LogQLError(ValueError):
    pass


@dataclass
class LogQuery:
    matchers: list[tuple[str, str, str]] = field(default_factory=list)
    filters: list[tuple[str, str]] = field(default_factory=list)


_STRING = r'"(?:[^"\\]|\\.)*"|`[^`]*`'
_MATCHER = re.compile(rf"\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*(=~|!~|!=|=)\s*({_STRING})\s*")
_FILTER = re.compile(rf"\s*(\|=|!=|\|~|!~)\s*({_STRING})\s*")


def _unquote(s: str) -> str:
    return s[1:-1] if s[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s[1:-1])


def parse(text: str) -> LogQuery:
    """An empty query and {} match all; a filter needs a selector before it. All else is refused."""
    text = text.strip()
    q = LogQuery()
    if not text:
        return q
    if text[0] != "{":
        raise LogQLError("a query starts with a stream selector")
    at = 1
    while True:
        rest = text[at:].lstrip()
        at = len(text) - len(rest)
        if rest.startswith("}"):
            at += 1
            break
        m = _MATCHER.match(text, at)
        if not m:
            raise LogQLError(f"bad matcher at {at}")
        q.matchers.append((m[1], m[2], _unquote(m[3])))
        at = m.end()
        if text[at : at + 1] == ",":
            at += 1
        elif text[at : at + 1] != "}":
            raise LogQLError(f"expected , or }} at {at}")
    while at < len(text) and text[at:].strip():
        m = _FILTER.match(text, at)
        if not m:
            raise LogQLError(f"only line filters may follow a selector (at {at})")
        q.filters.append((m[1], _unquote(m[2])))
        at = m.end()
    for op, value in [(o, v) for _, o, v in q.matchers] + q.filters:
        if op.endswith("~"):
            try:
                re.compile(value)
            except re.error as e:
                raise LogQLError(f"bad pattern {value!r}: {e}") from e
    return q


def line_of(df: DataFrame) -> Column:
    """The first of message and template that isn't empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("message", "template") if c in df.columns], F.lit(""))


def _line_filter(line: Column, op: str, value: str) -> Column:
    if op in ("|=", "!="):
        hit = F.contains(line, F.lit(value))
    else:
        hit = line.rlike(value)
    return hit if op[0] == "|" else ~hit


def select(logs: DataFrame, query: str | LogQuery, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Rows that the query matches in [start, end). A matcher on a label that no column has is decided before any scan."""
    q = parse(query) if isinstance(query, str) else query
    if start_ns is not None:
        logs = logs.where(F.col(INGEST_NS) >= start_ns)
    if end_ns is not None:
        logs = logs.where(F.col(INGEST_NS) < end_ns)
    for label, op, value in q.matchers:
        if label in logs.columns:
            logs = logs.where(matches(F.col(label).cast("string"), op, value))
        else:
            fixed = JOB if label == "job" else ""
            hit = {"=": fixed == value, "!=": fixed != value}.get(op)
            if hit is None:
                hit = bool(re.fullmatch(value, fixed, re.S)) == (op == "=~")
            if not hit:
                return logs.limit(0)
    for op, value in q.filters:
        logs = logs.where(_line_filter(line_of(logs), op, value))
    return logs


def stream_labels(df: DataFrame) -> Column:
    """Label text of a row's stream: text columns with a value, and job."""
    names = [c for c, t in df.dtypes if t == "string" and c not in _NOT_LABELS and c != "template"] + [c for c in ("template",) if c in df.columns]
    pairs = [F.struct(F.lit("job").alias("key"), F.lit(JOB).alias("value"))]
    pairs += [F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in names]
    return render_labels(F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"] != "")))


def all_rows(logs: DataFrame, query: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """(stream, ts_ns, line) of all rows of a range in no order, for aggregates; streams() is for query_rows."""
    df = select(logs, query, start_ns, end_ns)
    return df.select(stream_labels(df).alias("stream"), F.col(INGEST_NS).alias("ts_ns"), line_of(df).alias("line"))


def query_rows(logs: DataFrame, query: str, start_ns: int | None = None, end_ns: int | None = None, newest_first: bool = True, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(stream, ts_ns, line): the newest or oldest rows; ties are ordered by stream and line. The limit is part of the query."""
    if not 0 < limit <= MAX_LIMIT:
        raise LogQLError(f"the limit must be within 1 and {MAX_LIMIT}")
    t = F.col("ts_ns")
    return all_rows(logs, query, start_ns, end_ns).orderBy(t.desc() if newest_first else t.asc(), "stream", "line").limit(limit)


def streams(rows: DataFrame) -> DataFrame:
    """query_rows as streams with their entries in time order; the rows are at most a query's limit."""
    return rows.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("ts_ns", "line"))).alias("entries")).orderBy("stream")


def label_names(logs: DataFrame, query: str = "", start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Columns with any value that isn't empty, and job: one aggregate over the columns."""
    df = select(logs, query, start_ns, end_ns)
    names = [c for c in df.columns if c not in ("message", INGEST_NS)]
    counts = df.agg(*[F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in names], F.struct(F.lit("job").alias("label"), F.lit(1).cast("long").alias("n")))
    return counts.select(F.explode(pairs).alias("p")).where("p.n > 0").select("p.label").orderBy("label")


def label_values(logs: DataFrame, label: str, query: str = "", start_ns: int | None = None, end_ns: int | None = None, limit: int | None = None) -> DataFrame:
    df = select(logs, query, start_ns, end_ns)
    if label == "job" and label not in df.columns:
        out = df.limit(1).select(F.lit(JOB).alias("label_value"))
    elif label not in df.columns:
        out = df.limit(0).select(F.lit("").alias("label_value"))
    else:
        out = df.select(F.nullif(F.col(label).cast("string"), F.lit("")).alias("label_value")).where("label_value is not null").distinct().orderBy("label_value")
    return out.limit(limit) if limit else out
