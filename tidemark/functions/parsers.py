"""Parsers of log lines and expositions, as columns of Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import merge_labels, parse_labels, render_labels, set_label

# Keys that hold a record's own time, and those that hold its text, in this order.
TIME_KEYS = ["timestamp", "time", "ts", "@timestamp", "date", "datetime", "eventtime", "rt"]
MESSAGE_KEYS = ["message", "msg", "log", "body"]

_MAP = "map<string,string>"


def _pairs(*kv: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is not null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in kv])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _group(line: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(line, pattern, i)


def fill_absent(row: Column, other: Column) -> Column:
    """row, and those entries of other whose key it lacks."""
    return F.map_concat(row, F.map_filter(other, lambda k, v: ~F.map_contains_key(row, k) & v.isNotNull()))


def drop_times(row: Column) -> Column:
    return F.map_filter(row, lambda k, _: ~F.lower(k).isin(TIME_KEYS))


# --- single formats -----------------------------------------------------------


def _members(line: Column) -> Column:
    """A JSON object's members, from one parse of the line; null for anything else."""
    v = F.when(F.ltrim(line).startswith("{"), F.try_parse_json(line))
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_text(v: Column) -> Column:
    """A member as text: a string without quotes, anything else as JSON; null stays null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(~F.is_variant_null(v), F.to_json(v))


def parse_json(line: Column) -> Column:
    """A JSON object's members as text; nested values as JSON; null for anything else."""
    return F.transform_values(_members(line), lambda _, v: _as_text(v))


_LOGFMT = r'([^\s="]+)(?:=(?:"((?:[^"\\]|\\.)*)(?:"|$)|(\S*)))?'


def parse_logfmt(line: Column) -> Column:
    """key=value pairs: quoted values may hold backslash escapes; a bare key is true; an open quote takes the rest. The last of equal keys wins."""
    tokens = F.regexp_extract_all(line, F.lit(f"({_LOGFMT})"), F.lit(1))

    def value(t: Column) -> Column:
        quoted = F.regexp_extract(t, r'(?s)^[^="]+="(.*?)"?$', 1)
        mark = "\u0001"
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\\\\", mark), r"\\n", "\n"), r"\\t", "\t")
        plain = F.regexp_replace(F.regexp_replace(plain, r"\\(.)", "$1"), mark, r"\\")
        return F.when(~F.contains(t, F.lit("=")), "true").when(t.rlike('^[^="]+="'), plain).otherwise(F.regexp_extract(t, r"(?s)^[^=]+=(.*)$", 1))

    key = lambda t: F.regexp_extract(t, r'^([^\s="]+)', 1)
    entries = F.transform(tokens, lambda t: F.struct(key(t).alias("key"), value(t).alias("value")))
    merged = F.aggregate(entries, F.expr(f"cast(map() as {_MAP})"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
    return F.when(line.isNotNull(), merged)


def parse_regex(line: Column, pattern: str, strict: bool = True) -> Column:
    """The named groups of a pattern. A line that it doesn't match raises; if not strict, it gives null. (?P<n>..) is spelt (?<n>..) for Java."""
    names = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", pattern)
    if not names:
        raise ValueError("the pattern needs a named group")
    order = {n: i for n, i in re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", pattern)).groupindex.items()}
    java = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
    groups = F.when(line.rlike(java), _pairs(*[(n, _group(line, java, order[n])) for n in names]))
    return groups.when(line.isNotNull(), F.raise_error(F.concat(F.lit("the pattern doesn't match: "), line)).cast(_MAP)) if strict else groups


_EXPOSITION = r'^\s*([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(?:\{((?:[^"}]|"(?:[^"\\]|\\.)*")*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$'


def parse_exposition(df: DataFrame, column: str = "value", strict: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(__name__, labels, value, timestamp_ms) of exposition text; comments and blank lines are left out, a malformed line raises (or, if not strict, is left out). Columns in keep stay beside them."""
    line = F.col(column)
    df = df.where(~line.rlike(r"^\s*(#.*)?$"))
    number = _group(line, _EXPOSITION, 3)
    value = F.when(F.lower(number).isin("+inf", "inf"), float("inf")).when(F.lower(number) == "-inf", float("-inf")).when(F.lower(number) == "nan", float("nan")).otherwise(number.try_cast("double"))
    good = line.rlike(_EXPOSITION) & value.isNotNull()
    if not strict:
        df = df.where(good)
    checked = F.when(good, value).otherwise(F.raise_error(F.concat(F.lit("malformed sample: "), line)).cast("double"))
    stamp = F.coalesce(F.nullif(_group(line, _EXPOSITION, 4), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return df.select(_group(line, _EXPOSITION, 1).alias("__name__"), F.btrim(_group(line, _EXPOSITION, 2)).alias("labels"), checked.alias("value"), stamp.alias("timestamp_ms"), *(keep or []))


def parse_scrape(df: DataFrame, strict: bool = False) -> DataFrame:
    """Scraped lines (value, instance, labels, scraped_ms) as metrics: labels of the target join those of each sample, which win; a sample without a time has that of its round."""
    own = F.struct(F.col("value").alias("value"), F.col("instance").alias("instance"), F.col("labels").alias("labels"), F.col("scraped_ms").alias("scraped_ms"))
    parsed = parse_exposition(df.select(F.col("value"), own.alias("target")), "value", strict, ["target"])
    base = set_label(parse_labels(F.col("target.labels")), "instance", F.col("target.instance"))
    merged = render_labels(merge_labels(base, parse_labels(F.col("labels"))))
    at = F.when(F.col("timestamp_ms") == 0, F.col("target.scraped_ms")).otherwise(F.col("timestamp_ms"))
    return parsed.select("__name__", merged.alias("labels"), "value", at.alias("timestamp_ms"))


# --- log formats ----------------------------------------------------------------

_K8S = r"(?s)^\S+ (stdout|stderr) ([FP]) (.*)$"
_CLF = r'^(\S+) (\S+) (\S+) \[([^\]]*)\] "([^"]*)" (\d{3}) (\S+)'
_SYSLOG5424 = r"(?s)^<(\d{1,3})>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) ?(.*)$"
_SYSLOG3164 = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) (.*)$"
_CEF_KEY = r"(?:^|\s)([A-Za-z0-9_.\[\]]+)="


def parse_k8s(line: Column) -> Column:
    return F.when(line.rlike(_K8S), _pairs(("stream", _group(line, _K8S, 1)), ("logtag", _group(line, _K8S, 2)), ("message", _group(line, _K8S, 3))))


def parse_json_log(line: Column) -> Column:
    """JSON members without times; message is the first string among the message keys, else the line."""
    def read(m: Column) -> Column:
        string = lambda k: F.when(F.schema_of_variant(m[k]) == "STRING", F.try_variant_get(m[k], "$", "string"))
        found = F.coalesce(*[string(k) for k in MESSAGE_KEYS], line)
        others = F.map_filter(F.transform_values(drop_times(m), lambda _, v: _as_text(v)), lambda k, v: (k != "message") & v.isNotNull())
        return F.map_concat(others, _pairs(("message", found)))

    # The members are bound to a name, so that all uses share one parse.
    return F.get(F.transform(F.array(_members(line)), lambda m: F.when(m.isNotNull(), read(m))), F.lit(0))


def parse_syslog(line: Column) -> Column:
    """RFC 5424 and RFC 3164; facility is the priority div 8, severity the rest; fields that are - are left out."""
    field = lambda i: F.nullif(_group(line, _SYSLOG5424, i), F.lit("-"))
    pri = _group(line, r"^<(\d{1,3})>", 1).try_cast("int")
    body = F.regexp_replace(_group(line, _SYSLOG5424, 8), r"(?s)^(?:-|(?:\[(?:[^\]\\]|\\.)*\])+) ?", "")
    new = _pairs(("facility", F.floor(pri / 8)), ("severity", pri % 8), ("host", field(4)), ("app", field(5)), ("procid", field(6)), ("msgid", field(7)), ("message", body))
    rest = _group(line, _SYSLOG3164, 4)
    tag = F.nullif(_group(rest, r"(?s)^([^\s\[:]+)(?:\[[^\]]*\])?: ", 1), F.lit(""))
    pid = F.nullif(_group(rest, r"(?s)^[^\s\[:]+\[([^\]]*)\]: ", 1), F.lit(""))
    message = F.when(tag.isNotNull(), F.regexp_replace(rest, r"(?s)^[^\s\[:]+(?:\[[^\]]*\])?: ", "")).otherwise(rest)
    old = _pairs(("facility", F.floor(pri / 8)), ("severity", pri % 8), ("host", _group(line, _SYSLOG3164, 3)), ("app", tag), ("procid", pid), ("message", message))
    return F.when(pri <= 191, F.when(line.rlike(_SYSLOG5424), new).when(line.rlike(_SYSLOG3164), old))


def parse_clf(line: Column) -> Column:
    g = lambda i: _group(line, _CLF, i)
    parts = F.split(g(5), " ")
    whole = F.size(parts) == 3
    part = lambda i: F.when(whole, F.get(parts, F.lit(i)))
    row = _pairs(("host", g(1)), ("ident", F.nullif(g(2), F.lit("-"))), ("authuser", F.nullif(g(3), F.lit("-"))), ("status", g(6)), ("size", F.nullif(g(7), F.lit("-"))), ("message", g(5)), ("method", part(0)), ("path", part(1)), ("protocol", part(2)))
    return F.when(line.rlike(_CLF), row)


def parse_cef(line: Column) -> Column:
    """Seven header fields and key=value extensions, whose values go on to the next key."""
    parts = F.split(line, r"(?<!\\)\|", 8)
    # Names of the header fields, in their order.
    names = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "message", "severity"]
    head = [(n, F.get(parts, F.lit(i))) for i, n in enumerate(names)]
    head[0] = (names[0], F.regexp_replace(head[0][1], "^CEF:", ""))
    ext = F.get(parts, F.lit(7))
    marked = F.regexp_replace(ext, _CEF_KEY, "\u0001$1=")
    fields = F.filter(F.split(marked, "\u0001"), lambda f: F.contains(f, F.lit("=")))
    own = F.transform(fields, lambda f: F.struct(F.regexp_extract(f, r"^([^=]+)=", 1).alias("key"), F.rtrim(F.regexp_extract(f, r"(?s)^[^=]+=(.*)$", 1)).alias("value")))
    merged = F.aggregate(own, F.expr(f"cast(map() as {_MAP})"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
    return F.when(line.startswith("CEF:") & (F.size(parts) == 8), fill_absent(_pairs(*head), drop_times(merged)))


FORMATS = {"json": parse_json_log, "cef": parse_cef, "syslog": parse_syslog, "k8s": parse_k8s, "clf": parse_clf}


def parse_log(line: Column, kind: str = "auto") -> Column:
    """A line's fields with `format`. auto tries the format its first characters tell, then k8s, then CLF; a line that none takes is a message of format none."""
    plain = _pairs(("format", F.lit("none")), ("message", line))
    tagged = lambda f: F.transform_values(FORMATS[f](line), lambda _, v: v)
    with_format = lambda f: F.map_concat(F.map_filter(tagged(f), lambda k, _: k != "format"), _pairs(("format", F.lit(f))))
    if kind == "none":
        return plain
    if kind != "auto":
        return F.coalesce(with_format(kind), plain)
    head = F.ltrim(line)
    first = F.when(head.startswith("{"), with_format("json")).when(line.startswith("CEF:"), with_format("cef")).when(line.startswith("<"), with_format("syslog"))
    return F.coalesce(first, with_format("k8s"), with_format("clf"), plain)


def k8s_path_labels(path: Column) -> Column:
    """namespace, pod and container of a kubelet log path: /pods/ns_pod_uid/container/n.log or /containers/pod_ns_container-<64 hex>.log."""
    pods = r"/pods/([^/_]+)_([^/_]+)_[^/]+/([^/]+)/[^/]+$"
    flat = r"/containers/([^/_]+)_([^/_]+)_(.+)-[0-9a-f]{64}\.log$"
    g = lambda p, i: F.regexp_extract(path, p, i)
    return F.when(path.rlike(pods), _pairs(("namespace", g(pods, 1)), ("pod", g(pods, 2)), ("container", g(pods, 3)))).when(path.rlike(flat), _pairs(("namespace", g(flat, 2)), ("pod", g(flat, 1)), ("container", g(flat, 3)))).otherwise(F.expr(f"cast(map() as {_MAP})"))


# --- maps to typed columns -----------------------------------------------------------


def infer(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """The sorted union of a map column's keys as typed columns beside the columns in keep.

    One aggregate counts, for each key, the values that are integers, numbers and booleans:
    long, then double (an integral double counts as an integer), then boolean, else string.
    """
    v = F.col("value")
    number = v.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < F.lit(float(2**63))) & ~F.isnan(number)
    stats = df.select(F.explode(column)).where("value is not null").groupBy("key").agg(F.count("value").alias("n"), F.count_if(whole).alias("i"), F.count_if(number.isNotNull()).alias("d"), F.count_if(F.lower(v).isin("true", "false")).alias("b")).orderBy("key")
    kinds = {r.key: "long" if r.i == r.n else "double" if r.d == r.n else "boolean" if r.b == r.n else "string" for r in stats.collect()}  # one row for each column of the result

    def typed(key: str, kind: str) -> Column:
        c = F.col(column)[key]
        return (c.cast("double").cast("long") if kind == "long" else c.cast(kind)).alias(key)

    return df.select(*[F.col(c) for c in keep or []], *[typed(k, t) for k, t in sorted(kinds.items())])
