"""Registered queries over the driver's tables, each with its DuckDB oracle.

events are metrics (type = name, user = label), documents and conversations are log artifacts.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parsers
from .functions.labels import parse_labels
from .model import INGEST_NS, logs_of_documents, metrics_of_events, table
from .operators import alerts, joins, lifecycle, logs, metrics
from .operators.union import union_by_name
from .plans import logql, promql, sqlapi
from .sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: First midnight and last second of events in milliseconds; steps of PromQL queries are hours.
T0, HOUR = 1704067200000, 3_600_000
T1 = T0 + 29 * 24 * HOUR

_METRICS = """metrics AS (SELECT event_type AS name, 'user_id="' || user_id || '"' AS labels, CAST(user_id AS VARCHAR) AS user_id, value, epoch_us(ts) // 1000 AS t, ts FROM events)"""
_LOGS = f"""logs AS (SELECT text AS message, lang AS format, source, 1704067200000000000 + doc_id * 1000000 AS {INGEST_NS} FROM documents)"""


def _register(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics_of_events(table(spark, d, "events"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return logs_of_documents(table(spark, d, "documents"))


# --- rollups and ranges --------------------------------------------------------


def _rollup_sql(width: str) -> str:
    return f"""WITH {_METRICS} SELECT strftime(time_bucket(INTERVAL '{width}', ts), '%Y-%m-%d %H:%M:%S') AS bucket, name AS metric, round(avg(value), 9) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n, round(sum(value), 4) AS sum_value FROM metrics GROUP BY 1, 2"""


def _rolled(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), F.col("__name__").alias("metric"), F.round("avg", 9).alias("avg_value"), F.col("min").alias("min_value"), F.col("max").alias("max_value"), F.col("count").alias("n"), F.round("sum", 4).alias("sum_value"))


@_register(_rollup_sql("1 minute"))
def rollup_1m(spark, d):
    return _rolled(metrics.rollup(_metrics(spark, d), 60))


@_register(_rollup_sql("5 minutes"))
def rollup_5m(spark, d):
    return _rolled(metrics.rollup(_metrics(spark, d), 300))


@_register(_rollup_sql("1 hour"))
def rollup_1h(spark, d):
    return _rolled(metrics.rollup(_metrics(spark, d), 3600))


@_register(_rollup_sql("7 hours"))
def rollup_7h_origin(spark, d):
    return _rolled(metrics.rollup(_metrics(spark, d), 7 * 3600))


@_register(_rollup_sql("1 day"))
def rollup_reroll_1d(spark, d):
    return _rolled(metrics.reroll(metrics.rollup(_metrics(spark, d), 3600), 86400))


@_register(f"""WITH {_METRICS} SELECT name AS metric, labels, value, t AS timestamp_ms FROM metrics WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05 12:00:00'""")
def range_query(spark, d):
    return metrics.range_query(_metrics(spark, d), "2024-01-03", "2024-01-05 12:00:00").select(F.col("__name__").alias("metric"), "labels", "value", "timestamp_ms")


@_register(f"""WITH {_METRICS}, r AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, name, avg(value) AS v FROM metrics GROUP BY 1, 2) SELECT count(*) AS row_count, round(coalesce(sum(v), 0), 4) AS value_sum FROM (SELECT value AS v FROM metrics WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-12' UNION ALL SELECT v FROM r WHERE b >= TIMESTAMP '2024-01-03' AND b < TIMESTAMP '2024-01-12')""")
def range_with_rollup_totals(spark, d):
    m = _metrics(spark, d)
    assert metrics.pick_step(0, 9 * 86400) == "1h"
    out = metrics.count_and_sum(metrics.range_query(m, "2024-01-03", "2024-01-12", metrics.rollup(m, 3600)))
    return out.select("row_count", F.round("value_sum", 4).alias("value_sum"))


@_register(f"""WITH {_METRICS} SELECT count(*) AS row_count, round(coalesce(sum(value), 0), 4) AS value_sum FROM metrics""")
def metrics_count_sum(spark, d):
    return metrics.count_and_sum(_metrics(spark, d)).select("row_count", F.round("value_sum", 4).alias("value_sum"))


@_register(f"""WITH {_METRICS} SELECT name AS metric, round(avg(value), 9) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM metrics GROUP BY name""")
def metrics_by_name(spark, d):
    return metrics.by_name(_metrics(spark, d)).select(F.col("__name__").alias("metric"), F.round("avg", 9).alias("avg_value"), F.col("min").alias("min_value"), F.col("max").alias("max_value"), F.col("count").alias("n"))


@_register(f"""WITH {_METRICS} SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_ts FROM metrics""")
def metrics_bounds(spark, d):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return metrics.bounds(_metrics(spark, d)).select(f("min_ts"), f("max_ts"))


@_register(f"""WITH {_METRICS} SELECT name AS metric, labels, value, t AS timestamp_ms FROM metrics ORDER BY ts, name, labels LIMIT 50""")
def metrics_oldest_50(spark, d):
    return _metrics(spark, d).orderBy("ts", "__name__", "labels").limit(50).select(F.col("__name__").alias("metric"), "labels", "value", "timestamp_ms")


# --- summaries and templates -------------------------------------------------------


@_register("""SELECT event_type, CAST(count(*) AS BIGINT) AS "count", round(sum(value), 4) AS sum_value, round(avg(value), 9) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY event_type""")
def summary_basic(spark, d):
    out = logs.summary(table(spark, d, "events"), ["event_type"], ["count", "sum:value", "avg:value", "min:value", "max:value"])
    return out.withColumn("sum_value", F.round("sum_value", 4)).withColumn("avg_value", F.round("avg_value", 9))


@_register("""SELECT event_type, quantile_disc(value, 0) AS p0_value, quantile_disc(value, 0.5) AS p50_value, quantile_disc(value, 0.95) AS p95_value, quantile_disc(value, 0.99) AS p99_value FROM events GROUP BY event_type""")
def summary_percentiles(spark, d):
    return logs.summary(table(spark, d, "events"), ["event_type"], ["p0:value", "p50:value", "p95:value", "p99:value"])


@_register("""SELECT CAST(count(*) AS BIGINT) AS "count", round(sum(value), 4) AS sum_value, quantile_disc(value, 0.9) AS p90_value FROM events""")
def summary_global(spark, d):
    return logs.summary(table(spark, d, "events"), [], ["count", "sum:value", "p90:value"]).withColumn("sum_value", F.round("sum_value", 4))


_TEMPLATE = r"""array_to_string(list_transform(list_filter(string_split_regex(coalesce({c}, ''), '\s+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[=0-9]') THEN '<*>' ELSE x END), ' ')"""


@_register(f"""SELECT event_id, {_TEMPLATE.format(c="'user ' || user_id || ' did ' || event_type || '  value=' || event_id || ' ok'")} AS template FROM events""")
def template_mine(spark, d):
    line = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"), F.lit("  value="), F.col("event_id").cast("string"), F.lit(" ok"))
    return logs.mine(table(spark, d, "events").select("event_id", line.alias("message"))).select("event_id", "template")


@_register(f"""SELECT {_TEMPLATE.format(c="role || ' said turn=' || turn || ' in ' || conv_id")} AS template, CAST(count(*) AS BIGINT) AS "count" FROM conversations GROUP BY 1""")
def template_counts(spark, d):
    line = F.concat(F.col("role"), F.lit(" said turn="), F.col("turn").cast("string"), F.lit(" in "), F.col("conv_id").cast("string"))
    return logs.template_counts(logs.mine(table(spark, d, "conversations").select(line.alias("message"))))


@_register(r"""WITH lines AS (SELECT event_type AS template, 1 AS c FROM events UNION ALL SELECT event_type, 10 FROM events WHERE user_id < 50) SELECT template, CAST(sum(c) AS BIGINT) AS "count" FROM lines GROUP BY template ORDER BY "count" DESC, template LIMIT 3""")
def template_topk_mixed(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("event_type").alias("template"))
    summed = e.where("user_id < 50").select(F.col("event_type").alias("template"), F.lit(10).alias("count"))
    return logs.template_counts(union_by_name([raw, summed])).orderBy(F.col("count").desc(), "template").limit(3)


@_register(f"""SELECT lang AS format, CAST(NULL AS VARCHAR) AS role, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT CAST(NULL AS VARCHAR), role, count(*) FROM conversations GROUP BY role""")
def logs_union_by_name(spark, d):
    a = table(spark, d, "documents").select(F.col("text").alias("message"), F.col("lang").alias("format"))
    b = table(spark, d, "conversations").select(F.col("text").alias("message"), "role", "turn")
    return union_by_name([a, b]).groupBy("format", "role").agg(F.count(F.lit(1)).alias("n"))


@_register("""SELECT CAST(v AS VARCHAR) AS v, count(*) AS n FROM (SELECT CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT r_name FROM region) GROUP BY 1""")
def union_type_conflict(spark, d):
    return union_by_name([table(spark, d, "part").select(F.col("p_size").alias("v")), table(spark, d, "region").select(F.col("r_name").alias("v"))]).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


# --- parsers ---------------------------------------------------------------------------


@_register("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def parse_json_props(spark, d):
    row = table(spark, d, "events").select("event_id", parsers.parse_json(F.col("props")).alias("m"))
    return parsers.infer(row, "m", ["event_id"])


@_register("""SELECT event_id, event_type AS type, user_id AS "user", 'a b"c' AS msg, 'true' AS flag FROM events""")
def parse_logfmt(spark, d):
    line = F.concat(F.lit("type="), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(r' msg="a b\"c" flag'))
    m = F.col("m")
    return table(spark, d, "events").select("event_id", parsers.parse_logfmt(line).alias("m")).select("event_id", m["type"].alias("type"), m["user"].cast("long").alias("user"), m["msg"].alias("msg"), m["flag"].alias("flag"))


@_register("""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host FROM pages""")
def parse_regex_url(spark, d):
    m = F.col("m")
    return table(spark, d, "pages").select("page_id", parsers.parse_regex(F.col("url"), r"^(?P<scheme>https?)://(?P<host>[^/]+)").alias("m")).select("page_id", m["scheme"].alias("scheme"), m["host"].alias("host"))


@_register("""SELECT event_type AS metric, 'user_id="' || user_id || '",kind="a,b"' AS labels, value, epoch_us(ts) // 1000 AS timestamp_ms FROM events""")
def parse_exposition(spark, d):
    e = table(spark, d, "events")
    line = F.concat("event_type", F.lit('{user_id="'), F.col("user_id").cast("string"), F.lit('",kind="a,b"} '), F.col("value").cast("string"), F.lit(" "), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    lines = e.select(line.alias("value")).union(e.limit(1).select(F.lit("# HELP x")))
    return parsers.parse_exposition(lines).withColumnRenamed("__name__", "metric")


#: Lines made of the columns in braces.
_LINES = {
    "json": '{{"level":"info","msg":"{event_type}","user":{user_id},"ts":"x"}}',
    "syslog": "<34>1 2024-01-01T00:00:00Z host{user_id} app 12 ID1 - {event_type}",
    "clf": '10.0.0.{user_id} - bob [01/Jan/2024:00:00:00 +0000] "GET /{event_type} HTTP/1.1" 200 {event_id}',
}


def _parsed(spark, d, kind):
    parts = []
    for text, column, _, _ in Formatter().parse(_LINES[kind]):
        parts += [F.lit(text)] + ([F.col(column).cast("string")] if column else [])
    return table(spark, d, "events").select("event_id", parsers.parse_log(F.concat(*parts)).alias("m"))


@_register("""SELECT event_id, 'json' AS format, event_type AS message, user_id, 'info' AS level, CAST(NULL AS VARCHAR) AS ts_field FROM events""")
def parse_log_json(spark, d):
    m = F.col("m")
    return _parsed(spark, d, "json").select("event_id", m["format"].alias("format"), m["message"].alias("message"), m["user"].cast("long").alias("user_id"), m["level"].alias("level"), m["ts"].alias("ts_field"))


@_register("""SELECT event_id, 'syslog' AS format, event_type AS message, 4 AS facility, 2 AS severity, 'host' || user_id AS host, 'app' AS app FROM events""")
def parse_log_syslog(spark, d):
    m = F.col("m")
    return _parsed(spark, d, "syslog").select("event_id", m["format"].alias("format"), m["message"].alias("message"), m["facility"].cast("int").alias("facility"), m["severity"].cast("int").alias("severity"), m["host"].alias("host"), m["app"].alias("app"))


@_register("""SELECT event_id, 'clf' AS format, 'GET /' || event_type || ' HTTP/1.1' AS message, '10.0.0.' || user_id AS host, 200 AS status, event_id AS size, '/' || event_type AS path FROM events""")
def parse_log_clf(spark, d):
    m = F.col("m")
    return _parsed(spark, d, "clf").select("event_id", m["format"].alias("format"), m["message"].alias("message"), m["host"].alias("host"), m["status"].cast("int").alias("status"), m["size"].cast("long").alias("size"), m["path"].alias("path"))


# --- LogQL ---------------------------------------------------------------------------------


def _count(df: DataFrame) -> DataFrame:
    return df.groupBy("format", "source").agg(F.count(F.lit(1)).alias("n"))


def _logql_sql(where: str) -> str:
    return f"WITH {_LOGS} SELECT format, source, count(*) AS n FROM logs WHERE {where} GROUP BY 1, 2"


@_register(_logql_sql("format = 'en'"))
def logql_eq(spark, d):
    return _count(logql.select(_logs(spark, d), '{format="en"}'))


@_register(_logql_sql("format <> 'en'"))
def logql_neq(spark, d):
    return _count(logql.select(_logs(spark, d), '{format!="en"}'))


@_register(_logql_sql("regexp_full_match(source, 'src[0-3]') AND NOT regexp_full_match(format, 'd.')"))
def logql_regex(spark, d):
    return _count(logql.select(_logs(spark, d), '{source=~"src[0-3]", format!~"d."}'))


@_register(_logql_sql("contains(message, 'License') AND NOT contains(message, 'GNU')"))
def logql_line_contains(spark, d):
    return _count(logql.select(_logs(spark, d), '{job="tidemark"} |= "License" != "GNU"'))


@_register(_logql_sql("regexp_matches(message, '[0-9]{3}-[0-9]{4}') AND NOT regexp_matches(message, 'http')"))
def logql_line_regex(spark, d):
    return _count(logql.select(_logs(spark, d), '{} |~ "[0-9]{3}-[0-9]{4}" !~ "http"'))


@_register(f"""WITH {_LOGS} SELECT format, {INGEST_NS} AS ts_ns FROM logs WHERE {INGEST_NS} < 1704067200500000000 ORDER BY ts_ns DESC LIMIT 25""")
def logql_newest(spark, d):
    out = logql.query_rows(_logs(spark, d), "{}", end_ns=1704067200500000000, limit=25)
    return out.select(parse_labels(F.col("stream"))["format"].alias("format"), "ts_ns")


@_register(f"""WITH {_LOGS}, r AS (SELECT format, source, {INGEST_NS} AS ts FROM logs WHERE format = 'fr' ORDER BY ts LIMIT 100) SELECT 'format="' || format || '",job="tidemark",source="' || source || '"' AS stream, count(*) AS n, min(ts) AS first_ns FROM r GROUP BY 1""")
def logql_streams(spark, d):
    out = logql.streams(logql.query_rows(_logs(spark, d), '{format="fr"}', newest_first=False))
    return out.select("stream", F.size("entries").cast("long").alias("n"), F.col("entries")[0]["ts_ns"].alias("first_ns"))


@_register("SELECT unnest(['format', 'job', 'source']) AS label")
def logql_label_names(spark, d):
    return logql.label_names(_logs(spark, d))


@_register(f"WITH {_LOGS} SELECT DISTINCT source AS label_value FROM logs WHERE format = 'de'")
def logql_label_values(spark, d):
    return logql.label_values(_logs(spark, d), "source", '{format="de"}')


@_register(f"WITH {_LOGS} SELECT count(*) AS n FROM logs WHERE false")
def logql_absent_label(spark, d):
    return logql.select(_logs(spark, d), '{nothere="x"}').agg(F.count(F.lit(1)).alias("n"))


# --- PromQL -----------------------------------------------------------------------------------


def _prom(spark, d, expr, step=HOUR, start=T0, end=T1, lookback=300_000, digits=6):
    out = promql.query_range(_metrics(spark, d), expr, start, end, step, lookback)
    return out.select("metric", "t", F.round("value", digits).alias("value"))


_GRID = f"grid AS (SELECT {T0} + k * {HOUR} AS s FROM range(0, {29 * 24 + 1}) r(k))"
_INSTANT = f"""{_METRICS}, {_GRID}, inst AS (SELECT name, user_id, s, arg_max(value, (t, value)) AS v FROM (SELECT DISTINCT name, user_id, t, value FROM metrics) m JOIN grid ON t > s - {{lookback}} AND t <= s GROUP BY name, user_id, s)"""


def _inst(lookback=300_000):
    return "WITH " + _INSTANT.replace("{lookback}", str(lookback))


@_register(_inst() + """ SELECT '__name__="' || name || '",user_id="' || user_id || '"' AS metric, s AS t, round(v, 6) AS value FROM inst WHERE name = 'click'""")
def prom_instant(spark, d):
    return _prom(spark, d, "click")


@_register(_inst(3_600_000) + """ SELECT '__name__="' || name || '"' AS metric, s AS t, round(sum(v), 6) AS value FROM inst GROUP BY name, s""")
def prom_sum_by(spark, d):
    return _prom(spark, d, 'sum by (__name__) ({__name__=~".+"})', lookback=HOUR)


@_register(_inst(3_600_000) + """ SELECT '' AS metric, s AS t, round(avg(v), 6) AS value FROM inst WHERE name <> 'click' GROUP BY s""")
def prom_avg_without(spark, d):
    return _prom(spark, d, 'avg without (user_id) ({__name__!="click",user_id!=""})', lookback=HOUR)


@_register(_inst(3_600_000) + """ SELECT '__name__="' || name || '",user_id="' || user_id || '"' AS metric, s AS t, round(v, 6) AS value FROM inst WHERE name = 'view' QUALIFY row_number() OVER (PARTITION BY s ORDER BY v DESC, metric) <= 3""")
def prom_topk(spark, d):
    return _prom(spark, d, "topk(3, view)", lookback=HOUR)


@_register(_inst(3_600_000) + """ SELECT '' AS metric, s AS t, round(quantile_cont(v, 0.9), 6) AS value FROM inst WHERE name = 'view' GROUP BY s""")
def prom_quantile(spark, d):
    return _prom(spark, d, "quantile(0.9, view)", lookback=HOUR)


_SERIES = f"""WITH {_METRICS}, {_GRID}, samples AS (SELECT name, user_id, t, max(value) AS v FROM metrics GROUP BY ALL), win AS (SELECT name, user_id, s, t, v, lag(v) OVER w AS pv, row_number() OVER w AS rn FROM samples JOIN grid ON t > s - {{range}} AND t <= s WINDOW w AS (PARTITION BY name, user_id, s ORDER BY t)) """


def _over(span, body):
    return _SERIES.replace("{range}", str(span)) + body


@_register(_over(6 * HOUR, """SELECT 'user_id="' || user_id || '"' AS metric, s AS t, round(max(v), 6) AS value FROM win WHERE name = 'click' GROUP BY user_id, s"""))
def prom_max_over_time(spark, d):
    return _prom(spark, d, "max_over_time(click[6h])")


@_register(_over(6 * HOUR, """SELECT 'user_id="' || user_id || '"' AS metric, s AS t, round(stddev_pop(v), 6) AS value FROM win WHERE name = 'click' GROUP BY user_id, s"""))
def prom_stddev_over_time(spark, d):
    return _prom(spark, d, "stddev_over_time(click[6h])")


@_register(_over(12 * HOUR, """SELECT 'user_id="' || user_id || '"' AS metric, s AS t, round(quantile_cont(v, 0.5), 6) AS value FROM win WHERE name = 'click' GROUP BY user_id, s"""))
def prom_quantile_over_time(spark, d):
    return _prom(spark, d, "quantile_over_time(0.5, click[12h])")


_RATE = """, agg AS (SELECT user_id, s, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0, arg_max(v, t) AS v1, sum(CASE WHEN pv > v THEN pv ELSE 0 END) AS resets FROM win WHERE name = 'purchase' GROUP BY user_id, s HAVING count(*) >= 2),
raw AS (SELECT *, v1 - v0 + {resets} AS r, (t1 - t0) / 1000.0 AS span, (t1 - t0) / 1000.0 / (n - 1) AS mean, (t0 - (s - {range})) / 1000.0 AS a0, (s - t1) / 1000.0 AS b0 FROM agg),
ext AS (SELECT *, CASE WHEN a0 >= mean * 1.1 THEN mean / 2 ELSE a0 END AS a1, CASE WHEN b0 >= mean * 1.1 THEN mean / 2 ELSE b0 END AS b FROM raw),
fin AS (SELECT *, {clamp} AS a FROM ext) SELECT 'user_id="' || user_id || '"' AS metric, s AS t, round(r * ((span + a + b) / span) {per}, {digits}) AS value FROM fin"""


def _rate_sql(span, counter, per):
    clamp = "CASE WHEN r > 0 AND v0 >= 0 THEN least(a1, span * (v0 / r)) ELSE a1 END" if counter else "a1"
    body = _RATE.replace("{resets}", "resets" if counter else "0").replace("{clamp}", clamp).replace("{per}", f"/ {span / 1000}" if per else "").replace("{range}", str(span)).replace("{digits}", "9" if per else "6")
    return _over(span, "").rstrip() + body


@_register(_rate_sql(24 * HOUR, True, True))
def prom_rate(spark, d):
    return _prom(spark, d, "rate(purchase[24h])", digits=9)


@_register(_rate_sql(24 * HOUR, True, False))
def prom_increase(spark, d):
    return _prom(spark, d, "increase(purchase[24h])")


@_register(_rate_sql(24 * HOUR, False, False))
def prom_delta(spark, d):
    return _prom(spark, d, "delta(purchase[24h])")


@_register(_over(24 * HOUR, """, two AS (SELECT user_id, s, max(rn) AS m FROM win WHERE name = 'purchase' GROUP BY ALL HAVING max(rn) >= 2), l AS (SELECT w.*, lag(w.t) OVER (PARTITION BY w.user_id, w.s ORDER BY w.t) AS pt FROM win w WHERE name = 'purchase') SELECT 'user_id="' || l.user_id || '"' AS metric, l.s AS t, round((CASE WHEN v < pv THEN v ELSE v - pv END) / ((l.t - pt) / 1000.0), 6) AS value FROM l JOIN two ON l.user_id = two.user_id AND l.s = two.s AND l.rn = two.m"""))
def prom_irate(spark, d):
    return _prom(spark, d, "irate(purchase[24h])")


@_register(_over(24 * HOUR, """SELECT 'user_id="' || user_id || '"' AS metric, s AS t, round(CAST(count(*) FILTER (WHERE pv IS NOT NULL AND v <> pv) AS DOUBLE), 6) AS value FROM win WHERE name = 'click' GROUP BY user_id, s"""))
def prom_changes(spark, d):
    return _prom(spark, d, "changes(click[24h])")


@_register(_inst(3_600_000) + """ SELECT 'user_id="' || a.user_id || '"' AS metric, a.s AS t, round(a.v / b.v, 6) AS value FROM inst a JOIN inst b USING (user_id, s) WHERE a.name = 'click' AND b.name = 'view'""")
def prom_binop_match(spark, d):
    return _prom(spark, d, "click / on(user_id) view", lookback=HOUR)


@_register(_inst(3_600_000) + """, tot AS (SELECT s, sum(v) AS v FROM inst WHERE name = 'click' GROUP BY s) SELECT 'user_id="' || user_id || '"' AS metric, i.s AS t, round(100 * i.v / tot.v, 6) AS value FROM inst i JOIN tot USING (s) WHERE name = 'click'""")
def prom_binop_group_left(spark, d):
    return _prom(spark, d, "100 * click / on() group_left sum(click)", lookback=HOUR)


@_register(_inst(3_600_000) + """ SELECT '__name__="click",user_id="' || user_id || '"' AS metric, s AS t, round(v, 6) AS value FROM inst WHERE name = 'click' AND v > 50 AND (user_id, s) NOT IN (SELECT (user_id, s) FROM inst WHERE name = 'view')""")
def prom_filter_unless(spark, d):
    return _prom(spark, d, "click > 50 unless on(user_id) view", lookback=HOUR)


@_register(_inst() + """ SELECT '' AS metric, s AS t, 1.0 AS value FROM grid WHERE s NOT IN (SELECT s FROM inst WHERE name = 'purchase')""")
def prom_absent(spark, d):
    return _prom(spark, d, "absent(purchase)")


@_register(_inst(3_600_000) + f""", cnt AS (SELECT s, count(*) AS c FROM inst WHERE name = 'click' GROUP BY s) SELECT '' AS metric, g.s AS t, round(CAST(max(c.c) AS DOUBLE), 6) AS value FROM grid g JOIN cnt c ON c.s > g.s - {6 * HOUR} AND c.s <= g.s GROUP BY g.s""")
def prom_subquery(spark, d):
    return promql_with_hourly(spark, d, "max_over_time(count(click)[6h:1h])")


def promql_with_hourly(spark, d, expr):
    # Inner steps before T0 have no samples, so the grid of the oracle starts with the outer one.
    return _prom(spark, d, expr, lookback=HOUR)


@_register(_inst(3_600_000).replace("t > s - 3600000 AND t <= s", "t > s - 7200000 AND t <= s - 3600000") + """ SELECT '' AS metric, s AS t, round(CAST(count(*) AS DOUBLE), 6) AS value FROM inst GROUP BY s""")
def prom_offset(spark, d):
    return _prom(spark, d, 'count({__name__=~".+"} offset 1h)', lookback=HOUR)


@_register(_inst(3_600_000) + """ SELECT 'kind="click-x",user_id="' || user_id || '"' AS metric, s AS t, round(v * 2, 6) AS value FROM inst WHERE name = 'click'""")
def prom_label_replace(spark, d):
    return _prom(spark, d, 'label_replace(click, "kind", "$1-x", "__name__", "(.*)") * 2', lookback=HOUR)


@_register(f"WITH {_METRICS} SELECT DISTINCT name AS metric, labels FROM metrics WHERE name IN ('click', 'view')")
def prom_series(spark, d):
    return promql.series(_metrics(spark, d), ["click", "view"], T0, T1 + 86_400_000).withColumnRenamed("__name__", "metric")


@_register("SELECT unnest(['__name__', 'user_id']) AS label")
def prom_labels(spark, d):
    return promql.label_names(_metrics(spark, d), [], T0, T1)


@_register(f"WITH {_METRICS} SELECT DISTINCT user_id AS label_value FROM metrics WHERE name = 'click' AND t >= {T0} AND t <= {T1}")
def prom_label_values(spark, d):
    return promql.label_values(_metrics(spark, d), "user_id", ["click"], T0, T1)


_BUCKETS = """WITH b AS (SELECT event_type AS name, le, CAST(count(*) FILTER (WHERE value <= le) AS DOUBLE) AS v FROM events, (SELECT unnest([1.0, 10.0, 25.0, 50.0, 100.0, CAST('Infinity' AS DOUBLE)]) AS le) GROUP BY 1, 2),
o AS (SELECT *, max(v) OVER (PARTITION BY name) AS total, lag(v, 1, 0.0) OVER w AS pv, lag(le, 1, 0.0) OVER w AS ple, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY name ORDER BY le)),
f AS (SELECT * FROM o WHERE v >= 0.9 * total QUALIFY i = min(i) OVER (PARTITION BY name))
SELECT 'type="' || name || '"' AS metric, round(CASE WHEN isinf(le) THEN ple ELSE ple + (le - ple) * (0.9 * total - pv) / (v - pv) END, 6) AS value FROM f"""


@_register(_BUCKETS)
def prom_histogram_quantile(spark, d):
    bounds = ((1.0, "1"), (10.0, "10"), (25.0, "25"), (50.0, "50"), (100.0, "100"), (float("inf"), "+Inf"))
    # One row an event type, so buckets are made of counts and not of events.
    counts = table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= x).cast("double").alias(f"n{i}") for i, (x, _) in enumerate(bounds)])
    b = counts.select("event_type", F.explode(F.array(*[F.struct(F.lit(t).alias("txt"), F.col(f"n{i}").alias("value")) for i, (_, t) in enumerate(bounds)])).alias("b")).select("event_type", "b.*")
    m = b.select(F.lit("hist_bucket").alias("__name__"), F.concat(F.lit('type="'), "event_type", F.lit('",le="'), "txt", F.lit('"')).alias("labels"), "value", F.lit(0).cast("long").alias("timestamp_ms"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    return promql.query_instant(m, "histogram_quantile(0.9, hist_bucket)", T0).select("metric", F.round("value", 6).alias("value"))


# --- alerts ------------------------------------------------------------------------------------


_ALERTS = _inst(HOUR) + f""", c AS (SELECT s, count(*) AS v FROM inst WHERE name = 'click' GROUP BY s HAVING count(*) > 4), isl AS (SELECT s, v, s - {HOUR} * row_number() OVER (ORDER BY s) AS g FROM c), runs AS (SELECT g, min(s) AS a, max(s) AS b FROM isl GROUP BY g),
states AS (SELECT s AS t, a AS active_at, CASE WHEN s - a >= {2 * HOUR} THEN 'firing' ELSE 'pending' END AS state, v FROM isl JOIN runs USING (g) UNION ALL SELECT b + {HOUR}, a, 'resolved', NULL FROM runs WHERE b - a >= {2 * HOUR} AND b + {HOUR} <= {T1})"""


def _alerts(spark, d):
    rules = alerts.load_rules({"groups": [{"rules": [{"record": "x", "expr": "y"}, {"alert": "Busy", "expr": "count(click) > 4", "for": "2h", "labels": {"severity": "page"}, "annotations": {"text": "{{ $value }} users, {{ $labels.severity }}"}}]}]})
    return alerts.evaluate(_metrics(spark, d), rules[0], T0, T1, HOUR, HOUR)


@_register(_ALERTS + """ SELECT 'alertname="Busy",severity="page"' AS labels, t, active_at, state, CAST(v AS DOUBLE) AS value, 'text="' || coalesce(CAST(v AS VARCHAR), '') || ' users, page"' AS annotations FROM states""")
def alert_states(spark, d):
    return _alerts(spark, d)


@_register(_ALERTS + f""", nth AS (SELECT *, row_number() OVER (PARTITION BY active_at, state ORDER BY t) - 1 AS n FROM states WHERE state <> 'pending') SELECT t, active_at, state FROM nth WHERE n % 3 = 0""")
def alert_resends(spark, d):
    return alerts.resends(_alerts(spark, d), 2 * HOUR).select("t", "active_at", "state")


@_register(_ALERTS + """, sent AS (SELECT t + 30000 + CAST(ceil(greatest(0, 0) / 300000) AS BIGINT) AS x, t, state FROM states WHERE state <> 'pending'), f AS (SELECT 'severity="page"' AS group_key, min(t) OVER () AS first, t, state FROM sent), due AS (SELECT group_key, CAST(first + 30000 + ceil(greatest(t - first - 30000, 0) / 300000) * 300000 AS BIGINT) AS flush, state FROM f) SELECT DISTINCT group_key, flush, state FROM due""")
def alert_groups(spark, d):
    out = alerts.group(_alerts(spark, d), ["severity"], repeat_ms=1)  # each flush is due
    return out.select("group_key", "flush", F.explode("alerts").alias("a")).select("group_key", "flush", "a.state").distinct()


# --- lifecycle and sinks ---------------------------------------------------------------------


@_register(f"""SELECT page_id % 7 AS file, count(*) AS n, 1704067200000000000 + (page_id % 7) * 60000000000 AS ingest_ns FROM pages GROUP BY 1, 3""")
def ingest_stamp_join(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id") % 7).alias("path"), "page_id")
    stamps = spark.createDataFrame([(f"f{i}", 1704067200000000000 + i * 60_000_000_000) for i in range(7)], "path string, ingest_ns long")
    out = joins.stamp_by_file(pages, stamps)
    return out.groupBy(F.substring("path", 2, 9).cast("long").alias("file"), "ingest_ns").agg(F.count(F.lit(1)).alias("n"))


@_register("""WITH seg AS (SELECT user_id % 20 AS id, min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM events WHERE user_id % 20 < 12 OR ts < TIMESTAMP '2024-01-10' GROUP BY 1) SELECT id, hi < 1706572800000 - 15 * 86400000 AS expired FROM seg""")
def retention(spark, d):
    from .sources.catalog import Segment

    t = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").where((F.col("user_id") % 20 < 12) | (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))).groupBy((F.col("user_id") % 20).alias("id")).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).collect()  # one row a segment
    segs = {Segment(0, str(r.id), 1, r.lo, r.hi): r.id for r in rows}
    gone = set(lifecycle.expired(list(segs), 1706572800000))
    return spark.createDataFrame([(i, s in gone) for s, i in segs.items()], "id long, expired boolean")


@_register("""SELECT lang, count(DISTINCT w) AS n_tokens FROM (SELECT lang, unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS w FROM documents) GROUP BY lang""")
def token_index_words(spark, d):
    df = table(spark, d, "documents").select("lang", F.explode(sinks.word_tokens(F.col("text"))).alias("w"))
    return df.groupBy("lang").agg(F.count_distinct("w").alias("n_tokens"))


@_register("""SELECT source AS file FROM documents GROUP BY source HAVING bool_or(contains(lower(text), 'license'))""")
def token_index_skip(spark, d):
    df = table(spark, d, "documents")
    may = sinks.files_with(sinks.token_index(df, "text", F.col("source")), "license")
    return df.where(F.contains(F.lower("text"), F.lit("license"))).join(may, df.source.eqNullSafe(may.file), "left_semi").select(F.col("source").alias("file")).distinct()


@_register("""SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","x":null}' AS "value" FROM events""")
def encode_json(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "event_type", F.lit(float("nan")).alias("x"))
    return sinks.json_rows(df).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "value")


# --- joins that Spark lacks ------------------------------------------------------------------


@_register("""SELECT a.event_id, b.value AS price FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'click'""")
def join_as_of(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("price"))
    return joins.as_of(left, right, ["user_id"], "ts", "at", ["price"]).select("event_id", "price")


@_register("""SELECT c_custkey, count(*) AS n FROM customer JOIN (SELECT p_partkey, p_retailprice AS lo, p_retailprice + 5 AS hi FROM part WHERE p_size = 7) ON c_acctbal >= lo AND c_acctbal < hi GROUP BY 1""")
def join_range(spark, d):
    r = table(spark, d, "part").where("p_size = 7").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    return joins.within(table(spark, d, "customer").select("c_custkey", "c_acctbal"), r, "c_acctbal", "lo", "hi", 10.0).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@_register("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e) SELECT user_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM s GROUP BY user_id, sid""")
def session_events(spark, d):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return joins.sessions(table(spark, d, "events"), ["user_id"], "ts", "2 hours").select("user_id", "n", ms("first").alias("first_ms"), ms("last").alias("last_ms"))


@_register("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM events) GROUP BY 1, 2""")
def sliding_events(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


# --- SQL pass-through: the same text for both engines, but for the dialect shim ---------------

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages"]
SQL = {
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_join_inner": "SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_join_star": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey GROUP BY n_name",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_join_full": "SELECT coalesce(c_nationkey, s_nationkey) AS k, count(c_custkey) AS c, count(s_suppkey) AS s FROM (SELECT * FROM customer WHERE c_nationkey < 15) FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey > 10) ON c_nationkey = s_nationkey GROUP BY 1",
    "sql_join_semi": "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "sql_join_anti": "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_theta": "SELECT a.n_name AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY 1",
    "sql_lateral": "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x",
    "sql_subquery_scalar": "SELECT count(*) AS n FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "sql_subquery_in": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "sql_subquery_correlated": "SELECT count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)",
    "sql_cte": "WITH big AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1), top AS (SELECT * FROM big WHERE t > 500000) SELECT count(*) AS n, round(sum(t), 2) AS total FROM top",
    "sql_window_rank": "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS dr, ntile(4) OVER (ORDER BY c_custkey) AS q FROM customer",
    "sql_window_lag": "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events",
    "sql_window_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n1d FROM events",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_rollup": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_agg_distinct": "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS d, count(*) FILTER (WHERE c_acctbal > 0) AS pos, round(stddev_samp(c_acctbal), 4) AS sd, round(corr(c_acctbal, c_custkey), 6) AS r FROM customer GROUP BY c_mktsegment",
    "sql_setop_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_setop_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_setop_except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_case_string": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS size_class, upper(substr(p_brand, 1, 5)) AS b, count(*) AS n, max(length(p_name)) AS m FROM part GROUP BY 1, 2",
    "sql_dates": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "sql_group_all": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "sql_having": "SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 200",
    # Spellings that the shim translates.
    "sql_shim_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "sql_shim_exclude": "SELECT * EXCLUDE (n_name) FROM nation",
    "sql_shim_buckets": "SELECT epoch_ms(time_bucket(INTERVAL '5 minutes', ts)) AS b, count(*) AS n FROM events GROUP BY 1",
    "sql_shim_regex": "SELECT count(*) AS n, sum(event_id // 3) AS thirds FROM events WHERE regexp_full_match(event_type, 'c.*k') OR regexp_matches(event_type, '^v')",
    "sql_shim_identifiers": 'SELECT "event_type" AS "type", count(*) AS "n" FROM events GROUP BY "event_type"',
}


def _sql_query(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sqlapi.run_sql(spark, text, {t: table(spark, d, t) for t in _TABLES if t in text}, row_cap=None)

    return run


for _name, _text in SQL.items():
    QUERIES[_name] = _sql_query(_text)
    ORACLES[_name] = _text


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_1h(spark, sf_dir)


