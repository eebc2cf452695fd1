"""More registered queries: the store end to end, streams, parsers, encoders, planners, and further PromQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import parsers
from .functions.labels import parse_labels
from .model import INGEST_NS, METRICS, empty, table
from .operators import lifecycle, logs, metrics
from .operators.lifecycle import Materialization, Merge
from .operators.union import exclude
from .plans import sqlapi
from .queries import _METRICS, HOUR, T0, T1, _inst, _metrics, _over, _prom, _register
from .sources import sinks
from .sources.catalog import Segment
from .sources.files import join, scratch_folder
from .sources.tail import register as register_tail
from .store import Store, reconcile
from .streaming import pipeline

# --- parsers -------------------------------------------------------------------


def _line(spark, d, *parts):
    return table(spark, d, "events").select("event_id", F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("value"))


def _text(name):
    return F.col(name).cast("string")


@_register("SELECT event_id, 'none' AS format, 'plain ' || event_type AS message FROM events")
def parse_raw(spark, d):
    m = F.col("m")
    return _line(spark, d, "plain ", _text("event_type")).select("event_id", parsers.parse_log(F.col("value"), "none").alias("m")).select("event_id", m["format"].alias("format"), m["message"].alias("message"))


@_register("SELECT event_id, 'k8s' AS format, event_type || ' of ' || user_id AS message, CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, 'F' AS logtag FROM events")
def parse_log_k8s(spark, d):
    m = F.col("m")
    rows = _line(spark, d, "2024-01-01T00:00:00.5Z ", F.when(F.col("event_id") % 2 == 0, "stdout").otherwise("stderr"), " F ", _text("event_type"), " of ", _text("user_id"))
    return rows.select("event_id", parsers.parse_log(F.col("value")).alias("m")).select("event_id", *[m[c].alias(c) for c in ("format", "message", "stream", "logtag")])


@_register("SELECT event_id, 'cef' AS format, event_type AS message, 'v' || user_id AS device_vendor, '5' AS severity, 'a b ' || event_id AS msg, CAST(user_id AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS rt FROM events")
def parse_log_cef(spark, d):
    m = F.col("m")
    rows = _line(spark, d, "CEF:0|v", _text("user_id"), "|prod|1.0|100|", _text("event_type"), "|5|src=", _text("user_id"), " msg=a b ", _text("event_id"), " rt=123")
    return rows.select("event_id", parsers.parse_log(F.col("value")).alias("m")).select("event_id", *[m[c].alias(c) for c in ("format", "message", "device_vendor", "severity", "msg", "src", "rt")])


@_register("SELECT event_id, 'syslog' AS format, event_type || ' done' AS message, 4 AS facility, 2 AS severity, 'host' || user_id AS host, 'su' AS app, CAST(event_id AS VARCHAR) AS procid FROM events")
def parse_log_syslog_3164(spark, d):
    m = F.col("m")
    rows = _line(spark, d, "<34>Oct 11 22:14:15 host", _text("user_id"), " su[", _text("event_id"), "]: ", _text("event_type"), " done")
    return rows.select("event_id", parsers.parse_log(F.col("value")).alias("m")).select("event_id", m["format"].alias("format"), m["message"].alias("message"), m["facility"].cast("int").alias("facility"), m["severity"].cast("int").alias("severity"), m["host"].alias("host"), m["app"].alias("app"), m["procid"].alias("procid"))


@_register("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'ns' || user_id END AS namespace, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type || '-0' END AS pod, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'main' END AS container FROM events")
def k8s_path(spark, d):
    pods = F.concat(F.lit("/var/log/pods/ns"), _text("user_id"), F.lit("_"), "event_type", F.lit("-0_uid-1/main/0.log"))
    flat = F.concat(F.lit("/var/log/containers/"), "event_type", F.lit("-0_ns"), _text("user_id"), F.lit("_main-" + "0f" * 32 + ".log"))
    path = F.when(F.col("event_id") % 3 == 0, pods).when(F.col("event_id") % 3 == 1, flat).otherwise("/var/log/syslog")
    return table(spark, d, "events").select("event_id", parsers.k8s_path_labels(path).alias("m")).select("event_id", *[F.col("m")[c].alias(c) for c in ("namespace", "pod", "container")])


@_register("SELECT event_id, event_type AS a, 'x' AS b, CAST(NULL AS VARCHAR) AS c FROM events")
def fill_absent(spark, d):
    own = F.create_map(F.lit("a"), F.col("event_type"))
    other = F.create_map(F.lit("a"), F.lit("other"), F.lit("b"), F.lit("x"), F.lit("c"), F.lit(None).cast("string"))
    m = F.col("m")
    return table(spark, d, "events").select("event_id", parsers.fill_absent(own, other).alias("m")).select("event_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@_register("""SELECT event_type AS metric, 'env="x",instance="h' || user_id % 3 || ':1",job="' || CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'j' END || '"' AS labels, value, CASE WHEN event_id % 5 = 0 THEN event_id + 1 ELSE 7 END AS timestamp_ms FROM events""")
def scrape_labels(spark, d):
    sample = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, F.lit('{job="own"}')).otherwise(F.lit("")), F.lit(" "), _text("value"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), (F.col("event_id") + 1).cast("string"))).otherwise(F.lit("")))
    rows = table(spark, d, "events").select(sample.alias("value"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string"), F.lit(":1")).alias("instance"), F.lit('env="x",job="j"').alias("labels"), F.lit(7).cast("long").alias("scraped_ms"))
    return parsers.parse_scrape(rows).withColumnRenamed("__name__", "metric")


@_register("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 2 = 0")
def parse_json_lines(spark, d):
    """Lines that aren't objects give null."""
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, "[1]").otherwise("{broken")
    return table(spark, d, "events").select("event_id", parsers.parse_json(text).alias("m")).where("m is not null").select("event_id", F.col("m")["k"].alias("k"))


# --- summaries ------------------------------------------------------------------


@_register("""SELECT coalesce(k, '') AS k, CAST(count(*) AS BIGINT) AS "count", round(sum(coalesce(v, 0)), 4) AS sum_v, round(avg(coalesce(v, 0)), 9) AS avg_v, min(coalesce(v, 0)) AS min_v FROM (SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS k, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""")
def summary_parity(spark, d):
    df = table(spark, d, "events").select(F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("k"), F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("v"))
    return logs.summary(df, ["k"], ["count", "sum:v", "avg:v", "min:v"], parity=True).withColumn("sum_v", F.round("sum_v", 4)).withColumn("avg_v", F.round("avg_v", 9))


@_register("""SELECT CAST(0 AS BIGINT) AS "count", 0.0::DOUBLE AS sum_value, 0.0::DOUBLE AS p50_value, 0.0::DOUBLE AS max_value""")
def summary_empty(spark, d):
    return logs.summary(table(spark, d, "events").where("event_type = 'nothing'"), [], ["count", "sum:value", "p50:value", "max:value"])


@_register("SELECT 'group column user_id must be text' AS first_error, 'event_type must be a number' AS second_error")
def summary_checks(spark, d):
    errors = []
    for by, what in ((["user_id"], ["count"]), ([], ["sum:event_type"])):
        try:
            logs.summary(table(spark, d, "events"), by, what)
        except TypeError as e:
            errors.append(str(e))
    return spark.createDataFrame([tuple(errors)], "first_error string, second_error string")


@_register("SELECT event_id, message, template FROM (SELECT event_id, event_type AS message, event_type AS template FROM events) WHERE event_id % 100 = 0 AND false UNION ALL SELECT event_id, event_type, event_type FROM events")
def template_of_words(spark, d):
    return logs.mine(table(spark, d, "events").select("event_id", F.col("event_type").alias("message")))


# --- the store ------------------------------------------------------------------


class _Clock:
    def __init__(self):
        self.now = T0 / 1000

    def __call__(self) -> float:
        return self.now


def _store(spark, cold: bool = False):
    clock = _Clock()
    root = join(scratch_folder(spark), uuid.uuid4().hex)
    return Store(spark, join(root, "hot"), "acme", clock=clock, cold_root=join(root, "cold") if cold else None), clock


def _filled(spark, d, parts=4, tier1=2, cold=False, materializations=None):
    """Events in `parts` windows, ingested 40 s apart and each rolled; every tier1 of them merged."""
    s, clock = _store(spark, cold)
    m = _metrics(spark, d)
    for i in range(parts):
        clock.now = T0 / 1000 + 60 * i
        for j in range(2):
            s.ingest_metrics(m.where(F.pmod(F.xxhash64("labels", "timestamp_ms"), F.lit(2)) == j).where(F.col("timestamp_ms") % parts == i))
            clock.now += 40
        s.roll()
        if (i + 1) % tier1 == 0:
            s.compact(least=2, materializations=materializations)
    return s, clock


def _by_name(df):
    return metrics.by_name(df).select(F.col("__name__").alias("metric"), F.col("count").alias("n"), F.round("avg", 6).alias("avg_value"))


_BY_NAME = f"WITH {_METRICS} SELECT name AS metric, count(*) AS n, round(avg(value), 6) AS avg_value FROM metrics GROUP BY name"


@_register(_BY_NAME)
def store_ingest(spark, d):
    """Two windows, of which one is empty, as hot rows."""
    s, _ = _store(spark)
    m = _metrics(spark, d)
    assert s.ingest_metrics(m.where("false")) == 0
    s.ingest_metrics(m)
    return _by_name(s.metrics())


@_register(_BY_NAME)
def store_snapshot(spark, d):
    """Hot windows read as one snapshot instead."""
    s, clock = _store(spark)
    for i in range(2):
        clock.now += 15
        s.ingest_metrics(_metrics(spark, d).where(F.col("timestamp_ms") % 2 == i))
    s.snapshot()
    opened = s.opened(int(clock.now * 1000) - 15_000, int(clock.now * 1000), auto_hot=True)
    assert [x.path for x in opened] == [s.state["snapshot"]["path"]]
    return _by_name(s.metrics())


@_register(_BY_NAME)
def store_merged(spark, d):
    """Rolled, merged twice, purged."""
    s, _ = _filled(spark, d)
    assert s.compact(least=2).tier == 2
    s.purge(0)
    return _by_name(s.metrics())


@_register(f"""WITH {_METRICS} SELECT name AS metric, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM metrics GROUP BY 1""")
def store_rollups(spark, d):
    """Rollups over two merges of the same rows count each once."""
    s, _ = _filled(spark, d)
    s.compact(least=2)
    r = s.rollups("1m")
    return r.groupBy(F.col("__name__").alias("metric")).agg(F.sum("count").alias("n"), F.round(F.sum("sum"), 3).alias("total"), F.round(F.min("min"), 6).alias("low"), F.round(F.max("max"), 6).alias("high"))


@_register(f"""WITH {_METRICS} SELECT name AS metric, count(*) AS n FROM metrics WHERE t % 4 >= 2 GROUP BY 1""")
def store_pruned(spark, d):
    """A range opens the segments that may hold its rows, and no other."""
    s, clock = _filled(spark, d, tier1=99)
    low = T0 + 2 * 60_000
    opened = s.opened(low, low + 3_600_000)
    assert len(opened) == 2 < len(s.state["metrics"])
    return s.metrics(low, low + 3_600_000).groupBy(F.col("__name__").alias("metric")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH {_METRICS} SELECT name AS metric, count(*) AS n FROM metrics GROUP BY 1""")
def store_materialized(spark, d):
    """A table that follows merges, through the SQL surface."""
    s, _ = _filled(spark, d, materializations=[Materialization("per-name", "SELECT __name__ AS name, count(*) AS n FROM merge_output GROUP BY 1")])
    return s.sql("SELECT name AS metric, sum(n) AS n FROM mat_per_name GROUP BY 1", row_cap=None)


@_register(_BY_NAME)
def store_promoted(spark, d):
    """Merged segments read from cold storage."""
    s, clock = _filled(spark, d, cold=True)
    clock.now += 86_400
    assert len(s.promote()) == 2
    s.purge(0)
    return _by_name(s.metrics())


@_register(f"""WITH {_METRICS} SELECT name AS metric, count(*) AS n, true AS no_old_rollup FROM metrics WHERE t % 4 >= 2 GROUP BY 1""")
def store_expired(spark, d):
    """Segments and rollups that ended before the cut are gone, later ones stay."""
    s, clock = _filled(spark, d)
    clock.now = T0 / 1000 + 2 * 60 + 40 + 15 * 86_400 - 20
    s.expire()
    left = s.rollups("1m").agg((F.sum("count") == s.metrics().count()).alias("no_old_rollup"))
    return s.metrics().groupBy(F.col("__name__").alias("metric")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(left))  # one row


def _logs_store(spark, d, parts=3):
    s, clock = _store(spark)
    docs = table(spark, d, "documents")
    for i in range(parts):
        clock.now = T0 / 1000 + i * 86_400
        window = docs.where(F.col("doc_id") % parts == i).select(F.col("text").alias("message"), F.col("lang").alias("format"), *([F.col("source")] if i else []))
        s.land_logs("logs-raw", window if i < 2 else window.withColumn(INGEST_NS, F.lit((T0 + i * 86_400_000) * 1_000_000).cast("long")))
        clock.now += 120
        s.refresh("logs-raw")
    s.land_logs("logs-template", table(spark, d, "conversations").select(F.col("role").alias("template"), F.lit(2).cast("long").alias("count")))
    clock.now += 120
    s.refresh("logs-template")
    return s, clock


@_register(f"""SELECT lang AS format, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source, {T0 * 1_000_000} + (doc_id % 3) * 86400000000000 AS ts, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT NULL, NULL, {(T0 + 2 * 86_400_000 + 120_000) * 1_000_000}, count(*) FROM conversations GROUP BY ALL""")
def store_logs(spark, d):
    """Landed windows of different columns, merged by name and stamped where they had no ingest time."""
    s, _ = _logs_store(spark, d)
    return s.logs().groupBy("format", "source", F.col(INGEST_NS).alias("ts")).agg(F.count(F.lit(1)).alias("n"))


@_register("SELECT lang AS format, count(*) AS n FROM documents WHERE doc_id % 3 > 0 AND contains(text, 'License') GROUP BY 1")
def store_logql(spark, d):
    """All rows of a LogQL range, counted over the segments that may hold it."""
    s, _ = _logs_store(spark, d)
    low = (T0 + 86_400_000) * 1_000_000
    assert len(s.logs(None, low // 1_000_000, None).inputFiles()) < len(s.logs().inputFiles())
    out = s.logql_rows('{format=~".+"} |= "License"', low).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    return out.select(parse_labels(F.col("stream"))["format"].alias("format"), "n").groupBy("format").agg(F.sum("n").alias("n"))


@_register("SELECT 'format' AS label, lang AS label_value FROM documents GROUP BY ALL UNION ALL SELECT 'template', role FROM conversations GROUP BY ALL UNION ALL SELECT 'job', 'tidemark'")
def store_label_index(spark, d):
    s, _ = _logs_store(spark, d)
    return s.label_index()


@_register("SELECT (SELECT count(*) FROM documents) AS raw, (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS logs, (SELECT 2 * count(*) FROM conversations) AS counted, 0 AS metrics, 0 AS summaries")
def store_views(spark, d):
    """The views of the SQL surface, absent planes included."""
    s, _ = _logs_store(spark, d)
    return s.sql('SELECT (SELECT count(*) FROM logs_raw) AS raw, (SELECT count(*) FROM logs) AS logs, (SELECT sum("count") FROM logs_template) AS counted, (SELECT count(*) FROM metrics) AS metrics, (SELECT count(*) FROM logs_summary) AS summaries')


@_register("SELECT 'logs-raw' AS artifact, 1 AS landed, count(*) AS n FROM documents WHERE doc_id % 3 = 2")
def store_logs_expired(spark, d):
    """Logs in tiers expire by age, landed ones also by number."""
    s, clock = _logs_store(spark, d)
    for _ in range(3):
        s.land_logs("logs-raw", spark.createDataFrame([("x",)], "message string"))
    clock.now = T0 / 1000 + 15 * 86_400 + 1.5 * 86_400
    s.expire(most_landing=1)
    return spark.createDataFrame([("logs-raw", len(s.state["landing"]["logs-raw"]), s.logs("logs-raw").count())], "artifact string, landed int, n long")


@_register("SELECT 0 AS metrics, 0 AS logs, 0 AS rows_in_range")
def store_empty(spark, d):
    s, _ = _store(spark)
    return s.sql("SELECT (SELECT count(*) FROM metrics) AS metrics, (SELECT count(*) FROM logs) AS logs, 0 AS rows_in_range").withColumn("rows_in_range", F.lit(s.metrics(0, 1).count()))


@_register("SELECT plane, n FROM (VALUES ('metrics', 2), ('retired', 12), ('rollups 1h', 2)) t(plane, n)")
def store_stats(spark, d):
    """Four windows of two, rolled and merged in twos: 8 hot folders and 4 rolled ones are retired."""
    s, _ = _filled(spark, d)
    live = sum(not r["compacted"] for r in s.state["metrics"])
    return spark.createDataFrame([("metrics", live), ("retired", len(s.state["retired"])), ("rollups 1h", len(s.state["rollups"]["1h"]))], "plane string, n int")


# --- planners --------------------------------------------------------------------

_SEGMENTS = """seg AS (SELECT event_type || '-' || strftime(ts, '%m%d') || '-' || hour(ts) // 3 AS path, CAST(count(*) * 400000 AS BIGINT) AS bytes, min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM events GROUP BY 1),
lev AS (SELECT *, CASE WHEN bytes <= 1048576 THEN 0 ELSE CAST(floor(ln(bytes / 1048576.0) / ln(4)) AS INT) END AS level FROM seg),
brk AS (SELECT *, lag(lo) OVER w AS plo, lag(hi) OVER w AS phi FROM lev WINDOW w AS (PARTITION BY level ORDER BY lo, path)),
run AS (SELECT *, sum(CASE WHEN phi IS NOT NULL AND lo >= phi AND lo - phi <= CASE WHEN phi > plo THEN phi - plo ELSE 60000 END THEN 0 ELSE 1 END) OVER (PARTITION BY level ORDER BY lo, path) AS r FROM brk),
len AS (SELECT level, r, count(*) AS n, min(lo) AS a, min(path) AS p FROM run GROUP BY 1, 2),
best AS (SELECT level, r FROM len WHERE n >= 4 AND level = (SELECT min(level) FROM len WHERE n >= 4) ORDER BY n DESC, r LIMIT 1),
pick AS (SELECT path, bytes, row_number() OVER (ORDER BY lo, path) AS i, sum(bytes) OVER (ORDER BY lo, path) AS total FROM run JOIN best USING (level, r))"""


def _segments(spark, d):
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    path = F.concat("event_type", F.lit("-"), F.date_format("ts", "MMdd"), F.lit("-"), F.floor(F.hour("ts") / 3).cast("string"))
    rows = table(spark, d, "events").groupBy(path.alias("path")).agg((F.count(F.lit(1)) * 400_000).alias("bytes"), F.min(t).alias("lo"), F.max(t).alias("hi")).collect()  # a catalog: one row a segment
    return [Segment(0, r.path, r.bytes, r.lo, r.hi) for r in rows]


@_register(f"WITH {_SEGMENTS} SELECT path, 1 AS to_tier FROM pick WHERE i <= 64 AND total <= 67108864")
def merge_plan(spark, d):
    """The tiered planner over segments of three hours and a type."""
    got = lifecycle.plan_merge(_segments(spark, d), least=4, seal=64 << 20)
    return spark.createDataFrame([(s.path, got.to_tier) for s in got.sources] if got else [], "path string, to_tier int")


@_register("""WITH seg AS (SELECT event_type || '-' || strftime(ts, '%m%d') || '-' || hour(ts) // 3 AS path, min(epoch_us(ts) // 1000) AS lo, CAST(count(*) * 400000 AS BIGINT) AS bytes FROM events GROUP BY 1), b AS (SELECT *, lo // 86400000 AS day FROM seg), f AS (SELECT min(day) AS day FROM (SELECT day FROM b GROUP BY day HAVING count(*) >= 2)) SELECT path FROM b JOIN f USING (day) QUALIFY row_number() OVER (ORDER BY lo, path) <= 5""")
def compaction_plan(spark, d):
    got = lifecycle.plan_compaction(_segments(spark, d), T1 + 10 * 86_400_000, 0, bucket=86_400_000, most=5, budget=1 << 40)
    return spark.createDataFrame([(s.path,) for s in got.sources], "path string")


@_register("""WITH seg AS (SELECT event_type || '-' || strftime(ts, '%m%d') || '-' || hour(ts) // 3 AS path, min(epoch_us(ts) // 1000) AS lo FROM events GROUP BY 1), n AS (SELECT path, row_number() OVER (ORDER BY lo, path) - 1 AS i FROM seg) SELECT path, i // 6 AS merge FROM n WHERE i < 18""")
def log_merge_plan(spark, d):
    got = lifecycle.plan_log_merges(T1, _segments(spark, d), [], least=6, most=3)
    return spark.createDataFrame([(s.path, k) for k, m in enumerate(got) for s in m.sources], "path string, merge int")


@_register("""WITH seg AS (SELECT event_type || '-' || strftime(ts, '%m%d') || '-' || hour(ts) // 3 AS path, max(epoch_us(ts) // 1000) AS hi, min(epoch_us(ts) // 1000) AS lo FROM events GROUP BY 1) SELECT path, hi <= 1705276800000 - 43200000 AS promotable, row_number() OVER (ORDER BY lo, path) <= count(*) OVER () - 50 AS over_cap FROM seg""")
def promotion_and_cap(spark, d):
    segs = [Segment(1, s.path, s.bytes, s.min_ts, s.max_ts) for s in _segments(spark, d)]
    out, cap = set(lifecycle.promotable(segs, 1705276800000)), set(lifecycle.over_cap(segs, 50))
    return spark.createDataFrame([(s.path, s in out, s in cap) for s in segs], "path string, promotable boolean, over_cap boolean")


@_register("SELECT h, CASE WHEN h >= 168 THEN '1h' WHEN h >= 24 THEN '5m' WHEN h >= 1 THEN '1m' ELSE '' END AS step, CASE WHEN h % 2 = 0 THEN '5m' ELSE '' END AS asked FROM range(0, 200) r(h)")
def rollup_choice(spark, d):
    return spark.createDataFrame([(h, metrics.pick_step(0, h * 3600), metrics.pick_step(0, 60, "5m" if h % 2 == 0 else "9m")) for h in range(200)], "h long, step string, asked string")


@_register("SELECT unnest([60, 300, 3600, 7200]) AS seconds")
def rollup_steps(spark, d):
    return spark.createDataFrame([(s,) for s in metrics.parse_steps("1m, 5m,1h,,2h")], "seconds int")


# --- SQL surface -------------------------------------------------------------------


@_register("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 101")
def sql_row_cap(spark, d):
    """One row more than the cap tells that there are more."""
    return sqlapi.run_sql(spark, "SELECT event_id, event_type FROM events ORDER BY event_id DESC", {"events": table(spark, d, "events")}, row_cap=100)


#: Texts that both engines run, after the shim's translation here.
_SHIM = {
    "sql_shim_times": "SELECT strftime(ts, '%Y/%m/%d at %H:%M') AS t, date_diff('day', TIMESTAMP '2023-12-31 23:00:00', ts) AS days, date_diff('month', TIMESTAMP '2023-12-31 23:00:00', ts) AS months, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "sql_shim_lists": "SELECT event_type, list_contains(string_split(event_type || '.x.y', '.'), 'x') AS has, list_sort(list_distinct(list_value(event_type, 'b', 'b')))[1] IS NULL AS absent, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "sql_shim_aggregates": "SELECT event_type, arg_max(event_id, (ts, event_id)) AS newest, arg_min(event_id, (ts, event_id)) AS oldest, round(quantile_cont(value, 0.25), 6) AS q1, quantile_disc(value, 0.5) AS q2, round(CAST(sum(epoch(ts)) AS DOUBLE) / 1e9, 3) AS total FROM events GROUP BY event_type",
    "sql_try_cast": "SELECT event_type, count(TRY_CAST(event_type AS BIGINT)) AS none, sum(TRY_CAST(CAST(user_id AS VARCHAR) AS BIGINT)) AS total FROM events GROUP BY event_type",
}


def _shimmed(name, text):
    @_register(text)
    def run(spark, d):
        return sqlapi.run_sql(spark, text, {"events": table(spark, d, "events")}, row_cap=None)

    from .queries import ORACLES, QUERIES

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _name, _body in _SHIM.items():
    _shimmed(_name, _body)


_REFUSED = ["SELECT reflect('a', 'b')", "DROP TABLE events", "SELECT * FROM parquet.`/etc`", "INSERT INTO events SELECT * FROM events", "WITH x AS (SELECT 1) DELETE FROM events", "SELECT * FROM nowhere", "SET x = 1", "SELECT * FROM read_files('/')"]
_ALLOWED = ["SELECT ';' AS drop_table", "WITH t(a) AS (SELECT 1) SELECT a FROM t", 'SELECT "event_id" AS "insert" FROM events', "SELECT 'DROP TABLE x' -- ; DELETE", "(SELECT 1)", "SELECT count(*) FROM events GROUP BY GROUPING SETS (())"]


@_register(f"SELECT unnest(range({len(_REFUSED) + len(_ALLOWED)})) AS i, i < {len(_REFUSED)} AS refused")
def sql_read_only(spark, d):
    """Which statements the read-only check refuses."""
    out = []
    for i, text in enumerate(_REFUSED + _ALLOWED):
        try:
            sqlapi.run_sql(spark, text, {"events": table(spark, d, "events")})
            out.append((i, False))
        except sqlapi.SQLError:
            out.append((i, True))
    return spark.createDataFrame(out, "i long, refused boolean")


@_register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000Z' AS t, event_type, value FROM events")
def json_cells(spark, d):
    df = table(spark, d, "events")
    kinds = dict(df.dtypes)
    return df.select("event_id", sqlapi.json_cell(F.date_trunc("second", "ts"), kinds["ts"]).alias("t"), sqlapi.json_cell(F.col("event_type"), "string").alias("event_type"), sqlapi.json_cell(F.col("value"), "double").alias("value"))


@_register("SELECT coalesce(CASE WHEN user_id % 2 = 0 THEN event_type END, '') AS k, coalesce(CASE WHEN user_id % 3 = 0 THEN value END, 0) AS v FROM events")
def structured_rows(spark, d):
    return metrics.structured_rows(table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("k"), F.when(F.col("user_id") % 3 == 0, F.col("value")).alias("v")))


@_register("SELECT * EXCLUDE (n_name, n_regionkey) FROM nation")
def frame_exclude(spark, d):
    return exclude(table(spark, d, "nation"), "n_name", "n_regionkey")


@_register("SELECT 0 AS n, 5 AS n_columns")
def empty_relation(spark, d):
    df = empty(spark, METRICS)
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("n_columns", F.lit(len(df.columns)))


# --- encoders and sources --------------------------------------------------------------


def _folder(spark):
    return join(scratch_folder(spark), uuid.uuid4().hex)


@_register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def encode_parquet(spark, d):
    path = _folder(spark)
    for i, codec in enumerate(("zstd", "none", "gzip")):
        sinks.write_parquet(table(spark, d, "events").where(F.col("event_id") % 3 == i), path, codec, block_bytes=1 << 20, bloom=["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_register("SELECT coalesce(CASE WHEN event_id % 5 > 0 THEN event_type END, '') AS line, count(*) AS n FROM events GROUP BY 1")
def encode_raw(spark, d):
    path = _folder(spark)
    sinks.write_raw(table(spark, d, "events").select(F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("x"), "value"), path)
    return sinks.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@_register("SELECT r_regionkey, r_name FROM region")
def encode_arrow(spark, d):
    return sinks.from_arrow(spark, sinks.to_arrow(table(spark, d, "region").select("r_regionkey", "r_name")))


@_register("SELECT '[' || string_agg('{\"n_nationkey\":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']' AS array_text, '[]' AS none FROM nation")
def encode_json_array(spark, d):
    df = table(spark, d, "nation").select("n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey")
    return sinks.json_array(df).crossJoin(sinks.json_array(df.where("false")).withColumnRenamed("value", "none")).withColumnRenamed("value", "array_text")


@_register("SELECT n_nationkey, n_name FROM nation")
def import_json(spark, d):
    """A window of JSON lines, known by its content."""
    path = _folder(spark)
    sinks.write_json(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), path)
    file = next(f for f in spark.read.text(path).inputFiles())
    return sinks.import_window(spark, file).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@_register("SELECT lang, count(DISTINCT g) AS n FROM (SELECT lang, unnest([lower(text)[i:i+2] FOR i IN range(1, length(text) - 1)]) AS g FROM documents WHERE length(text) BETWEEN 3 AND 400) GROUP BY 1")
def token_ngrams(spark, d):
    df = table(spark, d, "documents").where(F.char_length("text").between(3, 400))
    return df.select("lang", F.explode(sinks.ngrams(F.col("text"))).alias("g")).groupBy("lang").agg(F.count_distinct("g").alias("n"))


@_register("SELECT true AS written, true AS summaries")
def reconciled(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "message")
    got = reconcile(e, e, logs.template_counts(logs.mine(e)))
    return spark.createDataFrame([tuple(got.values())], "written boolean, summaries boolean")


# --- streams ---------------------------------------------------------------------------


def _drained(stream, spark, mode="append"):
    """A stream's output once it has read what there is."""
    out = _folder(spark)
    stream.writeStream.foreachBatch(lambda df, epoch: df.write.mode(mode).parquet(out)).outputMode("append" if mode == "append" else "complete").option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _event_stream(spark, d):
    # A stream reads folders; the events go to one, in two files.
    path = _folder(spark)
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    e.repartition(2).write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@_register("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = _drained(pipeline.event_windows(_event_stream(spark, d), "ts", "60 days", "1 day", by=["event_type"]), spark, "overwrite")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("value_sum", 4).alias("total"))


@_register("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_sessions(spark, d):
    return _drained(pipeline.event_sessions(_event_stream(spark, d), "ts", "60 days", "6 hours", ["user_id"]), spark, "overwrite").select("user_id", "n")


@_register("SELECT branch, k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'all' AS branch, event_type AS k, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'odd', event_type, count(*) FROM events WHERE user_id % 2 = 1 GROUP BY ALL) GROUP BY ALL")
def stream_fan_out(spark, d):
    """Three branches of which one fails and is dropped; each micro-batch is a window."""
    out = _folder(spark)

    def to(name):
        return lambda df, epoch: df.groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("branch", F.lit(name)).write.mode("append").parquet(out)

    def fails(df, epoch):
        raise ValueError("this branch fails")

    p = pipeline.Pipeline("fan" + uuid.uuid4().hex, lambda s: _event_stream(s, d), lambda df: df, [pipeline.Branch("bad", [], fails), pipeline.Branch("all", [], to("all")), pipeline.Branch("odd", [lambda df: df.where("user_id % 2 = 1")], to("odd"))], on_error="drop")
    pipeline.start(spark, p, out + "-state", drain=True).awaitTermination()
    return spark.read.parquet(out).groupBy("branch", "k").agg(F.sum("n").alias("n"))


@_register("""SELECT event_type || ' by <*>' AS template, CAST(count(*) AS BIGINT) AS "count" FROM events GROUP BY 1""")
def stream_quick(spark, d):
    """Lines of files to template counts, by the preset."""
    lines, out = _folder(spark), _folder(spark)
    sinks.write_raw(table(spark, d, "events").select(F.concat("event_type", F.lit(" by user="), _text("user_id")).alias("line")), lines)
    p = pipeline.quick(lines, lambda df, epoch: df.write.mode("append").parquet(out))
    p.name += uuid.uuid4().hex
    pipeline.start(spark, p, out + "-state", drain=True).awaitTermination()
    return logs.template_counts(spark.read.parquet(out))


# --- PromQL --------------------------------------------------------------------------------

_USER = """'user_id="' || user_id || '"'"""
_NAMED = """'__name__="' || name || '"'"""


def _promql(name, expr, sql, **options):
    @_register(sql)
    def run(spark, d):
        return _prom(spark, d, expr, lookback=HOUR, **options)

    # The registry goes by the name.
    from .queries import ORACLES, QUERIES

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _kind, _sql in {"min": "min(v)", "max": "max(v)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "group": "1.0::DOUBLE", "count": "count(*)::DOUBLE"}.items():
    _promql(f"prom_{_kind}_by", _kind + ' by (__name__) ({__name__=~".+"})', _inst(HOUR) + f" SELECT {_NAMED} AS metric, s AS t, round({_sql}, 6) AS value FROM inst GROUP BY name, s")
for _kind, _sql in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "count": "count(*)::DOUBLE", "present": "1.0::DOUBLE", "stdvar": "var_pop(v)", "last": "arg_max(v, t)"}.items():
    _label = """'__name__="click",user_id="' || user_id || '"'""" if _kind == "last" else _USER
    _promql(f"prom_{_kind}_over_time", f"{_kind}_over_time(click[9h])", _over(9 * HOUR, f"SELECT {_label} AS metric, s AS t, round({_sql}, 6) AS value FROM win WHERE name = 'click' GROUP BY user_id, s"))
_promql("prom_mad_over_time", "mad_over_time(click[12h])", _over(12 * HOUR, f", med AS (SELECT user_id, s, quantile_cont(v, 0.5) AS m FROM win WHERE name = 'click' GROUP BY ALL) SELECT {_USER} AS metric, s AS t, round(quantile_cont(abs(v - m), 0.5), 6) AS value FROM win JOIN med USING (user_id, s) WHERE name = 'click' GROUP BY user_id, s"))
_promql("prom_bottomk", "bottomk(2, view)", _inst(HOUR) + """ SELECT '__name__="' || name || '",user_id="' || user_id || '"' AS metric, s AS t, round(v, 6) AS value FROM inst WHERE name = 'view' QUALIFY row_number() OVER (PARTITION BY s ORDER BY v, metric) <= 2""")
_promql("prom_count_values", 'count_values("v", floor(view / 50))', _inst(HOUR) + """ SELECT 'v="' || CAST(floor(v / 50) AS BIGINT) || '"' AS metric, s AS t, count(*)::DOUBLE AS value FROM inst WHERE name = 'view' GROUP BY ALL""")
_promql("prom_deriv", "deriv(click[24h])", _over(24 * HOUR, f"SELECT {_USER} AS metric, s AS t, round(regr_slope(v, (t - s) / 1000.0), 9) AS value FROM win WHERE name = 'click' GROUP BY user_id, s HAVING count(*) >= 2"), digits=9)
_promql("prom_predict_linear", "predict_linear(click[24h], 3600)", _over(24 * HOUR, f"SELECT {_USER} AS metric, s AS t, round(regr_intercept(v, (t - s) / 1000.0) + 3600 * regr_slope(v, (t - s) / 1000.0), 4) AS value FROM win WHERE name = 'click' GROUP BY user_id, s HAVING count(*) >= 2"), digits=4)
_promql("prom_resets", "resets(click[24h])", _over(24 * HOUR, f"SELECT {_USER} AS metric, s AS t, count(*) FILTER (WHERE pv > v)::DOUBLE AS value FROM win WHERE name = 'click' GROUP BY user_id, s"))
_promql("prom_idelta", "idelta(click[24h])", _over(24 * HOUR, f"SELECT {_USER} AS metric, s AS t, round(arg_max(v - pv, t), 6) AS value FROM win WHERE name = 'click' GROUP BY user_id, s HAVING count(*) >= 2"))
_promql("prom_and", "click and on(user_id) view", _inst(HOUR) + """ SELECT '__name__="click",user_id="' || user_id || '"' AS metric, s AS t, round(v, 6) AS value FROM inst WHERE name = 'click' AND (user_id, s) IN (SELECT (user_id, s) FROM inst WHERE name = 'view')""")
_promql("prom_or", "click or on(user_id) view", _inst(HOUR) + """ SELECT '__name__="' || name || '",user_id="' || user_id || '"' AS metric, s AS t, round(v, 6) AS value FROM inst WHERE name = 'click' OR (name = 'view' AND (user_id, s) NOT IN (SELECT (user_id, s) FROM inst WHERE name = 'click'))""")
_promql("prom_label_join", 'label_join(click, "both", "-", "__name__", "user_id")', _inst(HOUR) + """ SELECT '__name__="click",both="click-' || user_id || '",user_id="' || user_id || '"' AS metric, s AS t, round(v, 6) AS value FROM inst WHERE name = 'click'""")
_promql("prom_calendar", "year() * 1000000 + month() * 10000 + day_of_month() * 100 + hour() + day_of_week() / 10 + days_in_month() / 10000 + minute() / 1000000", f"SELECT '' AS metric, s AS t, round(year(w) * 1000000 + month(w) * 10000 + day(w) * 100 + hour(w) + dayofweek(w) / 10 + day(last_day(w)) / 10000.0 + minute(w) / 1000000.0, 6) AS value FROM (SELECT {T0} + k * {HOUR} AS s, make_timestamp(({T0} + k * {HOUR}) * 1000) AS w FROM range(0, {29 * 24 + 1}) r(k))")
_promql("prom_math", "sqrt(abs(click - 50)) + ln(click + 1) + exp(click / 100) + log2(click + 1) + log10(click + 1) + floor(click) + ceil(click) + sgn(click - 50) + clamp(click, 10, 20) + clamp_min(click, 30) + clamp_max(click, 40) + round(click, 5)", _inst(HOUR) + f""" SELECT {_USER} AS metric, s AS t, round(sqrt(abs(v - 50)) + ln(v + 1) + exp(v / 100) + log2(v + 1) + log10(v + 1) + floor(v) + ceil(v) + sign(v - 50) + least(greatest(v, 10), 20) + greatest(v, 30) + least(v, 40) + floor(v / 5 + 0.5) * 5, 6) AS value FROM inst WHERE name = 'click'""")
_promql("prom_scalar", "click * scalar(count(view)) + time() / 1000", _inst(HOUR) + f""", n AS (SELECT s, count(*) AS n FROM inst WHERE name = 'view' GROUP BY s) SELECT {_USER} AS metric, s AS t, round(v * coalesce(n, 'nan'::DOUBLE) + s / 1000000.0, 5) AS value FROM inst LEFT JOIN n USING (s) WHERE name = 'click'""", digits=5)
_promql("prom_absent_over_time", "absent_over_time(nothing[1h])", f"SELECT '' AS metric, {T0} + k * {HOUR} AS t, 1.0::DOUBLE AS value FROM range(0, {29 * 24 + 1}) r(k)")
_promql("prom_at", f"click @ {(T0 + 24 * HOUR) // 1000}", _inst(HOUR) + f""" SELECT '__name__="click",user_id="' || i.user_id || '"' AS metric, grid.s AS t, round(i.v, 6) AS value FROM inst i, grid WHERE i.name = 'click' AND i.s = {T0 + 24 * HOUR}""")
_promql("prom_bool", "click > bool 50", _inst(HOUR) + f" SELECT {_USER} AS metric, s AS t, CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM inst WHERE name = 'click'")
_promql("prom_arithmetic", "-click ^ 2 % 7 + 2 ^ 3 ^ 2", _inst(HOUR) + f" SELECT {_USER} AS metric, s AS t, round(-((v * v) % 7) + 512, 4) AS value FROM inst WHERE name = 'click'", digits=4)
_promql("prom_ignoring", "click - ignoring(__name__) view", _inst(HOUR) + f" SELECT {_USER.replace('user_id ||', 'a.user_id ||')} AS metric, a.s AS t, round(a.v - b.v, 6) AS value FROM inst a JOIN inst b USING (user_id, s) WHERE a.name = 'click' AND b.name = 'view'")
_promql("prom_group_right", "sum(click) - on() group_right click", _inst(HOUR) + f", tot AS (SELECT s, sum(v) AS v FROM inst WHERE name = 'click' GROUP BY s) SELECT {_USER} AS metric, i.s AS t, round(tot.v - i.v, 6) AS value FROM inst i JOIN tot USING (s) WHERE name = 'click'")
_promql("prom_timestamp", "timestamp(click)", f"""WITH {_METRICS}, grid AS (SELECT {T0} + k * {HOUR} AS s FROM range(0, {29 * 24 + 1}) r(k)) SELECT {_USER} AS metric, s AS t, round(max(m.t) / 1000.0, 3) AS value FROM metrics m JOIN grid ON m.t > s - {HOUR} AND m.t <= s WHERE name = 'click' GROUP BY user_id, s""", digits=3)

