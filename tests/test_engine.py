"""Parsers, summaries, union, LogQL, SQL API, lifecycle, streaming and alerts."""

import re
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark import limits
from tidemark.functions import parsers
from tidemark.functions.labels import merge_labels, parse_labels, render_labels
from tidemark.model import INGEST_NS, METRICS, empty, stamp
from tidemark.operators import alerts, joins, lifecycle, logs, metrics
from tidemark.operators.union import union_by_name
from tidemark.plans import logql, params, sqlapi
from tidemark.queries import QUERIES
from tidemark.sources import catalog, sinks
from tidemark.sources.catalog import Segment
from tidemark.streaming import pipeline


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr.alias("x")).first().x


# --- labels and parsers --------------------------------------------------------------


def test_labels(spark):
    text = r'a="1",b="x,\"y\"\\ \n"'
    m = one(spark, parse_labels(F.col("t")), t=text)
    assert m == {"a": "1", "b": 'x,"y"\\ \n'}
    assert one(spark, render_labels(parse_labels(F.col("t"))), t=text) == text
    assert one(spark, parse_labels(F.col("t")), t=None) == {}
    with pytest.raises(Exception, match="malformed labels"):
        one(spark, parse_labels(F.col("t")), t='{"pod":"p1"}')
    assert one(spark, merge_labels(parse_labels(F.col("a")), parse_labels(F.col("b"))), a='x="1",y="2"', b='y="3"') == {"x": "1", "y": "3"}


@pytest.mark.parametrize(
    "line, want",
    [
        ('{"msg":"hi","n":1,"ts":"x","o":{"a":1}}', {"format": "json", "message": "hi", "msg": "hi", "n": "1", "o": '{"a":1}'}),
        ('{"message":5}', {"format": "json", "message": '{"message":5}'}),
        ("<34>1 2024-01-01T00:00:00Z host app - ID1 [x@1 a=\"b\"] text here", {"format": "syslog", "facility": "4", "severity": "2", "host": "host", "app": "app", "msgid": "ID1", "message": "text here"}),
        ("<13>Oct 11 22:14:15 mymachine su[12]: failed", {"format": "syslog", "facility": "1", "severity": "5", "host": "mymachine", "app": "su", "procid": "12", "message": "failed"}),
        ("2024-01-01T00:00:00Z stdout F hello  there", {"format": "k8s", "stream": "stdout", "logtag": "F", "message": "hello  there"}),
        ('10.0.0.1 - bob [01/Jan/2024:00:00:00 +0000] "GET /x HTTP/1.1" 200 12', {"format": "clf", "host": "10.0.0.1", "authuser": "bob", "status": "200", "size": "12", "message": "GET /x HTTP/1.1", "method": "GET", "path": "/x", "protocol": "HTTP/1.1"}),
        ("CEF:0|Ven|Prod|1.0|100|name here|5|src=1.2.3.4 msg=two words here dst=5", {"format": "cef", "cef_version": "0", "device_vendor": "Ven", "device_product": "Prod", "device_version": "1.0", "signature_id": "100", "message": "name here", "severity": "5", "src": "1.2.3.4", "msg": "two words here", "dst": "5"}),
        ("plain text", {"format": "none", "message": "plain text"}), ("{broken", {"format": "none", "message": "{broken"}), ("<x", {"format": "none", "message": "<x"}), ("", {"format": "none", "message": ""}),
    ],
)
def test_logs(spark, line, want):
    assert one(spark, parsers.parse_log(F.col("l")), l=line) == want


def test_other_parsers(spark):
    assert one(spark, parsers.parse_logfmt(F.col("l")), l=r'a=1 b="x \"q\" \n" flag c= d="open rest') == {"a": "1", "b": 'x "q" \n', "flag": "true", "c": "", "d": "open rest"}
    assert one(spark, parsers.parse_regex(F.col("l"), r"(?P<k>\w+)-(?P<v>\d+)"), l="ab-12") == {"k": "ab", "v": "12"}
    assert one(spark, parsers.parse_regex(F.col("l"), r"(?P<k>\d+)", strict=False), l="ab") is None
    with pytest.raises(Exception, match="doesn't match"):
        one(spark, parsers.parse_regex(F.col("l"), r"(?P<k>\d+)"), l="ab")
    path = "/var/log/pods/ns_pod-1_uid/main/0.log"
    assert one(spark, parsers.k8s_path_labels(F.col("p")), p=path) == {"namespace": "ns", "pod": "pod-1", "container": "main"}
    flat = f"/var/log/containers/pod-1_ns_main-{'a' * 64}.log"
    assert one(spark, parsers.k8s_path_labels(F.col("p")), p=flat) == {"namespace": "ns", "pod": "pod-1", "container": "main"}
    lines = spark.createDataFrame([("# TYPE x",), ("",), ('x{a="}"} 1.5 1000',), ("y +Inf",), ("z NaN",)], "value string")
    got = {r[0]: (r.labels, r.timestamp_ms) for r in parsers.parse_exposition(lines).collect()}
    assert got == {"x": ('a="}"', 1000), "y": ("", 0), "z": ("", 0)}
    bad = spark.createDataFrame([("x",)], "value string")
    with pytest.raises(Exception, match="malformed sample"):
        parsers.parse_exposition(bad).collect()
    assert parsers.parse_exposition(bad, strict=False).count() == 0


def test_infer(spark):
    df = spark.createDataFrame([({"i": "42", "f": "1.5", "b": "true", "s": "x", "m": "true"},), ({"i": "7.0", "f": "2", "b": "false", "m": "1"},)], "m map<string,string>")
    out = parsers.infer(df, "m")
    assert out.dtypes == [("b", "boolean"), ("f", "double"), ("i", "bigint"), ("m", "string"), ("s", "string")]


# --- summaries, union, rollups ----------------------------------------------------------


def test_summary_and_templates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), (None, 5.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in logs.summary(df, ["k"], ["count", "p50:v", "p95:v", "p0:v", "sum:v"], parity=True).collect()}
    assert (got["a"]["p50_v"], got["a"]["p95_v"], got["a"]["p0_v"]) == (2.0, 4.0, 1.0) and got[""]["count"] == 1 and got["b"]["sum_v"] == 0
    with pytest.raises(TypeError):
        logs.summary(df, ["v"], ["count"])
    assert one(spark, logs.template_of(F.col("c")), c=" user 4821  logged in from 10.0.0.2 a=b ") == "user <*> logged in from <*> <*>"
    assert one(spark, logs.template_of(F.col("c")), c=None) == ""


def test_union(spark):
    a, b = spark.createDataFrame([(1, "x")], "n long, m string"), spark.createDataFrame([(1.5, True)], "n double, z boolean")
    out = union_by_name([a, b])
    assert out.dtypes == [("n", "string"), ("m", "string"), ("z", "boolean")] and out.count() == 2
    assert dict(union_by_name([a, b], numbers_widen=True).dtypes)["n"] == "double"


def test_steps():
    assert metrics.parse_steps("1m, 5m,1h") == [60, 300, 3600]
    assert [metrics.pick_step(0, s) for s in (60, 3600, 86400, 7 * 86400)] == ["", "1m", "5m", "1h"]
    with pytest.raises(ValueError):
        metrics.parse_steps("5x")


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k int, u int, v string")
    got = {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}


# --- LogQL and SQL -------------------------------------------------------------------------


def test_logql(spark):
    q = logql.parse('{job="tidemark"} |= "disk" != "sda2" |~ "d.sk" !~ "^ok$"')
    assert len(q.filters) == 4 and logql.parse("").matchers == [] and logql.parse("{}").filters == []
    for bad in ['|= "x"', "{a}", '{a="b"', '{a="b"} | json', "{a=b}", 'rate({a="b"}[1m])', '{a=~"("}', '{a="b"} |= x', '{a="b"} extra']:
        with pytest.raises(logql.LogQLError):
            logql.parse(bad)
    df = spark.createDataFrame([("disk full on /dev/sda1", "none", None, 1), ("user 42 logged in", "json", "t", 2), ("", "none", "tmpl", 3)], f"message string, format string, template string, {INGEST_NS} long")
    assert [r.line for r in logql.query_rows(df, '{format="none"}').collect()] == ["tmpl", "disk full on /dev/sda1"]
    assert logql.query_rows(df, '{} |= "disk"', 0, 2).count() == 1 and logql.query_rows(df, '{nope=~".+"}').count() == 0
    assert [r.label for r in logql.label_names(df).collect()] == ["format", "job", "template"]
    s = logql.streams(logql.query_rows(df, "{}")).collect()
    assert s[0].stream == 'format="json",job="tidemark",template="t"'


@pytest.mark.parametrize("sql", ["SELECT ';' AS x FROM v", "WITH c(a) AS (SELECT k FROM v) SELECT a FROM c", '(SELECT k AS "set" FROM v)', "SELECT count(*) FROM v -- comment", "SELECT k FROM v WHERE k IN (SELECT k FROM v)"])
def test_sql_allowed(spark, sql):
    v = spark.createDataFrame([(1,), (2,)], "k int")
    assert sqlapi.run_sql(spark, sql, {"v": v}).count() >= 1


@pytest.mark.parametrize("sql", ["DROP TABLE v", "SET a=b", "INSERT INTO v SELECT 1", "WITH c AS (SELECT 1) INSERT INTO v SELECT * FROM c", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "CREATE TABLE t AS SELECT 1", "SELECT reflect('java.lang.System','getenv','X') FROM v", "SELECT (SELECT max(k) FROM hidden) FROM v"])
def test_sql_refused(spark, sql):
    with pytest.raises(sqlapi.SQLError):
        sqlapi.run_sql(spark, sql, {"v": spark.createDataFrame([(1,)], "k int")})


def test_sql_without_cap(spark, tmp_path, monkeypatch):
    from tidemark import queries

    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "Limit" not in plan(sqlapi.run_sql(spark, "SELECT id FROM v", {"v": spark.range(3)}, row_cap=None))
    spark.range(3).write.parquet(f"{tmp_path}/nation.parquet")
    assert "Limit" not in plan(queries._sql_query("SELECT id FROM nation")(spark, str(tmp_path)))
    seen = []
    run = sqlapi.run_sql
    monkeypatch.setattr(sqlapi, "run_sql", lambda *a, **k: seen.append(plan(run(*a, **k))) or run(*a, **k))
    assert lifecycle.materialize(spark, "m", "SELECT id FROM merge_input", spark.range(3), spark.range(3), str(tmp_path))
    assert len(seen) == 1 and "Limit" not in seen[0]


def test_sql_cap(spark):
    rows, truncated = sqlapi.page(sqlapi.run_sql(spark, "SELECT id FROM v", {"v": spark.range(50)}, row_cap=10), 10)
    assert len(rows) == 10 and truncated
    assert "EXCEPT (a)" in sqlapi.translate("SELECT * EXCLUDE (a) FROM t WHERE x = 'a // b'") and "'a // b'" in sqlapi.translate("SELECT * EXCLUDE (a) FROM t WHERE x = 'a // b'")


# --- store ------------------------------------------------------------------------------------


def segs(n, tier=0, size=2 << 20):
    return [Segment(tier, f"p{i}", size, i * 10, i * 10 + 9) for i in range(n)]


def test_planners():
    assert lifecycle.plan_merge(segs(5)) is None
    assert lifecycle.plan_merge(segs(6)).to_tier == 1
    assert len(lifecycle.plan_merge(segs(20), most=8).sources) == 8
    assert len(lifecycle.plan_merge(segs(20, size=200 << 20), seal=1 << 30).sources) == 5  # within the bytes of a sealed one, though under least
    assert lifecycle.plan_merge(segs(8, size=3 << 30)) is None
    between = segs(6) + [Segment(0, "big", 1 << 30, 25, 26)]
    assert [s.path for s in lifecycle.plan_merge(between).sources] == [f"p{i}" for i in range(6)]  # one of another level between them parts nothing
    far = [Segment(0, f"p{i}", 2 << 20, i * 100, i * 100 + 9) for i in range(8)]
    assert lifecycle.plan_merge(far) is None  # gaps are longer than segments
    over = [Segment(0, f"p{i}", 2 << 20, i * 10, i * 10 + 15) for i in range(8)]
    assert lifecycle.plan_merge(over) is None  # overlaps part a chain
    instants = [Segment(0, f"p{i}", 2 << 20, i * 60_000, i * 60_000) for i in range(6)]
    assert len(lifecycle.plan_merge(instants).sources) == 6
    two = segs(6, tier=1) + [Segment(0, f"q{i}", 100, i * 10, i * 10 + 9) for i in range(7)]
    assert lifecycle.plan_merge(two).to_tier == 1 and len(lifecycle.plan_merge(two).sources) == 7  # the lowest tier first
    level = segs(6, size=100 << 20) + [Segment(0, f"q{i}", 100, i * 10, i * 10 + 9) for i in range(7)]
    assert {s.path[0] for s in lifecycle.plan_merge(level).sources} == {"q"}  # then the lowest level
    asked = [lifecycle.Merge(tuple(segs(1)), 3)]
    assert lifecycle.choose(asked, lambda: None, lambda: None, []).to_tier == 3 and not asked
    assert lifecycle.choose([], lambda: None, lambda: None, [lambda: lifecycle.Merge((), 9)]).to_tier == 9
    m = lifecycle.plan_log_merges(100_000, segs(2), [])
    assert len(m) == 1 and m[0].to_tier == 0
    assert lifecycle.plan_log_merges(100, segs(2), []) == []
    c = lifecycle.plan_compaction(segs(4), 10**9, 0, bucket=25)
    assert [s.path for s in c.sources] == ["p0", "p1", "p2"]
    assert [s.path for s in lifecycle.expired(segs(3), 100, 85)] == ["p0"]
    assert [s.path for s in lifecycle.over_cap(segs(3), 1)] == ["p0", "p1"]
    assert lifecycle.purge({"a": 1, "b": 5}, 6, 3) == ["a"]
    assert [s.path for s in lifecycle.promotable(segs(2, tier=1), 20, 5)] == ["p0"]


def test_pruning(tmp_path):
    s = segs(5)
    assert [x.path for x in catalog.prune(s, 10, 30)] == ["p1", "p2"]
    assert catalog.prune(lifecycle.retire(s, tuple(s[:4]))) == [s[4]]
    assert catalog.recent_floor(0, 100, 30) == 70 and catalog.recent_floor(5, 100, 30) == 5
    for bad in ("A", "", "a" * 64, "../x"):
        with pytest.raises(ValueError):
            catalog.check_tenant(bad)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "link").symlink_to("/etc")
    with pytest.raises(PermissionError):
        catalog.confined(str(tmp_path / "t"), str(tmp_path / "t" / "link"))


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path)
    src = []
    for i in range(2):
        df = stamp(spark.createDataFrame([("m", 'a="1"', float(i), 0)], "`__name__` string, labels string, value double, timestamp_ms long"), f"2024-01-01 00:0{i}:00")
        df.write.parquet(f"{root}/w{i}")
        src.append(catalog.stat(spark, f"{root}/w{i}", 0, 10))
    merged = lifecycle.merge_metrics(spark, lifecycle.Merge(tuple(src), 1), root)
    assert catalog.read_metrics(spark, [merged]).count() == 2 and merged.max_ts - merged.min_ts == 60_000
    paths = lifecycle.build_rollups(spark, merged, root, {"1m": 60})
    assert spark.read.parquet(paths["1m"]).count() == 2
    out = lifecycle.materialize(spark, "x", "SELECT count(*) AS n FROM merge_output", catalog.read_metrics(spark, src), catalog.read_metrics(spark, [merged]), root)
    assert spark.read.parquet(out).first().n == 2
    assert lifecycle.materialize(spark, "x", "SELECT FROM", empty(spark, METRICS), empty(spark, METRICS), root) is None
    views = catalog.tenant_views(spark, [merged], {}, {"x": [out]})
    assert sqlapi.run_sql(spark, "SELECT (SELECT count(*) FROM metrics) + (SELECT max(n) FROM mat_x) + (SELECT count(*) FROM logs) AS n", views).first().n == 4
    sinks.write_parquet(spark.range(5).withColumn("m", F.lit("x")), f"{root}/z", "zstd", bloom=["m"])
    assert spark.read.parquet(f"{root}/z").count() == 5


def test_sinks(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.5, None)], "v double, s string")
    assert sorted(r.value for r in sinks.json_rows(df).collect()) == ['{"v":1.5,"s":null}', '{"v":null,"s":"a"}']
    assert one(spark, sinks.ngrams(F.col("c")), c="ABCd") == ["abc", "bcd"] and one(spark, sinks.ngrams(F.col("c")), c="ab") == []
    assert sinks.bloom_size(1000, 0.01) == (9586, 7)
    assert sinks.to_arrow(df).num_rows == 2 and sinks.from_arrow(spark, sinks.to_arrow(df)).count() == 2
    assert sinks.scrape("x", lambda _: "m 1") == ["m 1", "up 1"]
    assert sinks.scrape("x", lambda _: 1 / 0) == ["up 0"]


def test_ngrams_of_a_long_text(spark):
    """In one pass; walking a text from its start for each of its runs took minutes here."""
    assert one(spark, sinks.ngrams(F.col("c")), c="A\U0001f600\nB\u00e9") == ["a\U0001f600\n", "\U0001f600\nb", "\nb\u00e9"]
    spark.range(1, numPartitions=1).select(F.size(sinks.ngrams(F.lit("warm")))).collect()
    began = time.time()
    n = 500_000
    df = spark.range(1, numPartitions=1).select(F.repeat(F.lit("ab\u00e9D "), n // 5).alias("c"))
    assert df.select(F.size(sinks.ngrams(F.col("c"))).alias("n")).first().n == n - 2
    assert time.time() - began < 15


def test_token_index_skip(spark, tmp_path):
    """Rows without a file's name are a file, as they are in SQL."""
    rows = [("a", "the LiCense"), ("b", "no lice, no dense"), (None, "license"), (None, None)]
    spark.createDataFrame(rows, "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.file for r in QUERIES["token_index_skip"](spark, str(tmp_path)).collect()} == {"a", None}


# --- streaming ---------------------------------------------------------------------------------


def test_quick_pipeline(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.log").write_text("user 1 in\nuser 2 in\nother\n")
    p = pipeline.quick(str(src), lambda df, _: df.write.mode("append").parquet(out))
    q = pipeline.start(spark, p, str(tmp_path / "cp"), drain=True)
    q.awaitTermination(60)
    assert {r.template: r["count"] for r in spark.read.parquet(out).collect()} == {"user <*> in": 2, "other": 1}


def test_fan_out_policies(spark):
    seen = []

    def bad(df, epoch):
        raise ValueError

    good = pipeline.Branch("b", [pipeline.with_template("m")], lambda df, e: seen.append(df.count()))
    df = spark.createDataFrame([("x 1",)], "m string")
    pipeline.fan_out([pipeline.Branch("a", [], bad), good], "drop")(df, 0)
    assert seen == [1]
    with pytest.raises(ValueError):
        pipeline.fan_out([pipeline.Branch("a", [], bad), good])(df, 0)


def test_windows_on_stream(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-01 00:0{i}:30", float(i)) for i in range(6)], "t string, value double").select(F.col("t").cast("timestamp").alias("ts"), "value").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "s"))
    q = pipeline.event_windows(stream, "ts", "1 minute", "2 minutes").writeStream.format("memory").queryName("w_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("w_out").collect()) == [2, 2, 2]


def test_config():
    assert pipeline.parse_bytes("12MiB") == 12 << 20 and pipeline.parse_bytes("1.5 kb") == 1500
    assert pipeline.expand_env("${A}-${B:-x}", {"A": "1"}) == "1-x"
    with pytest.raises(KeyError):
        pipeline.expand_env("${NOPE}", {})


# --- alerts --------------------------------------------------------------------------------------


def test_alert_states(spark):
    rows = [("a", t * 60, 1.0) for t in (0, 1, 2, 5, 8, 9, 10, 11)] + [("b", 60, 1.0)]
    df = spark.createDataFrame(rows, "key string, t long, value double")
    out = alerts._islands(df, 0, 1200, 60, 120, 0).orderBy("key", "t").collect()
    assert [(r.t // 60, r.state) for r in out if r.key == "a"] == [(0, "pending"), (1, "pending"), (2, "firing"), (3, "resolved"), (5, "pending"), (8, "pending"), (9, "pending"), (10, "firing"), (11, "firing"), (12, "resolved")]
    assert [(r.t, r.state) for r in out if r.key == "b"] == [(60, "pending")]
    kept = alerts._islands(df, 0, 1200, 60, 120, 180).where("key = 'a'").orderBy("t").collect()
    assert [(r.t // 60, r.state) for r in kept if r.state != "pending"][:6] == [(2, "firing"), (3, "firing"), (4, "firing"), (5, "firing"), (6, "firing"), (7, "firing")]


def test_alert_extras(spark):
    rules = alerts.load_rules({"groups": [{"rules": [{"record": "x", "expr": "y"}, {"alert": "A", "expr": "up == 0", "for": "1m", "labels": {"sev": "x"}}]}]})
    assert [(r.alert, r.for_ms) for r in rules] == [("A", 60_000)]
    assert alerts.expand("{{ $labels.job }} is {{ $value }}", {"job": "api"}, 0.5) == "api is 0.5"
    s = spark.createDataFrame([("l", t * 60, 0, "firing", 1.0) for t in range(6)], "labels string, t long, active_at long, state string, value double")
    assert [r.t for r in alerts.resends(s, 60).orderBy("t").collect()] == [0, 120, 240]
    g = alerts.group(spark.createDataFrame([('a="1",b="2"', 0, 0, "firing", 1.0), ('a="1",b="3"', 10_000, 0, "firing", 1.0)], "labels string, t long, active_at long, state string, value double"), ["a"])
    assert [(r.group_key, r.flush, len(r.alerts)) for r in g.collect()] == [('a="1"', 30_000, 2)]
    p = alerts.payload("r", "http://x", {"a": "1"}, [{"labels": {"a": "1", "b": "2"}, "status": "firing"}, {"labels": {"a": "1", "b": "3"}, "status": "resolved"}])
    assert p["status"] == "firing" and p["commonLabels"] == {"a": "1"} and p["version"] == "4"


# --- limits and parameters -----------------------------------------------------------------------


@pytest.mark.parametrize("sql", [
    "SELECT Reflect('java.lang.System','getProperty','user.home') FROM v", "SELECT `reflect`('java.lang.System', 'getProperty', 'a') FROM v", "SELECT (SELECT max(jAva_method('a', 'b')) FROM v)",
    "SELECT * FROM v LATERAL VIEW explode(array(reflect('a', 'b'))) t AS x", "SELECT transform(array(1), x -> reflect('a', 'b')) FROM v", "WITH q AS (SELECT try_reflect('a', 'b') AS k FROM v) SELECT * FROM q",
    "SELECT k FROM v ORDER BY REFLECT('a', 'b')", "SELECT k FROM v WHERE k IN (SELECT reflect('a', 'b'))", "SELECT * FROM VALUES (reflect('a', 'b')) t(x)", "SELECT sum(k) OVER (PARTITION BY input_file_name()) FROM v",
    "SELECT system.builtin.reflect('a', 'b') FROM v", "SELECT * FROM python_worker_logs()", "SELECT * FROM w", "SELECT mine(k) FROM v", "SELECT CURRENT_USER() FROM v",
])
def test_sql_refuses_functions(spark, sql):
    spark.udf.register("mine", lambda x: x)
    spark.range(1).createOrReplaceTempView("w")
    with pytest.raises(sqlapi.SQLError):
        sqlapi.run_sql(spark, sql, {"v": spark.createDataFrame([(1,)], "k int")})


def test_sql_sessions(spark):
    """Queries with views of one name at a time read their own rows, and the caller's view stays."""
    spark.range(7).createOrReplaceTempView("metrics")
    frames = [sqlapi.run_sql(spark, "SELECT count(*) AS n FROM metrics", {"metrics": spark.range(n)}) for n in (2, 3)]
    assert [f.first().n for f in frames] == [2, 3] and spark.table("metrics").count() == 7
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: sqlapi.run_sql(spark, "SELECT count(*) AS n FROM metrics", {"metrics": spark.range(n)}).first().n, range(8)))
    assert got == list(range(8)) and spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false") == "false"
    spark.catalog.dropTempView("metrics")


def test_admission():
    a = limits.Admission(1, queue=1, wait=0.2)
    with a.place():
        with pytest.raises(limits.Busy, match="wait timeout"), a.place():
            pass
        held = threading.Thread(target=lambda: pytest.raises(limits.Busy, a.place().__enter__))
        held.start()
        while not a.waiting and held.is_alive():
            time.sleep(0.01)
        with pytest.raises(limits.Busy, match="queue full"), a.place():
            pass
        held.join()
    with a.place():
        pass
    assert a.counts == {"admitted": 2, "queue full": 1, "wait timeout": 2} and a.running == a.waiting == 0


def test_within_time(spark):
    slow = spark.range(0, 10**14, 1, 4).select(F.sum(F.sin("id")))
    began = time.monotonic()
    with pytest.raises(limits.QueryTimeout):
        limits.within_time(spark, slow.collect, 1)
    assert time.monotonic() - began < 30
    assert limits.within_time(spark, lambda: spark.range(3).count(), 60) == limits.within_time(spark, lambda: 3, None) == 3


def test_params():
    assert params.prom_time_ms("1.5") == 1500 and params.prom_time_ms("1704067200") == 1704067200000 and params.prom_time_ms("1e3") == 1_000_000
    assert params.prom_time_ms("2024-01-01T01:00:00.25+01:00") == 1704067200250 and params.prom_time_ms(" ", 7) == 7
    assert params.loki_time_ns("1704067200000000001") == 1704067200000000001 and params.loki_time_ns("1.0000000019") == 1_000_000_001
    assert params.loki_time_ns("-1.5") == -1_500_000_000 and params.loki_time_ns("2024-01-01T00:00:00Z") == 1704067200 * 10**9
    assert params.duration_ms("1m30s") == 90_000 and params.duration_ms("15") == 15_000 and params.duration_ms("0.5") == 500 and params.duration_ms("1.5h") == 5_400_000
    for f, bad in ((params.prom_time_ms, "yesterday"), (params.loki_time_ns, "2024-01-01"), (params.loki_time_ns, "1.x"), (params.duration_ms, ""), (params.duration_ms, "5 apples"), (params.prom_time_ms, "2024-13-01T00:00:00Z")):
        with pytest.raises(params.ParamError):
            f(bad)
    assert params.prom_range("0", None, "15s", 0, 60_000) == (0, 60_000, 15_000)
    for bad in (("0", "100000", "1s"), ("5", "1", "1s"), ("0", "1", "0")):
        with pytest.raises(params.ParamError):
            params.prom_range(*bad, 0, 0)


def test_registry():
    from tidemark.queries import ORACLES, QUERIES

    assert len(QUERIES) >= 100 and set(ORACLES) <= set(QUERIES)
    assert all(re.fullmatch(r"\w+", n) for n in QUERIES)
