"""A tenant's store end to end, and the scraping source."""

import io
import os
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.parsers import parse_exposition, parse_scrape
from tidemark.limits import Admission, Busy
from tidemark.model import INGEST_NS
from tidemark.operators.lifecycle import Materialization, Merge
from tidemark.sources.files import Files
from tidemark.sources import sinks
from tidemark.sources.scrape import ScrapeReader, ScrapeSource
from tidemark.sources.tail import TailReader, register
from tidemark.store import Store, exposition, reconcile, widest
from tidemark.plans.promql import parse
from tidemark.queries_engine import store_logql

T = 1_704_067_200.0


def test_store(spark, tmp_path):
    now = [T]
    s = Store(spark, str(tmp_path), "acme", clock=lambda: now[0])
    schema = "`__name__` string, labels string, value double, timestamp_ms long"
    for i in range(3):
        now[0] = T + i * 15
        assert s.ingest_metrics(spark.createDataFrame([("up", 'job="a"', float(i), 0)], schema)) == 1
    assert s.ingest_metrics(spark.createDataFrame([], schema)) == 0
    ms = int(T * 1000)
    got = s.promql("sum(up)", ms, ms + 30_000, 15_000).orderBy("t").collect()
    assert [r.value for r in got] == [0, 1, 2]
    s.snapshot()
    assert s.metrics().count() == 3 and len(s.opened(ms, ms + 60_000, auto_hot=True)) == 1
    assert s.roll().tier == 0 and s.metrics().count() == 3
    now[0] = T + 100
    s.ingest_metrics(spark.createDataFrame([("up", 'job="a"', 9.0, 0)], schema))
    s.roll()
    assert s.compact(least=2) is None  # 70 s apart, but 30 s long
    merged = s.compact(queue=[Merge(tuple(s.segments(s.state["metrics"])), 1)])
    assert merged.tier == 1 and s.metrics().count() == 4 and s.rollups("1m").count() == 2
    assert s.range("2024-01-01 00:00:00", "2024-01-01 00:00:20").count() == 2
    assert s.sql("SELECT count(*) AS n FROM metrics").first().n == 4
    assert s.materialize("by-name", "SELECT __name__, count(*) AS n FROM merge_output GROUP BY 1")
    assert len(s.purge(0)) == 7 and s.metrics().count() == 4  # 4 hot windows, a snapshot, 2 segments
    s.land_logs("logs-raw", spark.createDataFrame([("disk full", "none")], "message string, format string"))
    assert s.logs().count() == 0
    now[0] += 120
    assert s.refresh("logs-raw") == 1 and s.logs().count() == 1
    assert s.logql('{job="tidemark"} |= "disk"').count() == 1
    assert {(r.label, r.label_value) for r in s.label_index().collect()} == {("job", "tidemark"), ("format", "none")}
    assert s.stats()["metrics"]["segments"] == 1
    again = Store(spark, str(tmp_path), "acme", clock=lambda: now[0])
    again_rollups = again.state["rollups"]
    now[0] += 1
    assert again.metrics().count() == 4 and again.expire(0) == 1 + len(again_rollups) + 1
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), "../x")


SCHEMA = "`__name__` string, labels string, value double, timestamp_ms long"


def folders(root):
    """Folders with Parquet files."""
    return {d for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def known(s):
    st = s.state
    rows = [*st["metrics"], *st["hot"], *([st["snapshot"]] if st["snapshot"] else []), *(r for p in (st["logs"], st["landing"], st["rollups"], st["materialized"], st["buffered"]) for x in p.values() for r in x)]
    return {r["path"] for r in rows} | set(st["retired"]) | ({st["index"]} if st["index"] else set())


def test_lifecycle(spark, tmp_path):
    now = [T]
    s = Store(spark, str(tmp_path / "hot"), "acme", clock=lambda: now[0], cold_root=str(tmp_path / "cold"))
    per_name = Materialization("per-name", "SELECT __name__, count(*) AS n FROM merge_output GROUP BY 1")
    never = Materialization("never", "SELECT nothing FROM merge_output")
    late = Materialization("late", "SELECT count(*) AS n FROM merge_input", min_tier=2)
    for i in range(4):
        for j in range(2):
            now[0] = T + i * 60 + j * 50
            s.ingest_metrics(spark.createDataFrame([("up", 'job="a"', float(i), 0)], SCHEMA))
        s.roll()
        if i % 2:
            m = s.compact(least=2, materializations=[per_name, never, late])
            assert m.tier == 1 and s.rollups("1m").agg({"count": "sum"}).first()[0] == 4 * (i // 2 + 1)
    assert s.sql("SELECT sum(n) AS n FROM mat_per_name").first().n == 8 and "never" not in s.state["materialized"]
    m = s.compact(least=2, materializations=[per_name, never, late])
    assert m.tier == 2 and s.metrics().count() == 8
    # A second merge counts no row twice.
    assert s.rollups("1m").agg({"count": "sum"}).first()[0] == 8 and s.sql("SELECT sum(n) AS n FROM mat_per_name").first().n == 8
    assert s.sql("SELECT max(n) AS n FROM mat_late").first().n == 8
    assert folders(tmp_path / "hot") <= known(s)
    s.land_logs("logs-raw", spark.createDataFrame([("disk full", "none")], "message string, format string"))
    now[0] += 3600
    assert s.refresh("logs-raw") == 1 and s.land_logs("logs-raw", spark.createDataFrame([], "message string, format string")) is None
    s.purge(0)
    assert folders(tmp_path / "hot") == {p for p in known(s) if folders(p)} and s.metrics().count() == 8 and s.logs().count() == 1
    # Cold storage: copied, checked, and read from there.
    now[0] += 13 * 3600
    moved = s.promote()
    assert [x.tier for x in moved] == [2] and moved[0].path.startswith(str(tmp_path / "cold")) and s.metrics().count() == 8 and s.promote() == []
    assert not [d for d in folders(tmp_path / "cold") if d.endswith(".tmp")]
    for _ in range(3):
        s.land_logs("logs-raw", spark.createDataFrame([("x", "none")], "message string, format string"))
    assert s.expire(most_landing=1) == 2 and len(s.state["landing"]["logs-raw"]) == 1
    now[0] += 16 * 86_400
    assert s.expire() == 1 + len(s.state["rollups"]) + 2
    assert s.metrics().count() == 0 and s.logs().count() == 0 and not any(s.state["rollups"].values())
    s.purge(0)
    assert folders(tmp_path) == {r["path"] for x in s.state["materialized"].values() for r in x} | {s.state["index"]}


def test_failed_promotion(spark, tmp_path, monkeypatch):
    now = [T]
    s = Store(spark, str(tmp_path / "hot"), "acme", clock=lambda: now[0], cold_root=str(tmp_path / "cold"))
    s.ingest_metrics(spark.createDataFrame([("up", 'job="a"', 1.0, 0)], SCHEMA))
    s.roll()
    s.compact(queue=[Merge(tuple(s.segments(s.state["metrics"])), 1)])
    now[0] += 86_400
    sizes = iter(range(100))
    with monkeypatch.context() as m:
        m.setattr(Files, "size", lambda self, path: next(sizes))
        assert s.promote() == []
    assert s.metrics().count() == 1 and folders(tmp_path / "cold") == set() and len(s.promote()) == 1


def test_vanished_files(spark, tmp_path):
    s = Store(spark, str(tmp_path), "acme", clock=lambda: T)
    for _ in range(2):
        s.ingest_metrics(spark.createDataFrame([("up", 'job="a"', 1.0, 0)], SCHEMA))
    df = s.metrics()
    shutil.rmtree(s.state["hot"][0]["path"])
    assert df.count() == 1 and s.metrics().count() == 1


def test_store_logql_counts_all(spark, tmp_path):
    """More rows than the limit of one LogQL query."""
    n = 9_000
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("MIT License").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("user",)], "role string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = store_logql(spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [("en", n // 3 * 2)] and out.columns == ["format", "n"]


def test_log_pruning(spark, tmp_path):
    now = [T]
    s = Store(spark, str(tmp_path), "acme", clock=lambda: now[0])
    ns = int(T) * 10**9
    for day in range(3):
        s.land_logs("logs-raw", spark.createDataFrame([(f"line {day}", f"f{day}", ns + day * 86_400 * 10**9)], f"message string, format string, {INGEST_NS} long"))
        now[0] = T + day * 86_400 + 120
        s.refresh("logs-raw")
    files = lambda df: len(df.inputFiles())
    day = 86_400_000
    assert files(s.logs()) == 3 and files(s.logs(None, int(T * 1000) + 2 * day, None)) == 1
    query = "{format=~\"f.*\"}"
    assert s.logql(query).count() == 3 and s.logql(query, ns + 86_400 * 10**9, ns + 2 * 86_400 * 10**9).count() == 1
    assert s.logql(query, lookback_ms=day + 200_000).count() == 2  # an open start looks back from now
    assert [r.label_value for r in s.log_label_values("format").collect()] == ["f0", "f1", "f2"]
    assert [r.label_value for r in s.log_label_values("format", None, ns + 86_400 * 10**9).collect()] == ["f1", "f2"]


def test_sql_page(spark, tmp_path):
    s = Store(spark, str(tmp_path), "acme", clock=lambda: T, admission=Admission(1))
    for i in range(3):
        s.ingest_metrics(spark.createDataFrame([("up", 'job="a"', float(i), 0)], SCHEMA))
    rows, truncated = s.sql_page("SELECT value FROM metrics ORDER BY value", 2)
    assert [r.value for r in rows] == [0, 1] and truncated and s.stats()["queries"]["admitted"] == 1
    with s.admission.place(), pytest.raises(Busy):
        s.sql_page("SELECT 1")


def test_buffered_logs(spark, tmp_path):
    now = [T]
    s = Store(spark, str(tmp_path), "acme", clock=lambda: now[0])
    one = spark.createDataFrame([("a",)], "message string")
    two = spark.createDataFrame([("b", "json")], "message string, format string")
    assert s.buffer_logs("logs-raw", one, most_rows=3) is None and s.buffer_logs("logs-raw", one.limit(0), most_rows=3) is None
    assert s.buffer_logs("logs-raw", two, most_rows=3) is None
    path = s.buffer_logs("logs-raw", one, most_rows=3)
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [("a", None), ("a", None), ("b", "json")] and len(s.state["landing"]["logs-raw"]) == 1
    assert s.buffer_logs("logs-raw", one) is None
    now[0] += 31
    assert s.buffer_logs("logs-raw", one) and s.flush_logs("logs-raw") is None
    assert folders(tmp_path) <= known(s)


def test_rebuild(spark, tmp_path):
    now = [T]
    s = Store(spark, str(tmp_path / "hot"), "acme", clock=lambda: now[0], cold_root=str(tmp_path / "cold"))
    for i in range(3):
        now[0] = T + i * 10
        s.ingest_metrics(spark.createDataFrame([("up", "", float(i), 0)], SCHEMA))
        s.roll()
    s.compact(queue=[Merge(tuple(s.segments(s.state["metrics"][:2])), 1)])
    s.land_logs("logs-raw", spark.createDataFrame([("x",)], "message string"))
    now[0] += 86_400
    s.refresh("logs-raw")
    s.promote()
    s.purge(0)
    before = sorted((r["tier"], r["path"], r["min_ts"], r["max_ts"]) for r in s.state["metrics"])
    with pytest.raises(ValueError):
        s.rebuild()
    os.remove(s.catalog)
    again = Store(spark, str(tmp_path / "hot"), "acme", clock=lambda: now[0], cold_root=str(tmp_path / "cold"))
    assert again.metrics().count() == 0 and again.rebuild() == 3
    assert sorted((r["tier"], r["path"], r["min_ts"], r["max_ts"]) for r in again.state["metrics"]) == before and again.metrics().count() == 3 and again.logs().count() == 1
    text = spark.createDataFrame([(x,) for x in exposition(again.stats(), "acme")], "value string")
    got = {(r["__name__"], r.labels): r.value for r in parse_exposition(text).collect()}
    assert got["tidemark_segments", 'plane="metrics",tenant="acme"'] == 2 and got["tidemark_queries_total", 'result="admitted",tenant="acme"'] == 0


def test_widest():
    assert widest(parse("rate(x[1h] offset 10m)")) == 300_000 + 3_600_000 + 600_000
    assert widest(parse("max_over_time(rate(x[5m])[1h:1m]) + y")) == 300_000 + 300_000 + 3_600_000


def test_reconcile(spark):
    raw = spark.range(5)
    assert reconcile(raw, raw, spark.createDataFrame([(2,), (3,)], "count long")) == {"written": True, "summaries": True}


def test_scrape_reader(spark):
    r = ScrapeReader({"targets": "http://127.0.0.1:1/metrics", "interval": "15", "labels": "env=x"})
    start = r.initialOffset()
    parts = r.partitions(start, r.latestOffset())
    rows = [next(iter(r.read(p))) for p in parts]
    assert [x[:3] for x in rows] == [("up 0", "127.0.0.1:1", 'env="x"')]
    assert r.partitions({"round": 5}, {"round": 5}) == [] and ScrapeSource.name() == "scrape"
    lines = [("# HELP x", "h:1", 'env="x",job="j"', 7), ('m{job="own",a="1"} 2', "h:1", 'env="x",job="j"', 7), ("n 3 99", "h:1", "", 7), ("bad line here", "h:1", "", 7)]
    out = parse_scrape(spark.createDataFrame(lines, "value string, instance string, labels string, scraped_ms long"))
    assert sorted(map(tuple, out.collect())) == [("m", 'a="1",env="x",instance="h:1",job="own"', 2.0, 7), ("n", 'instance="h:1"', 3.0, 99)]


def test_access(monkeypatch):
    seen = []
    monkeypatch.setattr(sinks.urllib.request, "urlopen", lambda req, timeout, context: seen.append((req.headers.get("Authorization"), context)) or io.BytesIO(b"x 1"))
    assert sinks.fetch("http://h/m", {"token": "t"}) == "x 1" and sinks.scrape("http://h/m") == ["x 1", "up 1"]
    sinks.fetch("https://h/m", {"user": "u", "password": "p", "insecure": "true"})
    assert [a for a, _ in seen] == ["Bearer t", None, "Basic dTpw"] and seen[0][1] is None and seen[2][1].verify_mode == 0


def test_tail(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\nhal")
    r = TailReader({"path": str(tmp_path / "*.log")})
    read = lambda a, b: [x[0] for p in r.partitions(a, b) for x in r.read(p)]
    first = r.latestOffset()
    assert read(r.initialOffset(), first) == ["one", "two"]
    with path.open("a") as f:
        f.write("f\r\n")
    (tmp_path / "b.log").write_text("other\n")
    second = r.latestOffset()
    assert read(first, second) == ["half", "other"] and read(second, second) == []
    path.write_text("new\n")  # shorter than before
    assert read(second, r.latestOffset()) == ["new"]
    assert TailReader({"path": str(tmp_path / "*.log"), "from": "end"}).initialOffset() == r.latestOffset()
    register(spark)
    q = spark.readStream.format("tail").option("path", str(tmp_path / "*.log")).load().writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        with path.open("a") as f:
            f.write("more\n")
        q.processAllAvailable()
        assert sorted(x.value for x in spark.table("tailed").collect()) == ["more", "new", "other"]
    finally:
        q.stop()


def test_windows_of_input(spark, tmp_path):
    sizes = [[r.value for r in w.collect()] for w in sinks.piped_lines(spark, ["a\n", "bb\r\n", "ccc\n", "d"], most_lines=2)]
    assert sizes == [["a", "bb"], ["ccc", "d"]]
    assert [w.count() for w in sinks.piped_lines(spark, ["aaaa\n"] * 5, most_bytes=8)] == [2, 2, 1] and list(sinks.piped_lines(spark, [])) == []
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    table = df.toArrow()
    with pa.OSFile(str(tmp_path / "w.bin"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(str(tmp_path / "w.json"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:  # the name doesn't count
        w.write_table(table)
    (tmp_path / "w.parquet").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    df.write.parquet(str(tmp_path / "folder"))
    for name in ("w.bin", "w.json", "w.parquet", "lines.json", "folder"):
        assert sorted(map(tuple, sinks.import_window(spark, str(tmp_path / name)).collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "text").write_text("plain\n")
    assert [r.value for r in sinks.import_window(spark, str(tmp_path / "text")).collect()] == ["plain"]
    assert sinks.json_array(df.where("a = 2")).first().value == '[{"a":2,"b":"y"}]' and sinks.json_array(df.limit(0)).first().value == "[]"
    out = io.StringIO()
    sinks.console(out, 1)(df.orderBy("a"), 0)
    assert out.getvalue() == '{"a":1,"b":"x"}\n... 1 more\n'
