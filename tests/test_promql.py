"""PromQL against hand-worked vectors."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import promql
from tidemark.plans.promql import evaluate
from tidemark.plans.promql.parse import Binary, PromQLError, Subquery, parse
from tidemark.queries import QUERIES

BASE = 1767225600000


@pytest.fixture(scope="module")
def metrics(spark):
    rows = []
    for i in range(4):
        t = BASE + i * 15_000
        rows += [("up", 'job="api",instance="a"', 1.0, t), ("up", 'job="api",instance="b"', 0.0, t), ("http_requests_total", 'job="api"', 10.0 * i, t)]
    rows += [("resets_total", "", v, BASE + i * 15_000) for i, v in enumerate([5.0, 9.0, 2.0, 6.0])]
    df = spark.createDataFrame(rows, "`__name__` string, labels string, value double, t long")
    return df.select("__name__", "labels", "value", F.lit(0).cast("long").alias("timestamp_ms"), F.timestamp_millis("t").cast("timestamp_ntz").alias("ts")).cache()


A, B, H = '__name__="up",instance="a",job="api"', '__name__="up",instance="b",job="api"', '__name__="http_requests_total",job="api"'


@pytest.mark.parametrize("copies", [32, 0])
@pytest.mark.parametrize(
    "expr, want",
    [
        ("up", {A: 1, B: 0}), ('up{instance="a"}', {A: 1}), ('up{instance=~"a|x"}', {A: 1}), ('up{nope=""}', {A: 1, B: 0}), ("1+1", {"": 2}), ("sum(up)", {"": 1}), ("count(up)", {"": 2}),
        ("rate(http_requests_total[1m])", {'job="api"': 0.5}), ("increase(http_requests_total[1m] offset 15s)", {'job="api"': 20}), ("increase(resets_total[1m])", {"": 10 * 60 / 45}), ("resets(resets_total[1m])", {"": 1}),
        ("max_over_time(http_requests_total[1m:15s])", {'job="api"': 30}), ("http_requests_total @ 1767225615", {H: 10}), ("topk(1, up)", {A: 1}), ("up == 0", {B: 0}), ("up == bool 0", {'instance="a",job="api"': 0, 'instance="b",job="api"': 1}),
        ("up and on(instance) up{instance=\"a\"}", {A: 1}), ("up unless on(instance) up{instance=\"a\"}", {B: 0}), ("up / on(job) group_left http_requests_total", {'instance="a",job="api"': 1 / 30, 'instance="b",job="api"': 0}),
        ('absent(nope{a="b"})', {'a="b"': 1}), ("absent(up)", {}), ("quantile(0.5, up)", {"": 0.5}), ("-up", {'instance="a",job="api"': -1, 'instance="b",job="api"': 0}), ("2 ^ 3 ^ 2", {"": 512}), ("-2 ^ 2", {"": -4}),
        ('label_replace(up, "x", "$1-y", "instance", "(.*)")', {'__name__="up",instance="a",job="api",x="a-y"': 1, '__name__="up",instance="b",job="api",x="b-y"': 0}), ('label_join(up, "x", "/", "job", "instance")', {'__name__="up",instance="a",job="api",x="api/a"': 1, '__name__="up",instance="b",job="api",x="api/b"': 0}),
        ("scalar(http_requests_total) + 1", {"": 31}), ('count_values("v", up)', {'v="0"': 1, 'v="1"': 1}), ("irate(http_requests_total[1m])", {'job="api"': 10 / 15}), ("deriv(http_requests_total[1m])", {'job="api"': 10 / 15}), ("predict_linear(http_requests_total[1m], 60)", {'job="api"': 70}),
        ("changes(http_requests_total[1m])", {'job="api"': 3}), ("mad_over_time(resets_total[1m])", {"": 2}), ("count_over_time(up[31s])", {'instance="a",job="api"': 3, 'instance="b",job="api"': 3}), ("avg_over_time(http_requests_total[1m])", {'job="api"': 15}), ("idelta(resets_total[1m])", {"": 4}), ("increase(resets_total[20s])", {"": 4 * 20 / 15}), ("last_over_time(up[1m])", {A: 1, B: 0}), ("clamp(http_requests_total, 1, 20)", {'job="api"': 20}), ("round(vector(2.5))", {"": 3}), ("timestamp(up) > bool 0", {'instance="a",job="api"': 1, 'instance="b",job="api"': 1}), ("hour()", {"": 0}), ("stddev(up)", {"": 0.5}), ("sum by (instance) (up) * 2", {'instance="a"': 2, 'instance="b"': 0}),
    ],
)
def test_instant(metrics, expr, want, copies, monkeypatch):
    monkeypatch.setattr(evaluate, "FEW_COPIES", copies)
    got = {r.metric: r.value for r in promql.query_instant(metrics, expr, BASE + 45_000).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_range_and_lookback(metrics):
    got = promql.query_range(metrics, "sum(up)", BASE - 15_000, BASE + 345_000, 15_000).collect()
    assert sorted(r.t for r in got) == list(range(BASE, BASE + 345_000, 15_000))  # (t - 5m, t]


def test_histogram_quantile(spark):
    """Labels are parsed by series, not by sample, and buckets without a bound are no buckets."""
    rows = [("h", f'job="{j}"{le}', v) for j, buckets in {"a": {',le="1"': 2.0, ',le="5"': 8.0, ',le="+Inf"': 10.0, ',le="x"': 99.0, "": 99.0}, "b": {"": 1.0, ',le="y"': 2.0}, "c": {',le="+Inf"': 1.0}, "d": {',le="1"': 1.0, ',le="2"': 1.0}}.items() for le, v in buckets.items()]
    m = spark.createDataFrame(rows, "`__name__` string, labels string, value double").withColumn("timestamp_ms", F.lit(0).cast("long")).withColumn("ts", F.timestamp_millis(F.lit(BASE)).cast("timestamp_ntz"))
    out = promql.query_instant(m, "histogram_quantile(0.5, h)", BASE)
    assert [(r.metric, r.value) for r in out.collect()] == [('job="a"', pytest.approx(1 + 4 * 3 / 6))]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x.split("(")[0] and "regexp" in x]


def test_histogram_of_events(spark, tmp_path):
    """Events are counted before buckets are made of them."""
    rows = [("x", v) for v in (0.5, 1.0, 9.0, 60.0, 200.0, float("inf"), float("nan"), None)] + [("none", None)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = QUERIES["prom_histogram_quantile"](spark, str(tmp_path))
    assert {r.metric: r.value for r in out.collect()}['type="x"'] == 100.0
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = {kind: max(i for i, x in enumerate(plan) if kind in x) for kind in ("Aggregate", "Generate")}
    assert last["Generate"] < last["Aggregate"]


def test_metadata(metrics):
    assert [r.label for r in promql.label_names(metrics, [], BASE, BASE + 60_000).collect()] == ["__name__", "instance", "job"]
    assert [r.label_value for r in promql.label_values(metrics, "instance", ["up"], BASE, BASE + 60_000).collect()] == ["a", "b"]
    assert promql.series(metrics, ["up", 'up{instance="a"}'], BASE, BASE).count() == 2


def test_errors(metrics):
    for bad in ["up[5m]", "{}", "sum(", "up +", 'up{a="b"', "1 and 2", "1 == 1", "rate(up)", "nope(up)"]:
        with pytest.raises(PromQLError):
            promql.query_instant(metrics, bad, BASE)
    with pytest.raises(PromQLError):
        promql.query_range(metrics, "up", 0, 20_000_000, 1)
    with pytest.raises(Exception, match="many-to-many"):
        promql.query_instant(metrics, "http_requests_total / on(job) up", BASE + 45_000).collect()


def test_tree():
    node = parse("a + b * c unless d")
    assert node.op == "unless" and node.left.op == "+" and node.left.right.op == "*"
    assert isinstance(parse("x[1h:5m] offset 1m"), Subquery) and isinstance(parse("a == bool 1"), Binary)
