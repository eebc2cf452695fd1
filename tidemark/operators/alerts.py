"""Alerting rules over PromQL: state machine, grouping, and the webhook payload."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import drop, parse_labels, render_labels, set_label
from ..plans.promql import query_range
from ..plans.promql.evaluate import LOOKBACK_MS
from ..plans.promql.parse import duration_ms


@dataclass
class Rule:
    alert: str
    expr: str
    for_ms: int = 0
    keep_firing_ms: int = 0
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)


def load_rules(config: dict) -> list[Rule]:
    """Alerting rules of parsed rule groups; recording rules are left out."""
    out = []
    for group in config.get("groups", []):
        for r in group.get("rules", []):
            if "alert" in r:
                out.append(Rule(r["alert"], r["expr"], duration_ms(r.get("for", "0s")), duration_ms(r.get("keep_firing_for", "0s")), dict(r.get("labels", {})), dict(r.get("annotations", {}))))
    return out


def expand(template: str, labels: dict[str, str], value: float) -> str:
    """{{ $value }} and {{ $labels.name }}."""
    text = re.sub(r"\{\{\s*\$labels\.([A-Za-z_]\w*)\s*\}\}", lambda m: labels.get(m[1], ""), template)
    return re.sub(r"\{\{\s*\$value\s*\}\}", f"{value:g}", text)


def _islands(df: DataFrame, start_ms: int, end_ms: int, step_ms: int, for_ms: int, keep_firing_ms: int) -> DataFrame:
    """(key, t, active, value, state) from the steps at which an expression has a value.

    A run of steps, with gaps of no more than keep_firing_ms once it fires, is one activity: pending until it
    has lasted for_ms, then firing; the step after a fired run is resolved. One window by series.
    """
    series = Window.partitionBy("key").orderBy("t")
    df = df.withColumn("gap", F.col("t") - F.lag("t").over(series))
    df = df.withColumn("run", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > step_ms), 1).otherwise(0)).over(series))
    runs = df.groupBy("key", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    # A gap within keep_firing_ms joins a run to the one before if that has fired by then; the start of a joined run is the earlier one's.
    runs = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))
    fired = f"x.b - x.a >= {for_ms}"
    merged = F.expr(
        f"aggregate(r, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, y) -> CASE WHEN size(acc) > 0 AND exists(slice(acc, -1, 1), x -> {fired} AND y.a - x.b <= {keep_firing_ms}) "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', y.b))) ELSE concat(acc, array(named_struct('a', y.a, 'b', y.b))) END)"
    )
    runs = runs.select("key", F.explode(merged).alias("m")).select("key", F.col("m.a").alias("active_at"), F.col("m.b").alias("last"))
    last = F.least(F.col("last") + F.when(F.col("last") - F.col("active_at") >= for_ms, keep_firing_ms).otherwise(0), F.lit(end_ms))
    last = last - F.pmod(last - start_ms, F.lit(step_ms))
    runs = runs.withColumn("until", F.greatest(last, F.col("last")))
    resolved = F.when((F.col("last") - F.col("active_at") >= for_ms) & (F.col("until") + step_ms <= end_ms), F.col("until") + step_ms)
    steps = runs.withColumn("resolved", resolved).withColumn("t", F.explode(F.sequence("active_at", F.coalesce("resolved", "until"), F.lit(step_ms))))
    state = F.when(F.col("t") == F.col("resolved"), "resolved").when(F.col("t") - F.col("active_at") >= for_ms, "firing").otherwise("pending")
    return steps.select("key", "t", "active_at", state.alias("state")).join(df.select("key", "t", "value"), ["key", "t"], "left")


def number_text(v: Column) -> Column:
    """A number as templates write it: whole ones without a point."""
    return F.when((F.abs(v) < 1e15) & (v == F.floor(v)), F.floor(v).cast("string")).otherwise(v.cast("string"))


def expand_column(template: str, labels: Column, value: Column) -> Column:
    """expand() over columns; an unknown label is empty, any other {{ .. }} gives <template error> as a whole."""
    parts = re.split(r"(\{\{.*?\}\})", template)
    out = []
    for p in parts:
        m = re.fullmatch(r"\{\{\s*(?:\$labels\.([A-Za-z_]\w*)|(\$value))\s*\}\}", p)
        if m:
            out.append(F.coalesce(labels[m[1]], F.lit("")) if m[1] else F.coalesce(number_text(value), F.lit("")))
        elif p.startswith("{{"):
            return F.lit("<template error>")
        elif p:
            out.append(F.lit(p))
    return F.concat(*out) if out else F.lit("")


def evaluate(metrics: DataFrame, rule: Rule, start_ms: int, end_ms: int, step_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """(alert labels, t, active_at, state, value, annotations) at each evaluation: pending, firing or resolved; a run that never fired ends without a word.

    Labels and annotations of the rule may hold {{ $value }} and {{ $labels.name }}; annotations are label text. A label with $value would
    make an alert of each value, so only annotations are filled in at each evaluation, and labels where the series' own labels allow it. A scalar
    result is one series without labels.
    """
    v = query_range(metrics, rule.expr, start_ms, end_ms, step_ms, lookback_ms)
    own = drop(parse_labels(F.col("metric")), ["__name__"])
    labels = own
    for k, x in sorted(rule.labels.items()):
        labels = set_label(labels, k, expand_column(x, own, F.col("value")))
    labels = set_label(labels, "alertname", F.lit(rule.alert))
    df = v.select(render_labels(labels).alias("key"), "t", "value")
    out = _islands(df, start_ms, end_ms, step_ms, rule.for_ms, rule.keep_firing_ms).select(F.col("key").alias("labels"), "t", "active_at", "state", "value")
    own = parse_labels(F.col("labels"))
    notes = [F.struct(F.lit(k).alias("key"), expand_column(x, own, F.col("value")).alias("value")) for k, x in sorted(rule.annotations.items())]
    return out.withColumn("annotations", render_labels(F.map_from_entries(F.array(*notes))) if notes else F.lit(""))


def evaluate_all(rules: list[Rule], run: Callable[[Rule], DataFrame], previous: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """States of each rule by its name, and what failed. A rule whose query fails keeps its states of before, so that nothing resolves by a failure."""
    states, failed = dict(previous or {}), {}
    for r in rules:
        try:
            got = run(r)
            got.schema  # analysis errors show here
            states[r.alert] = got
        except (ValueError, PySparkException) as e:
            failed[r.alert] = str(e).splitlines()[0]
    return states, failed


def resends(states: DataFrame, delay_ms: int) -> DataFrame:
    """Firing and resolved rows that are sent: the first of a state, then one as soon as more than delay_ms passed since the last one sent.

    Evaluations are evenly spaced, so the sends of a state are every (delay div step + 1)-th of its steps.
    """
    w = Window.partitionBy("labels", "active_at", "state").orderBy("t")
    df = states.where("state <> 'pending'").withColumn("nth", F.row_number().over(w) - 1).withColumn("step", F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w), F.lit(1)))
    return df.where(F.col("nth") % (F.floor(F.lit(delay_ms) / F.col("step")) + 1) == 0).drop("nth", "step")


def group(states: DataFrame, by: list[str], wait_ms: int = 30_000, interval_ms: int = 300_000, repeat_ms: int = 14_400_000) -> DataFrame:
    """Alerts by the labels in `by`: the first notice after wait_ms, then at most one each interval_ms that brings something new, or each repeat_ms."""
    labels = parse_labels(F.col("labels"))
    key = render_labels(F.map_filter(labels, lambda k, _: k.isin(by) if by else F.lit(False)))
    df = states.where("state <> 'pending'").withColumn("group_key", key)
    first = df.groupBy("group_key").agg(F.min("t").alias("first"))
    df = df.join(first, "group_key")
    due = F.col("first") + wait_ms + F.ceil(F.greatest(F.col("t") - F.col("first") - wait_ms, F.lit(0)) / interval_ms) * interval_ms
    flush = df.withColumn("flush", due.cast("long")).groupBy("group_key", "flush").agg(F.array_sort(F.collect_set(F.struct("labels", "state"))).alias("alerts"))
    w = Window.partitionBy("group_key").orderBy("flush")
    changed = F.lag("alerts").over(w).isNull() | (F.lag("alerts").over(w) != F.col("alerts"))
    return flush.withColumn("new", changed).where(F.col("new") | (F.pmod(F.col("flush"), F.lit(repeat_ms)) < interval_ms)).drop("new")


def common(maps: list[dict[str, str]]) -> dict[str, str]:
    """Entries that all have."""
    if not maps:
        return {}
    return {k: v for k, v in maps[0].items() if all(m.get(k) == v for m in maps[1:])}


def payload(receiver: str, external_url: str, group_labels: dict[str, str], alerts: list[dict], truncated: int = 0) -> dict:
    """A version-4 webhook body of one group's alerts (each with labels, annotations, status, startsAt, endsAt, generatorURL, fingerprint)."""
    alerts = sorted(alerts, key=lambda a: sorted(a["labels"].items()))
    firing = any(a["status"] == "firing" for a in alerts)
    key = "{}:{" + ", ".join(f'{k}="{v}"' for k, v in sorted(group_labels.items())) + "}"
    return {
        "version": "4", "groupKey": key, "truncatedAlerts": truncated, "status": "firing" if firing else "resolved", "receiver": receiver, "groupLabels": group_labels,
        "commonLabels": common([a["labels"] for a in alerts]), "commonAnnotations": common([a.get("annotations", {}) for a in alerts]), "externalURL": external_url, "alerts": alerts,
    }
