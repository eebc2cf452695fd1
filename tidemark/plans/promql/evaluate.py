"""Lowering of PromQL to DataFrames.

A vector is a DataFrame (k, labels, v): k counts the steps of the evaluation grid. A
whole expression becomes one plan: samples are dealt to the steps that they serve by an
explode over integers, not by a range join, and every operator is a shuffle by
(labels, k) with partial aggregation, so series spread over the cluster. Functions of the ends of a range (rate, changes,
last and the like) copy no sample: cumulative columns of a series are looked up at the two ends of each step's window. Sums, means and
extremes are taken by slices of a range before they are dealt out. One series is one window's key, and so one task's work there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.labels import drop, keep, matches, parse_labels, render_labels, set_label
from ...model import ms_of
from .parse import Aggregate, Binary, Call, Negate, Number, PromQLError, Selector, String, Subquery, parse

LOOKBACK_MS, MAX_POINTS = 300_000, 11_000
#: Steps that a sample may be copied to.
FEW_COPIES = 32
_NAME = "__name__"


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def at(self, k: Column) -> Column:
        return F.lit(self.start) + k.cast("long") * F.lit(self.step)


@dataclass
class Vector:
    df: DataFrame


@dataclass
class Samples:
    """(labels, t, v) and the window that ends at `end_of(k)` and spans range_ms."""

    df: DataFrame
    range_ms: int
    shift: int
    fixed: int | None


@dataclass
class Scalar:
    """A column over k, with the frame (k, s) that it needs, if any."""

    col: Column
    df: DataFrame | None = None


def _key(labels: Column) -> Column:
    # Never null, so that joins put no filter on it, which would be pushed down to the samples and parse the labels of each.
    return F.coalesce(render_labels(labels), F.lit(""))


class Evaluator:
    def __init__(self, metrics: DataFrame, lookback_ms: int = LOOKBACK_MS):
        self.metrics = metrics
        self.spark = metrics.sparkSession
        self.lookback = lookback_ms
        self.outer: Grid | None = None

    # --- leaves --------------------------------------------------------------

    def steps(self, g: Grid) -> DataFrame:
        return self.spark.range(g.last + 1).select(F.col("id").cast("int").alias("k"))

    def samples(self, s: Selector, low: int, high: int) -> DataFrame:
        """(name, labels text, t, v) with low < t <= high; time and name reach the scan."""
        df = self.metrics
        stamp = lambda ms: F.timestamp_micros(F.lit(ms * 1000)).cast("timestamp_ntz")
        df = df.where((F.col("ts") >= stamp(low)) & (F.col("ts") < stamp(high + 1)))
        if s.name is not None:
            df = df.where(F.col(_NAME) == s.name)
        for label, op, value in s.matchers:
            df = df.where(matches(F.col(_NAME) if label == _NAME else parse_labels(F.col("labels"))[label], op, value))
        return df.select(F.col(_NAME).alias("name"), F.coalesce("labels", F.lit("")).alias("text"), ms_of(F.col("ts")).alias("t"), F.col("value").alias("v")).where(F.col("t") > low)

    def window(self, node, g: Grid) -> tuple[Grid, int, int | None]:
        """(grid of the steps to look at, shift, fixed instant)."""
        if node.at is None:
            return g, node.offset_ms, None
        at = {"start": self.outer.start, "end": self.outer.end}.get(node.at, node.at)
        return Grid(at - node.offset_ms, at - node.offset_ms, 1), 0, at - node.offset_ms

    @staticmethod
    def deal(df: DataFrame, g: Grid, shift: int, span: int) -> DataFrame:
        """One row for each step k whose window (end - span, end], end = at(k) - shift, holds the sample."""
        begin, step = g.start - shift, F.lit(g.step)
        k0 = F.greatest(F.ceil((F.col("t") - begin) / step), F.lit(0)).cast("int")
        k1 = F.least(F.ceil((F.col("t") + span - begin) / step) - 1, F.lit(g.last)).cast("int")
        return df.withColumn("k0", k0).withColumn("k1", k1).where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1"))).drop("k0", "k1")

    def spread(self, df: DataFrame, g: Grid) -> DataFrame:
        """A result at one instant, at each step."""
        return df.drop("k").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(g.last)))) if g.last else df

    def instant(self, s: Selector, g: Grid, with_time: bool = False) -> DataFrame:
        inner, shift, fixed = self.window(s, g)
        df = self.deal(self.samples(s, inner.start - shift - self.lookback, inner.end - shift), inner, shift, self.lookback)
        df = df.groupBy("name", "text", "k").agg(F.max(F.struct("t", "v")).alias("m"))
        df = df.select("k", set_label(parse_labels(F.col("text")), _NAME, F.col("name")).alias("labels"), F.col("m.v").alias("v"), *([(F.col("m.t") / 1000).alias("at")] if with_time else []))
        return self.spread(df, g) if fixed is not None else df

    def ranged(self, node, g: Grid) -> tuple[DataFrame, Grid, int, int, int | None]:
        """Rows (k, id columns, t, v, pv, pt) of each window with the sample before in the series; ids, grid, shift, span, fixed."""
        if isinstance(node, Selector) and node.range_ms is not None:
            inner, shift, fixed = self.window(node, g)
            df = self.samples(node, inner.start - shift - node.range_ms, inner.end - shift).groupBy("name", "text", "t").agg(F.max("v").alias("v"))
            ids = ["name", "text"]
        elif isinstance(node, Subquery):
            inner, shift, fixed = self.window(node, g)
            step = node.step_ms or 60_000
            low = inner.start - shift - node.range_ms
            first = (low // step + 1) * step
            last = (inner.end - shift) // step * step
            if last < first:
                last = first
            sub = Grid(first, last, step)
            df = self.vector(node.expr, sub).df
            df = df.select(_key(F.col("labels")).alias("text"), F.lit("").alias("name"), sub.at(F.col("k")).alias("t"), "v")
            ids = ["name", "text"]
        else:
            raise PromQLError("expected a range vector")
        w = Window.partitionBy(*ids).orderBy("t")
        df = df.withColumn("pv", F.lag("v").over(w)).withColumn("pt", F.lag("t").over(w))
        return df, inner, shift, node.range_ms, fixed

    @staticmethod
    def ends(df: DataFrame, g: Grid, shift: int, span: int) -> DataFrame:
        """(name, text, k, f, l): the first and last sample in each window that has one, with what the series has summed up until each.

        A sample (t, v, pt, pv) also holds its rank and the sums of drops, of falls and of changes. Two marks of a step, at its window's end and
        start, find the last sample before them in one pass over the series in time order; the first in the window is the one after the latter.
        """
        ids = ["name", "text"]
        w = Window.partitionBy(*ids).orderBy("t")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fell = F.col("pv") > F.col("v")
        total = lambda c: F.sum(F.when(c[0], c[1]).otherwise(0.0)).over(upto)
        sample = F.struct("t", "v", "pt", "pv", F.row_number().over(w).alias("rank"), total((fell, F.col("pv"))).alias("drops"), total((fell, F.lit(1.0))).alias("falls"), total((F.col("pv") != F.col("v"), F.lit(1.0))).alias("turns"))
        rows = df.select(*ids, "t", sample.alias("s"))
        if span <= FEW_COPIES * g.step:  # a sample serves few steps: dealing it out is cheaper than a second pass over the series
            return Evaluator.deal(rows, g, shift, span).groupBy(*ids, "k").agg(F.min("s").alias("f"), F.max("s").alias("l"))
        rows = rows.select(*ids, "t", "s", F.lead("s").over(w).alias("next"))
        begin, step = g.start - shift, F.lit(g.step)
        k0 = F.greatest(F.ceil((F.min("t") - begin) / step), F.lit(0)).cast("int")
        k1 = F.least(F.ceil((F.max("t") + span - begin) / step) - 1, F.lit(g.last)).cast("int")
        series = rows.groupBy(*ids).agg(F.min_by("s", "t").alias("first"), k0.alias("k0"), k1.alias("k1")).where("k0 <= k1")
        marks = series.select(*ids, "first", F.explode(F.sequence("k0", "k1")).alias("k")).withColumn("end", F.lit(begin) + F.col("k").cast("long") * step)
        marks = marks.select(*ids, "first", "k", F.explode(F.array(F.struct(F.col("end").alias("t"), F.lit(True).alias("is_end")), F.struct((F.col("end") - span).alias("t"), F.lit(False).alias("is_end")))).alias("m")).select(*ids, "first", "k", "m.*")
        both = rows.unionByName(marks, allowMissingColumns=True)
        order = Window.partitionBy(*ids).orderBy("t", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("before", F.last(F.when(F.col("k").isNull(), F.struct("s", "next")), ignorenulls=True).over(order)).where("k is not null")
        last = F.when(F.col("is_end"), F.col("before.s"))
        first = F.when(~F.col("is_end"), F.when(F.col("before").isNull(), F.col("first")).otherwise(F.col("before.next")))
        return both.groupBy(*ids, "k").agg(F.max(first).alias("f"), F.max(last).alias("l")).where("f.rank <= l.rank")

    @staticmethod
    def slices(df: DataFrame, g: Grid, shift: int, span: int) -> DataFrame:
        """(name, text, t, n, total, low, high) of slices that no window's end cuts; t is the end of the slice."""
        begin, width = g.start - shift, math.gcd(g.step, span)
        t = (F.lit(begin) + F.ceil((F.col("t") - begin) / F.lit(width)) * F.lit(width)).cast("long")
        v = F.col("v")
        return df.groupBy("name", "text", t.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))

    # --- functions over ranges -------------------------------------------------

    def over_range(self, name: str, args: list, g: Grid) -> Vector:
        at = 1 if name == "quantile_over_time" else 0
        node = args[at]
        df, inner, shift, span, fixed = self.ranged(node, g)
        t, v, n, by = F.col("t"), F.col("v"), F.count(F.lit(1)), ["name", "text", "k"]
        end = (inner.at(F.col("k")) - shift).cast("double")
        dealt = lambda rows=df: self.deal(rows, inner, shift, span)
        ends = lambda: self.ends(df, inner, shift, span)
        kind = name.removesuffix("_over_time")
        if kind != name and kind in ("sum", "avg", "min", "max"):
            value = {"sum": F.sum("total"), "avg": F.sum("total") / F.sum("n"), "min": F.min("low"), "max": F.max("high")}[kind]
            out = dealt(self.slices(df, inner, shift, span)).groupBy(*by).agg(value.alias("v"))
        elif kind != name and kind in ("count", "last", "present"):
            value = {"count": (F.col("l.rank") - F.col("f.rank") + 1).cast("double"), "last": F.col("l.v"), "present": F.lit(1.0)}[kind]
            out = ends().select(*by, value.alias("v"))
        elif kind != name and kind in ("stddev", "stdvar", "quantile"):
            value = {"stddev": F.stddev_pop(v), "stdvar": F.var_pop(v)}[kind] if kind != "quantile" else self.quantile(v, self.constant(args[0]))
            out = dealt().groupBy(*by).agg(value.alias("v"))
        elif name == "mad_over_time":
            rows = dealt()
            middle = rows.groupBy(*by).agg(F.median(v).alias("middle"))
            out = rows.join(middle, by).groupBy(*by).agg(F.median(F.abs(v - F.col("middle"))).alias("v"))
        elif name in ("changes", "resets"):
            c = "turns" if name == "changes" else "falls"
            out = ends().select(*by, (F.col(f"l.{c}") - F.col(f"f.{c}")).alias("v"))
        elif name in ("irate", "idelta"):
            out = ends().where(F.col("l.rank") > F.col("f.rank"))
            gap = (F.col("l.t") - F.col("l.pt")) / 1000
            change = F.col("l.v") - F.col("l.pv")
            out = out.select(*by, (change if name == "idelta" else F.when(change < 0, F.col("l.v")).otherwise(change) / gap).alias("v"))
        elif name in ("deriv", "predict_linear"):
            x = (t.cast("double") - end) / 1000
            out = dealt().withColumn("x", x).groupBy(*by).agg(n.alias("n"), F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("base")).where("n >= 2")
            out = out.withColumn("v", F.col("slope") if name == "deriv" else F.col("base") + F.col("slope") * F.lit(self.constant(args[1])))
        elif name in ("rate", "increase", "delta"):
            counter = name != "delta"
            out = ends().where(F.col("l.rank") > F.col("f.rank"))
            raw = F.col("l.v") - F.col("f.v") + (F.col("l.drops") - F.col("f.drops") if counter else 0.0)
            out = out.select(*by, raw.alias("raw"), F.col("f.v").alias("v0"), F.col("f.t").alias("t0"), F.col("l.t").alias("t1"), (F.col("l.rank") - F.col("f.rank")).alias("gaps"))
            sampled = (F.col("t1") - F.col("t0")) / 1000
            mean = sampled / F.col("gaps")
            to_start, to_end = (F.col("t0") - (end - span)) / 1000, (end - F.col("t1")) / 1000
            to_start = F.when(to_start >= mean * 1.1, mean / 2).otherwise(to_start)
            if counter:
                to_zero = F.when((F.col("raw") > 0) & (F.col("v0") >= 0), sampled * (F.col("v0") / F.col("raw"))).otherwise(to_start)
                to_start = F.least(to_start, to_zero)
            to_end = F.when(to_end >= mean * 1.1, mean / 2).otherwise(to_end)
            value = F.col("raw") * ((sampled + to_start + to_end) / sampled)
            out = out.withColumn("v", value / (span / 1000) if name == "rate" else value)
        else:
            raise PromQLError(f"unknown function {name}")
        labels = parse_labels(F.col("text"))
        labels = set_label(labels, _NAME, F.col("name")) if name == "last_over_time" and isinstance(node, Selector) else drop(labels, [_NAME]) if name != "last_over_time" else labels
        out = out.select("k", labels.alias("labels"), "v")
        return Vector(self.spread(out, g) if fixed is not None else out)

    @staticmethod
    def quantile(v: Column, q: float) -> Column:
        if math.isnan(q):
            return F.first(F.lit(float("nan")))
        if q < 0 or q > 1:
            return F.first(F.lit(math.copysign(float("inf"), q - 0.5)))
        return F.percentile(v, F.lit(q))

    # --- expressions -------------------------------------------------------------

    def constant(self, node) -> float:
        if isinstance(node, Number):
            return node.value
        if isinstance(node, Negate):
            return -self.constant(node.expr)
        if isinstance(node, Binary):
            a, b = self.constant(node.left), self.constant(node.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else math.nan, "^": a**b, "%": math.fmod(a, b) if b else math.nan}[node.op]
        raise PromQLError("a constant number is needed here")

    def text(self, node) -> str:
        if not isinstance(node, String):
            raise PromQLError("a string is needed here")
        return node.value

    def vector(self, node, g: Grid) -> Vector:
        out = self.evaluate(node, g)
        if isinstance(out, Scalar):
            df = (out.df if out.df is not None else self.steps(g)).select("k", F.expr("cast(map() as map<string,string>)").alias("labels"), out.col.alias("v"))
            return Vector(df)
        return out

    def scalar(self, node, g: Grid) -> Scalar:
        out = self.evaluate(node, g)
        if not isinstance(out, Scalar):
            raise PromQLError("a scalar is needed here")
        return out

    def evaluate(self, node, g: Grid):
        if isinstance(node, Number):
            return Scalar(F.lit(node.value))
        if isinstance(node, Selector):
            if node.range_ms is not None:
                raise PromQLError("a range vector needs a function")
            return Vector(self.instant(node, g))
        if isinstance(node, Negate):
            out = self.evaluate(node.expr, g)
            if isinstance(out, Scalar):
                return Scalar(-out.col, out.df)
            return Vector(out.df.select("k", drop(F.col("labels"), [_NAME]).alias("labels"), (-F.col("v")).alias("v")))
        if isinstance(node, Aggregate):
            return self.aggregate(node, g)
        if isinstance(node, Binary):
            return self.binary(node, g)
        if isinstance(node, Call):
            return self.call(node, g)
        raise PromQLError(f"{type(node).__name__.lower()} isn't allowed here")

    def aggregate(self, node: Aggregate, g: Grid) -> Vector:
        df = self.vector(node.expr, g).df
        labels = F.col("labels")
        group = drop(labels, [*node.labels, _NAME]) if node.without else keep(labels, node.labels)
        df = df.withColumn("gk", _key(group))
        v = F.col("v")
        if node.op in ("topk", "bottomk"):
            k = int(self.constant(node.param))
            order = F.when(F.isnan(v), F.lit(None)).otherwise(v)
            order = order.desc_nulls_last() if node.op == "topk" else order.asc_nulls_last()
            w = Window.partitionBy("k", "gk").orderBy(order, _key(labels))
            return Vector(df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("k", "labels", "v"))
        if node.op == "count_values":
            text = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
            df = df.withColumn("labels", set_label(group, self.text(node.param), text))
            df = df.withColumn("gk", _key(F.col("labels")))
            return Vector(df.groupBy("k", "gk").agg(F.first("labels").alias("labels"), F.count(F.lit(1)).cast("double").alias("v")).select("k", "labels", "v"))
        value = {"sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(F.lit(1)).cast("double"), "group": F.first(F.lit(1.0)), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v)}.get(node.op)
        if node.op == "quantile":
            value = self.quantile(v, self.constant(node.param))
        return Vector(df.groupBy("k", "gk").agg(value.alias("v")).select("k", parse_labels(F.col("gk")).alias("labels"), "v"))

    @staticmethod
    def arithmetic(op: str, a: Column, b: Column) -> Column:
        a, b = a.cast("double"), b.cast("double")
        if op == "/":
            by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))
        if op == "%":
            return F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b), "atan2": lambda: F.atan2(a, b)}[op]()

    @staticmethod
    def compare(op: str, a: Column, b: Column) -> Column:
        """Like IEEE: NaN is unequal to all and neither larger nor smaller."""
        odd = F.isnan(a) | F.isnan(b)
        plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return (odd | plain) if op == "!=" else (~odd & plain)

    def both(self, a: Scalar, b: Scalar) -> tuple[Column, Column, DataFrame | None]:
        if a.df is not None and b.df is not None:
            df = a.df.select("k", a.col.alias("s1")).join(b.df.select("k", b.col.alias("s2")), "k")
            return F.col("s1"), F.col("s2"), df
        return a.col, b.col, a.df if a.df is not None else b.df

    def binary(self, node: Binary, g: Grid):
        comparing = node.op in ("==", "!=", "<", "<=", ">", ">=")
        left, right = self.evaluate(node.left, g), self.evaluate(node.right, g)
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if node.op in ("and", "or", "unless") or (comparing and not node.as_bool):
                raise PromQLError("set operators need vectors; comparisons of scalars need bool")
            a, b, df = self.both(left, right)
            return Scalar(self.compare(node.op, a, b).cast("double") if comparing else self.arithmetic(node.op, a, b), df)
        if node.op in ("and", "or", "unless"):
            if isinstance(left, Scalar) or isinstance(right, Scalar):
                raise PromQLError("set operators need vectors")
            return self.sets(node, left.df, right.df)
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            s, vec = (left, right) if isinstance(left, Scalar) else (right, left)
            df = vec.df if s.df is None else vec.df.join(s.df.select("k", s.col.alias("sv")), "k")
            sv = s.col if s.df is None else F.col("sv")
            a, b = (sv, F.col("v")) if s is left else (F.col("v"), sv)
            return Vector(self.combine(node, df, a, b, F.col("v"), F.col("labels")))
        return self.matched(node, left.df, right.df)

    def combine(self, node: Binary, df: DataFrame, a: Column, b: Column, kept: Column, labels: Column) -> DataFrame:
        if node.op in ("==", "!=", "<", "<=", ">", ">="):
            hit = self.compare(node.op, a, b)
            if not node.as_bool:
                return df.where(hit).select("k", labels.alias("labels"), kept.alias("v"))
            return df.select("k", drop(labels, [_NAME]).alias("labels"), hit.cast("double").alias("v"))
        return df.select("k", drop(labels, [_NAME]).alias("labels"), self.arithmetic(node.op, a, b).alias("v"))

    @staticmethod
    def match_key(node: Binary) -> Column:
        labels = F.col("labels")
        return _key(keep(labels, node.labels) if node.on else drop(labels, [*node.labels, _NAME]))

    def sets(self, node: Binary, left: DataFrame, right: DataFrame) -> Vector:
        if node.group:
            raise PromQLError("set operators are many-to-many")
        left, right = left.withColumn("mk", self.match_key(node)), right.withColumn("mk", self.match_key(node))
        keys = ["k", "mk"]
        if node.op == "or":
            extra = right.join(left.select(*keys).distinct(), keys, "left_anti")
            return Vector(left.select("k", "labels", "v").unionByName(extra.select("k", "labels", "v")))
        how = "left_semi" if node.op == "and" else "left_anti"
        return Vector(left.join(right.select(*keys), keys, how).select("k", "labels", "v"))

    def matched(self, node: Binary, left: DataFrame, right: DataFrame) -> Vector:
        swap = node.group == "group_right"
        many, one = (right, left) if swap else (left, right)
        keys = ["k", "mk"]

        def unique(df: DataFrame, side: str) -> DataFrame:
            df = df.withColumn("mk", self.match_key(node)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("labels").alias("labels"), F.first("v").alias("v"))
            error = F.raise_error(F.concat(F.lit(f"many-to-many matching: several series on the {side} side for "), "mk"))
            return df.select(*keys, "labels", F.when(F.col("n") > 1, error.cast("double")).otherwise(F.col("v")).alias("v"))

        one = unique(one, "one").select(*keys, F.col("labels").alias("one_labels"), F.col("v").alias("one_v"))
        many = many.withColumn("mk", self.match_key(node)) if node.group else unique(many, "left")
        df = many.join(one, keys)
        labels = F.col("labels")
        if not node.group:
            labels = keep(labels, node.labels) if node.on else drop(labels, node.labels)
        for name in node.include:
            labels = set_label(labels, name, F.coalesce(F.col("one_labels")[name], F.lit("")))
        a, b = (F.col("one_v"), F.col("v")) if swap else (F.col("v"), F.col("one_v"))
        return Vector(self.combine(node, df, a, b, a, labels))

    # --- functions -----------------------------------------------------------------

    _MATH = {
        "abs": F.abs, "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"), "exp": F.exp, "sqrt": F.sqrt, "ln": F.log, "log2": F.log2, "log10": F.log10, "sgn": F.signum,
        "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians,
    }
    _DATES = {"minute": F.minute, "hour": F.hour, "month": F.month, "year": F.year, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "day_of_week": lambda t: F.dayofweek(t) - 1, "days_in_month": lambda t: F.dayofmonth(F.last_day(t))}
    _RANGES = {"rate", "irate", "increase", "resets", "delta", "idelta", "deriv", "predict_linear", "changes"}

    def map_values(self, node, g: Grid, f) -> Vector:
        df = self.vector(node, g).df
        return Vector(df.select("k", drop(F.col("labels"), [_NAME]).alias("labels"), f(F.col("v")).alias("v")))

    def call(self, node: Call, g: Grid):
        name, args = node.name, node.args
        if name in self._RANGES or (name.endswith("_over_time") and name != "absent_over_time"):
            return self.over_range(name, args, g)
        if name in self._MATH:
            f = self._MATH[name]
            if name in ("ln", "log2", "log10"):  # Spark gives null outside the domain
                return self.map_values(args[0], g, lambda v: F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(f(v)))
            return self.map_values(args[0], g, f)
        if name in self._DATES:
            seconds = args[0] if args else Call("time", [])
            return self.map_values(seconds if not isinstance(seconds, Call) or seconds.name != "time" else Call("vector", [seconds]), g, lambda v: self._DATES[name](F.timestamp_seconds(v)).cast("double"))
        if name == "time":
            return Scalar(g.at(F.col("k")) / 1000, self.steps(g))
        if name == "pi":
            return Scalar(F.lit(math.pi))
        if name == "vector":
            return self.vector(args[0], g)
        if name == "scalar":
            one = self.vector(args[0], g).df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
            df = self.steps(g).join(one, "k", "left").select("k", F.when(F.col("n") == 1, F.col("v")).otherwise(F.lit(float("nan"))).alias("s"))
            return Scalar(F.col("s"), df)
        if name in ("clamp", "clamp_min", "clamp_max"):
            low = self.constant(args[1]) if name != "clamp_max" else float("-inf")
            high = self.constant(args[-1]) if name != "clamp_min" else float("inf")
            if low > high:
                return Vector(self.vector(args[0], g).df.where("false"))
            return self.map_values(args[0], g, lambda v: F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), v))))
        if name == "round":
            to = self.constant(args[1]) if len(args) > 1 else 1.0
            return self.map_values(args[0], g, lambda v: F.floor(v * (1.0 / to) + 0.5).cast("double") / (1.0 / to))
        if name == "timestamp":
            if isinstance(args[0], Selector):
                df = self.instant(args[0], g, with_time=True)
                return Vector(df.select("k", drop(F.col("labels"), [_NAME]).alias("labels"), F.col("at").alias("v")))
            return self.map_values(args[0], g, lambda v: g.at(F.col("k")) / 1000)
        if name in ("sort", "sort_desc", "sort_by_label", "sort_by_label_desc"):
            return self.vector(args[0], g)  # the order is that of the output
        if name == "absent" or name == "absent_over_time":
            arg = args[0]
            if name == "absent":
                df = self.vector(arg, g).df
            else:
                df, inner, shift, span, fixed = self.ranged(arg, g)
                df = self.deal(df, inner, shift, span)
                df = self.spread(df.select("k").distinct(), g) if fixed is not None else df
            fixed_labels = {label: value for label, op, value in getattr(arg, "matchers", []) if op == "=" and label != _NAME}
            labels = F.create_map(*[F.lit(x) for kv in fixed_labels.items() for x in kv]) if fixed_labels else F.expr("cast(map() as map<string,string>)")
            return Vector(self.steps(g).join(df.select("k").distinct(), "k", "left_anti").select("k", labels.alias("labels"), F.lit(1.0).alias("v")))
        if name == "label_replace":
            df = self.vector(args[0], g).df
            dst, new, src, pattern = (self.text(a) for a in args[1:5])
            value = F.coalesce(F.col("labels")[src], F.lit(""))
            full = f"^(?s:{pattern})$"
            put = set_label(F.col("labels"), dst, F.regexp_replace(value, full, new))
            return Vector(df.select("k", F.when(value.rlike(full), put).otherwise(F.col("labels")).alias("labels"), "v"))
        if name == "label_join":
            df = self.vector(args[0], g).df
            dst, sep = self.text(args[1]), self.text(args[2])
            parts = [F.coalesce(F.col("labels")[self.text(a)], F.lit("")) for a in args[3:]]
            return Vector(df.select("k", set_label(F.col("labels"), dst, F.concat_ws(sep, *parts)).alias("labels"), "v"))
        if name == "histogram_quantile":
            return self.histogram(self.constant(args[0]), self.vector(args[1], g).df)
        raise PromQLError(f"unknown function {name}")

    def histogram(self, q: float, df: DataFrame) -> Vector:
        le = F.col("labels")["le"]
        bound = F.when(le.isin("+Inf", "Inf", "inf"), F.lit(float("inf"))).otherwise(le.try_cast("double"))
        df = df.withColumn("le", bound).withColumn("gk", _key(drop(F.col("labels"), ["le", _NAME])))
        # A group has one row for each of a histogram's buckets, whose number is part of the metric's definition.
        # Rows without a bound go here, for a filter on it would be pushed down to the samples and parse the labels of each.
        bucket = F.when(F.col("le").isNotNull(), F.struct("le", "v"))
        df = df.groupBy("k", "gk", "le").agg(F.sum("v").alias("v")).groupBy("k", "gk").agg(F.array_sort(F.collect_list(bucket)).alias("b"))
        df = df.where(F.size("b") >= 2).where(F.try_element_at("b", F.lit(-1))["le"] == float("inf"))
        total = F.element_at("b", -1)["v"]
        df = df.withColumn("total", total).withColumn("rank", F.lit(q) * F.col("total"))
        df = df.withColumn("i", F.expr("int(array_position(transform(b, x -> x.v >= rank), true))"))
        at = F.element_at("b", F.col("i"))
        before = F.when(F.col("i") > 1, F.element_at("b", F.greatest(F.col("i") - 1, F.lit(1))))
        low, under = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["v"], F.lit(0.0))
        inside = low + (at["le"] - low) * F.try_divide(F.col("rank") - under, at["v"] - under)
        value = F.when(F.col("i") == F.size("b"), F.element_at("b", -2)["le"]).when((F.col("i") == 1) & (at["le"] <= 0), at["le"]).otherwise(inside)
        if math.isnan(q) or q < 0 or q > 1:
            value = F.lit(math.nan if math.isnan(q) else math.copysign(math.inf, q - 0.5))
        value = F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(value)
        return Vector(df.select("k", parse_labels(F.col("gk")).alias("labels"), value.alias("v")))


def query_range(metrics: DataFrame, expr: str, start_ms: int, end_ms: int, step_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """(metric, t, value): the labels as text with the name among them, milliseconds, and the value at each step.

    metrics has the columns of model.METRICS; samples are placed by ts. Two samples of a
    series at one instant count as the larger. At most 11,000 steps.
    """
    if step_ms <= 0 or end_ms < start_ms:
        raise PromQLError("the step must be positive and the end not before the start")
    g = Grid(start_ms, end_ms, step_ms)
    if g.last + 1 > MAX_POINTS:
        raise PromQLError(f"more than {MAX_POINTS} points")
    ev = Evaluator(metrics, lookback_ms)
    ev.outer = g
    node = parse(expr)
    if isinstance(node, String):
        return metrics.sparkSession.createDataFrame([(node.value, end_ms, None)], "metric string, t long, value double")
    return ev.vector(node, g).df.select(_key(F.col("labels")).alias("metric"), g.at(F.col("k")).alias("t"), F.col("v").cast("double").alias("value"))


def query_instant(metrics: DataFrame, expr: str, at_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """The result at one instant, in the order that sort(), sort_desc(), topk() or bottomk() ask for."""
    out = query_range(metrics, expr, at_ms, at_ms, 1, lookback_ms)
    node = parse(expr)
    asked = node.name if isinstance(node, Call) else node.op if isinstance(node, Aggregate) else ""
    if asked in ("sort", "bottomk"):
        return out.orderBy("value", "metric")
    if asked in ("sort_desc", "topk"):
        return out.orderBy(F.col("value").desc(), "metric")
    return out


def series(metrics: DataFrame, selectors: list[str], start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    """Distinct series (name, labels) that any of the selectors matches in the closed interval, in order."""
    ev, found = Evaluator(metrics), None
    for text in selectors or ['{__name__=~".+"}']:
        one = ev.samples(parse(text), start_ms - 1, end_ms).select("name", "text")
        found = one if found is None else found.union(one)
    out = found.distinct().orderBy("name", "text").select(F.col("name").alias(_NAME), F.col("text").alias("labels"))
    return out.limit(limit) if limit else out


def label_names(metrics: DataFrame, selectors: list[str], start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    s = series(metrics, selectors, start_ms, end_ms)
    out = s.select(F.explode(F.map_keys(parse_labels(F.col("labels")))).alias("label")).union(s.select(F.lit(_NAME)).limit(1)).distinct().orderBy("label")
    return out.limit(limit) if limit else out


def label_values(metrics: DataFrame, label: str, selectors: list[str], start_ms: int, end_ms: int, limit: int | None = None) -> DataFrame:
    s = series(metrics, selectors, start_ms, end_ms)
    value = F.col(_NAME) if label == _NAME else parse_labels(F.col("labels"))[label]
    out = s.select(value.alias("label_value")).where("label_value is not null and label_value <> ''").distinct().orderBy("label_value")
    return out.limit(limit) if limit else out
