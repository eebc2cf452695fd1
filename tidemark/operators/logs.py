"""Template mining and windowed summaries of logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "<*>"


def template_of(c: Column) -> Column:
    """Words joined by one space, those with = or a digit replaced by <*>; null and blank give ""."""
    words = F.filter(F.split(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("[=0-9]"), MARK).otherwise(w)), " ")


def mine(df: DataFrame, column: str = "message", to: str = "template", enabled: bool = True) -> DataFrame:
    return df.withColumn(to, template_of(F.col(column))) if enabled else df


def template_counts(logs: DataFrame) -> DataFrame:
    """Rows by template; rows that are summaries already count as many as they say."""
    count = F.coalesce(F.col("count"), F.lit(1)) if "count" in logs.columns else F.lit(1)
    return logs.groupBy("template").agg(F.sum(count).cast("long").alias("count"))


def summary(df: DataFrame, group_by: list[str], aggregates: list[str], parity: bool = False) -> DataFrame:
    """count, sum:f, avg:f, min:f, max:f and pNN:f (nearest rank) by text columns, ordered by them.

    Without group columns there is one group. With parity, null keys read as "" and null numbers as 0,
    and a NaN makes min and max NaN; else nulls are left out and a NaN is the largest number.
    """
    kinds = dict(df.dtypes)
    for g in group_by:
        if kinds.get(g) != "string":
            raise TypeError(f"group column {g} must be text")
    out = []
    for a in aggregates:
        fn, _, field = a.partition(":")
        if fn == "count" and not field:
            out.append(F.count(F.lit(1)).alias("count"))
            continue
        if kinds.get(field) not in ("bigint", "int", "double", "float", "smallint", "tinyint"):
            raise TypeError(f"{field or a} must be a number")
        v = F.col(field).cast("double")
        if parity:
            v = F.coalesce(v, F.lit(0.0))
        pct = re.fullmatch(r"p(\d+(?:\.\d+)?)", fn)
        if pct:
            e = F.expr(f"percentile_disc({float(pct[1]) / 100}) WITHIN GROUP (ORDER BY {'coalesce(cast(`%s` as double), 0D)' % field if parity else 'cast(`%s` as double)' % field})")
        elif fn in ("sum", "avg", "min", "max"):
            e = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](v)
            if parity and fn == "min":
                e = F.when(F.bool_or(F.isnan(v)), F.lit(float("nan"))).otherwise(e)
        else:
            raise ValueError(f"unknown aggregate {a}")
        out.append(F.coalesce(e, F.lit(0.0)).alias(f"{fn}_{field}"))
    if parity:
        df = df.withColumns({g: F.coalesce(F.col(g), F.lit("")) for g in group_by})
    return df.groupBy(*group_by).agg(*out).orderBy(*group_by) if group_by else df.agg(*out)
