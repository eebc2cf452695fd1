"""Union by name with the schema rule of windows: a column whose types differ becomes text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(frames: list[DataFrame], numbers_widen: bool = False) -> DataFrame:
    """All rows; columns in the order in which they are first seen, absent ones null.

    Integers and doubles in different frames also become text, unless numbers_widen.
    """
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            kinds.setdefault(c, set()).add(t)

    def target(types: set[str]) -> str:
        if len(types) == 1:
            return next(iter(types))
        if numbers_widen and types <= {"int", "bigint", "double", "float"}:
            return "double" if types & {"double", "float"} else "bigint"
        return "string"

    want = {c: target(t) for c, t in kinds.items()}
    aligned = []
    for f in frames:
        have = dict(f.dtypes)
        aligned.append(f.select(*[(F.col(f"`{c}`").cast(t) if have[c] != t else F.col(f"`{c}`")).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in want.items()]))
    return reduce(DataFrame.union, aligned)


def exclude(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)
