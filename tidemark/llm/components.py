"""Connected components of an edge list, and runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component) for the ends of edges (a, b): the smallest id that can be reached. Ids are of any type with an order.

    Each round takes the smallest label of the neighbours and then the label of that
    label, and ends in a table on shared storage, for which that of the round before goes; rounds stop when no label changes. Nothing is
    collected but whether a label changed. Null ends are ignored. The centre of a star is a hot key of joins only, one side of
    which has one row for it, so adaptive execution can split it; minima are taken map-side first. rows: as for durable().
    """
    both = edges.select("a", "b").where("a <> b")
    both = durable(both.union(both.select(F.col("b"), F.col("a"))).distinct(), rows)
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("changed")), rows)
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = hooked.join(jump, "label", "left").select("id", "old", F.least("label", "up").alias("label"))
        new = durable(new.select("id", "label", (F.col("label") != F.col("old")).alias("changed")), rows)
        discard(labels)
        labels = new
    discard(both)
    return labels.select("id", F.col("label").alias("component"))


def runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Slices with equal keys from batches sorted by them; a run may cross batches. Keys are non-null integers."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[x] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges a-b connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
