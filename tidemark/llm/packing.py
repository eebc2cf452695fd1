"""Best-fit packing of texts into training windows, with conflicts."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches
from .components import runs

#: Bytes of a window, and pieces that one packing unit holds on average.
CAPACITY, UNIT = 16384, 2000


class Packer:
    """Bins ordered by (room left, number). A bin carries the set bits of the sources and clusters in it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.room: list[int] = []
        self.count: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.bits: dict = {}

    def bit(self, key) -> int:
        return 1 << self.bits.setdefault(key, len(self.bits))

    def put(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, place): the tightest bin with room and neither the source nor the cluster; else a new one.

        From the first bin with enough room the search goes on to its successors until
        one is compatible. A null source or cluster conflicts with nothing.
        """
        s = 0 if source is None else self.bit(("s", source))
        c = 0 if cluster is None else self.bit(("c", cluster))
        order, sources, clusters = self.order, self.sources, self.clusters
        for i in range(bisect_left(order, (size, -1)), len(order)):
            b = order[i][1]
            if not (sources[b] & s or clusters[b] & c):
                del order[i]
                break
        else:
            b = len(self.room)
            self.room.append(self.capacity)
            self.count.append(0)
            sources.append(0)
            clusters.append(0)
        self.room[b] -= size
        self.count[b] += 1
        sources[b] |= s
        clusters[b] |= c
        if self.room[b]:
            insort(order, (self.room[b], b))
        return b, self.count[b] - 1


def _pack(capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, "unit"):
            p = Packer(capacity)
            put = [p.put(*x) for x in zip(r.column("size").to_pylist(), r.column("source").to_pylist(), r.column("cluster").to_pylist())]
            bins, slots = zip(*put)
            yield from pa.table({"uid": r.column("uid"), "piece": r.column("piece"), "size": r.column("size"), "unit": r.column("unit"), "bin": pa.array(bins, pa.int64()), "slot": pa.array(slots, pa.int64())}).to_batches()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: F.Column | None = None) -> DataFrame:
    """Packs the UTF-8 bytes of each text into bins of `capacity` bytes, best fit first.

    A text longer than the capacity is cut into full pieces, each a bin of its own, and a
    rest that is packed. A bin holds at most one piece of each source and of each
    duplicate cluster (by default: texts with equal letters and digits, A-Z lower-cased). Rests are
    packed largest first within units of about `unit` pieces, to which a hash of the
    row deals them; the number of units grows with the rows, so bins of a hot source are
    spread over all units and no task packs all of it. No text is shuffled.

    Returns id, piece (from 0), start (byte), n_bytes, bin (string: unit-number, or the
    row and piece for a full bin), slot. Null and empty texts get one piece of 0 bytes in bin "none", slot 0.
    Null ids, repeated rows and null sources are allowed: each row is packed for itself. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    same = F.xxhash64(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")) if cluster is None else cluster
    source = F.xxhash64(F.col(f"`{source_col}`")) if source_col in docs.columns else F.lit(None).cast("long")
    src = F.when(F.col(f"`{source_col}`").isNotNull(), source) if source_col in docs.columns else source
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("bytes"), src.alias("source"), same.alias("cluster"))
    rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()))
    units = max(1, math.ceil(rows.where(F.col("bytes") % capacity > 0).count() / unit))
    full = rows.where(F.col("bytes") >= capacity).select("uid", F.explode(F.sequence(F.lit(0), F.floor(F.col("bytes") / capacity).cast("int") - 1)).alias("piece"))
    full = full.select("uid", "piece", F.lit(capacity).cast("long").alias("size"), F.concat_ws("-", F.lit("full"), "uid", "piece").alias("bin"), F.lit(0).cast("long").alias("slot"))
    rest = rows.where(F.col("bytes") % capacity > 0).select("uid", F.floor(F.col("bytes") / capacity).cast("int").alias("piece"), (F.col("bytes") % capacity).alias("size"), "source", "cluster", F.pmod(F.xxhash64("id", "bytes", "cluster"), F.lit(units).cast("long")).alias("unit"), "id")
    rest = rest.repartition("unit").sortWithinPartitions("unit", F.col("size").desc(), F.col("id").asc_nulls_first(), "cluster", "source", "uid").drop("id")
    rest = rest.mapInArrow(_pack(capacity), "uid long, piece int, size long, unit long, bin long, slot long").select("uid", "piece", "size", F.concat_ws("-", "unit", "bin").alias("bin"), "slot")
    none = rows.where("bytes = 0").select("uid", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("size"), F.lit("none").alias("bin"), F.lit(0).cast("long").alias("slot"))
    out = full.unionByName(rest).unionByName(none).join(rows.select("uid", "id"), "uid")
    return out.select(F.col("id").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("size").alias("n_bytes"), "bin", "slot")
