"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots, runs
from .common import durable, small_batches

#: Vectors of one bucket that are compared in one block.
BLOCK = 1024


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection agrees for vectors this far apart."""
    r = width / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, width: float = 2.0, per_bucket: int = 160, miss: float = 5e-4) -> tuple[int, int]:
    """(projections in a key, tables): keys grow with log n, so that a bucket holds about
    per_bucket unrelated vectors at any n; tables, so that a pair at the threshold is missed with chance miss."""
    near = collision(math.sqrt(max(2 - 2 * threshold, 1e-9)), width)
    far = collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 1) / per_bucket + 1) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


def _keys(x: np.ndarray, k: int, tables: int, width: float, seed: int, cache: dict) -> np.ndarray:
    """32-bit keys of unit vectors, one column for each table."""
    m = x.shape[1]
    if m not in cache:
        g = np.random.default_rng([seed, m])
        odd = np.random.default_rng(seed).integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        cache[m] = g.standard_normal((m, k * tables)), g.uniform(0, width, k * tables), odd
    planes, shift, odd = cache[m]
    q = np.floor((x @ planes + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
    h = (q * odd).sum(axis=2, dtype=np.uint64)
    return (((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = np.asarray(pa.compute.list_value_length(b.column("v")))
    for m in np.unique(sizes):
        part = b.take(pa.array(np.flatnonzero(sizes == m)))
        yield int(m), part, np.asarray(part.column("v").flatten()).reshape(part.num_rows, m)


def _sign(k: int, tables: int, width: float, seed: int, light: bool):
    """Light rows are (t, key, id); the others also carry the class, its keys in earlier tables and its vector,
    once for each block of a hot bucket that it is to be compared with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            for m, part, x in _by_length(b):
                sig = _keys(_unit(x), k, tables, width, seed, cache)
                key = (sig.astype(np.int64) << 16) ^ m
                ids = part.column("id")
                if light:
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(key[:, t]), ids], names=["t", "key", "id"])
                    continue
                raw, size = x.tobytes(), x.itemsize * m
                vectors = [raw[i * size : (i + 1) * size] for i in range(len(x))]
                hot = [{s["t"]: (s["block"], s["blocks"]) for s in r or ()} for r in part.column("hot").to_pylist()]
                n = part.column("n")
                for t in range(tables):
                    rows, lo, hi, block = [], [], [], []
                    for i, h in enumerate(hot):
                        own, blocks = h.get(t, (0, 1))
                        for other in range(blocks):
                            rows.append(i)
                            lo.append(min(own, other))
                            hi.append(max(own, other))
                            block.append(own)
                    at = pa.array(rows)
                    cols = [pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(key[rows, t]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(block, pa.int32()), ids.take(at), n.take(at), pa.array([sig[i, :t].tobytes() for i in rows], pa.binary()), pa.array([vectors[i] for i in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["t", "key", "lo", "hi", "block", "id", "n", "sig", "x"])

    return run


def _compare(threshold: float, dtype: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, tops = [], [], []
        for r in runs(batches, "t", "key", "lo", "hi"):
            n = r.num_rows
            if n == 1:
                continue
            order = np.argsort(r.column("id").to_numpy(), kind="stable")
            ident = r.column("id").to_numpy()[order]
            size = r.column("n").to_numpy()[order]
            raw = r.column("x").to_pylist()
            x = _unit(np.frombuffer(b"".join(raw[i] for i in order), dtype=dtype).reshape(n, -1))
            t, lo, hi = (r.column(c)[0].as_py() for c in ("t", "lo", "hi"))
            block = r.column("block").to_numpy()[order]
            raw = r.column("sig").to_pylist()
            sig = np.frombuffer(b"".join(raw[i] for i in order), dtype=np.uint32).reshape(n, t)
            left, right = [], []
            for a in range(0, n, 512):
                i, j = np.nonzero(x[a : a + 512] @ x.T >= threshold)
                i = i + a
                new = i < j
                if lo != hi:
                    new &= block[i] != block[j]
                i, j = i[new], j[new]
                for c in range(0, len(i) if t else 0, 1 << 16):  # pairs that met in an earlier table count there
                    s = slice(c, c + (1 << 16))
                    old = (sig[i[s]] == sig[j[s]]).any(axis=1)
                    i[s][old] = -1
                new = i >= 0
                left.append(i[new])
                right.append(j[new])
            i, j = np.concatenate(left), np.concatenate(right)
            if not len(i):
                continue
            count = (np.bincount(i, size[j], n) + np.bincount(j, size[i], n)).astype(np.int64)
            top = roots(n, i, j)
            has = count > 0
            ids.append(ident[has])
            counts.append(count[has])
            tops.append(ident[top[has]])
            if sum(map(len, ids)) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, counts, tops)], names=["id", "links", "top"])
                ids, counts, tops = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, counts, tops)], names=["id", "links", "top"])

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.9, width: float = 2.0, miss: float = 5e-4, seed: int = 7, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links vectors with cosine >= threshold and gives each its component.

    Equal vectors are one class with a size. Each class is hashed into several tables
    by quantised random projections of its unit vector; rows of one bucket are
    compared exactly in double precision. A bucket of more than `block` classes is cut into blocks
    and each pair of blocks is its own unit of work, so no task holds a whole hot bucket.
    A pair that meets in several tables counts in the first. Tasks emit, per class, a
    number of links and the local root, never pairs.

    A pair below the threshold is never linked. A pair at the threshold is missed with chance
    `miss`, closer ones far more seldom. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, link with nothing and are their own component.
    Vectors of different lengths don't link. Repeated rows count as vectors of their own.
    Returns id, n_links, component_id, kept (id = component_id; true for null ids). Other columns are ignored.
    """
    element = dict(vectors.dtypes)[vector_col]
    v = F.col(f"`{vector_col}`") if element in ("array<float>", "array<double>") else F.col(f"`{vector_col}`").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fine = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda c: c != 0)
    rows = small_batches(vectors).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(fine, v).alias("v"))
    classes = durable(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    n = classes.count()
    k, tables = plan(n, threshold, width, miss=miss)
    light = classes.select("id", "n", "v").mapInArrow(_sign(k, tables, width, seed, True), "t int, key long, id long")
    hot = light.groupBy("t", "key").count().where(F.col("count") > block).select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block")
    hot = light.join(hot, ["t", "key"]).groupBy("id").agg(F.collect_list(F.struct("t", own, "blocks")).alias("hot"))
    keyed = classes.join(hot, "id", "left").select("id", "n", "v", "hot").mapInArrow(_sign(k, tables, width, seed, False), "t int, key long, lo int, hi int, block int, id long, n long, sig binary, x binary")
    dtype = "float32" if "float" in element else "float64"
    found = durable(keyed.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi").mapInArrow(_compare(threshold, dtype), "id long, links long, top long").groupBy("id", "top").agg(F.sum("links").alias("links")))
    comp = components(found.select(F.col("id").alias("a"), F.col("top").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "id", "left").join(comp, "id", "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(by_class, "v", "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))
