"""Near-duplicate texts: Order MinHash buckets, pairs counted exactly and verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, discard, durable, mix, rows_of, shingles, small_batches, temp_name
from .components import components, runs

#: Words of a k-mer, ordered samples (tables), k-mers in a sample, tables of the first pass.
K, SAMPLES, LENGTH, FIRST = 5, 16, 3, 4
#: k-mers in a block of a bucket, where each text counts for WEIGHT more; a unit of work holds one block or two.
UNIT, WEIGHT = 65536, 32
_NULL = -(1 << 63)


def labelled(s: np.ndarray) -> np.ndarray:
    """Each k-mer hash joined with how many equal ones stand before it, in text order."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = t[1:] != t[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    out = np.empty_like(s)
    out[order] = mix(t + (np.arange(len(t)) - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


_ODD = mix(np.arange(SAMPLES, dtype=np.uint64), 3) | np.uint64(1)


def order_minhash(x: np.ndarray) -> np.ndarray:
    """One 64-bit value for each sample: the LENGTH smallest labelled k-mers, in text order."""
    out = np.empty(SAMPLES, dtype=np.uint64)
    n = min(LENGTH, len(x))
    for a in range(0, SAMPLES, 4):
        h = mix(x[None, :] * _ODD[a : a + 4, None])
        at = np.sort(np.argpartition(h, n - 1, axis=1)[:, :n], axis=1) if n < len(x) else np.broadcast_to(np.arange(n), (len(h), n))
        key = np.zeros(len(h), dtype=np.uint64)
        for j in range(n):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + x[at[:, j]])
        out[a : a + 4] = key
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches stay within `band` of the diagonal.

    Bit-parallel: one number holds a row of the alignment, so a step costs len(b) / 64 words
    however often a k-mer repeats.
    """
    places: dict[int, int] = {}
    for j, s in enumerate(b.tolist()):
        places[s] = places.get(s, 0) | 1 << j
    whole = (1 << len(b)) - 1
    window = (1 << 2 * band + 1) - 1
    row = whole
    for i, s in enumerate(a.tolist()):
        m = places.get(s)
        if m is None:
            continue
        if band < len(b):
            m &= window << i - band if i >= band else window >> band - i
        u = row & m
        row = ((row + u) | (row - u)) & whole
    return len(b) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Shared over all k-mers of two texts, where shared ones must align in order; 0 if it is under threshold.

    The alignment is a longest common subsequence within a band around the
    diagonal: texts at the threshold differ by at most (1 - t) / (1 + t) of all k-mers, so their
    alignment never leaves it.
    """
    total = len(a) + len(b)
    need = threshold / (1 + threshold) * total - 1e-9
    n = min(len(a), len(b))
    if n < need:
        return 0.0
    d = np.flatnonzero(a[:n] != b[:n])
    head = int(d[0]) if len(d) else n
    d = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(d[0]) if len(d) else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    shared = head + tail
    if len(a) and len(b):
        shared += aligned(a, b, int((1 - threshold) / (1 + threshold) * total) + 1)
    return shared / (total - shared) if shared >= need else 0.0


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d: a digest of the words; for a text without words of its id and text, so that only repeated rows share it."""
    for uid, ids, hashes, texts in rows_of(batches, "uid", "k", "th", "text"):
        for a, b in by_bytes(texts):
            w = Words(texts[a:b])
            h = w.hashes
            n, digests, keys = [], [], []
            for i in range(b - a):
                words = h[w.first[i] : w.first[i + 1]]
                n.append(max(len(words) - K + 1, min(len(words), 1)))
                if len(words):
                    digests.append(xxhash.xxh3_128_digest(words.tobytes()))
                    keys.append(order_minhash(labelled(shingles(words, K))).view(np.int64).tolist())
                else:
                    digests.append(xxhash.xxh3_128_digest(np.array([ids[a + i], hashes[a + i]]).tobytes(), seed=1))
                    keys.append([])
            yield pa.RecordBatch.from_arrays([pa.array(uid[a:b], pa.int64()), pa.array(ids[a:b], pa.int64()), pa.array(hashes[a:b], pa.int64()), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["uid", "k", "th", "d", "n", "keys"])


def _links(threshold: float):
    """Links in each unit of work, as stars around the least digest of each group that it connects.

    Rows of a unit have (n, d, label, tried, side, keys, text). Compared are pairs with different labels, of different sides
    (or side -1), not of one block of the first pass (tried), and that share no earlier sample, for there they are compared.
    How many labelled k-mers a pair shares is counted exactly for a text and all before it at once; only pairs that reach the
    threshold by that count, and that the unit hasn't connected yet, are aligned.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for r in runs(batches, "t", "key", "u"):
            out += _unit(r, threshold)
            if len(out) > 20_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def _edges(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*set(rows))], names=["a", "b"])


def _unit(r: pa.Table, threshold: float) -> Iterator[tuple[bytes, bytes]]:
    d = r.column("d").to_pylist()
    first = [i for i in range(len(d)) if not i or d[i] != d[i - 1]]  # repeated rows have one digest and stand together
    m = len(first)
    if m < 2:
        return
    r = r.take(first) if m < len(d) else r
    d = [d[i] for i in first]
    n, side, tried, t = r.column("n").to_numpy(), r.column("side").to_numpy(), r.column("tried").to_numpy(), r.column("t")[0].as_py()
    labels = r.column("label").to_pylist()
    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    group = np.array([number[x] for x in labels])
    if len(number) == 1:
        return
    keys = np.array(r.column("keys").to_pylist(), dtype=np.int64)[:, :t]
    runs_, x = [], []
    texts = r.column("text").to_pylist()
    for a, b in by_bytes(texts):
        w = Words(texts[a:b])
        h = w.hashes
        runs_ += [shingles(h[w.first[i] : w.first[i + 1]], K) for i in range(b - a)]
    del texts
    x = np.unique(np.concatenate([labelled(s) for s in runs_]), return_inverse=True)[1]
    at = np.zeros(m + 1, dtype=np.int64)
    np.cumsum(n, out=at[1:])
    mark = np.zeros(int(x.max()) + 1, dtype=np.int32)
    start = group.copy()
    low = np.searchsorted(n, threshold * n - 1e-9)  # rows come by n: those with fewer k-mers can't meet the threshold
    for i in range(1, m):
        lo = low[i]
        open_ = group[lo:i] != group[i]
        if side[i] >= 0:
            open_ &= side[lo:i] != side[i]
        if tried[i] >= 0:
            open_ &= tried[lo:i] != tried[i]
        if t and open_.any():
            open_ &= ~(keys[lo:i] == keys[i]).any(axis=1)
        if not open_.any():
            continue
        own = x[at[i] : at[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[x[at[lo] : at[i]]], at[lo:i] - at[lo])
        mark[own] = 0
        share = shared / (n[lo:i] + n[i] - shared)
        fit = np.flatnonzero(open_ & (share >= threshold - 1e-9))
        for j in (lo + fit[np.argsort(-share[fit], kind="stable")]).tolist():
            if group[j] != group[i] and similarity(runs_[i], runs_[j], threshold) >= threshold:
                group[group == group[j]] = group[i]
    for g in np.unique(group):
        ends = np.flatnonzero(group == g)
        ends = ends[np.unique(start[ends], return_index=True)[1]]  # one row stands for those that came connected
        least = min(d[i] for i in ends)
        yield from ((d[i], least) for i in ends if d[i] != least)


_UNIT_COLUMNS = ["t", "key", "u", "side", "tried", "label", "d", "n", "keys", "text"]


def _compare(rows: DataFrame, threshold: float, n: int) -> DataFrame:
    rows = rows.select(*_UNIT_COLUMNS).repartition("t", "key", "u").sortWithinPartitions("t", "key", "u", "n", "d")
    return durable(rows.mapInArrow(_links(threshold), "a binary, b binary").distinct(), n)


def _mixed_units(near: DataFrame, classes: DataFrame, unit: int) -> DataFrame:
    """(d, t, key, u, side, tried, label): the units of work of the second pass.

    Only buckets that still hold several labels and that weren't one block before. A label that fills a block has blocks
    of its own, and no two of those meet; all other labels of the bucket share blocks.
    """
    open_ = near.where((F.col("t") >= FIRST) | (F.col("blocks") > 1)).withColumn("tried", F.when(F.col("t") < FIRST, F.col("block")).otherwise(-1).cast("long"))
    rows = open_.join(classes.select(F.col("id").alias("d"), "component"), "d", "left").select("t", "key", "d", "n", "tried", F.coalesce("component", "d").alias("label"))
    w = F.sum(F.col("n") + WEIGHT).alias("w")
    by_label = rows.groupBy("t", "key", "label").agg(w)
    several = by_label.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "key")
    by_label = by_label.join(several, ["t", "key"]).withColumn("g", F.when(F.col("w") >= unit, F.col("label")).otherwise(F.lit(b"")))
    groups = by_label.groupBy("t", "key", "g").agg(F.ceil(F.sum("w") / unit).cast("int").alias("blocks"))
    rows = rows.join(by_label.select("t", "key", "label", "g"), ["t", "key", "label"]).join(groups, ["t", "key", "g"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    other = groups.select("t", "key", F.col("g").alias("h"), F.col("blocks").alias("others"))
    meet = groups.join(other, ["t", "key"]).where((F.col("g") < F.col("h")) | ((F.col("g") == F.lit(b"")) & (F.col("h") == F.lit(b""))))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    meet = meet.withColumn("x", upto("blocks")).withColumn("y", upto("others")).where((F.col("g") < F.col("h")) | (F.col("x") <= F.col("y")))
    meet = meet.withColumn("u", F.xxhash64("g", "x", "h", "y"))
    alone = (F.col("g") == F.col("h")) & (F.col("x") == F.col("y"))
    ends = F.explode(F.when(alone, F.array(F.struct(F.col("g"), F.col("x").alias("block"), F.lit(-1).alias("side")))).otherwise(F.array(F.struct(F.col("g"), F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("h").alias("g"), F.col("y").alias("block"), F.lit(1).alias("side")))))
    units = meet.select("t", "key", "u", ends.alias("e")).select("t", "key", "u", "e.*")
    return rows.join(units, ["t", "key", "g", "block"]).select("d", "t", "key", "u", "side", "tried", "label")


def _rows_with_classes(docs: DataFrame, threshold: float, unit: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, k, th, class_k, kept) of each row of docs."""
    src = small_batches(docs).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL)).alias("k"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sig = durable(src.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_signatures, "uid long, k long, th long, d binary, n long, keys array<long>"))
    n = sig.count()
    reps = durable(sig.groupBy("d").agg(F.min(F.struct("k", "uid", "th")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")).select("d", "first.*", "n", "keys"), n)
    banded = reps.select("d", "n", F.posexplode("keys").alias("t", "key"))
    buckets = banded.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.sum(F.col("n") + WEIGHT) / unit).cast("int").alias("blocks")).where("m > 1").drop("m")
    block = F.pmod(F.xxhash64("d"), F.col("blocks").cast("long"))
    near = durable(banded.join(buckets, ["t", "key"]).withColumn("block", block), SAMPLES * n)

    # Texts that share a bucket, each with its places in the tables of the first pass.
    places = near.groupBy("d").agg(F.collect_list(F.when(F.col("t") < FIRST, F.struct("t", "key", F.col("block").alias("u")))).alias("at"))
    wanted = reps.join(places, "d").select("k", "th", "d", "n", "keys", "at")
    if not sig.groupBy("k", "th").count().where("count > 1").isEmpty():
        src = src.dropDuplicates(["k", "th"])  # repeated rows have one text
    texts = durable(src.join(wanted, ["k", "th"]).select("d", "n", "keys", "at", "text"), SAMPLES * n)

    # First pass: the blocks of the first tables, each by itself.
    rows = texts.select("d", "n", "keys", "text", F.explode("at").alias("p")).select("d", "n", "keys", "text", "p.*")
    one = _compare(rows.select("*", F.lit(-1).alias("side"), F.lit(-1).cast("long").alias("tried"), F.col("d").alias("label")), threshold, n)
    classes = components(one, n)
    # Second pass: what is left, in buckets that hold texts of several classes.
    two = _compare(_mixed_units(near, classes, unit).join(texts.drop("at"), "d"), threshold, n)
    stars = classes.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    if not two.isEmpty():
        classes = components(stars.union(two), n)
    discard(near, texts, one, two)

    classed = reps.join(classes.withColumnRenamed("id", "d"), "d", "left").withColumn("component", F.coalesce("component", "d"))
    least = classed.groupBy("component").agg(F.min(F.struct("k", "uid")).alias("least"))
    by_text = classed.select("d", "component").join(least, "component").select("d", F.col("least.k").alias("class_k"), F.col("least.uid").alias("class_uid"))
    return sig.select("uid", "k", "th", "d").join(by_text, "d").select("uid", "k", "th", "class_k", (F.col("uid") == F.col("class_uid")).alias("kept"))


def near_classes(docs: DataFrame, threshold: float = 0.8, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Gives each row the class of its text: texts linked directly or over others.

    Two texts are linked if their words (ASCII letters, digits, all non-ASCII code points; A-Z
    lower-cased) are the same, or if at least `threshold` of their five-word runs are shared in
    an alignment (a text of under five words is one run). Exact copies are grouped by a 128-bit digest, and one of each group
    goes on. Order MinHash: each of 16 samples takes the three smallest of a text's
    occurrence-labelled k-mers and keeps their text order; texts with an equal sample are candidates.
    A pair at similarity 0.8 shares a given sample with chance about 0.5, so all 16 fail for about 1 pair
    in 60,000; nothing else is missed.

    Candidates are never listed. A bucket is cut into blocks of about `unit` k-mers; a unit of work is a block, or two blocks of
    a bucket, and holds whole texts. In it the shared k-mers of all pairs that aren't connected yet are counted exactly, and pairs that
    reach the threshold are verified by banded alignment; the unit returns a star for each group it connects, so at most one link a text.
    The first pass takes the blocks of four samples by themselves. Its components label the texts for the second pass, which takes
    all samples and all pairs of blocks, but only of buckets with several labels, and compares only texts of different
    labels: two blocks of one class never meet. There is no limit on partners, buckets or rounds.

    Returns id, class_id (smallest id of the class), kept: true for one row of each class, which has that id. Texts without words
    (null, empty, marks only) link with nothing, but for rows with equal id and text: repeated rows are copies like others.
    Null ids count as the smallest long and come back as null, with class_id null if it is theirs. Other columns are ignored. An empty table gives no rows.
    """
    rows = _rows_with_classes(docs, threshold, unit, id_col, text_col)
    known = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return rows.select(known("k").alias(id_col), known("class_k").alias("class_id"), "kept")


def keep_first(docs: DataFrame, threshold: float = 0.8, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_classes keeps: one of each class, with all its columns."""
    rows = _rows_with_classes(docs, threshold, unit, id_col, text_col)
    k, th = temp_name(docs, "k"), temp_name(docs, "th")
    stay = durable(rows.groupBy("k", "th").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("m")).where("kept").select(F.col("k").alias(k), F.col("th").alias(th), "m"), docs.count())
    marked = docs.withColumn(k, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL))).withColumn(th, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    out = marked.join(stay.where("m = 1"), [k, th], "left_semi")
    if not stay.where("m > 1").isEmpty():
        out = out.unionByName(marked.join(stay.where("m > 1"), [k, th], "left_semi").dropDuplicates([k, th]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
