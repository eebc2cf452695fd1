"""Toxicity from confirmed toxic texts and unlabelled ones: non-negative PU learning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Words, by_bytes, mix, rows_of, small_batches, temp_name

BITS = 20
#: Bytes of the word beginnings that are features besides whole words.
STEMS = (4, 5, 6)


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) for each word and each of its beginnings."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    ids, docs = [mix(w.hashes, 7) >> np.uint64(64 - BITS)], [doc]
    size = w.end - w.start
    for k in STEMS:
        long = size > k
        ids.append(mix(w.hash(w.start[long], w.start[long] + k), 7 + k) >> np.uint64(64 - BITS))
        docs.append(doc[long])
    return np.concatenate(ids).astype(np.int64), np.concatenate(docs)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in by_bytes(texts):
            f, d = _features(Words(texts[a:b]))
            out[a:b] = np.bincount(d, self.weights[f], b - a) + self.bias
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40)))


def risk(s: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative PU risk of scores s (the first n_p those of positives) with the sigmoid loss, and the direction to go down in, by logit.

    The risk is prior * R_p+ + max(0, R_u- - prior * R_p-); the loss of a score as a negative is s, as a positive 1 - s. Where
    the second part is under 0 the direction is up that part's gradient alone, which
    keeps the classifier from explaining the unlabelled texts away.
    """
    rest = s[n_p:].mean() - prior * s[:n_p].mean()
    slope = s * (1 - s)
    g = np.empty(len(s))
    if rest >= 0:
        g[:n_p] = -2 * prior * slope[:n_p] / n_p
        g[n_p:] = slope[n_p:] / (len(s) - n_p)
    else:
        g[:n_p] = prior * slope[:n_p] / n_p
        g[n_p:] = -slope[n_p:] / (len(s) - n_p)
    return prior * (1 - s[:n_p]).mean() + max(0.0, rest), g


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 120, rate: float = 0.03, least: int = 3, z: float = 4.0) -> Model:
    """Minimises the non-negative PU risk by Adam.

    Only features in at least
    `least` positives that are more frequent there than in unlabelled texts by z standard
    errors get a weight, which stays non-negative; it starts from the log ratio of the
    feature's share among positives and among negatives, the latter being the
    prior-corrected share (u - prior * p) / (1 - prior).
    Without positives or unlabelled texts every score is that of an empty text, under 0.5.
    """
    size = 1 << BITS
    weights = np.zeros(size)
    prior = min(max(prior, 1e-3), 0.999)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(weights, min(bias, -1.0), prior)
    rows = [*positive, *unlabelled]
    n_p, n, n_u = len(positive), len(rows), len(unlabelled)
    seen_p = np.bincount(np.concatenate(positive), minlength=size)
    seen_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    p, u = seen_p / n_p, seen_u / n_u
    error = np.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u + 1e-12)
    kept = np.flatnonzero((seen_p >= least) & (p - u > z * error))
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    flat = place[np.concatenate(rows)]
    doc = np.repeat(np.arange(n), [len(r) for r in rows])[flat >= 0]
    flat = flat[flat >= 0]
    negative = np.maximum((u[kept] - prior * p[kept]) / (1 - prior), 0.5 / n_u)
    x = np.append(np.clip(np.log(p[kept] / negative), 0, 6) / (1 + len(STEMS)), bias)
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, steps + 1):
        _, g = risk(1 / (1 + np.exp(-np.clip(np.bincount(doc, x[flat], n) + x[-1], -40, 40))), n_p, prior)
        grad = np.append(np.bincount(flat, g[doc], len(kept)), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        x[:-1] = np.maximum(x[:-1], 0)
    weights[kept] = x[:-1]
    return Model(weights, min(float(x[-1]), -0.5), prior)


def _unique_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, toxic in rows_of(batches, "text", "toxic"):
        out = []
        for a, b in by_bytes(texts):
            f, d = _features(Words(texts[a:b]))
            key = np.unique((d << BITS) | f)
            cut = np.searchsorted(key, np.arange(b - a + 1) << BITS)
            out += [(key[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)).astype(np.int32) for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in out], pa.binary()), pa.array(toxic, pa.int32())], names=["f", "toxic"])


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 6000, max_bytes: int = 64 << 20, steps: int = 120, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most max_positive toxic texts and max_unlabelled texts of any kind, of max_bytes together.

    Only rows outside the held-out third take part, and of rows with one id one (the text with the smallest hash). The ids with the smallest hash
    are taken, so the sample doesn't depend on partitions; from the one on whose text would exceed max_bytes they are left out. The prior is the share of toxic
    rows among these labels. Labels that are null, or of ids that no document has, are ignored, as are rows without an id. Without labels, or without documents,
    every score is that of an empty text.
    """
    said = small_batches(labels).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    prior = said.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("id is not null").where(~held_out(F.col("id")))
    order = [F.xxhash64("id"), F.col("id")]
    one = src.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"))).alias("t")).select("id", "t.*")
    toxic = said.where("toxic = 1").join(one, "id").orderBy(*order).limit(max_positive).select("id", "th", "size", F.lit(1).alias("toxic"))
    other = one.orderBy(*order).limit(max_unlabelled).select("id", "th", "size", F.lit(0).alias("toxic"))
    chosen = toxic.unionByName(other)  # at most max_positive + max_unlabelled rows, so one task sums their sizes
    before = F.sum("size").over(Window.orderBy(*order, "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = chosen.withColumn("total", before).where(F.col("total") <= max_bytes).select("id", "th", "toxic")
    picked = src.join(F.broadcast(chosen), (src.id == chosen.id) & (F.xxhash64(src.text) == chosen.th)).select(src.id, "toxic", "text").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = picked.select("text", "toxic").mapInArrow(_unique_features, "f binary, toxic int").collect()  # bounded by max_bytes: a byte begins at most one word, of four features
    get = lambda y: [np.frombuffer(bytes(r.f), dtype=np.int32) for r in sorted((r for r in rows if r.toxic == y), key=lambda r: bytes(r.f))]
    return fit(get(1), get(0), prior, steps)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from threshold on) to each row, named with trailing _ if docs has such columns; null texts score as empty ones."""
    sc = small_batches(docs).sparkSession.sparkContext
    shared = sc.broadcast((np.flatnonzero(model.weights).astype(np.int32), model.weights[np.flatnonzero(model.weights)], model.bias, model.prior))

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias, prior = shared.value
        full = np.zeros(1 << BITS)
        full[at] = w
        m = Model(full, bias, prior)
        for texts in batches:
            step = max(1, len(texts) * PIECE_BYTES // max(texts.nbytes, 1))
            yield pa.array(np.concatenate([np.zeros(0), *(m.score(texts.slice(i, step).to_pylist()) for i in range(0, len(texts), step))]))

    name = temp_name(docs, "score")
    out = docs.withColumn(name, toxicity(F.col(f"`{text_col}`")))
    return out.withColumn(temp_name(docs, "predicted"), (F.col(name) >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows under the threshold, with the columns of docs as they are."""
    return score(docs, model, threshold, text_col).where(F.col(f"`{temp_name(docs, 'predicted')}`") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
