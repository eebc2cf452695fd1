"""Removal of long byte strings that stand more than once, by blockwise suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, mix, powers, rows_of, small_batches, temp_name
from .suffixes import equal_suffixes

#: Bytes of the samples that anchor a string, of text that is searched at once, and of contexts that are sorted at once.
GRAM, CHUNK, SORT_BYTES = 40, 1 << 18, 2_000_000
#: Different contexts that are sorted in one task; a larger group is dealt by slices of its offsets, first wide, then narrow ones.
MANY, SLICES = 256, (40, 8, 1)
#: Contexts of a text, by and large.
CONTEXTS = 20
_BASE = 0xD1342543DE82EF95
_POS = np.uint64((1 << 20) - 1)


def _anchors(buf: np.ndarray, length: int) -> np.ndarray:
    """For each string of `length` bytes in buf the place of its leftmost least sample (GRAM bytes)."""
    n = len(buf)
    c = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n + 1)[:n], out=c[1:])
    m = n - GRAM + 1
    h = mix((c[GRAM:] - c[:m]) * powers(pow(_BASE, -1, 1 << 64), n + 1)[:m])
    w = length - GRAM + 1
    key = (h & ~_POS) | np.arange(m, dtype=np.uint64)
    pad = -m % w
    key = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    up = np.minimum.accumulate(key, axis=1).ravel()
    down = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(down[: n - length + 1], up[w - 1 : w - 1 + n - length + 1]) & _POS).astype(np.int64)


def contexts(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, start, end, anchor) of runs of string starts start..end that have one anchor."""
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        buf = np.frombuffer(b"".join(t for _, _, t in batch), dtype=np.uint8)
        at = _anchors(buf, length)
        base = 0
        for i, off, t in batch:
            own = at[base : base + len(t) - length + 1]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            lo = [0, *cut.tolist()]
            hi = [*(cut - 1).tolist(), len(own) - 1]
            for x, y in zip(lo, hi):
                yield i, off + x, off + y, off + int(own[x]) - base
            base += len(t)

    for i, t in enumerate(texts):
        for off in range(0, len(t) - length + 1, CHUNK - length + 1):
            part = t[off : off + CHUNK]
            if len(part) < length:
                break
            if size + len(part) > CHUNK * 2 - 1 and batch:
                yield from flush()
                batch, size = [], 0
            batch.append((i, off, part))
            size += len(part)
    if batch:
        yield from flush()


def _half(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def _raw(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def _find(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, th, texts in rows_of(batches, "k", "th", "text"):
            raw = [_raw(t) for t in texts]
            rows: list[tuple] = []
            for i, s, e, p in contexts(raw, length):
                t = raw[i]
                c = xxhash.xxh3_128_intdigest(t[s : e + length])
                rows.append((k[i], th[i], _half(xxhash.xxh3_64_intdigest(t[p : p + GRAM])), _half(c), _half(c >> 64), s, e, p))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


_NAMES = ["k", "th", "g", "c1", "c2", "s", "e", "p"]


def _batch(rows: list[tuple], names: list[str] = _NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*rows)], names=names)


def _cut_out(length: int):
    """The bytes of the wanted contexts, with the offset of the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, wants in rows_of(batches, "text", "want"):
            rows: list[tuple] = []
            size = 0
            for text, want in zip(texts, wants):
                t = _raw(text)
                for w in want:
                    s, e = w["s"], w["e"]
                    rows.append((w["g"], w["c1"], w["c2"], 0, w["p"] - s, t[s : e + length]))
                    size += e + length - s
                    if size > 4_000_000:
                        yield _batch(rows, _PIECE)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, _PIECE)

    return run


_PIECE = ["g", "c1", "c2", "shift", "at", "bytes"]


def _slice(length: int, width: int):
    """Pieces cut to those strings whose offset from the sample is in one slice of `width`.

    Such strings share length - width + 1 bytes, so a hash of these deals them into groups that part no equal strings. Of
    width 1 a group is one string.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c1, c2, shift, at, pieces in rows_of(batches, *_PIECE):
            rows: list[tuple] = []
            for i, t in enumerate(pieces):
                p, e = at[i], len(t) - length
                for lo in range((p - e) // width * width, p + 1, width):
                    a, b = max(0, p - lo - width + 1), min(e, p - lo)
                    core = t[p - lo : p + length - lo - width + 1]
                    part = t[a : b + length]
                    h = xxhash.xxh3_128_intdigest(part)
                    rows.append((_half(xxhash.xxh3_64_intdigest(core, seed=lo & 0xFFFFFFFF) ^ g[i]), c1[i], c2[i], shift[i] + a, p - a, part, _half(h), _half(h >> 64)))
                if len(rows) > 10_000:
                    yield _batch(rows, [*_PIECE, "h1", "h2"])
                    rows = []
            if rows:
                yield _batch(rows, [*_PIECE, "h1", "h2"])

    return run


def _sort(length: int):
    """Strings that stand more than once in contexts with the same sample: (c1, c2, from, to) as offsets in the context.

    Contexts are padded so that their samples stand at multiples of the cover's period:
    equal strings then have one residue, as they have one offset from their sample.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        size, last = 0, None
        for b in batches:
            for r in b.to_pylist():
                if size > SORT_BYTES and r["g"] != last:
                    yield held
                    held, size = [], 0
                last = r["g"]
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            parts, starts, at = [], [], 0
            for r in rows:
                pad = -(at + r["at"]) % 31
                parts.append(b"\0" * pad + r["bytes"])
                at += pad
                starts.append(np.arange(at, at + len(r["bytes"]) - length + 1))
                at += len(r["bytes"])
            n = equal_suffixes(np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate(starts), length)
            out, base = [], 0
            for r, s in zip(rows, starts):
                hit = np.concatenate([[0], n[base : base + len(s)] > 1, [0]]).astype(np.int8)
                base += len(s)
                step = np.diff(hit)
                for a, b in zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist()):
                    out.append((r["c1"], r["c2"], r["shift"] + a, r["shift"] + b))
            if out:
                yield _batch(out, ["c1", "c2", "x", "y"])

    return run


def _sorted(pieces: DataFrame, length: int, rows: int) -> DataFrame:
    return durable(pieces.select(*_PIECE).repartition("g").sortWithinPartitions("g", "c1", "c2", "shift").mapInArrow(_sort(length), "c1 long, c2 long, x long, y long"), rows)


def _in_slices(pieces: DataFrame, length: int, rows: int) -> DataFrame:
    """(c1, c2, x, y) of strings that stand more than once in pieces of large groups.

    Level by level: pieces are cut to slices, equal slices are counted map-side and are repeated as a whole, and one of each goes on. Groups that
    are small now are sorted; the others are cut to narrower slices, at last to single strings.
    """
    out, written = None, []
    for width in SLICES:
        cut = durable(pieces.mapInArrow(_slice(length, width), "g long, c1 long, c2 long, shift long, at long, bytes binary, h1 long, h2 long"), rows)
        one = durable(cut.groupBy("g", "h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("c1", "c2", "shift", "at", "bytes")).alias("p")).select("g", "h1", "h2", "m", "p.*"), rows)
        twice = one.where("m > 1").select("g", "h1", "h2")
        whole = cut.join(twice, ["g", "h1", "h2"], "left_semi").select("c1", "c2", F.col("shift").alias("x"), (F.col("shift") + F.octet_length("bytes") - length).cast("long").alias("y"))
        groups = durable(one.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rows)
        part = _sorted(one.join(groups.where(F.col("n") <= MANY), "g"), length, rows)
        whole = durable(whole, rows)
        out = whole.union(part) if out is None else out.union(whole).union(part)
        written += [cut, groups]
        pieces = one.join(groups.where(F.col("n") > MANY), "g").select(*_PIECE)
        if groups.where(F.col("n") > MANY).isEmpty():
            break
    discard(*written)
    return out


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, th, spans): for each text with strings of `length` bytes that also start elsewhere, the starts (from, to) of these."""
    src = small_batches(docs).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") >= length)
    n = docs.count()
    # Rows with one id and text are copies of each other: all of them is repeated.
    again = durable(src.groupBy("k", "th").agg(F.count(F.lit(1)).alias("m"), F.max(F.octet_length("text")).alias("n")).where("m > 1").select("k", "th", F.lit(0).cast("long").alias("from"), (F.col("n") - length).cast("long").alias("to")), n)
    if not again.isEmpty():
        src = src.dropDuplicates(["k", "th"])
    found = src.mapInArrow(_find(length), ", ".join(f"{n} long" for n in _NAMES))
    place = F.xxhash64("k", "th", "p", "s")
    # Tables that a join meets are written first, so that each join has two plain shuffles and adaptive execution can split a hot key.
    seen = durable(found.select("g", place.alias("o")).groupBy("g").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a <> b").select("g"), CONTEXTS * n)
    found = durable(found.join(seen, "g", "left_semi"), CONTEXTS * n)
    discard(seen)
    by_context = durable(found.groupBy("g", "c1", "c2").agg((F.min(place) != F.max(place)).alias("twice"), F.first(F.struct("k", "th", "s", "e", "p")).alias("loc")), CONTEXTS * n)
    # A context that stands twice is all repeated; one that stands once is compared with the others of its sample.
    mixed = durable(by_context.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.bool_and("twice").alias("all")).where("n > 1 and not all").select("g", (F.col("n") > MANY).alias("many")), n)
    wanted = by_context.join(mixed, "g").select("loc.k", "loc.th", "many", F.struct("g", "c1", "c2", "loc.s", "loc.e", "loc.p").alias("w"))
    texts = durable(src.join(wanted.groupBy("k", "th", "many").agg(F.collect_list("w").alias("want")), ["k", "th"]).select("text", "want", "many"), CONTEXTS * n)
    discard(mixed)
    pieces = lambda many: texts.where(F.col("many") == many).select("text", "want").mapInArrow(_cut_out(length), "g long, c1 long, c2 long, shift long, at long, bytes binary")
    partial = _sorted(pieces(False), length, CONTEXTS * n)
    if not texts.where("many").isEmpty():
        partial = partial.union(_in_slices(pieces(True), length, CONTEXTS * n))
    whole = found.join(by_context.where("twice").select("g", "c1", "c2"), ["g", "c1", "c2"], "left_semi").select("k", "th", F.col("s").alias("from"), F.col("e").alias("to"))
    part = found.join(partial, ["c1", "c2"]).select("k", "th", (F.col("s") + F.col("x")).alias("from"), (F.col("s") + F.col("y")).alias("to"))
    spans = durable(whole.unionByName(part).unionByName(again).distinct().groupBy("k", "th").agg(F.collect_list(F.struct("from", "to")).alias("spans")), n)
    discard(found, by_context, texts)
    return spans


def removed(spans: list, length: int, n: int) -> list[tuple[int, int]]:
    """Merged byte ranges that the strings starting in these ranges cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"] + length) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _remove(length: int, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, texts, spans in rows_of(batches, "uid", "text", "spans"):
            cols: list[list] = [[], [], [], [], []]
            for u, text, s in zip(uid, texts, spans):
                t = _raw(text)
                cuts = removed(s, length, len(t))
                edges = [0, *(x for c in cuts for x in c), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])) if cuts else t
                for c, v in zip(cols, (u, len(t), len(t) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest() if digest else None if text is None else kept.decode("utf-8", "ignore"))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["uid", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    names = {x: temp_name(docs, x) for x in ("k", "th", "spans")}
    spans = repeated_spans(docs, length, id_col, text_col).select(*[F.col(x).alias(n) for x, n in names.items()])
    rows = docs.withColumn(names["k"], F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))).withColumn(names["th"], F.xxhash64(F.col(f"`{text_col}`")))
    return rows.join(spans, [names["k"], names["th"]], "left"), names


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts each byte covered by a string of `length` bytes that also starts anywhere else, first ones included.

    A string is anchored by the least of its 40-byte samples, which equal strings share. Only strings whose
    sample stands twice go on. Runs of strings with one anchor are a context; one that stands twice
    is repeated as a whole, any other is compared with those of its sample by blockwise
    suffix sorting (equal_suffixes). A sample with more than MANY different contexts would be one hot group of a task: these are
    cut into slices, of which equal ones are counted map-side, until groups are small. Matches never cross texts and are judged on the input.

    Returns the columns of docs with the remaining text (bytes of a character cut in two are dropped); a null text stays null.
    Repeated rows (equal id and text) are copies of each other, so all of each goes. Null ids are one id. Texts under `length` bytes are unchanged. length is 62 or more.
    """
    rows, names = _with_spans(docs, length, id_col, text_col)
    columns, spans_col = docs.columns, names["spans"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(text_col).to_pylist(), b.column(spans_col).to_pylist()
            out = []
            for text, s in zip(texts, spans):
                t = _raw(text)
                edges = [0, *(x for c in removed(s, length, len(t)) for x in c), len(t)]
                out.append(text if not s else b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore"))
            cols = [pa.array(out, pa.string()) if c == text_col else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return rows.select(*[F.col(f"`{c}`") for c in columns], F.col(spans_col)).mapInArrow(cut, docs.schema)


def repeat_digests(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What remove_repeats does to each row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. A null text counts as empty."""
    rows, names = _with_spans(docs, length, id_col, text_col)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("uid"), F.col(f"`{text_col}`").alias("text"), F.col(names["spans"]).alias("spans"))
    out = rows.mapInArrow(_remove(length, True), "uid long, n_bytes long, n_removed long, n_spans long, kept string")
    return out.select(F.col("uid").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
