"""SentencePiece encoding and decoding with the N best segmentations."""

from __future__ import annotations

import gc
import heapq
import math
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, rows_of, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Entries that one Python worker keeps; beyond, it starts anew.
CACHE = 900_000
#: Words that are searched at once; code points from which a word is searched for itself; characters of text whose new words are gathered.
BLOCK, LONG, GATHER = 1024, 48, 1 << 20
#: Places that are tried for a node's children.
TRIES = 1000
_models: dict[str, PieceModel] = {}


class PieceModel:
    """The pieces of a SentencePiece model file as a lattice with additive scores.

    A character that no piece covers becomes its UTF-8 bytes, each `penalty` under the lowest score.
    """

    def __init__(self, path: str, penalty: float = 10.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.surface = [m.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.surface[i][3:-1], 16): i for i in range(n) if m.is_byte(i)}
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) for i in range(n)]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in range(n) if special[i] and i not in self.byte_of}
        self.raw = [b"" if i in self.special else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.surface)]
        self.pieces = {self.surface[i]: (i, m.get_score(i)) for i in range(n) if not special[i]}
        #: By each beginning of a piece: the piece, or None if it is only a beginning.
        self.begins: dict = {p[:i]: None for p in self.pieces for i in range(1, len(p))}
        self.begins |= self.pieces
        scores = [s for _, s in self.pieces.values() if s > -1e8]
        self.byte_score = min(scores) - penalty
        self.unknown = next((i for i in range(n) if m.is_unknown(i)), 0)
        self.width, self.code = ("<u2", "H") if n <= 1 << 16 else ("<u4", "I")
        inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        # No piece goes from a letter to one of these marks or back, nor into a space mark, so the
        # lattice falls apart there and the parts can be searched for themselves.
        marks = [c for c in ".,;:!?()\"'\n" if not any((a == c) != (b == c) and (a if b == c else b).isalpha() for a, b in inside)]
        self.apart = not any(b == SPACE != a for a, b in inside)
        letters = "[^\\W\\d_]"
        cut = "".join(map(re.escape, marks))
        stop = f"{SPACE}|(?<={letters})[{cut}]|(?<=[{cut}]){letters}" if cut else SPACE
        self.split = re.compile(f"(?:{SPACE}+.?|.)(?:(?!{stop}).)*", re.S)
        self._trie()
        #: Results by chunk, and by word after a space (chunks put together).
        self.chunk_cache: dict[tuple[str, int], tuple] = {}
        self.word_cache: dict[int, tuple[dict[str, tuple], dict[str, tuple]]] = {}

    def _trie(self) -> None:
        """The beginnings of pieces as nodes of a trie in arrays, the root is 0.

        Node v has a child by symbol s if owner[base[v] + s] is v; symbol 0 (any character that is in no piece) leads nowhere.
        The last entry of score, token and depth, so index -1, is a character as bytes.
        """
        chars = sorted({c for p in self.pieces for c in p})
        self.symbol = np.zeros(max(map(ord, chars), default=0) + 2, np.int32)
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {p: v for v, p in enumerate(self.begins, 1)}
        children: dict[int, list[tuple[int, int]]] = {}
        for p, v in number.items():
            children.setdefault(number.get(p[:-1], 0), []).append((int(self.symbol[ord(p[-1])]), v))
        span = max(1 << 16, 1 << (8 * len(number)).bit_length())
        self.base = np.zeros(len(number) + 2, np.int32)
        taken: dict[int, tuple[int, int]] = {}
        at, end = 0, span + len(chars)
        for v, below in sorted(children.items(), key=lambda x: -len(x[1])):
            for _ in range(TRIES):
                if not any([at + s in taken for s, _ in below]):
                    self.base[v] = at
                    break
                at = (at * 5 + 12345) % span  # goes through all places of a power of two
            else:  # behind all others
                self.base[v], end = end, end + len(chars)
            taken |= {int(self.base[v]) + s: (v, w) for s, w in below}
        self.owner, self.child = np.full(end + len(chars) + 1, -1, np.int32), np.zeros(end + len(chars) + 1, np.int32)
        slots = list(taken)
        self.owner[slots], self.child[slots] = [v for v, _ in taken.values()], [w for _, w in taken.values()]
        self.score = np.full(len(number) + 2, -np.inf)
        self.token = np.full(len(number) + 2, -1, np.int32)
        self.depth = np.ones(len(number) + 2, np.int64)
        for p, v in number.items():
            self.depth[v] = len(p)
            if self.begins[p]:
                self.token[v], self.score[v] = self.begins[p]

    def normal(self, text: str) -> str:
        """The text as the lattice sees it: a space mark before it and for each space. Empty stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def chunks(self, normal: str) -> list[str]:
        return self.split.findall(normal) if self.apart else [normal] if normal else []

    def lattice(self, chunk: str) -> tuple[list[list[tuple]], list[float]]:
        """Edges (start, ids, score) by their end, and the best score from the start to each position."""
        n, get = len(chunk), self.begins.get
        edges: list[list[tuple]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-1e300] * n
        for i in range(n):
            at = best[i]
            for j in range(i + 1, n + 1):
                p = get(chunk[i:j], 0)
                if p is None:
                    continue
                if not p:
                    break
                s = p[1]
                edges[j].append((i, p[0], s))
                if at + s > best[j]:
                    best[j] = at + s
            if not edges[i + 1] or edges[i + 1][-1][0] != i:  # no piece is this character
                raw = chunk[i].encode("utf-8", "surrogatepass")
                s = self.byte_score * len(raw)
                edges[i + 1].append((i, tuple([self.bytes.get(b, self.unknown) for b in raw]), s))
                if at + s > best[i + 1]:
                    best[i + 1] = at + s
        return edges, best

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n segmentations with the highest scores, (score, ids).

        Forward Viterbi scores are the exact rest of any path that is built from the end,
        so backward A* completes paths in falling order of score. Each open path stands for a
        complete one of its priority, so no more than the paths still wanted need be open.
        """
        edges, best = self.lattice(chunk)
        queue = [(-best[-1], 0, len(chunk), 0.0, None)]  # sorted
        out, made, want = [], 0, n
        while queue:
            _, _, at, score, path = queue.pop(0)
            if not at:
                ids: list[int] = []
                while path is not None:
                    piece, path = path
                    if isinstance(piece, tuple):
                        ids += piece
                    else:
                        ids.append(piece)
                out.append((score, tuple(ids)))
                want -= 1
                if not want:
                    break
                continue
            size = len(queue)
            worst = queue[-1][0] if size >= want else 1e308
            for start, piece, s in edges[at]:
                rest = score + s
                key = -rest - best[start]
                if key < worst:
                    made += 1
                    insort(queue, (key, made, start, rest, (piece, path)))
                    if size >= want:
                        queue.pop()
                    else:
                        size += 1
                    if size >= want:
                        worst = queue[-1][0]
        return out

    def known(self, chunk: str, n: int) -> tuple:
        """(score, ids as bytes, smallest loss of another segmentation, all losses) from the cache."""
        got = self.chunk_cache.get((chunk, n))
        if got is None:
            if len(self.chunk_cache) >= CACHE // 4:
                self.chunk_cache.clear()
            got = self.chunk_cache[chunk, n] = self._entry(chunk, n)
        return got

    def _entry(self, chunk: str, n: int) -> tuple:
        found = self.nbest(chunk, n)
        s, ids = found[0]
        lost = tuple([s - x for x, _ in found[1:]])
        return s, array(self.code, ids).tobytes(), lost[0] if lost else math.inf, lost

    def _word(self, word: str, n: int) -> tuple:
        """(score, ids as bytes, smallest loss, losses) of a space mark and this word."""
        if word.isalpha():  # one chunk
            return self._entry(SPACE + word, n)
        parts = [self.known(c, n) for c in self.chunks(SPACE + word)]
        if len(parts) == 1:
            return parts[0]
        lost = [0.0]
        for p in parts:
            lost = heapq.nsmallest(n, [x + d for x in lost for d in (0.0, *p[3])])
        return sum(p[0] for p in parts), b"".join([p[1] for p in parts]), lost[1] if len(lost) > 1 else float("inf"), tuple(lost[1:])

    def _edges(self, cp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length of a piece: score and node of the piece that begins at each place; -inf where none does. Node -1 is a character as bytes."""
        size, width = cp.shape
        symbol = self.symbol[np.minimum(cp, len(self.symbol) - 1)].ravel()
        at, node = np.arange(size * width), np.zeros(size * width, np.int32)
        scores: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        for d in range(size):
            live = np.searchsorted(at, (size - d) * width)
            at, node = at[:live], node[:live]
            slot = self.base[node] + symbol[at + d * width]
            ok = np.flatnonzero(self.owner[slot] == node)
            at, node = at[ok], self.child[slot[ok]]
            if d and not len(at):
                break
            s, v = np.full(size * width, -np.inf), np.full(size * width, -1, np.int32)
            s[at], v[at] = self.score[node], node
            if not d:
                raw = np.flatnonzero(s == -np.inf)  # no piece is this character
                c = cp.ravel()[raw]
                s[raw] = self.byte_score * (1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
                v[raw] = -1
            scores.append(s.reshape(size, width))
            nodes.append(v.reshape(size, width))
        return scores, nodes

    def _ids(self, tokens: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word from tokens by word and place: -2 for none, -1 for the character there as bytes."""
        row, place = np.nonzero(tokens != -2)
        flat, many = tokens[row, place], np.ones(len(row), np.int64)
        raw = np.flatnonzero(flat == -1)
        if len(raw):
            kinds, kind = np.unique(cp[place[raw], row[raw]], return_inverse=True)
            ids = [[self.bytes.get(b, self.unknown) for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
            many[raw] = np.array([len(x) for x in ids])[kind]
            start = (np.cumsum(many) - many)[raw]
            flat = np.repeat(flat, many)
            for k, x in enumerate(ids):
                flat[start[kind == k][:, None] + np.arange(len(x))] = x
        return flat, np.bincount(row, many, len(tokens)).astype(np.int64)

    def _entries(self, words: list[str], n: int) -> list[tuple | None]:
        """What _word() gives, of words of about one length at once; None where several segmentations are best, so that _word() chooses.

        The n best scores to each place come from those to the places before, for all words together. Summed from
        the front and not from the end, which is the same number where scores are integers.
        """
        size = np.array([len(w) + 1 for w in words])
        width, longest, keep = len(words), int(size.max()), max(n, 2)
        cp = np.zeros((width, longest), np.uint32)
        cp[np.arange(longest) < size[:, None]] = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), "<u4")
        cp = np.ascontiguousarray(cp.T)
        scores, nodes = self._edges(cp)
        some = [(s > -np.inf).any(axis=1).tolist() for s in scores]
        best = np.full((longest + 1, keep, width), -np.inf)
        best[0, 0] = 0.0
        back = np.full((longest + 1, width), -1, np.int32)
        a, low = np.empty(width), np.empty(width)
        for j in range(1, longest + 1):
            top = best[j]
            for d in range(min(j, len(scores))):
                i = j - 1 - d
                if not some[d][i]:
                    continue
                for r in range(keep if i else 1):  # the r-th is at most the r before
                    np.add(best[i, r], scores[d][i], out=a)
                    if not r:
                        np.copyto(back[j], nodes[d][i], where=a > top[0])
                    for q in range(r, keep):
                        np.minimum(top[q], a, out=low)
                        np.maximum(top[q], a, out=top[q])
                        a, low = low, a
        column = np.arange(width)
        tops = best[size, :, column]
        tokens = np.full((width, longest), -2, np.int32)
        at = size
        while len(column):
            node = back[at, column]
            at = at - self.depth[node]
            tokens[column, at] = self.token[node]
            left = at > 0
            at, column = at[left], column[left]
        flat, many = self._ids(tokens, cp)
        data, item = flat.astype(self.width).tobytes(), np.dtype(self.width).itemsize
        ends = (np.cumsum(many) * item).tolist()
        out: list[tuple | None] = []
        a0 = 0
        for b0, s, lost, tie in zip(ends, tops[:, 0].tolist(), (tops[:, :1] - tops[:, 1:n]).tolist(), (tops[:, 0] == tops[:, 1]).tolist()):
            if lost and lost[-1] == math.inf:
                lost = [x for x in lost if x < math.inf]
            out.append(None if tie else (s, data[a0:b0], lost[0] if lost else math.inf, tuple(lost)))
            a0 = b0
        return out

    def _learn(self, words: set[str], n: int, young: dict[str, tuple], old: dict[str, tuple]) -> None:
        """Puts the entries of all these words into young."""
        new = []
        for w in words.difference(young):
            got = old.get(w)
            if got is not None:
                young[w] = got
            elif len(w) < LONG:
                new.append(w)
            else:
                young[w] = self._word(w, n)
        new.sort(key=len)
        for i in range(0, len(new), BLOCK):
            block = new[i : i + BLOCK]
            for w, e in zip(block, self._entries(block, n)):
                young[w] = e or self._word(w, n)

    def encode(self, text: str | None, n: int = 3) -> tuple[bytes, list[float]]:
        """(ids of the best segmentation, scores of the n best) of a whole text."""
        return self.encode_all([text], n)[0]

    def encode_all(self, texts: list[str | None], n: int = 3) -> list[tuple[bytes, list[float]]]:
        """encode() of each text; words that are new in them are searched together."""
        split = [t.split(" ") if t and self.apart and SPACE not in t else None for t in texts]
        split = [None if w is None or "" in w else w for w in split]
        # Two generations: words that are met again outlive a full cache.
        young, old = self.word_cache.setdefault(n, ({}, {}))
        self._learn(set().union(*[w for w in split if w]), n, young, old)
        out = [self._joined([young[w] for w in words] if words else [self.known(c, n) for c in self.chunks(self.normal(t or ""))], n) for t, words in zip(texts, split)]
        if len(young) >= CACHE // 2:
            self.word_cache[n] = {}, young
        return out

    def _joined(self, parts: list[tuple], n: int) -> tuple[bytes, list[float]]:
        if not parts:
            return b"", [0.0]
        total = sum([p[0] for p in parts])
        # The n best of the text change at most n - 1 parts, those with the smallest losses.
        lost = [0.0]
        if n > 1:
            losses = [p[2] for p in parts]
            cut = heapq.nsmallest(n - 1, losses)[-1]
            few = sorted([p[3] for p, x in zip(parts, losses) if x <= cut and p[3]])[: n - 1]
            for p in few:
                lost = heapq.nsmallest(n, [x + d for x in lost for d in (0.0, *p)])
        return b"".join([p[1] for p in parts]), [total - x for x in lost]

    def segmentations(self, text: str | None, n: int = 3) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text, with their ids."""
        states: list[tuple[float, list[int]]] = [(0.0, [])]
        for c in self.chunks(self.normal(text or "")):
            found = self.nbest(c, n)
            states = heapq.nsmallest(n, [(x - s, p + list(i)) for x, p in states for s, i in found], key=lambda v: v[0])
        return [(-x, p) for x, p in states]

    def text(self, ids: Iterable[int]) -> str:
        """The normal text of ids; byte pieces are joined to characters, broken ones become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is None:
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw = bytearray()
                if i not in self.special:
                    out.append(self.surface[i])
            else:
                raw.append(b)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode_array(self, ids: np.ndarray) -> str:
        """decode() for many ids: surfaces are joined as bytes."""
        t = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return t[1:] if t.startswith(" ") else t

    def decode(self, ids: Iterable[int]) -> str:
        t = self.text(ids).replace(SPACE, " ")
        return t[1:] if t.startswith(" ") else t


def model(path: str = MODEL) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, n: int = 3, path: str = MODEL, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text to pieces.

    Returns id, n_tokens, ids (array, if with_ids), ids_crc32 (of the ids as little-endian
    16-bit numbers, or 32-bit for a vocabulary over 65,536), scores (of the n best segmentations, best
    first; fewer if there are fewer), round_trip (decoding the ids gives the text).
    Null and empty texts have no ids and the scores [0]. A text that holds U+2581 decodes to
    a space there. Each row is encoded for itself; ids may be null or repeated. Other columns are ignored.
    No shuffle; each worker keeps the results of recent words, at most CACHE of them and those of a batch.
    """
    src = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for ids, texts in rows_of(batches, "id", "text"):
            for a, b in by_bytes(texts, GATHER):
                got = m.encode_all(texts[a:b], n)
                arrays = [np.frombuffer(x, m.width) for x, _ in got]
                fits = [m.decode_array(x) == (t or "") for x, t in zip(arrays, texts[a:b])]
                cols = [pa.array(ids[a:b], pa.int64()), pa.array([len(x) for x in arrays], pa.int64()), pa.array([zlib.crc32(x) for x, _ in got], pa.int64()), pa.array([s for _, s in got], pa.list_(pa.float64())), pa.array(fits, pa.bool_())]
                names = ["id", "n_tokens", "ids_crc32", "scores", "round_trip"]
                if with_ids:
                    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in arrays], out=offsets[1:])
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else [], pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the caches are slow to scan
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    schema = "id long, n_tokens long, ids_crc32 long, scores array<double>, round_trip boolean" + ", ids array<int>" * with_ids
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str = MODEL, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of each row's ids; null ids give a null text. Control pieces are left out."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for s in batches:
            yield pd.Series([None if x is None else m.decode(list(x)) for x in s], dtype="object")

    return tokens.withColumn(out_col, text_of(F.col(f"`{ids_col}`")))
