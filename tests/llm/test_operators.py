"""The training-data operators against brute force, on a fixture with the odd cases and on a small table."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, fingerprints, licenses, lines, near, packing, pieces, queries, repeats, sharding, suffixes, toxicity
from tidemark.llm.common import Words, shingles

SMALL = "/root/testdata/sf0.001"
PHRASE = "the quick brown fox jumps over a lazy dog and then goes home to sleep under the old oak tree by the quiet river bank where nobody ever walks at night because of the owls"


def odd_texts():
    long = " ".join(f"w{i * 7919 % 1009}" for i in range(20_000))
    block = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(700))
    return [
        None, "", " \n\t ", "a", "Straße ﬁn", "STRASSE  fin", "é", "é", "x" * 5000, "ab" * 900,
        PHRASE, PHRASE, PHRASE.upper(), PHRASE.replace("lazy", "hazy"), PHRASE + " x",
        long, long[:60_000] + " tail", block, "pre " + block + " post", block[:399], block[:401], "日本語のテキスト" * 80, "日本語のテキスト" * 80 + "。",
        "line number one is here\nline number two is here\n\nline number one is hero", "line number one is here\r\n  line number one is here  ", "line number 1ne is here", "line numbr one is here",
        "Released under the MIT License.\nGNU general\npublic license", "mit licenses", "Licensed under CC BY-SA 4.0", "cc by cc by", "▁odd▁ marks", "퟿\U0001f600 smile",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i * 3 - 5, t, "s" if i % 3 else None, "k" + str(i), i) for i, t in enumerate(odd_texts())]
    rows += [(None, "no id", None, "q", 1), (None, None, "z", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, k string, spans int")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def both(*f):
    return pytest.mark.parametrize("name", ["odd", "small"])


def empty(df):
    return df.limit(0)


# --- 1 ----------------------------------------------------------------------


def all_segmentations(m, chunk):
    edges, _ = m.lattice(chunk)
    found = {len(chunk): [(0.0, ())]}

    def walk(end):
        if end == 0:
            return [(0.0, ())]
        return [(s + t, p + (i if isinstance(i, tuple) else (i,))) for start, i, t in edges[end] for s, p in walk(start)]

    del found
    return sorted((-s, p) for s, p in walk(len(chunk)))


def test_pieces_nbest_is_exact():
    m = pieces.model()
    for chunk in ["▁the", "▁reading", "▁é\n", "▁▁a", "日本", "▁Sträße"]:
        want = all_segmentations(m, chunk)
        for n in (1, 3, 7):
            got = m.nbest(chunk, n)
            assert [-s for s, _ in got] == [s for s, _ in want[:n]]
            assert len({p for _, p in got}) == len(got)
    text = "Reading, the  cat. é"
    want = sorted(-sum(c[0] for c in x) for x in itertools.product(*[m.nbest(c, 5) for c in m.chunks(m.normal(text))]))
    assert [-s for s in m.encode(text, 5)[1]] == want[:5]
    whole = m.nbest(m.normal(text), 5)  # without cutting it up
    assert [-s for s, _ in whole] == want[:5]
    assert [s for s, _ in m.segmentations(text, 5)] == [-s for s in want[:5]]
    assert all(m.decode(p) == text for _, p in m.segmentations(text, 5))


def test_pieces_of_words_searched_together():
    m = pieces.PieceModel(pieces.MODEL)
    rng = random.Random(7)
    parts = ["the", "ing", "er", "é", "ß", "Ab", "7", ".", ",\n", "%%%", "日本", "\U0001f9ff", "\ud800", "\0", "q", "\t\n"]
    words = list({"".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(4000)} - {""})[:3000] + ["x" * pieces.LONG, "ab" * 200]
    for n in (1, 3, 5):
        for w in words[:300] + words[-2:]:
            want = m.segmentations(w, n)
            ids, scores = m.encode(w, n)
            assert scores == [s for s, _ in want] and np.frombuffer(ids, m.width).tolist() == want[0][1]
        entries = m._entries(words[:3000], n)
        assert all(e is None or e == m._word(w, n) for w, e in zip(words, entries)) and sum(e is None for e in entries) < 1000
    whole = " ".join(words)
    want = m.segmentations(whole, 3)
    texts = [whole, None, "", " two  spaces ", "a▁b", whole[: len(whole) // 2]]
    got = m.encode_all(texts)
    assert got[0][1] == [s for s, _ in want] and np.frombuffer(got[0][0], m.width).tolist() == want[0][1]
    assert got[1:3] == [(b"", [0.0])] * 2 and [m.encode(t) for t in texts] == got


@pytest.mark.parametrize("tries", [1, 1000])
def test_pieces_trie_has_all_beginnings(tries, monkeypatch):
    monkeypatch.setattr(pieces, "TRIES", tries)
    rng = random.Random(3)
    chars = [chr(c) for c in rng.sample(range(32, 5000), 600)]
    m = object.__new__(pieces.PieceModel)
    m.pieces = {w: (i, -float(i)) for i, w in enumerate({a + b + c for a in chars[:60] for b in rng.sample(chars, 150) for c in ("", chars[0])})}
    m.begins = {p[:i]: None for p in m.pieces for i in range(1, len(p))} | m.pieces
    m._trie()

    def node(word):
        v = 0
        for c in word:
            slot = m.base[v] + (m.symbol[ord(c)] if ord(c) < len(m.symbol) else 0)
            if m.owner[slot] != v:
                return None
            v = m.child[slot]
        return v

    assert len({node(p) for p in m.begins} - {None, 0}) == len(m.begins)
    assert all((m.token[node(p)], m.score[node(p)], m.depth[node(p)]) == (*x, len(p)) for p, x in m.pieces.items())
    for _ in range(2000):
        w = "".join(rng.choices([*chars, "\U0001f9ff", "\0"], k=rng.randint(1, 4)))
        assert (node(w) is not None) == (w in m.begins)


def test_pieces_new_words_cost_no_search_each(monkeypatch):
    rng = random.Random(7)
    calls, search = [], pieces.PieceModel.nbest
    monkeypatch.setattr(pieces.PieceModel, "nbest", lambda self, chunk, n: calls.append(chunk) or search(self, chunk, n))
    text = " ".join({"".join(rng.choices(["tion", "und", "the", "er", "an", "wh"], k=6)) for _ in range(3000)})
    pieces.PieceModel(pieces.MODEL).encode(text)
    assert 0 <= len(calls) < len(text.split(" ")) // 4


@both()
def test_pieces(name, request):
    docs = request.getfixturevalue(name)
    m = pieces.model()
    out = pieces.encode(docs).collect()
    assert len(out) == docs.count()
    texts = collections.Counter(t for _, t in pairs(docs))
    back = pieces.decode(pieces.encode(docs)).collect()
    assert collections.Counter(r.text for r in back) == collections.Counter((t or "").replace("▁", " ") for t in texts.elements())
    for r in out:
        assert r.round_trip or r.doc_id == (odd_texts().index("▁odd▁ marks")) * 3 - 5
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u2").tobytes())
        assert r.scores == sorted(r.scores, reverse=True)
    assert m.encode(None) == (b"", [0.0])
    assert pieces.encode(empty(docs)).count() == 0


# --- 2 ----------------------------------------------------------------------


def canon(t):
    if not t.isascii():
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    else:
        t = t.lower()
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")


@pytest.mark.parametrize("bits", [128, 3])
@both()
def test_fingerprints(name, bits, request):
    docs = request.getfixturevalue(name).where("doc_id is not null")
    rows = sorted(pairs(docs))
    out = {r.doc_id: r for r in fingerprints.edit_and_fingerprint(docs, bits).collect()}
    assert len(out) == len(rows)
    by_canon, by_print = {}, {}
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_edited == float(canon(t) == canon(e)) and r.near_next == float(canon(t) == canon(nxt))
        for c, f in ((canon(t), r.fingerprint), (canon(e), r.edited_fingerprint)):
            assert by_canon.setdefault(c, f) == f and by_print.setdefault(f, c) == c


def test_fingerprints_odd(odd, spark):
    assert fingerprints.edit_and_fingerprint(odd).count() == odd.count()
    assert fingerprints.edit_and_fingerprint(empty(odd)).count() == 0
    far = spark.createDataFrame([(i * 10**12, f"t{i % 3}") for i in range(300)], "doc_id long, text string")
    out = fingerprints.edit_and_fingerprint(far.union(far.limit(1))).collect()
    assert len(out) == 301 and len({r.fingerprint for r in out}) == 3
    plan = fingerprints.edit_and_fingerprint(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints_uneven_ids(spark):
    """One outlier, or ids in far clumps: no block holds more than a few times its share, and next texts are right."""
    clumps = [10**14 * c + i for c in range(5) for i in range(400)]
    for ids in ([*range(1000), 10**15], clumps, [-(2**63), 2**63 - 1, *range(500)], list(range(0, 3000, 3))):
        df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
        rows = fingerprints._with_next(df, "doc_id", "text").collect()
        order = sorted(ids)
        after = dict(zip(order, [*order[1:], order[0]]))
        assert {r.id: r.next for r in rows} == {i: f"text {after[i]}" for i in ids}
        assert max(collections.Counter(r.block for r in rows).values()) <= 4 * fingerprints.BLOCK
    df = spark.createDataFrame([(None, f"text {i}") for i in range(1000)] + [(5, "x")], "doc_id long, text string")
    rows = fingerprints._with_next(df, "doc_id", "text").collect()
    assert max(collections.Counter(r.block for r in rows).values()) <= 4 * fingerprints.BLOCK and len({r.next for r in rows}) == 1001
    df = spark.createDataFrame([("a", "x"), ("7", "y"), ("b", "z")], "doc_id string, text string")
    assert {r.next for r in fingerprints._with_next(df, "doc_id", "text").collect()} == {"x", "y", "z"}


# --- 3 ----------------------------------------------------------------------


@both()
def test_packing(name, request):
    docs = request.getfixturevalue(name)
    cap = 2000
    out = packing.pack(docs, cap, unit=50).collect()
    size = collections.Counter()
    for r in out:
        size[r.bin] += r.n_bytes if r.bin != "none" else 0
    assert max(size.values()) <= cap
    total = sum(len((t or "").encode()) for _, t in pairs(docs))
    assert sum(r.n_bytes for r in out) == total
    source = {r.doc_id: r.source for r in docs.collect()}
    in_bin = collections.defaultdict(list)
    for r in out:
        if r.bin != "none":
            in_bin[r.bin].append(r)
    for rows in in_bin.values():
        s = [source[r.doc_id] for r in rows if r.doc_id is not None and source[r.doc_id] is not None]
        assert len(s) == len(set(s))
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert packing.pack(empty(docs)).count() == 0


def test_packer_is_best_fit():
    rng = np.random.default_rng(0)
    p, bins = packing.Packer(100), []
    for _ in range(500):
        size, s, c = int(rng.integers(1, 60)), int(rng.integers(6)), int(rng.integers(40))
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and s not in b[1] and c not in b[2]]
        want = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([100, set(), set()])
        bins[want][0] -= size
        bins[want][1].add(s)
        bins[want][2].add(c)
        assert p.put(size, s, c)[0] == want


# --- 4 ----------------------------------------------------------------------


def brute_vectors(rows, threshold):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    comp = {i: i for i, _ in rows}
    n = collections.Counter()

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for (i, x), (j, y) in itertools.combinations(good, 2):
        if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
            n[i] += 1
            n[j] += 1
            a, b = sorted((find(i), find(j)))
            comp[b] = a
    return {i: (n[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [1024, 4])
def test_embeddings(spark, block):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rng = np.random.default_rng(3)
    base = rng.standard_normal((5, 64))
    extra = [(10_000 + i, (base[i % 5] + 0.25 * rng.standard_normal(64)).tolist(), 1) for i in range(60)]
    odd = [(20_000, None, 0), (20_001, [0.0] * 64, 0), (20_002, [float("nan")] * 64, 0), (20_003, [1.0] * 3, 0), (20_004, [2.0] * 3, 0), (20_005, [1e300] * 64, 0), (20_006, [1e300] * 64, 0), (20_007, [None] * 64, 0), (20_008, [], 0)]
    df = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").union(spark.createDataFrame(extra + odd, "vec_id long, embedding array<double>, label int"))
    want = brute_vectors([(r.vec_id, r.embedding) for r in df.collect() if r.vec_id not in (20_005, 20_006)], 0.9)
    want[20_005], want[20_006] = (1, 20_005), (1, 20_005)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link_vectors(df, block=block).collect()}
    assert got == want
    assert embeddings.link_vectors(df.limit(0)).count() == 0


# --- 5 ----------------------------------------------------------------------


def brute_repeats(rows, length):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, t in raw:
        seen.update(t[a : a + length] for a in range(len(t) - length + 1))
    out = {}
    for i, t in raw:
        gone = np.zeros(len(t) + 2, dtype=int)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a + 1 : a + length + 1] = 1
        cuts = int((np.diff(gone) == 1).sum())
        out[i] = (len(t), int(gone.sum()), cuts, hashlib.sha256(bytes(x for x, g in zip(t, gone[1:]) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("many", [repeats.MANY, 1])
@both()
def test_repeats(name, many, request, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    docs = request.getfixturevalue(name).where("doc_id is not null")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_digests(docs).collect()}
    assert got == brute_repeats(pairs(docs), 400)


def test_repeats_odd(odd):
    out = repeats.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert repeats.remove_repeats(empty(odd)).count() == 0 and repeats.repeat_digests(empty(odd)).count() == 0


def test_repeated_rows_are_copies(odd):
    """Of a table united with itself nothing of 400 bytes stays."""
    twice = odd.where("doc_id is not null").union(odd.where("doc_id is not null"))
    rows = pairs(twice)
    want = collections.Counter((i, n, 0 if n < 400 else n) for i, n in ((i, len((t or "").encode())) for i, t in rows))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.repeat_digests(twice).collect()) == want


@pytest.mark.parametrize("many", [repeats.MANY, 1])
def test_common_passage(spark, many, monkeypatch):
    """One passage, with neighbours that differ, in all documents: a hot sample."""
    monkeypatch.setattr(repeats, "MANY", many)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = word(450)
    texts = [(i, word(int(rng.integers(0, 300))) + passage[: 450 - i % 60] + word(int(rng.integers(0, 300)))) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_digests(df).collect()}
    assert got == brute_repeats(texts, 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_digests(df, 250).collect()}
    assert got == brute_repeats(texts, 250)


@pytest.mark.parametrize("depth", [62, 63, 92, 93, 94, 124, 155, 200, 250, 278, 279, 280, 400, 527, 528])
def test_suffixes(depth):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, 900, dtype=np.uint8) + 97
    text = np.concatenate([np.where(rng.random(900) < 0.002, 65, base)[rng.integers(0, 200) :] for _ in range(6)] + [np.full(1000, 97)]).astype(np.uint8)
    starts = rng.permutation(len(text) - depth + 1)
    got = suffixes.equal_suffixes(text, starts, depth, block=500)
    count = collections.Counter(text[s : s + depth].tobytes() for s in starts)
    assert all(g == count[text[s : s + depth].tobytes()] for g, s in zip(got, starts))


# --- 6 ----------------------------------------------------------------------


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = queries.op6_toxicity(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in out)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    hit = sum(p for _, p, y in held if y)
    assert hit >= 0.75 * sum(y for _, _, y in held) and hit >= 0.85 * sum(p for _, p, _ in held)


def test_toxicity_odd(odd, spark):
    labels = spark.createDataFrame([(i * 3 - 5, int(i in (10, 11, 12))) for i in range(30)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.score(odd, toxicity.train(odd, labels))
    assert out.count() == odd.count() and out.where("score between 0 and 1").count() == odd.count()
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).where("predicted = 0").count() == odd.count()
    assert toxicity.score(empty(odd), toxicity.train(empty(odd), labels)).count() == 0


def own_features(text):
    """The features of a text one by one: each word and its beginnings of 4, 5 and 6 bytes."""
    out = set()
    for w in re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        for k in (0, *toxicity.STEMS):
            if not k or len(w) > k:
                part = Words([None])
                part.buf = np.frombuffer((w[:k] if k else w) + b"\0", dtype=np.uint8)
                h = part.hash(np.array([0]), np.array([len(part.buf) - 1]))
                out.add(int(toxicity.mix(h, 7 + k)[0] >> np.uint64(64 - toxicity.BITS)))
    return out


def test_risk_gradient():
    """The direction is the slope of the risk where the rest is not negative, and up that of the rest alone where it is."""
    rng = np.random.default_rng(6)
    sides = set()
    for prior in (0.05, 0.3, 0.9):
        for n_p, lower in ((5, 0), (20, 5)):
            z = rng.normal(0, 2, 40)
            z[n_p:] -= lower
            squash = lambda z: 1 / (1 + np.exp(-z))
            parts = lambda z: (prior * np.mean([1 - x for x in squash(z)[:n_p]]), np.mean(squash(z)[n_p:]) - prior * np.mean(squash(z)[:n_p]))
            got, g = toxicity.risk(squash(z), n_p, prior)
            fit, rest = parts(z)
            assert got == pytest.approx(fit + max(0, rest))
            sides.add(rest >= 0)
            for i in range(len(z)):
                up, down = z.copy(), z.copy()
                up[i] += 1e-5
                down[i] -= 1e-5
                a, b = parts(up), parts(down)
                slope = ((a[0] - b[0]) + (a[1] - b[1]) if rest >= 0 else -(a[1] - b[1])) / 2e-5
                assert g[i] == pytest.approx(slope, abs=1e-8)
    assert sides == {True, False}


def brute_fit(positive, unlabelled, prior, steps):
    """The classifier on a dense matrix, one weight for each feature of the texts."""
    names = sorted(set().union(*positive, *unlabelled))
    x = np.array([[f in t for f in names] for t in [*positive, *unlabelled]], dtype=float)
    n_p, n_u = len(positive), len(unlabelled)
    p, u = x[:n_p].mean(axis=0), x[n_p:].mean(axis=0)
    use = (x[:n_p].sum(axis=0) >= 3) & (p - u > 4 * np.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u + 1e-12))
    w = np.where(use, np.clip(np.log(np.where(use, p, 1) / np.maximum((u - prior * p) / (1 - prior), 0.5 / n_u)), 0, 6) / 4, 0.0)
    b = math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-(x @ w + b)))
        slope = s * (1 - s)
        fit, minus, rest = np.zeros(len(s)), np.zeros(len(s)), np.zeros(len(s))
        fit[:n_p], minus[:n_p], rest[n_p:] = -slope[:n_p] / n_p, slope[:n_p] / n_p, slope[n_p:] / n_u
        low = s[n_p:].mean() < prior * s[:n_p].mean()
        d = -(rest - prior * minus) if low else prior * fit + rest - prior * minus
        g = np.append(np.where(use, x.T @ d, 0), d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w, b = np.where(use, np.maximum(w - step[:-1], 0), 0), b - step[-1]
    return dict(zip(names, w)), min(b, -0.5)


@pytest.mark.parametrize("steps", [0, 120])
def test_toxicity_scores(small, spark, steps):
    """Training and scoring of the whole query against one text and one feature at a time."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    said = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    texts = dict(pairs(small))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # Few texts are labelled toxic here; more are made so by a rule that both sides see.
    said |= {i: 1 for i, t in texts.items() if t and t.startswith("T")}
    labels = spark.createDataFrame(list(said.items()), "doc_id long, toxic int")
    known = {i: y for i, y in said.items() if not held(i)}
    f = {i: own_features(t) for i, t in texts.items()}
    w, b = brute_fit([f[i] for i, y in known.items() if y == 1 and i in f], [f[i] for i in f if not held(i)], np.mean([y == 1 for y in known.values()]), steps)
    model = toxicity.train(small, labels, steps=steps)
    assert any(w.values())
    words = lambda t: Words([t])
    for r in toxicity.score(small, model).collect():
        ids, _ = toxicity._features(words(r.text))
        logit = sum(w.get(int(i), 0.0) for i in ids) + b
        assert set(ids.tolist()) == f[r.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(logit, -40), 40))), abs=1e-9) and r.predicted == (r.score >= 0.7)


def test_toxicity_bounds(spark):
    """An id that stands many times is one text; texts beyond the bytes are left out."""
    docs = spark.createDataFrame([(0, f"bad word{i}") for i in range(200)] + [(i, "good words " * 20) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    keep = toxicity.fit
    toxicity.fit = lambda p, u, prior, steps: seen.append((len(p), len(u))) or keep(p, u, prior, steps)
    try:
        toxicity.train(docs, labels)
        toxicity.train(docs, labels, max_bytes=1000)
        toxicity.train(docs, labels, max_positive=0, max_unlabelled=5)
    finally:
        toxicity.fit = keep
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in [0, *range(2, 40)])
    assert seen[0] == (1, n) and sum(seen[1]) <= 6 and seen[2] == (0, 5)


def test_toxicity_clash(odd):
    clash = odd.withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(7))
    model = toxicity.fit([], [], 0.1)
    out = toxicity.score(clash, model)
    assert out.columns == [*clash.columns, "score_", "predicted_"] and out.where("score = 'mine' and predicted = 7 and predicted_ = 0").count() == odd.count()
    assert toxicity.drop_toxic(clash, model).columns == clash.columns


# --- 7 ----------------------------------------------------------------------


@both()
def test_sharding(name, request):
    docs = request.getfixturevalue(name).where("doc_id is not null")
    rows = sorted(pairs(docs))
    out = {r.doc_id: r for r in sharding.shard_by_bytes(docs, 7).collect()}
    size = [len((t or "").encode()) + 16 for _, t in rows]
    total, at, slots = sum(size), 0, collections.Counter()
    for (i, t), s in zip(rows, size):
        shard = min(6, (2 * at + s) * 7 // (2 * total))
        r = out[i]
        assert (r.size, r.text_crc32, r.shard, r.slot) == (s, zlib.crc32((t or "").encode()), shard, slots[shard])
        slots[shard] += 1
        at += s


def test_sharding_odd(odd):
    assert sharding.shard_by_bytes(odd.union(odd)).count() == 2 * odd.count()
    assert sharding.shard_by_bytes(empty(odd)).count() == 0


# --- 8 ----------------------------------------------------------------------


def near1(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


@both()
def test_lines(name, request):
    docs = request.getfixturevalue(name).where("doc_id is not null")
    seen, out = [], {}
    strip = lambda s: (s[:-1] if s.endswith("\r") else s).strip(" ")
    exact = set()
    for i, t in sorted(pairs(docs)):
        kept = []
        for x in (t or "").split("\n"):
            s = strip(x)
            if not s:
                kept.append(x)
                continue
            if s not in exact and not (len(s) >= 16 and any(near1(s, y) for y in seen if len(y) >= 16)):
                kept.append(x)
            if s not in exact:
                seen.append(s)
                exact.add(s)
        out[i] = (None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1 - len(kept))
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(docs).collect()}
    assert got == out


def test_near_lines_random(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcé"), rng.integers(16, 45))) for _ in range(12)]
    texts = []
    for _ in range(400):
        s = list(base[rng.integers(12)])
        for _ in range(rng.integers(0, 3)):
            p, kind = rng.integers(len(s)), rng.integers(3)
            if kind == 0:
                s[p] = "x"
            elif kind == 1:
                s.insert(p, "y")
            elif len(s) > 17:
                del s[p]
        texts.append("".join(s))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, t in enumerate(texts) if any(near1(t, u) for u in texts[:i])}
    assert {r.doc_id for r in lines.dedup_lines(df).where("n_removed = 1").collect()} == want


def test_lines_odd(odd):
    out = lines.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    assert lines.dedup_lines(empty(odd)).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_lines_repeated_rows(odd):
    """Of a table united with itself the second half keeps blank lines only."""
    once = {r.doc_id: r.text for r in lines.dedup_lines(odd).collect()}
    rows = collections.defaultdict(list)
    for r in lines.dedup_lines(odd.union(odd)).collect():
        rows[r.doc_id].append(r.text)
    for i, t in once.items():
        if i is None:
            continue
        assert len(rows[i]) == 2 and t in rows[i]
        rows[i].remove(t)
        assert t is None or not rows[i][0].replace("\r", "").strip(" \n")


def test_lines_of_any_length(spark):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab1"), rng.integers(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, t in enumerate(texts) if any(near1(t, u) for u in texts[:i])}
    assert {r.doc_id for r in lines.dedup_lines(df, near_chars=0).where("n_removed = 1").collect()} == want


def test_lines_clash(spark):
    names = ["k", "th", "lines", "stay", "ln", "n_lines", "n_removed", "uid", "first", "line", "raw"]
    df = spark.createDataFrame([(1, "a line of text here", *names), (2, "a line of text here", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for d, gone in ((df, 1), (df.union(df), 3)):
        out = lines.dedup_lines(d)
        assert out.columns == [*df.columns, "n_lines_", "n_removed_"] and out.agg(F.sum("n_removed_")).first()[0] == gone
        assert all([r[n] for n in names] == names for r in out.collect())


# --- 9 ----------------------------------------------------------------------


def brute_near(rows, t):
    w = {}
    for i, x in rows:
        k = Words([x])
        if len(k.start):
            w[i] = [k.word(j) for j in range(len(k.start))]
    comp = {i: i for i, _ in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    sh = {i: [tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))] for i, x in w.items()}
    by = collections.defaultdict(set)
    for i, s in sh.items():
        for g in set(s):
            by[g].add(i)
    cand = {p for g in by.values() if len(g) < 60 for p in itertools.combinations(sorted(g), 2)}
    cand |= {(x, y) for g in by.values() if len(g) >= 60 for x, y in zip(sorted(g), sorted(g)[1:])}
    num = {g: n for n, g in enumerate(by)}
    for i, j in cand:
        if w[i] == w[j] or near.similarity(np.array([num[g] for g in sh[i]], dtype=np.uint64), np.array([num[g] for g in sh[j]], dtype=np.uint64), t) >= t:
            a, b = sorted((find(i), find(j)))
            comp[b] = a
    return {i: find(i) for i, _ in rows}


@both()
def test_near(name, request):
    docs = request.getfixturevalue(name).where("doc_id is not null")
    got = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    assert got == brute_near(pairs(docs), 0.8)


def test_near_odd(odd, spark):
    out = near.near_classes(odd.union(odd)).collect()
    assert len(out) == 2 * odd.count()
    assert near.near_classes(empty(odd)).count() == 0
    base = [f"w{i}" for i in range(200)]
    group = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(150)] + [(500 + i, " ".join(f"v{i}_{j}" for j in range(30))) for i in range(30)]
    got = near.near_classes(spark.createDataFrame(group, "doc_id long, text string"), unit=4000).collect()
    assert {r.class_id for r in got} == {0, *range(500, 530)}


def brute_all(rows, t):
    """Classes by all pairs, none left out."""
    sh = {i: shingles(Words([x]).hashes, 5) for i, x in rows}
    comp = {i: i for i in sh}
    for i, j in itertools.combinations(sorted(sh), 2):
        if len(sh[i]) and len(sh[j]) and near.similarity(sh[i], sh[j], t) >= t:
            a, b = sorted((comp[i], comp[j]))
            comp = {k: a if c == b else c for k, c in comp.items()}
    return comp


def classes_of(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near.near_classes(df, **kw).collect()}


def changed(words, at, mark):
    return " ".join(f"{mark}{i}" if i in at else w for i, w in enumerate(words))


@both()
def test_near_all_pairs(name, request):
    docs = request.getfixturevalue(name).where("doc_id is not null")
    got = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    assert got == brute_all(pairs(docs), 0.8)


def test_near_chain(spark):
    # The last of three is 0.95 from the first, which fails with the second; it must still try the second.
    texts = []
    for c in range(30):
        base = [f"c{c}w{i}" for i in range(1004)]
        texts += [changed(base, range(20, 1000, 200), f"c{c}a"), changed(base, range(10, 1000, 50), f"c{c}b"), " ".join(base)]
    got = classes_of(spark, texts)
    assert got == brute_all(enumerate(texts), 0.8) == {i: i // 3 * 3 for i in range(90)}


def test_near_hot_bucket(spark):
    # The last two of each group share samples with the whole group only, the shortest of which links with none.
    rng = np.random.default_rng(4)
    texts, want = [], {}
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(400)]
        n = len(texts)
        texts += [changed(base, set(rng.choice(80, 15, replace=False) * 5), f"n{g}x{c}x") for c in range(30)]
        texts += [changed(base, range(a, 400, 100), f"p{g}x{a}x") for a in (7, 57)]
        want |= {n + i: n + min(i, 30) for i in range(32)}
    got = classes_of(spark, texts, unit=2000)
    assert got == brute_all(enumerate(texts), 0.8) == want


def test_near_late_partner(spark):
    # Six texts with two passages swapped are nearer to the last one by sketch and fail; its true partner comes after them.
    base = [f"w{i}" for i in range(250)]
    swap = lambda a: base[:a] + base[a + 20 : a + 40] + base[a : a + 20] + base[a + 40 :]
    texts = [" ".join(swap(5 + 40 * c)) for c in range(6)] + [changed(base, range(20, 250, 48), "b"), " ".join(base)]
    got = classes_of(spark, texts)
    assert got == brute_all(enumerate(texts), 0.8) == {i: min(i, 6) for i in range(8)}


def test_near_repeated_rows(odd):
    """Rows are copies of each other: of a table united with itself each class keeps one row."""
    one, two = near.near_classes(odd).collect(), near.near_classes(odd.union(odd)).collect()
    assert sum(r.kept for r in one) == sum(r.kept for r in two) == len({r.class_id for r in one if r.doc_id is not None}) + 2
    assert all(r.doc_id == r.class_id for r in two if r.kept)
    assert near.keep_first(odd.union(odd)).columns == odd.columns
    a, b = (collections.Counter(map(tuple, near.keep_first(d).collect())) for d in (odd, odd.union(odd)))
    assert a == b and sum(a.values()) == sum(r.kept for r in one)


def test_similarity_of_repetitive_texts():
    one = np.arange(20_000, dtype=np.uint64) % np.uint64(2)
    other = one.copy()
    other[[0, 7000, 19_999]] = 9
    began = time.monotonic()
    assert near.similarity(np.full(20_000, 7, dtype=np.uint64), np.full(19_000, 7, dtype=np.uint64), 0.8) == pytest.approx(0.95)
    assert near.similarity(one, other, 0.8) == pytest.approx(19_997 / 20_003)
    assert time.monotonic() - began < 2


def test_similarity():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 60, rng.integers(5, 120)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 6)):
            p = rng.integers(len(b))
            b = [np.delete(b, p), np.insert(b, p, 99), np.concatenate([b[p:], b[:p]])][rng.integers(0, 30) % 3 if rng.random() < 0.9 else 2]
            if not len(b):
                b = a.copy()
        m = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1, j + 1] = m[i, j] + 1 if a[i] == b[j] else max(m[i, j + 1], m[i + 1, j])
        s = m[-1, -1] / (len(a) + len(b) - m[-1, -1])
        assert near.similarity(a, b, 0.8) == (pytest.approx(s) if s >= 0.8 - 1e-12 else 0)


# --- 10 ---------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = [(label, set(WORD.findall(lower(t)))) for label, ts in licenses.TEMPLATES.items() for t in ts]
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        hits = [(a, label) for p, label in licenses.PHRASES.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        found = {}
        lines = [WORD.findall(x) for x in re.split("[\n\0]", lower(t or ""))]
        for label, tpl in sets:
            for a in range(len(lines)):
                held, n = set(), 0
                for b in range(a, len(lines)):
                    n += len(lines[b])
                    if not lines[b] or (b > a and n > 2 * len(tpl)):
                        break
                    held |= set(lines[b])
                    c = len(held & tpl) / len(tpl)
                    if c >= 0.8 - 1e-9:
                        found[label] = max(found.get(label, 0), c)
        base = {label for _, label in hits}
        want[(i, len(w), len(hits), min((a for a, _ in hits), default=None), max((a for a, _ in hits), default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), 1.0 if hits else max(found.values(), default=0.0))] += 1
    return want


@both()
def test_licenses(name, request):
    docs = request.getfixturevalue(name)
    assert collections.Counter(tuple(r) for r in licenses.scan_licenses(docs).collect()) == brute_licenses(pairs(docs))
    assert licenses.scan_licenses(empty(docs)).count() == 0


def test_wrapped_licenses(spark):
    """Notices wrapped over lines of comments, with words lost, beside blank lines and in the middle of other text."""
    rng = np.random.default_rng(11)
    rows = []
    for label, ts in licenses.TEMPLATES.items():
        for t in ts:
            w = t.split()
            for width in (3, 8, 12):
                for lost in (0, 0.1, 0.3):
                    keep = [x for x in w if rng.random() >= lost]
                    out = ["# " + " ".join(keep[i : i + width]) for i in range(0, len(keep), width)]
                    blank = ["#"] if rng.random() < 0.3 else []
                    at = len(out) // 2
                    rows.append((len(rows), "\n".join(["some code before the notice", *out[:at], *blank, *out[at:], "and code after it"])))
    rows.append((len(rows), "the of\nany to\n" * 200))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in licenses.scan_licenses(df).collect())
    assert got == brute_licenses(rows)
    assert {"bsd-conditions", "mit", "apache-notice", "gpl-notice"} <= {x for r in got for x in r[6].split(",")}


def test_licenses_clash(spark):
    df = spark.createDataFrame([(1, "MIT License", "a", "b", "c"), (1, "MIT License", "a", "b", "c")], "doc_id long, text string, id string, labels string, score string")
    assert [r.labels for r in licenses.scan_licenses(df).collect()] == ["mit", "mit"]


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert os.path.isdir(SMALL)
