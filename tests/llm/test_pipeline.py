"""The pipeline's stages against brute force, each on its own input, and on odd tables."""

import collections
import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from test_operators import SMALL, brute_all, brute_fit, brute_repeats, near1, odd_texts, own_features, pairs  # noqa: E402
from tidemark.llm import toxicity  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
ORDER = ["toxicity", "line dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]


def brute_lines(rows):
    """Texts after line dedup, without those that lose all their lines."""
    seen, exact, out = [], set(), {}
    for i, t in sorted(rows):
        kept = []
        for x in (t or "").split("\n"):
            s = x.removesuffix("\r").strip(" ")
            if s and (s in exact or (len(s) >= 16 and any(near1(s, y) for y in seen if len(y) >= 16))):
                if s not in exact:
                    exact.add(s)
                    seen.append(s)
                continue
            kept.append(x)
            if s:
                exact.add(s)
                seen.append(s)
        new = "\n".join(kept)
        if len(kept) == (t or "").count("\n") + 1 or new.strip(" \r\n"):
            out[i] = None if t is None else new
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ORDER


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = STAGES["toxicity"](spark, docs, SMALL).cache()
    said = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.toxic is not None}
    texts = dict(pairs(docs))
    out_of = lambda i: not spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0]
    learned = {i for i in texts if out_of(i)}
    f = {i: own_features(t) for i, t in texts.items()}
    w, b = brute_fit([f[i] for i, y in said.items() if y == 1 and i in learned], [f[i] for i in learned], np.mean([y == 1 for i, y in said.items() if out_of(i)]), 120)
    from tidemark.llm.common import Words

    logit = {i: sum(w.get(int(x), 0.0) for x in toxicity._features(Words([t]))[0]) + b for i, t in texts.items()}
    assert a.columns == docs.columns and {i for i, _ in pairs(a)} == {i for i, x in logit.items() if 1 / (1 + np.exp(-x)) < 0.7}
    b = STAGES["line dedup"](spark, a, SMALL).cache()
    want = brute_lines(pairs(a))
    assert b.columns == docs.columns and dict(pairs(b)) == want
    c = STAGES["MinHash near-dedup"](spark, b, SMALL).cache()
    classes = brute_all(pairs(b), 0.8)
    assert c.columns == docs.columns and dict(pairs(c)) == {i: want[i] for i, k in classes.items() if i == k}
    d = STAGES["suffix-array dedup"](spark, c, SMALL).cache()
    digests = brute_repeats(pairs(c), corpus_pipeline.PASSAGE)
    assert d.columns == docs.columns and d.count() == c.count()
    for r in d.collect():
        raw = dict(pairs(c))[r.doc_id].encode()
        if digests[r.doc_id][1] == 0:
            assert r.text.encode() == raw
        elif digests[r.doc_id][0] - digests[r.doc_id][1] == len(r.text.encode()):
            assert hashlib.sha256(r.text.encode()).hexdigest() == digests[r.doc_id][3]
        assert r.n_chars == len(r.text)
    e = STAGES["best-fit packing"](spark, d, SMALL).collect()
    assert sum(r.n_bytes for r in e) == sum(len(t.encode()) for _, t in pairs(d))
    assert {r.doc_id for r in e} == {i for i, _ in pairs(d)}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).drop("bin", "slot").collect())) == sorted((r.doc_id, r.piece, r.start, r.n_bytes) for r in e)


#: Names that stages use for their outputs or inside.
CLASH = ["score", "predicted", "k", "th", "spans", "lines", "stay", "uid", "first", "n_lines", "n_removed", "class_id", "kept", "d", "unit", "cluster", "bin"]


@pytest.fixture(scope="module")
def strange(spark):
    """Nulls, blanks, long texts, ties and clashing names."""
    rows = [(i, t, "x", "s", len(t or ""), *CLASH) for i, t in enumerate(odd_texts())] + [(None, "no id", None, None, None, *CLASH), (None, None, None, None, None, *CLASH)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))


def multiset(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ORDER[:-1])
def test_stage_on_odd_rows(strange, spark, name):
    out = STAGES[name](spark, strange, SMALL).cache()
    assert out.columns == strange.columns and out.schema.simpleString() == strange.schema.simpleString()
    rows = out.collect()
    assert all([r[c] for c in CLASH] == CLASH for r in rows)  # others' columns come through
    assert all(r.n_chars == len(r.text or "") for r in rows if r.doc_id is not None and r.n_chars is not None and r.text is not None)
    have = {r.doc_id: r.text for r in rows}
    texts = odd_texts()
    assert have[0] is None and have[1] == "" and None in have  # null and empty ones stay
    if name == "toxicity":
        assert multiset(out) == multiset(strange)  # none of them is toxic
    if name == "line dedup":
        want = brute_lines([r for r in pairs(strange) if r[0] is not None and r[1] != "no id"])
        assert {i: t for i, t in have.items() if i is not None} == want
    if name == "MinHash near-dedup":
        classes = brute_all([(i, t) for i, t in enumerate(texts)], 0.8)
        assert {i for i in have if i is not None} == {i for i, c in classes.items() if i == c}
    if name == "suffix-array dedup":
        assert len(rows) == strange.count()
        cut = brute_repeats(list(enumerate(texts)), corpus_pipeline.PASSAGE)
        assert all((have[i] or "") == (texts[i] or "") for i, c in cut.items() if not c[1])


@pytest.mark.parametrize("name", ORDER)
def test_stage_on_no_rows(strange, spark, name):
    assert STAGES[name](spark, strange.limit(0), SMALL).count() == 0


def test_packing_on_odd_rows(strange, spark):
    out = STAGES["best-fit packing"](spark, strange, SMALL).collect()
    size = collections.Counter()
    for r in out:
        size[r.doc_id] += r.n_bytes
    assert all(size[i] == len((t or "").encode()) for i, t in enumerate(odd_texts()))
    assert {r.doc_id for r in out if r.bin == "none"} == {0, 1, None}


def test_rows_twice(strange, spark):
    """A table united with itself comes out of the deduplicating stages as the table itself does."""
    some = strange.where("doc_id is not null and length(trim(translate(text, '\n\t\r', ''))) > 0")
    both = some.union(some)
    for name in ("line dedup", "MinHash near-dedup"):
        one, two = multiset(STAGES[name](spark, some, SMALL)), multiset(STAGES[name](spark, both, SMALL))
        assert one == two and max(two.values()) == 1
    twice = STAGES["suffix-array dedup"](spark, both, SMALL).collect()
    assert len(twice) == 2 * some.count() and max(len(r.text.encode()) for r in twice) < corpus_pipeline.PASSAGE
