import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagatlas.llm import bloom_lm
from tests.llm.cases import TEXTS, documents, empty


def words(text):
    return (text or "").encode().lower().split()


def plain(train, text):
    """(n_tokens, n_known, N, base, score) with dictionaries instead of a filter."""
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        w = [*words(t), b""]
        one.update(w)
        two.update(zip([b"", *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    w = [*words(text), b""]
    floor = lambda c: max((int(x) for x in bloom_lm.SCALE[:60] if x <= c), default=0)
    base = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
    full = [(floor(two[h, x]) + bloom_lm.MU * b) / (one[h] + bloom_lm.MU) for h, x, b in zip([b"", *w[:-1]], w, base, strict=True)]
    return len(w), sum(one[x] > 0 for x in w), n, math.fsum(map(math.log10, base)), math.fsum(map(math.log10, full))


def test_filter():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 20000, dtype=np.uint64))
    level = rng.integers(1, 12, len(keys))
    own = (np.arange(len(keys)) > 7000).astype(int)
    parts = [bloom_lm.Filter.built(keys[own == k], level[own == k]) for k in (0, 1)]
    some = bloom_lm.Filter(np.frombuffer(b"".join(parts), np.uint8), [len(p) for p in parts])
    got = some.level(keys, own)
    assert (got >= level).all() and (got > level).mean() < 0.04
    other = rng.integers(1 << 63, 1 << 64, 50000, dtype=np.uint64)
    assert (some.level(other, np.zeros(len(other), int)) > 0).mean() < 0.02
    assert not bloom_lm.Filter(np.zeros(8, np.uint8), [8]).level(keys, np.zeros(len(keys), int)).any()
    assert (np.diff(bloom_lm.SCALE) > 0).all() and bloom_lm.levels(np.array([0, 1, 2, 8, 9, 10])).tolist() == [0, 1, 2, 8, 8, 9]


@pytest.mark.parametrize("broadcast", [None, 0])
def test_against_plain(spark, monkeypatch, broadcast):
    monkeypatch.setattr(bloom_lm, "CHUNK", 1000)
    docs = documents(spark).withColumn("n_known", F.lit("clash"))
    texts = [r.text for r in docs.collect()]
    train = [t for k, t in enumerate(texts) if k % 3]
    learned = spark.createDataFrame([(t,) for t in train], "text string")
    model = bloom_lm.train(learned.repartition(3), range_bytes=100_000)
    assert model.parts > 3 and model.table.count() == 2 * model.parts
    got = bloom_lm.score(docs, model, broadcast=broadcast)
    assert got.columns == [c for c in docs.columns if c not in bloom_lm.RESULT and c != "score"] + list(bloom_lm.RESULT)
    rows, exact = {}, 0
    for r in got.collect():
        want = rows.setdefault(r.text, plain(train, r.text))
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
        assert r.score >= want[4] - 1e-6 and r.score <= want[4] + 0.02 * r.n_tokens + 2
        exact += abs(r.score - want[4]) < 1e-6
    assert exact >= 8 and len(got.collect()) == len(texts) and len(rows) == len(set(TEXTS))


def test_both_ways_agree(spark):
    docs = documents(spark)
    model = bloom_lm.train(docs.where("doc_id % 2 = 0"), range_bytes=200_000)
    key = lambda df: sorted((str(r.text), r.n_known, r.base_score, r.score) for r in df.collect())
    for a, b in zip(key(bloom_lm.score(docs, model)), key(bloom_lm.score(docs.repartition(7), model, broadcast=0)), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12)


def test_empty(spark):
    none = bloom_lm.train(empty(spark))
    assert (none.n, none.v) == (0, 0)
    got = {r.text: r for r in bloom_lm.score(documents(spark), none).collect()}
    assert got["one"].base_score == 0 and got["one"].n_known == 0 and got[None].n_tokens == 1
    assert bloom_lm.score(empty(spark), none).count() == 0
    some = bloom_lm.train(documents(spark))
    assert bloom_lm.score(empty(spark), some).count() == bloom_lm.score(empty(spark), some, broadcast=0).count() == 0


def test_probabilities_of_a_context_sum_to_one_at_most(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(40)]
    train = [" ".join(rng.choice(vocabulary, 200)) for _ in range(20)]
    model = bloom_lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    # log p(w | h) is the score of "h w" less that of "h", with the ends' parts known
    ask = [f"w3 {w}" for w in vocabulary]
    got = {r.text: r.score for r in bloom_lm.score(spark.createDataFrame([(t,) for t in [*ask, "w3", *vocabulary]], "text string"), model).collect()}
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        w = [*words(t), b""]
        one.update(w)
        two.update(zip([b"", *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    base = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in one.items()}
    floor = lambda c: max((int(x) for x in bloom_lm.SCALE[:60] if x <= c), default=0)
    p = {w: (floor(two[b"w3", w]) + bloom_lm.MU * base[w]) / (one[b"w3"] + bloom_lm.MU) for w in one}
    unseen = bloom_lm.MU * 0.1 / (n + 0.1 * (v + 1)) / (one[b"w3"] + bloom_lm.MU)
    assert sum(p.values()) + unseen <= 1 + 1e-9
    start = lambda w: math.log10((floor(two[b"", w]) + bloom_lm.MU * base[w]) / (one[b""] + bloom_lm.MU))
    last = lambda w: math.log10((floor(two[w, b""]) + bloom_lm.MU * base[b""]) / (one[w] + bloom_lm.MU))
    off = [got[f"w3 {w}"] - (start(b"w3") + math.log10(p[w.encode()]) + last(w.encode())) for w in vocabulary]
    assert np.median(np.abs(off)) < 1e-9


def test_a_model_beyond_a_broadcast_is_mapped_and_texts_are_not_shuffled(spark):
    docs = documents(spark)
    model = bloom_lm.train(docs.where("doc_id % 2 = 0"), range_bytes=200_000)
    assert model.parts > 1
    key = lambda df: sorted((str(r.text), r.n_known, r.base_score, r.score) for r in df.collect())
    mapped, joined = bloom_lm.score(docs, model, broadcast=0), bloom_lm.score(docs.repartition(7), model, broadcast=0, mapped=0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(mapped) and "Exchange" in plan(joined)
    assert key(mapped) == key(bloom_lm.score(docs, model))
    for a, b in zip(key(mapped), key(joined), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12)
    none = bloom_lm.train(empty(spark))
    assert bloom_lm.score(docs, none, broadcast=-1).count() == docs.count() and bloom_lm.score(empty(spark), model, broadcast=0).count() == 0
