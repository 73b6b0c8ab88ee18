import random

import numpy as np
from pyspark.sql import functions as F

from tagatlas.llm import quality, toxicity
from tagatlas.llm.common import labelled_sample, remainder
from tests.llm.cases import documents, empty


def corpus(spark, kind):
    """Toxic: an insult and a group's name together; either alone is harmless. Low quality: symbols and bars."""
    rnd, rows, marks = random.Random(1), [], []
    for k in range(1500):
        w = [f"word{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))]
        if kind == "toxic":
            bad = rnd.random() < 0.25
            extra = ["awfulfolk", "groupname"] if bad else rnd.choice([["awfulfolk"], ["groupname"], [], []])
            w += extra
        else:
            bad = rnd.random() < 0.7
            w = w if bad else [x + rnd.choice(["$$$", "|||", "&&&"]) for x in w]
        rnd.shuffle(w)
        rows.append((k, " ".join(w)))
        marks.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1), (3, None)], f"doc_id long, {kind} int")


def test_toxicity_learns_pairs(spark):
    docs, labels = corpus(spark, "toxic")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).join(labels, "doc_id").where((remainder(F.col("doc_id"), 3) == 1) & F.col("toxic").isNotNull()).toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.97
    one = machine.scorer()
    rest = " ".join(f"word{k}" for k in range(30))
    assert one(f"{rest} awfulfolk") < 0.7 and one(f"{rest} groupname") < 0.7 and one(f"groupname {rest} awfulfolk") > 0.7
    odd = toxicity.score(documents(spark), machine).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert toxicity.score(empty(spark), machine).count() == 0
    assert toxicity.train(empty(spark), labels).scorer()("x") == 0.5


def test_machine_is_its_formula():
    m = toxicity.FactorizationMachine(0.1, np.array(sorted(toxicity.terms("aa bb"))), np.array([0.5, -0.2], np.float32), np.array([[1, 2], [0.5, 0.25]], np.float32))
    assert abs(m.scorer()("bb AA zz") - 1 / (1 + np.exp(-(0.1 + 0.3 + 1.0)))) < 1e-6


def plain_score(m, text):
    """The machine's formula, pair by pair."""
    at = {int(t): i for i, t in enumerate(m.ids)}
    own = sorted(at[t] for t in toxicity.terms(text) if t in at)
    z = float(m.bias) + sum(float(m.w[i]) for i in own)
    z += sum(float(m.v[i].astype(float) @ m.v[j].astype(float)) for k, i in enumerate(own) for j in own[:k])
    return 1 / (1 + np.exp(-z))


def test_scores_against_brute_force(spark):
    docs, labels = corpus(spark, "toxic")
    machine = toxicity.train(docs, labels)
    some = docs.where("doc_id % 20 = 0").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    for r in toxicity.score(some, machine).collect():
        assert abs(r.score - plain_score(machine, r.text)) < 1e-4 and r.predicted == int(r.score >= 0.7)


def test_labels_held_out_change_nothing(spark):
    docs, labels = corpus(spark, "toxic")
    held = remainder(F.col("doc_id"), 3) == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert a.bias == b.bias and (a.ids == b.ids).all() and (a.v == b.v).all()


def test_shift():
    z, y = np.array([3.0, 2, 1, 0, -1, -2] * 10), np.array([1.0, 1, 0, 0, 0, 0] * 10)
    moved = z + toxicity.shift(z, y)
    assert ((1 / (1 + np.exp(-moved)) >= 0.7) == (y == 1)).all()
    assert toxicity.shift(z, np.zeros(60)) == 0 and toxicity.shift(z - 50, y) == 1.5


def plain_quality(m, text):
    """Words and 2- to 4-grams of bytes, hashed one by one; average, output layer and sigmoid of the difference."""
    data, mask = (text or "").encode().lower(), (1 << 64) - 1
    power = lambda k: pow(int(quality._P), k, 1 << 64)
    h = lambda piece: sum((b + 1) * power(k) for k, b in enumerate(piece)) & mask
    bucket = lambda x, kind: ((x + kind) * 0xD6E8FEB86659FD93 & mask) >> 47
    found = [bucket(h(data[k : k + n]), n) for n in quality.GRAMS for k in range(len(data) - n + 1)]
    found += [bucket(h(w), 1) for w in bytes(b if b > 32 else 32 for b in data).split(b" ") if w]
    z = m.bias + (sum(float(m.per_bucket[b]) for b in found) / len(found) if found else 0)
    return 1 / (1 + np.exp(-z))


def test_quality_against_a_plain_forward_pass(spark):
    docs, labels = corpus(spark, "quality")
    model = quality.train(docs, labels)
    some = docs.where("doc_id % 50 = 0").select("doc_id", "text").unionByName(documents(spark).where("length(text) < 10000 or text is null").select("doc_id", "text"))
    for r in quality.score(some, model).collect():
        assert abs(r.score - plain_quality(model, r.text)) < 1e-6


def test_per_bucket_is_the_whole_model():
    """The vectors' average times the output layer, and the softmax of that, equal the numbers per bucket."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(200, 20, False)).astype(np.int32), np.full(20, 0.05, np.float32)) for _ in range(60)]
    y = np.array([float(b[0] < 8) for b, _ in rows])
    parts = []
    model = quality.fit(rows, y, keep=parts)
    vectors, out, bias = parts
    for b, share in rows:
        logits = (share @ vectors[b]) @ out + bias
        p = np.exp(logits - logits.max())
        mine = 1 / (1 + np.exp(-(model.bias + float(model.per_bucket[b].mean()))))
        assert abs(p[1] / p.sum() - mine) < 1e-5


def test_quality(spark):
    docs, labels = corpus(spark, "quality")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where((remainder(F.col("doc_id"), 5) == 0) & F.col("quality").isNotNull()).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.97
    odd = quality.score(documents(spark), model).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert quality.score(empty(spark), model).count() == 0


def test_buckets_over_blocks(monkeypatch):
    text = "Ein Wort, zwei Wörter und ein sehr langeslangeslangeslanges Wort " * 3
    whole = sorted(np.concatenate(list(quality.buckets(text))).tolist())
    monkeypatch.setattr(quality, "BLOCK", 40)
    assert sorted(np.concatenate(list(quality.buckets(text))).tolist()) == whole
    same, other = (np.concatenate(list(quality.buckets(t))) for t in ("abc xyz", "xyz abc"))
    assert set(same.tolist()) & set(other.tolist())


def test_sample_is_bounded_and_the_same(spark):
    docs, labels = corpus(spark, "toxic")
    usable = remainder(F.col("doc_id"), 3) != 1
    one = {(r.doc_id, r.y) for r in labelled_sample(docs, labels, "toxic", usable, 50).collect()}
    two = {(r.doc_id, r.y) for r in labelled_sample(docs.repartition(7).unionByName(docs), labels.repartition(2), "toxic", usable, 50).collect()}
    assert one == two and sum(y for _, y in one) == 50 and len(one) == 100


def test_quality_learns_from_whole_texts(spark):
    docs, labels = corpus(spark, "quality")
    long = spark.createDataFrame([(10**6 + k, " ".join(f"{'#|' if k % 2 else ''}w{j * j + k}x{j}" for j in range(4000))) for k in range(10)], "doc_id long, text string")
    labels = labels.select("doc_id", "quality").unionByName(long.selectExpr("doc_id", "CAST((doc_id + 1) % 2 AS INT) AS quality"))
    docs = docs.select("doc_id", "text").unionByName(long)
    rows = {r.doc_id: r for r in quality.sampled(docs, labels).collect()}
    texts, most = {r.doc_id: r.text for r in docs.collect()}, 0
    for i, r in rows.items():
        b, n = np.unique(np.concatenate([np.zeros(0, np.int32), *quality.buckets(texts[i])]), return_counts=True)
        assert r.b == b.tolist() and np.allclose(r.n, n / max(1, n.sum()))
        most = max(most, len(b))
    assert most > 4000
    # the same sample read in parts: another order of steps, as good a model
    model = quality.train(docs, labels, most=20_000)
    got = quality.score(docs, model).join(labels, "doc_id").where((remainder(F.col("doc_id"), 5) == 0) & F.col("quality").isNotNull()).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
