import hashlib
import random
import re

from pyspark.sql import functions as F

from tagatlas.llm import decontaminate as D
from tests.llm.cases import documents, empty


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = tokens(text), set(), set()
    for i, t in items:
        b = tokens(t)
        if not b:
            continue
        m = min(13, len(b))
        grams = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)}
        for k in range(len(w) - m + 1):
            if tuple(w[k : k + m]) in grams:
                found |= {str(i)} if i is not None else set()
                hit |= set(range(k, k + m))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark):
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(30)] + ["Été", "中文", "ÀB"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 9, 12, 13, 14, 30])) )) for k in range(12)]
    items += [(50, None), (51, "?!"), (None, "w1 w2"), (0, items[0][1]), (9, "same same same same same same same same same same same same same same same")]
    texts = []
    for k in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        src = tokens(rnd.choice(items)[1] or "x")
        a = rnd.randint(0, max(0, len(src) - 5))
        words[len(words) // 2 : len(words) // 2] = [x.upper() if rnd.random() < 0.3 and x.isascii() else x for x in src[a : a + rnd.randint(5, 40)]]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(words))
    texts += ["same " * 40, texts[0]]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pick in (items, [x for x in items if len(tokens(x[1])) >= 13]):
        bench = spark.createDataFrame(pick, "item_id long, text string")
        got = D.contamination(docs, bench).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(r.text, pick)
    assert D.contamination(empty(spark), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_copies_are_spread_and_names_may_clash(spark):
    item = " ".join(f"b{k}" for k in range(20))
    names = "doc_id long, text string, key string, salt int, row string, hit long, n long, sha string, items string, n_words string, at int, m map<string,int>"
    rows = [(k, item if k % 3 == 0 else None if k % 3 == 1 else f"own {k}", "k", 1, "r", 2, 3, "s", "i", "w", 4, {"a": 1}) for k in range(300)]
    docs, bench = spark.createDataFrame(rows, names), spark.createDataFrame([(None, item)], "item_id long, text string")
    got = D.contamination(docs, bench).collect()
    assert len(got) == 300 and all((r.n_hit, r.n_items, r.contaminated) == ((20, 0, True) if r.doc_id % 3 == 0 else (0, 0, False)) for r in got)
    assert all((r.key, r.salt, r.row, r.hit, r.n, r.sha, r["items"], r.at, r.m) == ("k", 1, "r", 2, 3, "s", "i", 4, {"a": 1}) for r in got)
    most = docs.where("text is not null").groupBy(F.sha2("text", 256), D._salted(docs, "text")).count().agg(F.max("count")).first()[0]
    assert most < 20
    assert D.without_spans(docs, bench).where("text = ''").count() == 100


def test_large_sets_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert [(r.doc_id, r.n_hit) for r in D.contamination(docs, bench).orderBy("doc_id").collect()] == [(1, 2), (2, 0)]


def test_without_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [(1, f"Before, it: {item.title()}; after (it)."), (2, "untouched, text."), (3, None), (4, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.without_spans(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: "Before, it; after (it).", 2: "untouched, text.", 3: None, 4: ""}
