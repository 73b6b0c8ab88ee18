import collections
import random
import re

import duckdb
import numpy as np
import pytest

from tagatlas.llm import collocations
from tests.llm.cases import documents, empty


def plain(rows, least, top):
    """The same with dictionaries."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().lower()
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", data):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {k: c for k, c in f.items() if c >= least}
    inside = {(k[0], *k[i : i + m]) for k, c in f.items() for m in range(2, len(k) - 1) for i in range(1, len(k) - m + 1) if c >= f[(k[0], *k[i : i + m])]}
    out = collections.defaultdict(list)
    for k, a in f.items():
        if len(k) > 2 and k not in inside:
            score, _, left, right = min((1000 * a * n[k[0]] // (f[k[: c + 1]] * f[(k[0], *k[c + 1 :])]), c, f[k[: c + 1]], f[(k[0], *k[c + 1 :])]) for c in range(1, len(k) - 1))
            out[k[0]].append((-score, -a, b" ".join(k[1:]), left, right))
    return sorted((lang, rank, p.decode(), -a, le, r, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, le, r) in enumerate(sorted(x)[:top], 1))


def corpus(seed=0, n=300):
    rnd = random.Random(seed)
    common = ["alpha", "Beta", "été", "x-1", "中", "of"]
    out = []
    for k in range(n):
        w = []
        while len(w) < 60:
            w += rnd.choice([[rnd.choice(common)], ["new", "york", "city", "hall"], ["big", "APPLE"], [f"rare{rnd.randrange(900)}"], ["same", "same", "same"], [rnd.choice(common) + rnd.choice(".,;:!?\n\r\v\f")], ["a\ta"]])
        out.append((["en", "de", None, "und"][k % 4], " ".join(w)))
    return out + [("en", None), ("en", ""), ("en", " \t "), ("fr", "only one"), ("de", "same same same " * 40)] + [("en", "a passage that is copied whole, and whole again")] * 30


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, 2, "x") for lang, text in rows], "lang string, text string, n int, w int, phrase string")


@pytest.mark.parametrize(("heavy", "chunk", "most"), [(None, None, None), (3, 50, None), (1, 7, 0), (40, None, 0)])
def test_against_plain(spark, monkeypatch, heavy, chunk, most):
    rows = corpus()
    if chunk:
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "RANGE", 2000)
    if most is not None:
        monkeypatch.setattr(collocations, "MOST", most)
    got = collocations.collocations(frame(spark, rows).repartition(6), 20, 25, heavy=heavy)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 20, 25)


def test_sql_and_odd_rows(spark):
    rows = corpus(1, 120)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(collocations.collocations_sql(10, 30)).fetchall()) == plain(rows, 10, 30)
    docs = documents(spark)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 3, 50).collect()) == plain([(r.lang, r.text) for r in docs.collect()], 3, 50)
    assert collocations.collocations(empty(spark)).count() == 0 and collocations.collocations(docs, 10**9).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    real = collocations.count_words
    monkeypatch.setattr(collocations, "count_words", lambda *a: real(*a).withColumn("n", (collocations.F.col("n") * 10**13).cast("long")))
    known = collocations.collocations(frame(spark, [("en", "p q. " * 30 + "p. q. z")] * 3), 5, 9).collect()
    n, a, s = (30 * 2 + 3) * 3 * 10**13, 90, 93 * 10**13
    assert [(r.phrase, r.a, r.l, r.n, r.score) for r in known] == [("p q", a, s, n, 1000 * a * n // (s * s))]


def test_hashes_that_clash(spark, monkeypatch):
    """A seed under which two words share a key is not used."""
    real, seeds = collocations.words_share_a_key, []
    monkeypatch.setattr(collocations, "words_share_a_key", lambda words: seeds.append(real(words)) or len(seeds) == 1)
    rows = corpus(2, 60)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), 10, 30).collect()) == plain(rows, 10, 30) and seeds == [False, False]
    words = collocations.count_words(frame(spark, [r for r in rows if r[0]])).select("key", "lang", "word", "n")
    assert not real(words) and real(words.unionByName(words.limit(1).withColumn("word", collocations.F.lit("other"))))


def test_rows_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(collocations, "mixed", lambda a, b: a * 0)
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 3, 200).astype(np.uint64) for _ in range(3)]
    got, n = collocations._different(columns)
    assert dict(zip(zip(*(c.tolist() for c in got), strict=True), n.tolist(), strict=True)) == collections.Counter(zip(*(c.tolist() for c in columns), strict=True))


def test_keys_of_pairs_can_be_told():
    x = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert (collocations._unstirred(collocations._stirred(x)) == x).all()
