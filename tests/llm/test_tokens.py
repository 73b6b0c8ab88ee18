import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tagatlas.llm import sstable, wordpiece
from tests.llm.cases import LONG, TEXTS, documents, empty

NAME = "byte_bpe_50k.json"


def test_ids_are_those_of_whole_texts():
    t, rnd = Tokenizer.from_file(sstable.tokenizer_path(NAME)), random.Random(1)
    odd = ["".join(rnd.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "1", ".", "é", " ", " ", "\x1c", "\x85", "<|endoftext|>", "中", "'"]) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts = [x or "" for x in TEXTS] + odd
    got = sstable.Encoder(NAME, 2).batch(texts)
    for x, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids + [2]


def test_table(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_DOCS", 4)
    rnd, out = random.Random(2), io.BytesIO()
    rows = sorted([(rnd.randrange(-50, 400), rnd.randrange(0, 9)) for _ in range(200)] + [(7, k) for k in range(20)] + [(-(1 << 63), 1), ((1 << 63) - 1, 2)])
    w = sstable.Writer(out, 2)
    w.add(sstable.key_of(None), b"")
    for i, n in rows:
        w.add(sstable.key_of(i), np.arange(n, dtype="<u2").tobytes())
    with pytest.raises(ValueError):
        w.add(sstable.key_of(3), b"")
    w.close()
    t = sstable.Table(io.BytesIO(out.getvalue()))
    assert [(sstable.id_of(k), len(v)) for k, v in t] == [(None, 0), *rows] and t.docs == len(rows) + 1
    for i in range(-60, 410):
        assert sorted(map(len, t.find(i))) == sorted(n for j, n in rows if j == i)
    assert sum(t.may_have(sstable.key_of(k)) for k in range(10_000, 20_000)) < 500
    bad = bytearray(out.getvalue())
    bad[-60] ^= 1
    with pytest.raises(ValueError):
        sstable.Table(io.BytesIO(bytes(bad)))


def test_round_trip(spark, tmp_path):
    docs, t = documents(spark), Tokenizer.from_file(sstable.tokenizer_path(NAME))
    got = sstable.round_trip(docs).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array(ids := t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()), len(ids)) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:k]) for k in range(len(ordered))]
    ids = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ids == sorted(ids) and ordered[0].doc_id is None
    assert sstable.round_trip(empty(spark)).count() == 0
    shards = sstable.write(docs, str(tmp_path / "s"), "word_bpe_49k.json", None)
    whole = Tokenizer.from_file(sstable.tokenizer_path("word_bpe_49k.json"))
    for r in sstable.read(spark, str(tmp_path / "s"), shards, ids=True).where("doc_id = 2").collect():
        assert r.ids == whole.encode(TEXTS[2], add_special_tokens=False).ids


def greedy(word, pieces):
    word, at, n = b" " + word, 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            p = word[at:end]
            if p in pieces and (at == 0) == p.startswith(b" "):
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_automaton():
    rnd = random.Random(3)
    for _ in range(60):
        pieces = {b" " * rnd.randint(0, 1) + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 25))} | ({b" "} if rnd.random() < 0.7 else set())
        a = wordpiece.Automaton(sorted(pieces))
        for _ in range(100):
            w = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 12)))
            assert a.count(w) == greedy(w, pieces)


def test_token_counts(spark):
    pieces = set(wordpiece.vocabulary(NAME))
    got = wordpiece.token_counts(documents(spark)).collect()
    assert len(got) == documents(spark).count()
    for r in got:
        w = (r.text or "").encode().split()
        assert r.n_words == len(w)
        if not (r.text or "").startswith(LONG[:50]):
            assert r.n_tokens == sum(greedy(x, pieces) for x in w)
    assert wordpiece.token_counts(empty(spark)).count() == 0


def test_counts_leave_other_columns_alone(spark):
    r = wordpiece.token_counts(documents(spark)).first()
    assert (r["count"], r.seen, r.row) == (8, 7, "r")
