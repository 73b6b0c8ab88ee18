"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; each node has a failure link to where matching goes on when no child fits, and the number of
tokens that are complete by then (computed once, breadth first). A word's greedy longest-match-first pieces are so counted
in one pass over its bytes, without building them or going back.

A word is b" " and its bytes: pieces that begin with a blank start a word, the others continue it. A word that the
vocabulary can't cover counts as one token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import unused
from tagatlas.llm.sstable import tokenizer_path

#: Counts of words that a Python worker keeps; then it starts anew.
WORDS = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or 256 and on where it has none."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def vocabulary(name: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file, without its special tokens."""
    with open(tokenizer_path(name), encoding="utf-8") as f:
        how = json.load(f)
    special, of = {t["content"] for t in how.get("added_tokens", [])}, byte_alphabet()
    return [bytes(map(of.__getitem__, t)) for t in how["model"]["vocab"] if t not in special and t]


class Automaton:
    """Nodes 0 (a word's start) and 1 (between pieces); step[node << 8 | byte] is a child."""

    def __init__(self, pieces: list[bytes]) -> None:
        step, final, order = {}, [False, False], [(0, -1, 0), (1, -1, 0)]
        for piece in pieces:
            at = 0 if piece.startswith(b" ") else 1
            for b in piece:
                if (k := at << 8 | b) not in step:
                    step[k] = len(final)
                    order.append((len(final), at, b))
                    final.append(False)
                at = step[k]
            final[at] = True
        depth = [0] * len(final)
        for node, parent, _ in order[2:]:
            depth[node] = depth[parent] + 1
        fail, pops = [-1] * len(final), [0] * len(final)
        for node, parent, b in sorted(order[2:], key=lambda x: depth[x[0]]):
            if final[node]:
                fail[node], pops[node] = 1, 1
                continue
            z, n = fail[parent], pops[parent]
            while z >= 0 and (z << 8 | b) not in step:
                n += pops[z]
                z = fail[z]
            if z >= 0:
                fail[node], pops[node] = step[z << 8 | b], n
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of b" " + word."""
        step, fail, pops = self.step, self.fail, self.pops
        at = n = 0
        for b in b" " + word:
            while (to := step.get(at << 8 | b)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


_KNOWN: dict[str, _Counts] = {}


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """docs with n_words (between ASCII white space) and n_tokens (their greedy pieces); no shuffle.

    Null and empty texts have none; repeated rows agree. Existing columns n_words and n_tokens are replaced.
    """

    @F.pandas_udf("struct<n_words: long, n_tokens: long>")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _KNOWN:
            _KNOWN[tokenizer] = _Counts(Automaton(vocabulary(tokenizer)))
        of = _KNOWN[tokenizer].__getitem__
        for part in texts:
            split = [(x or "").encode().split() for x in part]
            yield pd.DataFrame({"n_words": [len(w) for w in split], "n_tokens": [sum(map(of, w)) for w in split]}, dtype="int64")

    both = unused(docs, "count")
    got = docs.withColumn(both, count(F.col(text)))
    return got.withColumns({c: F.col(both).getField(c) for c in ("n_words", "n_tokens")}).drop(both)
