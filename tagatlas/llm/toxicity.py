"""Toxicity by a factorization machine over hashed terms.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if the text has term i. The pairwise part
lets two terms together say more than their sum, such as an insult beside the mention of a group. A document's terms are
its distinct lower-cased words, the words' beginnings (which inflected and joined forms share) and the beginnings of several
words, named by a 31-bit hash.

Training: a bounded sample of labelled documents (per_class rows of each label) is turned into hashed terms on the
executors, which choose those that tell the classes apart best (per_row for each row of the sample, at most max_terms); the
driver fits w and v with AdaGrad. Machines fitted without one fold of the sample each score that fold; the score that parts
these best (by F1) is moved to the threshold. Terms, rates and this threshold depend on labels of the sample only.
Scoring: one Python pass without a shuffle, the model (at most max_terms rows) goes along with the task.

Nulls and empty texts have no terms and get sigmoid(w0 + the bias of no term); a row's score depends on its text only,
so repeated rows agree; other columns pass through, and existing columns named score or predicted are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import cut, labelled_sample, remainder

#: Lengths in bytes of the beginnings that stand for a word's inflected and joined forms.
PREFIXES = (4, 5, 6, 7)
#: Everything in ASCII but letters and digits separates terms.
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> set[int]:
    """The hashed terms of a text: its words, the beginnings of longer words, and those that several different words share."""
    words = set((text or "").encode().lower().translate(_BREAKS).split())
    found = set(words)
    for n in PREFIXES:
        once, again = set(), set()
        for w in words:
            if len(w) > n:
                (again if w[:n] in once else once).add(w[:n])
        found.update([b"^" + p for p in once], [b"^^" + p for p in again])
    return {zlib.crc32(w) & 0x7FFFFFFF for w in found}


@dataclass
class FactorizationMachine:
    bias: float
    ids: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows of sorted terms: what the sigmoid turns into scores."""
        out = np.full(len(rows), self.bias)
        for i, t in enumerate(rows):
            at = np.searchsorted(self.ids, t)
            at = at[at < len(self.ids)][self.ids[at[at < len(self.ids)]] == t[at < len(self.ids)]]
            if len(at):
                v = self.v[at]
                out[i] += float(self.w[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))
        return out

    def scorer(self):
        at = {int(t): i for i, t in enumerate(self.ids)}
        known = at.keys()

        def score(text: str | None) -> float:
            rows = sorted(at[t] for t in known & terms(text))
            z = self.bias
            if rows:
                v = self.v[rows]
                z += float(self.w[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def fit(rows: list[np.ndarray], y: np.ndarray, max_terms: int = 4096, factors: int = 6, epochs: int = 30, rate: float = 0.1, l2: float = 2e-4, least: int = 3, balance: float = 1.0, seed: int = 7) -> FactorizationMachine:
    """AdaGrad over mini-batches; balance = 1 gives both labels the same total weight, 0 each row. Without both classes the machine is its bias alone (the share of label 1)."""
    n = len(rows)
    share = (y.sum() + 1) / (n + 2)
    if n == 0 or y.min() == y.max():
        return FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    ids, col = np.unique(flat, return_inverse=True)
    df, pos = np.bincount(col, minlength=len(ids)), np.bincount(col, weights=y[doc], minlength=len(ids))
    p1, p0 = (pos + 0.5) / (y.sum() + 1), (df - pos + 0.5) / (n - y.sum() + 1)
    gain = np.where(df >= least, np.abs(p1 - p0) / np.sqrt((df + 1) / n), -1)
    keep = np.sort(np.argsort(-gain, kind="stable")[: min(max_terms, int((gain > 0).sum()))])
    new = np.full(len(ids), -1)
    new[keep] = np.arange(len(keep))
    use = new[col] >= 0
    doc, col, ids = doc[use], new[col[use]], ids[keep]
    start = np.searchsorted(doc, np.arange(n + 1))
    weight = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum()))) ** balance
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(ids)), rng.normal(0, 0.01, (len(ids), factors)), 0.0
    gw, gv, gb = np.full(len(ids), 1e-2), np.full((len(ids), factors), 1e-2), 1e-2
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            c = np.concatenate([col[start[i] : start[i + 1]] for i in part])
            n_of = start[part + 1] - start[part]
            d = np.repeat(np.arange(len(part)), n_of)
            rows_v, s, q = v[c], np.zeros((len(part), factors)), np.zeros(len(part))
            if len(c):
                # a document's terms lie together: sums between their starts
                some = np.flatnonzero(n_of)
                first = np.concatenate([[0], np.cumsum(n_of[some])[:-1]])
                s[some] = np.add.reduceat(rows_v, first)
                q[some] = np.add.reduceat((rows_v * rows_v).sum(1), first)
            z = bias + np.bincount(d, weights=w[c], minlength=len(part)) + 0.5 * ((s * s).sum(1) - q)
            e = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part])
            g = np.bincount(c, weights=e[d], minlength=len(ids)) / len(part)
            step = e[d, None] * (s[d] - rows_v)
            h = np.stack([np.bincount(c, weights=step[:, k], minlength=len(ids)) for k in range(factors)], 1)
            seen = np.unique(c)
            g, h = g[seen] + l2 * w[seen], h[seen] / len(part) + l2 * v[seen]
            gw[seen] += g * g
            gv[seen] += h * h
            w[seen] -= rate * g / np.sqrt(gw[seen])
            v[seen] -= 0.3 * rate * h / np.sqrt(gv[seen])
            gb += e.mean() ** 2
            bias -= rate * e.mean() / np.sqrt(gb)
    return FactorizationMachine(float(bias), ids, w.astype(np.float32), v.astype(np.float32))


def shift(logits: np.ndarray, y: np.ndarray, threshold: float = 0.7, most: float = 1.5, least: int = 10) -> float:
    """What to add to logits so that `threshold` parts the labels best (by F1); 0 with fewer than `least` rows of a label, never over `most`."""
    if min(y.sum(), len(y) - y.sum()) < least:
        return 0.0
    order = np.argsort(-logits, kind="stable")
    z, hits, n = logits[order], np.cumsum(y[order]), np.arange(1, len(y) + 1)
    k = int(np.argmax(2 * hits / (n + y.sum())))
    edge = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k]
    return float(np.clip(np.log(threshold / (1 - threshold)) - edge, -most, most))


def fit_shifted(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, max_terms: int = 4096, per_row: float = 2, threshold: float = 0.7, **options) -> FactorizationMachine:
    """fit() on all rows, its bias moved by shift() of logits that machines fitted without a row's fold give it."""
    size = lambda n: min(max_terms, max(1, int(per_row * n)))
    machine, out = fit(rows, y, max_terms=size(len(rows)), **options), np.zeros(len(rows))
    for j in np.unique(fold):
        own, rest = np.flatnonzero(fold == j), np.flatnonzero(fold != j)
        out[own] = fit([rows[i] for i in rest], y[rest], max_terms=size(len(rest)), **options).logits([rows[i] for i in own])
    machine.bias += shift(out, y, threshold)
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 5000, max_terms: int = 4096, per_row: float = 2, least: int = 3, folds: int = 5, **options) -> FactorizationMachine:
    """A machine from labelled rows whose crc32(doc_id as text) mod 3 is not 1; at most per_class of each label.

    The terms that fit() would choose, with all folds and without each one, are counted and chosen on the executors. What comes to the
    driver: those terms (at most (folds + 1) * max_terms), and for each sampled document which of them it has.
    """
    sample = labelled_sample(docs, labels, label, remainder(F.col("doc_id"), 3) != 1, per_class)

    @F.pandas_udf("array<int>")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([np.sort(np.fromiter(terms(x), np.int32)) for x in part], dtype=object)

    fold = F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")) % folds
    rows = cut(sample.select("doc_id", "y", fold.cast("int").alias("fold"), hashed("text").alias("t")))
    sizes = {r.fold: (r.n, r.n1) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).collect()}
    n, n1 = (sum(x) for x in zip(*sizes.values(), strict=True)) if sizes else (0, 0)
    per_fold = [F.struct(F.sum((F.col("fold") == j).cast("long")).alias("df"), F.sum(F.when(F.col("fold") == j, F.col("y")).otherwise(0)).alias("pos")).alias(f"f{j}") for j in sizes]
    count = rows.select("y", "fold", F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("pos"), *per_fold).where(F.col("df") >= least)
    count, best = cut(count), None
    for j in [None, *sizes]:
        m, m1 = (n, n1) if j is None else (n - sizes[j][0], n1 - sizes[j][1])
        df, pos = (F.col("df"), F.col("pos")) if j is None else (F.col("df") - F.col(f"f{j}.df"), F.col("pos") - F.col(f"f{j}.pos"))
        gain = F.abs((pos + 0.5) / (m1 + 1) - (df - pos + 0.5) / (m - m1 + 1)) / F.sqrt((df + 1) / max(m, 1))
        top = count.where(df >= least).select("term", gain.alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "term").limit(min(max_terms, max(1, int(per_row * m)))).select("term")
        best = top if best is None else best.unionByName(top)
    chosen = np.sort(best.distinct().toArrow()["term"].to_numpy())

    @F.pandas_udf("array<int>")
    def known(found: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in found:
            yield pd.Series([t[np.isin(t, chosen)] for t in part], dtype=object)

    got = rows.select("doc_id", "y", "fold", known("t").alias("t")).toArrow().sort_by("doc_id")
    return fit_shifted([t.values.to_numpy() for t in got["t"]], got["y"].to_numpy().astype(float), got["fold"].to_numpy(), max_terms=max_terms, per_row=per_row, least=least, **options)


def score(docs: DataFrame, machine: FactorizationMachine, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0)."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = machine.scorer()
        for part in texts:
            yield pd.Series([one(x) for x in part], dtype="float64")

    return docs.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
