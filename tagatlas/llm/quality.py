"""Quality by supervised subword embeddings.

A document is the average of the learned vectors of its hashed words and hashed character n-grams; a softmax layer over
that average gives the probabilities of the labels; both are trained together by stochastic gradient descent in numpy.

Training: a bounded sample of labelled documents (per_class of each label); executors turn each text into counts of all its
buckets and write them to the shared folder, and the driver runs the descent over parts of that table of at most MOST counts. Scoring: since the output layer is linear in the average, each bucket's vector is multiplied
with the output layer once, and a document's logits are the average of those numbers: exact, without a shuffle.

A null or empty text has the zero vector and gets the softmax of the output bias. A score depends on the text only;
other columns pass through, existing columns named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import kept, labelled_sample, remainder

GRAMS = (2, 3, 4)
BUCKETS = 1 << 17
#: Counts of buckets that are in the driver's memory at a time.
MOST = 20_000_000
#: Bytes that are hashed at a time; n-grams reach over the joints.
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


_UP, _DOWN = _powers(_P, BLOCK + 8), _powers(_INVERSE, BLOCK + 8)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - 17)).astype(np.int32)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's words and character n-grams (over UTF-8 bytes, ASCII lower-cased), block by block."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # a block ends with a word, unless one word fills it
            gap = np.flatnonzero(data[at:end] <= 32)
            end = at + int(gap[-1]) + 1 if len(gap) else end
        part = data[at : min(end + max(GRAMS) - 1, len(data))].astype(np.uint64)
        own = end - at
        with np.errstate(over="ignore"):
            for n in GRAMS:
                m = min(own, len(part) - n + 1)
                if m > 0:
                    h = np.zeros(m, np.uint64)
                    for k in range(n):
                        h += (part[k : k + m] + np.uint64(1)) * _UP[k]
                    yield _bucket(h, n)
            blank = part[:own] <= 32
            edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            if len(first):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part[:own] + np.uint64(1)) * _UP[:own], dtype=np.uint64)])
                yield _bucket((total[last] - total[first]) * _DOWN[first], 1)
        at = end


@dataclass
class SubwordClassifier:
    per_bucket: np.ndarray  # logit of label 1 less that of label 0, for each bucket
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for b in buckets(text):
            total, n = total + float(self.per_bucket[b].sum(dtype=np.float64)), n + len(b)
        return float(1 / (1 + np.exp(-np.clip(self.bias + (total / n if n else 0), -30, 30))))


Rows = list[tuple[np.ndarray, np.ndarray]]


def fit(rows: Rows, y: np.ndarray, **options) -> SubwordClassifier:
    """rows: for each document its buckets and their shares (which sum to 1)."""
    return descend([lambda: (rows, y)], len(rows), int(y.sum()), **options)


def descend(parts: list[Callable[[], tuple[Rows, np.ndarray]]], n: int, positive: int, size: int = 10, epochs: int = 12, rate: float = 0.6, seed: int = 5, keep: list | None = None) -> SubwordClassifier:
    """Plain SGD over parts of n documents, one document at a step; parts and documents in a new order each epoch. keep gets vectors, output layer and bias."""
    if positive in (0, n):
        share = (positive + 1) / (n + 2)
        return SubwordClassifier(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32), np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    steps, step, part = epochs * n, 0, None
    for _ in range(epochs):
        for k in rng.permutation(len(parts)) if len(parts) > 1 else [0]:
            if part is None or len(parts) > 1:
                part = None  # freed before the next one is read
                part = parts[k]()
            rows, y = part
            for i in rng.permutation(len(rows)):
                b, share = rows[i]
                lr = rate * (1 - step / steps)
                step += 1
                if not len(b):
                    continue
                own = vectors[b]
                mean = share @ own
                logits = mean @ out + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[int(y[i])] -= 1
                back = out @ p
                out -= lr * np.outer(mean, p)
                bias -= lr * 0.1 * p
                # the step of each vector follows its share of the document, relative to the mean share
                own -= ((lr * len(b) ** 0.5) * share)[:, None] * back
                vectors[b] = own
    both = vectors @ out
    if keep is not None:
        keep += [vectors, out, bias]
    return SubwordClassifier((both[:, 1] - both[:, 0]).astype(np.float32), float(bias[1] - bias[0]))


def sampled(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2500) -> DataFrame:
    """(doc_id, y, b, n) of the sample: each document's different buckets and their shares, all of them."""

    @F.pandas_udf("struct<b: array<int>, n: array<float>>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            found = [np.unique(np.concatenate([np.zeros(0, np.int32), *buckets(x)]), return_counts=True) for x in part]
            yield pd.DataFrame({"b": [b.astype("int32") for b, _ in found], "n": [(n / max(1, n.sum())).astype("float32") for _, n in found]})

    sample = labelled_sample(docs, labels, label, remainder(F.col("doc_id"), 5) != 0, per_class)
    return kept(sample.select("doc_id", "y", counted("text").alias("t")).select("doc_id", "y", "t.b", "t.n"), "quality-sample")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2500, most: int | None = None, **options) -> SubwordClassifier:
    """A classifier from labelled rows whose crc32(doc_id as text) mod 5 is not 0; at most per_class of each label, with all buckets of their texts.

    The table of counts is dealt into as many parts, by a hash of the id, as keep each at about `most` counts (MOST); a document has at most BUCKETS."""
    table = sampled(docs, labels, label, per_class)
    about = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("positive"), F.coalesce(F.sum(F.size("b")), F.lit(0)).alias("counts")).first()
    many = max(1, -(-about.counts // (most or MOST)))

    def part(k: int) -> tuple[Rows, np.ndarray]:
        got = table.where(F.pmod(F.xxhash64("doc_id"), F.lit(many)) == k).toArrow().sort_by("doc_id")
        return [(b.values.to_numpy(), n.values.to_numpy()) for b, n in zip(got["b"], got["n"], strict=True)], got["y"].to_numpy().astype(float)

    return descend([lambda k=k: part(k) for k in range(many)], about.n, about.positive, **options)


def score(docs: DataFrame, model: SubwordClassifier, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0)."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([model.score(x) for x in part], dtype="float64")

    return docs.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
