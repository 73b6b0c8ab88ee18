"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words of a text (A-Z lower-cased, between ASCII white space) and one end; the end also stands before the first word.
The filter holds the counts of pairs of neighbours: a count is quantised to a level on a scale that is exact up to 8 and then
grows by a quarter, and pair and level are inserted for every level up to its own. A pair's count is found by asking for level after
level until the filter denies one. Nothing that was counted is missed, a level gives the least count that has it, and a pair
that never occurred passes the first level with probability 2^-FIRST, and one that did passes its next level with 2^-NEXT. Single tokens have exact counts c, N in all, of V different ones.

    base(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))          p(w | h) = (filter(h, w) + MU base(w)) / (c(h) + MU)

Since levels round down, the p of a context sum to 1 at most, false positives of the filter aside. Tokens and pairs go by 64-bit hashes.

Scale: counts are merged per block of tokens before they travel, as packed arrays, dealt by range of hash; a range is one group of about
RANGE bytes of text whatever the corpus' size, and becomes one segment of the filter. The model is measured: up to BROADCAST bytes it
goes along with the tasks and texts are scored without a shuffle. Beyond that, up to MAPPED bytes, tasks lay the segments out side by side as
flat files in the shared folder and map those into memory, so that texts are still not shuffled and an executor's tasks share one copy. Where the shared folder
can't be mapped, or for a larger model, the distinct tokens and pairs of the texts meet the segments in a join, and each row gets the numbers
that it needs. All ways ask the same filter and give the same scores.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import kept, new_folder, unused
from tagatlas.llm.hashes import PACKED, looked_up, merged, mixed, packed, segment

#: Hash functions of the filter: for the first level, which most pairs that are asked for don't have, and for each further one.
FIRST, NEXT = 6, 5
#: How many tokens the base distribution counts for after each context; chosen on training rows (crc32 mod 10 = 1, learned from the rest).
MU = 300
BROADCAST, MAPPED = 64 << 20, 4 << 30
#: Bytes of training text for each segment of the model.
RANGE = 16 << 20
#: Tokens that are counted together, those that are scored together, and bytes of a text that are split at a time.
BLOCK, SCORED, CHUNK = 1 << 20, 1 << 18, 1 << 22
END = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty
WORDS, PAIRS = 1, 2
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SECOND = np.uint64(0x9E3779B97F4A7C15)
RESULT = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
STRUCT = f"struct<{', '.join(f'{k}: {v}' for k, v in RESULT.items())}>"


def _scale(top: int = 1 << 62) -> np.ndarray:
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


#: The least count of each level from 1 on.
SCALE = _scale()


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(SCALE, counts, side="right")


def tokens(text: str | None) -> Iterator[np.ndarray]:
    """The hashes of a text's tokens, chunk by chunk; the last chunk is the end."""
    data, at = (text or "").encode(), 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK)
        words = data[at : gap.start() if gap else len(data)].lower().split()
        yield np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        at = gap.start() if gap else len(data)
    yield np.array([END])


def blocks(texts: Iterable[str | None], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, contexts, piece of each token, text of each piece): about `size` tokens at a time; a text is one piece, a long one several."""
    parts, before, own, n = [], [], [], 0

    def out():
        each = [len(p) for p in parts]
        h = np.concatenate(parts)
        context = np.concatenate([END[None], h[:-1]])
        some = np.flatnonzero(each)
        context[(np.cumsum(each) - each)[some]] = np.array(before, np.uint64)[some]
        return h, context, np.repeat(np.arange(len(parts)), each), np.array(own)

    for k, text in enumerate(texts):
        last = END
        for h in tokens(text):
            parts.append(h)
            before.append(last)
            own.append(k)
            last, n = h[-1] if len(h) else last, n + len(h)
        if n >= size:
            yield out()
            parts, before, own, n = [], [], [], 0
    if parts:
        yield out()


class Filter:
    """Segments of bits, each of its own range of keys and its own length, one behind the other."""

    def __init__(self, bits: np.ndarray, sizes: list[int]) -> None:
        """sizes: bytes of each segment."""
        self.bits, self.size = bits, np.array(sizes, np.uint64) * np.uint64(8)
        self.start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.size, dtype=np.uint64)])

    @staticmethod
    def built(keys: np.ndarray, level: np.ndarray) -> bytes:
        """The bits of one segment with every level up to its own of each key."""
        words = max(1, int(np.ceil((len(level) * FIRST + (level.sum() - len(level)) * NEXT) / np.log(2) / 64)))
        bits, size = np.zeros(words * 64, bool), np.uint64(words * 64)
        for j in range(1, int(level.max(initial=0)) + 1):
            for at in Filter._places(keys[level >= j], j, size):
                bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    @staticmethod
    def _places(keys: np.ndarray, level: int, size):
        h = mixed(keys, np.uint64(level))
        step = mixed(h, _SECOND) | np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(FIRST if level == 1 else NEXT):
                yield (h + np.uint64(k) * step) % size

    def level(self, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The level of each key, in the segments that own says: 0 where the filter denies the first."""
        out, left, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(left):
            j += 1
            key, seg, still = keys[left], own[left], np.ones(len(left), bool)
            for at in Filter._places(key, j, self.size[seg]):
                at += self.start[seg]
                still &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[still]
            out[left] = j
        return out


@dataclass
class Model:
    """table: (kind, part, n, total, keys, data), one row a segment: exact counts of tokens or bits of pairs; kept in the shared folder."""

    table: DataFrame
    parts: int
    n: int  # N
    v: int  # V
    size: int  # bytes


def train(docs: DataFrame, text: str = "text", range_bytes: int | None = None) -> Model:
    """The model of all rows of docs. Null and empty texts are one end each; repeated rows count again; an empty table gives a model that knows nothing."""
    source = docs.select(F.col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (range_bytes or RANGE)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, context, _, _ in blocks(x.as_py() for x in batch["text"]):
                yield from packed(WORDS, h, parts)
                yield from packed(PAIRS, mixed(context, h), parts)

    def built(group: pa.Table) -> pa.Table:
        kind, (u, n) = group["kind"][0].as_py(), merged(group)
        whole = (u.tobytes(), n.tobytes()) if kind == WORDS else (b"", Filter.built(u, levels(n)))
        return pa.table({"kind": pa.array([kind], pa.int32()), "part": [group["part"][0].as_py()], "n": [len(u)], "total": [int(n.sum())], "keys": pa.array([whole[0]], pa.binary()), "data": pa.array([whole[1]], pa.binary())})

    partial = source.mapInArrow(counted, PACKED)
    table = kept(partial.groupBy("kind", "part").applyInArrow(built, "kind int, part long, n long, total long, keys binary, data binary"), "language-model")
    row = table.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == WORDS, F.col(c))), F.lit(0)).alias(c) for c in ("n", "total")), F.coalesce(F.sum(F.octet_length("keys") + F.octet_length("data")), F.lit(0)).alias("size")).first()
    return Model(table, parts, row.total, row.n, row.size)


def _scores(texts: list, n: int, v: int, count, pair) -> pd.DataFrame:
    """The result of texts, given functions from different hashes to the counts of tokens and of pairs."""
    out = np.zeros((4, len(texts)))
    for h, context, piece, own in blocks(texts, SCORED):
        u, back = np.unique(np.concatenate([h, context]), return_inverse=True)
        c = count(u)[back]
        c, before = c[: len(h)], c[len(h) :]
        base = (c + 0.1) / (n + 0.1 * (v + 1))
        u, back = np.unique(mixed(context, h), return_inverse=True)
        p = (np.minimum(pair(u)[back], before) + MU * base) / (before + MU)
        for k, x in enumerate((np.ones(len(h)), c > 0, np.log10(base), np.log10(p))):
            # a piece is summed token by token and a text piece by piece, so equal texts agree to the last bit
            out[k] += np.bincount(own, weights=np.bincount(piece, weights=x, minlength=len(own)), minlength=len(texts))
    return pd.DataFrame({"n_tokens": out[0].astype(np.int64), "n_known": out[1].astype(np.int64), "train_tokens": np.full(len(texts), n), "base_score": out[2], "score": out[3]})


def score(docs: DataFrame, model: Model, text: str = "text", broadcast: int | None = None, mapped: int | None = None) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text and its end).

    Null and empty texts are one end; a row's numbers depend on its text and the model only, so repeated rows agree; an empty
    table stays empty; texts of any length go chunk by chunk. Other columns pass through, columns named like the result are replaced.
    """
    whole, own = F.struct(*docs.columns).alias("row"), [c for c in docs.columns if c.lower() not in RESULT]
    rows = docs.select(whole, F.col(text).alias("text"))
    if model.size <= (BROADCAST if broadcast is None else broadcast):
        scored = _by_broadcast(rows, model)
    else:
        flat = _flat_files(model) if model.size <= (MAPPED if mapped is None else mapped) else None
        scored = _by_join(rows, model) if flat is None else _by_files(rows, model, *flat)
    return scored.select(*(F.col("row")[c].alias(c) for c in own), *(F.col("s")[c].alias(c) for c in RESULT))


def _layout(model: Model) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Where each segment's tokens and bits begin when all lie one behind the other, and the bytes of each segment of bits."""
    words, sizes = [0] * (model.parts + 1), [8] * model.parts
    for r in model.table.select("kind", "part", "n", F.octet_length("data").alias("size")).collect():
        if r.kind == WORDS:
            words[r.part + 1] = r.n
        else:
            sizes[r.part] = r.size
    return np.cumsum(words), np.concatenate([[0], np.cumsum(sizes)]), sizes


def _scored(texts: Iterator[pd.Series], n: int, v: int, parts: int, known: np.ndarray, counts: np.ndarray, bits: np.ndarray, sizes: list[int]) -> Iterator[pd.DataFrame]:
    pairs, value = Filter(bits, sizes), np.concatenate([[0], SCALE])
    for part in texts:
        yield _scores(list(part), n, v, lambda u: looked_up(u, known, counts).astype(np.int64), lambda u: value[pairs.level(u, segment(u, parts).astype(np.int64))])


def _by_broadcast(rows: DataFrame, model: Model) -> DataFrame:
    n, v, parts = model.n, model.v, model.parts
    # what is sent is laid out first and then filled, a file of the table at a time, so that the driver holds it once
    first, start, sizes = _layout(model)
    known, counts, bits = np.zeros(first[-1], np.uint64), np.zeros(first[-1], np.uint32 if n < 1 << 32 else np.int64), np.zeros(start[-1], np.uint8)
    for r in model.table.select("kind", "part", "keys", "data").toLocalIterator():
        if r.kind == WORDS:
            known[first[r.part] : first[r.part + 1]] = np.frombuffer(r.keys, np.uint64)
            counts[first[r.part] : first[r.part + 1]] = np.frombuffer(r.data, np.int64)
        else:
            bits[start[r.part] : start[r.part + 1]] = np.frombuffer(r.data, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast((known, counts, bits, sizes))
    del known, counts, bits

    @F.pandas_udf(STRUCT)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _scored(texts, n, v, parts, *sent.value)

    return rows.withColumn("s", of("text"))


def _flat_files(model: Model) -> tuple[str, list[int]] | None:
    """The folder with the model as flat files (known, counts, bits), each segment written to its place by a task, and the sizes of segments; None if the shared folder can't be mapped."""
    folder = new_folder(model.table.sparkSession, "language-model-flat")
    folder = re.sub(r"^file:/+", "/", folder)
    if "://" in folder or not folder.startswith("/"):
        return None
    first, start, sizes = _layout(model)
    os.makedirs(folder)
    for name, size in (("known", 8 * int(first[-1])), ("counts", 8 * int(first[-1])), ("bits", int(start[-1]))):
        with open(f"{folder}/{name}", "wb") as file:
            file.truncate(max(size, 8))

    def put(name: str, at: int, data: bytes) -> None:
        with open(f"{folder}/{name}", "r+b") as file:  # a repeated task writes the same again
            file.seek(at)
            file.write(data)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part, data = batch["part"][k].as_py(), batch["data"][k].as_py()
                if batch["kind"][k].as_py() == WORDS:
                    put("known", 8 * int(first[part]), batch["keys"][k].as_py())
                    put("counts", 8 * int(first[part]), data)
                else:
                    put("bits", int(start[part]), data)
            yield batch.select(["part"])

    model.table.select("kind", "part", "keys", "data").mapInArrow(filled, "part long").count()
    return folder, sizes


def _by_files(rows: DataFrame, model: Model, folder: str, sizes: list[int]) -> DataFrame:
    n, v, parts = model.n, model.v, model.parts

    @F.pandas_udf(STRUCT)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, counts, bits = (np.asarray(np.memmap(f"{folder}/{name}", kind, "r")) for name, kind in (("known", np.uint64), ("counts", np.int64), ("bits", np.uint8)))
        yield from _scored(texts, n, v, parts, known[:v], counts[:v], bits, sizes)

    return rows.withColumn("s", of("text"))


def _by_join(rows: DataFrame, model: Model) -> DataFrame:
    """For models of any size, in any store: each row is joined with the counts of its own tokens and pairs; the filter is asked segment by segment."""
    at = unused(rows, "at")
    rows = kept(rows.withColumn(at, F.monotonically_increasing_id()), "scored")
    n, v, parts = model.n, model.v, model.parts

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch[at].to_numpy()
            for h, context, piece, own in blocks(x.as_py() for x in batch["text"]):
                of = number[own[piece]]
                for kind, row, key in ((WORDS, np.concatenate([of, of]), np.concatenate([h, context])), (PAIRS, of, mixed(context, h))):
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    first = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
                    row, key = row[first], key[first]
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(key), kind, np.int32)), pa.array(segment(key, parts).astype(np.int64)), pa.array(key.view(np.int64))], ["row", "kind", "part", "key"])

    def answered(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        key, kind = asked["key"].to_numpy().view(np.uint64), held["kind"][0].as_py()
        data = held["data"][0].as_py()
        if kind == WORDS:
            found = looked_up(key, np.frombuffer(held["keys"][0].as_py(), np.uint64), np.frombuffer(data, np.int64))
        else:
            found = np.concatenate([[0], SCALE])[Filter(np.frombuffer(data, np.uint8), [len(data)]).level(key, np.zeros(len(key), np.int64))]
        some = found > 0
        return pa.table({"kind": pa.array(np.full(some.sum(), kind, np.int32)), "key": key[some].view(np.int64), "n": found[some]})

    asked = rows.select(at, "text").mapInArrow(keys, "row long, kind int, part long, key long")
    segments = model.table.select("kind", "part", "keys", "data").groupBy("kind", "part")
    values = asked.select("kind", "part", "key").distinct().groupBy("kind", "part").cogroup(segments).applyInArrow(answered, "kind int, key long, n long")
    # a key of very many rows is split by the engine's skew join; a row's list is as long as its text at most
    own = asked.select("row", "kind", "key").join(values, ["kind", "key"]).groupBy("row").agg(F.collect_list(F.struct("kind", "key", "n")).alias("known"))
    own = rows.join(own.withColumnRenamed("row", at), at, "left")

    @F.pandas_udf(STRUCT)
    def of(texts: pd.Series, kinds: pd.Series, found: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        out = []
        for text, kind, key, count in zip(texts, kinds, found, numbers, strict=True):
            tables = []
            for k in (WORDS, PAIRS):
                mine = np.array([], bool) if kind is None else np.asarray(kind) == k
                own = np.asarray([] if key is None else key, np.int64)[mine].view(np.uint64)
                order = np.argsort(own)
                tables.append((own[order], np.asarray([] if count is None else count, np.int64)[mine][order]))
            out.append(_scores([text], n, v, lambda u, t=tables: looked_up(u, *t[0]), lambda u, t=tables: looked_up(u, *t[1])))
        return pd.concat(out) if out else _scores([], n, v, None, None)

    return own.withColumn("s", of("text", *(F.col("known")[c] for c in ("kind", "key", "n"))))
