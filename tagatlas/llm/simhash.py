"""Near duplicates by SimHash: 64-bit fingerprints, compared exactly in tiles.

Fingerprints: over the 3-word shingles of a text (A-Z lower-cased, words between ASCII white space), each hashed by XXH64
with seed 42; a bit is set if it is set in over half the hashes.

Comparison: equal fingerprints collapse first. A fingerprint's tile is the population counts of its four 16-bit quarters.
If two fingerprints differ in at most `radius` bits, these four counts differ by at most `radius` in sum, so only such
pairs of tiles meet; all other pairs are skipped, and nothing is lost. Tiles larger than BLOCK fingerprints are split into
blocks, and each pair of blocks is one numpy exclusive-or and bit count. A pair of blocks gives back a spanning forest of
its links, which keeps the components and bounds the rows.

Scale: the work is quadratic within neighbouring tiles, about 5% of all pairs for random fingerprints. The first block of a
pair travels to the second by an equi-join on the second's number and a salt, which deals the pairs of each block to groups of
about FAN; so the pairs of the fullest tile are spread over the cluster as well. Tiles and their neighbours (at most 17^4 rows of at most
65 numbers) are the only broadcast. Nothing is sampled or capped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import cut, kept
from tagatlas.llm.components import components

BLOCK = 512
#: Pairs of blocks that share a key of the join.
FAN = 64
_BASE = 17  # counts of a quarter: 0 to 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    hashes, ones = map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        h = np.fromiter(itertools.islice(hashes, 1 << 14), np.uint64, min(1 << 14, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fp (bigint)."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(x) for x in part], dtype="int64")

    return docs.withColumn("fp", of(F.col(text)))


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as u-v over n nodes, fewer than n."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _compare(radius: int):
    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same, us, vs = batch["a"], batch["b"], batch["same"].to_pylist(), [], []
            la, lo = left.values.to_numpy().view(np.uint64), left.offsets.to_numpy()
            ra, ro = right.values.to_numpy().view(np.uint64), right.offsets.to_numpy()
            for k in range(batch.num_rows):
                a, b = la[lo[k] : lo[k + 1]], ra[ro[k] : ro[k + 1]]
                near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
                i, j = np.nonzero(np.triu(near, 1) if same[k] else near)
                if len(i):
                    both = a if same[k] else np.concatenate([a, b])
                    i, j = _forest(i, j if same[k] else j + len(a), len(both))
                    us.append(both[i])
                    vs.append(both[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

    return block_pairs


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that differ in at most radius bits, up to components."""
    key = F.lit(0)
    for k in range(4):
        key = key * _BASE + F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    keyed = cut(fps.where("fp is not null").select("fp").distinct().withColumn("key", key.cast("int")))
    tiles = cut(keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
    blocks = keyed.join(F.broadcast(tiles), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    blocks = cut(blocks.groupBy("key", "part").agg(F.collect_list("fp").alias("fps")))
    steps = (sum(d * _BASE ** (3 - k) for k, d in enumerate(x)) for x in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, x)) <= radius)
    half = F.array(*(F.lit(s) for s in sorted(s for s in steps if s >= 0)))
    near = tiles.select(F.col("key").alias("key_a"), F.col("parts").alias("parts_a"), F.explode(half).alias("step"))
    near = near.select("key_a", "parts_a", (F.col("key_a") + F.col("step")).alias("key_b")).join(F.broadcast(tiles.select(F.col("key").alias("key_b"), F.col("parts").alias("parts_b"))), "key_b")
    salts = near.groupBy("key_b").agg(F.ceil(F.sum("parts_a") / FAN).cast("int").alias("salts"))
    # three numbers in one keep the table that goes along with every task small: a tile has 17 bits, blocks and salts 22 each
    packed = F.shiftleft(F.col("key_b").cast("long"), 44) + F.shiftleft(F.col("parts_b").cast("long"), 22) + F.col("salts")
    of = lambda bits: F.shiftright("n", bits).bitwiseAND(F.lit((1 << 22) - 1)).cast("int")
    near = cut(near.join(F.broadcast(salts), "key_b").groupBy("key_a").agg(F.collect_list(packed).alias("near")))
    left = blocks.join(F.broadcast(near), blocks["key"] == near["key_a"]).select("key_a", F.col("part").alias("part_a"), F.col("fps").alias("a"), F.explode("near").alias("n"))
    salt = F.pmod(F.xxhash64("key_a", "part_a"), of(0)).cast("int")
    left = left.select("a", "part_a", (F.col("key_a") == of(44)).alias("own"), of(44).alias("key"), salt.alias("salt"), F.explode(F.sequence(F.lit(0), of(22) - 1)).alias("part"))
    right = blocks.join(F.broadcast(salts), blocks["key"] == salts["key_b"]).select("key", "part", F.col("fps").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = left.where("not own or part_a <= part").join(right, ["key", "part", "salt"])
    return met.select("a", "b", (F.col("own") & (F.col("part_a") == F.col("part"))).alias("same")).mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for every row of docs.

    fingerprint has 16 lower-case hexadecimal digits; component_id is the smallest id that links lead to, the row's own
    included, and null where no row of the component has an id. Null and empty texts have fingerprint zero and link
    like any other; repeated rows link by their equal fingerprints; an empty table gives no rows; other columns are not read.
    """
    fps = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").drop("text"))
    roots = components(links(fps, radius)).withColumnRenamed("node", "fp")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = cut(classes)
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = classes.join(smallest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of near_duplicates(docs), with the columns of docs.

    The row with the smallest id stays; rows without an id come after all others, ties go by the hash of the text and of the whole
    row, so reruns agree. Ids need not be unique: an id that several components share keeps a row in each. Null and empty
    texts are near each other like any texts; an empty table gives no rows. Columns of any name and type pass through.

    Rows of equal fingerprints are reduced first (a partial aggregate, so any number of copies is one row per task and fingerprint).
    What is linked, without texts, then says which fingerprints go.
    """
    whole = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    order = F.struct(F.col(doc_id).isNull().alias("nameless"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text"), F.xxhash64(*whole).alias("row"))
    rows = fingerprints(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), order.alias("order")), "text")
    # the one row of each fingerprint, kept in the shared folder: texts are hashed and moved once
    rows = kept(rows.groupBy("fp").agg(F.min("order").alias("order"), F.min_by("row", "order").alias("row")), "fingerprints")
    roots = components(links(rows.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = cut(roots.join(rows.select("fp", "order"), "fp"))
    first = linked.groupBy("root").agg(F.min_by("fp", "order").alias("fp"))
    gone = linked.select("fp").join(first.select("fp"), "fp", "left_anti")
    return rows.join(gone, "fp", "left_anti").select("row.*")
