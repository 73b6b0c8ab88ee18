"""Centroid clustering of integer vectors, exact at every size.

A component x becomes floor(256 * x). Distances to all centroids come from |x|^2 - 2 x.c + |c|^2, one float64 matrix product a
block of rows. Every number on the way is an integer, so the product is exact as long as no sum can pass 2^53; `products`
checks that bound by the largest magnitudes of block and centroids and otherwise counts in 64-bit or, beyond that, in
unbounded integers. New centroids are floors of exact sums, which tasks build by block and RDD.treeAggregate combines, so the
result doesn't depend on partitions, order or retries.

Scale: a round is one pass over the kept vectors without a shuffle of rows; what travels is k centroids to the tasks and k sums from
them, combined in a tree. First centroids are a top-k by hash. Nothing else comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import kept

DIM, SCALE = 64, 256
EXACT = 1 << 53
#: Rows of one matrix product.
BLOCK = 4096


def usable(vector: Column, dim: int = DIM) -> Column:
    """True if vector has dim components and all of them, scaled, are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int = DIM) -> np.ndarray:
    """The scaled integers of a column of vectors, as float64: a double times 256, floored, is an integer that a double holds exactly."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE)


def integers(x: np.ndarray) -> np.ndarray:
    """float64 integers as int64 where all fit, else as Python integers."""
    if not x.size or np.abs(x).max() < 2**62:
        return x.astype(np.int64)
    out = np.empty(x.shape, object)
    out[...] = [[int(v) for v in row] for row in x.tolist()]
    return out


def products(x: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """Squared distances of the rows of x (float64 integers) to all centroids, exact."""
    reach = int(np.abs(x).max(initial=0)) + max((abs(v) for c in centres for v in c), default=0)
    most = x.shape[1] * reach * reach  # no sum on the way is larger: |x|^2, 2 x.c and |c|^2 are each at most this
    if most < EXACT:
        c = np.array(centres, np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    if most < 1 << 62:
        x, c = x.astype(np.int64), np.array(centres, np.int64)
        return np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    x = np.array([[int(v) for v in row] for row in x.tolist()], object)
    return np.stack([((x - np.array(row, object)) ** 2).sum(1) for row in centres], 1)


def nearest(x: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number."""
    d = products(x, centres)
    at = np.argmin(d, 1) if d.dtype != object else np.array([min(range(len(row)), key=row.__getitem__) for row in d.tolist()], int)
    return at, d[np.arange(len(at)), at]


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (rows, componentwise sum as Python integers)}"""
    out, whole = {}, integers(x)
    safe = whole.dtype == object or int(np.abs(whole).max(initial=0)) * len(whole) < 1 << 62
    for c in np.unique(at).tolist():
        own = whole[at == c]
        total = own.sum(0).tolist() if safe else [sum(col) for col in own.T.tolist()]
        out[c] = (len(own), total)
    return out


def _merge(a: dict, b: dict) -> dict:
    for c, (n, total) in b.items():
        if c in a:
            m, mine = a[c]
            a[c] = (m + n, [p + q for p, q in zip(mine, total, strict=True)])
        else:
            a[c] = (n, total)
    return a


def seeds(vectors: DataFrame, k: int, seed: int, dim: int = DIM) -> list[list[int]]:
    """The k vectors with the smallest hash of `seed:vec_id`; ties by the vector, ids that are null last."""
    tag = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(tag.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return [[int(v) for v in np.floor(np.array(r.embedding, np.float64) * SCALE)] for r in first]


def train(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = DIM) -> list[list[int]]:
    """Centroids of vectors (vec_id, embedding; all usable): rounds of assigning and of flooring the means; empty ones stay."""
    centres = seeds(vectors, k, seed, dim)
    if not centres:
        return centres
    arrow = vectors.select("embedding")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([matrix(batch["embedding"].slice(at, BLOCK), dim).tobytes()], pa.binary())], ["x"])

    blocks = arrow.mapInArrow(packed, "x binary").rdd
    for _ in range(rounds):
        now = centres

        def add(sums: dict, row, now=now) -> dict:
            x = np.frombuffer(row.x).reshape(-1, dim)
            return _merge(sums, _sums(x, nearest(x, now)[0], len(now)))

        sums = blocks.treeAggregate({}, add, _merge)
        centres = [[v // sums[c][0] for v in sums[c][1]] if c in sums else old for c, old in enumerate(now)]
    return centres


def assigned(vectors: DataFrame, centres: list[list[int]], dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector; a distance beyond 38 digits is null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.decimal128(38, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                cluster, distance = nearest(matrix(part["embedding"], dim), centres)
                whole = pa.array(distance).cast(kind) if distance.dtype != object else pa.array([v if v < 10**38 else None for v in distance.tolist()], kind)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(cluster, pa.int32()), whole], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(of, f"vec_id {kind}, cluster int, distance decimal(38,0)")


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row of table (vec_id, embedding) whose vector is usable.

    Rows with a null vector, one of another length, or one with a null or non-finite component are left out. A null vec_id is kept
    and comes last among first centroids; repeated rows are rows of their own, and copies of a vector may be several centroids, of which
    the smallest number wins; fewer rows than k give fewer centroids; an empty table gives no rows; other columns are not read.
    Distances and sums that a long can't hold are null.
    """
    spark = table.sparkSession
    vectors = kept(table.where(usable(F.col("embedding"), dim)).select("vec_id", "embedding"), "vectors")
    centres = train(vectors, k, rounds, seed, dim)
    rows = kept(assigned(vectors, centres, dim), "assigned")
    long = lambda c: F.when(c <= (1 << 63) - 1, c).cast("long")
    # one row a centroid
    sums = {r.cluster: r for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s"), F.count("distance").alias("n"), F.count(F.lit(1)).alias("m")).collect()}
    known = {c: int(r.s) if r.s is not None and r.n == r.m else None for c, r in sums.items()}
    total = sum(known.values()) if None not in known.values() else None
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    each = spark.createDataFrame([(c, fits(v), fits(total), digest[c]) for c, v in known.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    got = rows.join(F.broadcast(each), "cluster")
    return got.select("vec_id", "cluster", long(F.col("distance")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = DIM) -> str:
    """DuckDB's SQL of cluster() over embeddings, for vectors whose sums fit 64 bits and ids without repeats."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        "parts AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range(len(v))) AS i FROM first)",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM parts JOIN c{r} USING (i) GROUP BY vec_id, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            mean = "CAST(sum(x) AS HUGEINT) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END"
            steps.append(f"m{r} AS (SELECT c, i, {mean} AS y FROM a{r} JOIN parts USING (vec_id) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.y, c{r}.y) AS y, i FROM c{r} LEFT JOIN m{r} USING (c, i))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(y AS BIGINT), ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c) USING (c)"""
