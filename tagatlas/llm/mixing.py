"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by pattern (their set of sources). Tokens flow from each
pattern, through tiers that cost more with each repetition (convex), to the quotas of the sources it belongs to; the
cheapest largest flow says how many tokens each pattern gives. Patterns come to the driver's flow, a row each, never documents. Beyond
max_patterns only those of sources that overlap do (more of these are an error); a source that shares no document with another is a flow of one
arc, which is its quota, and stays in Spark. A pattern's documents then all repeat floor(flow / size) times, and a seeded part of them once
more: in the order of their hashes as long as they fit into what is left; after the first that doesn't fit, those that are small enough for
the rest, and so on for some rounds. Where a round ends is found by a histogram of the hashes (a partial aggregate) and one look into a single
bucket of each pattern, so no source, however large, is sorted or gathered in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagatlas.llm.common import WORD, cut, kept, numbered

#: Cost of a token at its first, second and third use.
COSTS = (0, 1, 3)
_SHIFT = 50  # 2^14 buckets of the 64-bit hash


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, float]:
    """Each source's tokens: shares of the total by weight, at most `most` times its size, the excess reshared.

    Sources take the weights in order of code point, null last, again and again.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, names, float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def cheapest_flow(supply: list[int], members: list[list[int]], quota: list[int], costs: tuple[int, ...] = COSTS) -> list[int]:
    """Tokens that each pattern gives in the largest flow of least cost (successive shortest paths with potentials).

    supply: tokens of each pattern, which may be used len(costs) times; members: the quotas that a pattern may fill.
    """
    p, q = len(supply), len(quota)
    source, sink = p + q, p + q + 1
    graph: list[list[int]] = [[] for _ in range(p + q + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)

    for i, n in enumerate(supply):
        for w in costs:
            arc(source, i, n, w)
        for j in members[i]:
            arc(i, p + j, sum(quota), 0)
    for j, n in enumerate(quota):
        arc(p + j, sink, n, 0)
    height = [0] * len(graph)
    while True:
        far, by, heap = [float("inf")] * len(graph), [-1] * len(graph), [(0, source)]
        far[source] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for a in graph[x]:
                if room[a] and (n := d + cost[a] + height[x] - height[to[a]]) < far[to[a]]:
                    far[to[a]], by[to[a]] = n, a
                    heapq.heappush(heap, (n, to[a]))
        if by[sink] < 0:
            break
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        n = min(room[a] for a in path)
        for a in path:
            room[a] -= n
            room[a ^ 1] += n
    given = [0] * p
    for a in range(0, len(to), 2):
        if to[a ^ 1] == source:
            given[to[a]] += room[a ^ 1]
    return given


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def pattern(sources: Column) -> Column:
    """A name for a set of sources (array of strings)."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def _hash(seed: int, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources (source, n, ...) with target: targets() as columns, for any number of sources; only sums come to the driver."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("number") % len(weights) + 1).cast("int"))
    table = cut(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight))
    total = float(table.agg(F.sum("n")).first()[0] or 0)
    left, among = total, table.agg(F.sum("weight")).first()[0] or 0.0
    cap = (F.col("n") * most).cast("double")
    over = lambda: F.lit(left) * F.col("weight") / F.lit(among) > cap
    while among:  # the rate only rises, so what is over once stays over
        full, free = table.agg(F.sum(F.when(over(), F.col("n") * most)), F.sum(F.when(~over(), F.col("weight")))).first()
        now, free = total - (full or 0), free or 0.0
        if (now, free) == (left, among):
            break
        left, among = now, free
    rate = F.when(over(), cap).otherwise(F.lit(left) * F.col("weight") / F.lit(among)) if among else cap
    return table.withColumn("target", rate).drop("number", "weight")


def plan(slim: DataFrame, seed: int, weights=(1, 2, 3), most: int = 3, max_patterns: int = 4096) -> DataFrame:
    """(pattern, source_size, target, repeats, picks): picks say which documents repeat once more (again()).

    slim: sources (array of strings), pattern, size, hash."""
    spark = slim.sparkSession
    patterns = cut(slim.groupBy("pattern", "sources").agg(F.sum("size").alias("n")))
    each = patterns.select("pattern", "n", F.explode("sources").alias("source"), (F.size("sources") > 1).alias("several"))
    sources = cut(source_targets(each.groupBy("source").agg(F.sum("n").alias("n"), F.max("several").alias("several")), weights, most))
    # sources that overlap count a document once for each; their shares refer to what is there once
    total, apart = patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if apart and total != apart:
        sources = sources.withColumn("target", F.col("target") * F.lit(total / apart))
    same = F.col("source").eqNullSafe(F.col("name"))
    joined = each.join(sources.select(F.col("source").alias("name"), F.col("n").alias("own"), F.col("target"), F.col("several").alias("tangled")), same)
    of = joined.groupBy("pattern").agg(F.sum("own").alias("source_size"), F.sum("target").alias("target"), F.max("tangled").alias("tangled"), F.collect_list(F.struct("source", "target")).alias("quotas"))
    of = cut(patterns.select("pattern", "n").join(of, "pattern", "left"))
    few = of.limit(max_patterns + 1).count() <= max_patterns
    through = F.col("quotas").isNotNull() if few else F.coalesce("tangled", F.lit(False))
    free = of.where(~through).withColumn("flow", F.least(F.floor(F.coalesce("target", F.lit(0.0))), F.col("n") * most))
    found = of.where(through).select("pattern", "n", "quotas").limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns of sources that overlap; raise max_patterns or merge rare sources")
    found.sort(key=lambda r: r.pattern)
    quota: dict[str | None, int] = {q.source: int(q.target) for r in found for q in r.quotas}
    names = list(quota)
    flow = cheapest_flow([r.n for r in found], [[names.index(q.source) for q in r.quotas] for r in found], list(quota.values()), COSTS[:most])
    flows = spark.createDataFrame([(r.pattern, f) for r, f in zip(found, flow, strict=True)], "pattern string, flow long")
    rows = free.unionByName(of.where(through).join(F.broadcast(flows), "pattern")) if found else free
    rows = rows.withColumn("repeats", F.when(F.col("n") > 0, F.expr("flow div n")).otherwise(F.lit(0)).cast("long"))
    rows = rows.select("pattern", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "repeats", F.when(F.col("n") > 0, F.col("flow") % F.col("n")).otherwise(F.lit(0)).cast("long").alias("rest"))
    rows = kept(rows, "mix")
    return kept(rows.join(picked(slim, rows.where("rest > 0").select("pattern", "rest")), "pattern", "left").drop("rest"), "mix")


def picked(slim: DataFrame, rows: DataFrame, rounds: int = 8, near: float = 0.002) -> DataFrame:
    """(pattern, picks) for rows (pattern, rest): documents of sizes that sum up to rest at most, and to within `near` of it unless the rounds end or nothing is small enough.

    A pick says that documents up to a size, with hashes above one number and up to another, are taken. Documents of one hash go together or not at all."""
    state = rows.select("pattern", "rest", F.col("rest").alias("goal"), F.lit(None).cast("long").alias("above"), F.expr("cast(array() as array<struct<most: bigint, above: bigint, upto: bigint>>)").alias("picks"))
    settled, sized = None, slim.where("size > 0").select("pattern", "size", "hash")
    for _ in range(rounds):
        own = sized.join(state.select("pattern", "rest", "above"), "pattern").where("size <= rest and (above is null or hash > above)").withColumn("bucket", F.shiftright("hash", _SHIFT))
        hist = own.groupBy("pattern", "rest", "bucket").agg(F.sum("size").alias("n"))
        hist = cut(hist.withColumn("sum", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket"))))
        edge = hist.where("sum > rest").groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("sum") - F.col("n")).alias("below")), "bucket").alias("e")).select("pattern", "e.*")
        inside = own.join(edge, ["pattern", "bucket"]).groupBy("pattern", "bucket", "below", "rest", "hash").agg(F.sum("size").alias("n"))
        inside = inside.withColumn("sum", F.col("below") + F.sum("n").over(Window.partitionBy("pattern").orderBy("hash")))
        fits = F.col("sum") <= F.col("rest")
        ends = inside.groupBy("pattern", "bucket", "below").agg(F.max(F.when(fits, F.col("hash"))).alias("last"), F.max(F.when(fits, F.col("sum"))).alias("taken"), F.min(F.when(~fits, F.col("hash"))).alias("blocked"))
        before = F.when(F.col("bucket") > -(1 << (63 - _SHIFT)), F.shiftleft("bucket", _SHIFT) - 1)
        ends = ends.select("pattern", "blocked", F.coalesce("last", before).alias("upto"), F.coalesce("taken", "below").alias("taken"))
        whole = hist.groupBy("pattern").agg(F.max("sum").alias("all"))
        now = state.join(whole, "pattern", "left").join(ends, "pattern", "left")
        # without an edge all that was small enough fits
        upto, taken = F.when(F.col("blocked").isNull(), F.lit((1 << 63) - 1)).otherwise(F.col("upto")), F.when(F.col("blocked").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.col("taken"))
        pick = F.struct(F.col("rest").alias("most"), F.col("above").alias("above"), upto.alias("upto"))
        now = kept(now.select("pattern", (F.col("rest") - taken).alias("rest"), "goal", F.col("blocked").alias("above"), F.when(taken > 0, F.concat("picks", F.array(pick))).otherwise(F.col("picks")).alias("picks")), "picks")
        open_ = F.col("above").isNotNull() & (F.col("rest") > F.col("goal") * near)
        settled = now.where(~open_) if settled is None else settled.unionByName(now.where(~open_))
        state = now.where(open_)
        if state.isEmpty():
            break
    return settled.unionByName(state).select("pattern", "picks")


def again(size: Column, hash_: Column, picks: Column) -> Column:
    """1 for documents that picks take, else 0."""
    return F.coalesce(F.exists(picks, lambda p: (size <= p.most) & (p.above.isNull() | (hash_ > p.above)) & (hash_ <= p.upto)), F.lit(False)).cast("long")


def slim(docs: DataFrame, sources: Column, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    own = F.array_sort(F.array_distinct(sources))
    return docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("size"), own.alias("sources"), pattern(sources).alias("pattern"), _hash(seed, F.col(doc_id), F.col(text)).alias("hash"))


def mixed(docs: DataFrame, sources: Column | None = None, seed: int = 42, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for every row of docs.

    sources: the array of a document's sources; its column `source` by default. Where it belongs to several, source_size
    and target are their sums. Null and empty texts have size 0; the null source is a source, the last. Repeated rows (same id and
    text) share a hash, and so get the extra repetition together or not at all. An empty table gives no rows.
    """
    small = cut(slim(docs, F.array("source") if sources is None else sources, seed))
    got = small.join(plan(small, seed, **options), "pattern")
    more = again(F.col("size"), F.col("hash"), F.col("picks"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("repeats") + more)).alias("taken"))


def repeated(docs: DataFrame, sources: Column | None = None, seed: int = 42, **options) -> DataFrame:
    """docs, each row as many times as the mix takes it.

    Documents without words (null and empty texts too) stay once; the null source is a source; repeated rows repeat alike; an empty
    table gives no rows; columns of any name pass through.
    """
    by = F.array("source") if sources is None else sources
    mix = plan(cut(slim(docs, by, seed)), seed, **options).select("pattern", "repeats", "picks")
    own = docs.select(F.struct(*docs.columns).alias("row"), pattern(by).alias("pattern"), _hash(seed, F.col("doc_id"), F.col("text")).alias("hash"), words(F.col("text")).alias("size"))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("repeats") + again(F.col("size"), F.col("hash"), F.col("picks")))
    got = own.join(mix, "pattern").withColumn("times", times.cast("int")).where("times > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
