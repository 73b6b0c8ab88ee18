"""Phrase collocations by contiguous pattern growth, in the manner of PrefixSpan.

Texts are split into pieces and pieces into words; everything is counted per language. A phrase can only be frequent if its words and
its pairs of neighbours are, so an occurrence pointer (the place where a phrase of three words or more may begin) is only kept with the next
words that such pairs join to it. Equal pointers are merged with their number. All pointers of a frequent prefix meet in one task, which grows it to
the right, depth first: it projects the pointers onto each next word, keeps the words that are frequent enough and goes on from there.

Words go by a 64-bit hash of language and word; the count of words proves that no two share one (else another seed is taken).

Scale: counts are merged per block of text before they travel. A prefix with more than HEAVY different pointers is no task: the counts
of its longer prefixes are summed by a shuffle with map-side sums, and those are dealt out in its place, as often as needed, so a word on
a third of all places is spread. A phrase that is repeated a billion times is one pointer. Sets of frequent words and pairs go along with the
tasks up to MOST keys; beyond that the texts aren't pruned by them, which costs time and changes nothing else.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagatlas.llm.common import LOWER, UPPER, kept
from tagatlas.llm.hashes import PACKED, member, merged, mixed, packed

LONGEST = 5
#: Different pointers of a prefix that one task grows, and keys of frequent words or pairs that go along with a task.
HEAVY, MOST = 200_000, 8_000_000
#: Bytes of text for each range of the pairs' counts.
RANGE = 16 << 20
BLOCK, CHUNK = 1 << 20, 1 << 22
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
W = [f"w{k}" for k in range(1, LONGEST + 1)]
_TIMES = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_TIMES), -1, 1 << 64))


def chunks(text: str | None, seed: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, hashes, numbers of their pieces), a part of the text at a time; a piece may go on in the next part under its number."""
    data, at, piece = (text or "").encode(), 0, 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK)
        end = gap.start() if gap else len(data)
        lines = [line.split() for line in data[at:end].lower().translate(_ENDS).split(b"\n")]
        words = list(itertools.chain.from_iterable(lines))
        h = np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(seed)), np.uint64, len(words))
        yield words, np.maximum(h, np.uint64(1)), np.repeat(np.arange(piece, piece + len(lines)), [len(x) for x in lines])
        at, piece = end, piece + len(lines) - 1


def _seed(lang: str, salt: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), salt)


def blocks(langs: Iterable[str], texts: Iterable[str | None], salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, pieces) of whole texts, about BLOCK words at a time; a piece's number is its own within a block."""
    hashes, pieces, n, used = [], [], 0, 0
    for lang, text in zip(langs, texts, strict=True):
        for _, h, piece in chunks(text, _seed(lang, salt)):
            hashes.append(h)
            pieces.append(piece + used)
            n += len(h)
        used = int(next((p[-1] for p in reversed(pieces) if len(p)), -1)) + 1
        if n >= BLOCK:
            yield np.concatenate(hashes), np.concatenate(pieces)
            hashes, pieces, n, used = [], [], 0, 0
    if n:
        yield np.concatenate(hashes), np.concatenate(pieces)


def count_words(source: DataFrame, salt: int = 0) -> DataFrame:
    """(key, lang, word, n): n occurrences of each word of each language."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, order = batch["lang"].to_pylist(), {}
            for k, lang in enumerate(langs):
                order.setdefault(lang, []).append(k)
            for lang, own in order.items():
                words, hashes, seed = [], [], _seed(lang, salt)
                for k in own:
                    for part, h, _ in chunks(batch["text"][k].as_py(), seed):
                        words += part
                        hashes.append(h)
                    if len(words) >= BLOCK:
                        yield _rows(lang, words, hashes)
                        words, hashes = [], []
                if words:
                    yield _rows(lang, words, hashes)

    def _rows(lang: str, words: list[bytes], hashes: list[np.ndarray]) -> pa.RecordBatch:
        u, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
        own = pa.array([words[k] for k in first.tolist()], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array([lang] * len(u), pa.string()), own, pa.array(n)], ["key", "lang", "word", "n"])

    return source.mapInArrow(of, "key long, lang string, word string, n long").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def words_share_a_key(words: DataFrame) -> bool:
    return not words.groupBy("key").count().where("count > 1").isEmpty()


def _keys(df: DataFrame, column: str) -> np.ndarray | None:
    """The sorted keys of df, or None where they are too many to go along with a task."""
    if df.count() > MOST:
        return None
    return np.sort(df.select(column).toArrow()[column].to_numpy().view(np.uint64))


def _linked(h: np.ndarray, piece: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places that a frequent word follows, itself frequent, in one piece; the keys of these pairs): ranks of both words, so that they can be told from the key, or a hash where there are no ranks."""
    beside = piece[:-1] == piece[1:]
    if known is None:
        at = np.flatnonzero(beside)
        return at, mixed(h[at], h[at + 1])
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rank = np.minimum(np.searchsorted(known, h), len(known) - 1)
    ok = known[rank] == h
    at = np.flatnonzero(ok[:-1] & ok[1:] & beside)
    return at, _stirred((rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + 1].astype(np.uint64))


def _stirred(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads ranks over all ranges."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _TIMES
        return x ^ (x >> np.uint64(32))


def _unstirred(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _BACK
        return x ^ (x >> np.uint64(32))


def frequent_pairs(source: DataFrame, words, salt: int, least: int, parts: int) -> DataFrame:
    """(key, f) of the pairs of neighbours that occur at least `least` times; words is a broadcast set of frequent words, or of None."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, piece in blocks(batch["lang"].to_pylist(), (x.as_py() for x in batch["text"]), salt):
                yield from packed(0, _linked(h, piece, words.value)[1], parts)

    def often(group: pa.Table) -> pa.Table:
        u, n = merged(group)
        return pa.table({"key": u[n >= least].view(np.int64), "f": n[n >= least]})

    return source.mapInArrow(of, PACKED).groupBy("part").applyInArrow(often, "key long, f long")


def named_pairs(pairs: DataFrame, words) -> DataFrame:
    """(w, f) of pairs whose keys are ranks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = _unstirred(batch["key"].to_numpy().view(np.uint64))
            both = np.stack([words.value[(ranks >> np.uint64(32)).astype(np.int64)], words.value[(ranks & np.uint64((1 << 32) - 1)).astype(np.int64)]], 1) if len(ranks) else np.zeros((0, 2), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ranks) + 1) * 2, pa.int32()), pa.array(both.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([lists, batch["f"]], ["w", "f"])

    return pairs.mapInArrow(of, "w array<long>, f long")


def _different(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of some columns, and how often each occurs."""
    key = columns[0]
    for c in columns[1:]:
        key = mixed(key, c)
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if all((c[first][back] == c).all() for c in columns):
        return [c[first] for c in columns], n
    order = np.lexsort(columns)  # two rows share a key
    new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)])
    first = np.flatnonzero(new)
    return [c[order][first] for c in columns], np.diff([*first, len(order)])


def pointers(source: DataFrame, words, pairs, salt: int) -> DataFrame:
    """(w1 .. w5, n): where phrases begin, as the words that follow there up to the first pair that isn't frequent (0 from then on), and how often.

    Phrases of two words are counted already where the keys of pairs name them; then only places count that a third word follows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, piece in blocks(batch["lang"].to_pylist(), (x.as_py() for x in batch["text"]), salt):
                at, key = _linked(h, piece, words.value)
                if pairs.value is not None:
                    at = at[member(key, pairs.value)]
                link = np.zeros(len(h) + LONGEST, bool)
                link[at] = True
                start = at if words.value is None else at[link[at + 1]]
                if not len(start):
                    continue
                h = np.concatenate([h, np.zeros(LONGEST, np.uint64)])
                columns, on = [h[start]], np.ones(len(start), bool)
                for k in range(1, LONGEST):
                    on = on & link[start + k - 1]
                    columns.append(np.where(on, h[start + k], np.uint64(0)))
                columns, n = _different(columns)
                yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], [*W, "n"])

    return source.mapInArrow(of, ", ".join(f"{w} long" for w in W) + ", n long").groupBy(*W).agg(F.sum("n").alias("n"))


def grown(columns: list[np.ndarray], n: np.ndarray, depth: int, least: int) -> Iterator[tuple[list[int], int]]:
    """(words, count) of the frequent phrases that begin with a prefix of depth words, given all its pointers."""

    def grow(prefix: list[int], at: np.ndarray, depth: int) -> Iterator[tuple[list[int], int]]:
        following = columns[depth][at]
        order = np.argsort(following, kind="stable")
        at, following = at[order], following[order]
        first = np.flatnonzero(np.concatenate([[True], following[1:] != following[:-1]]))
        total, last = np.add.reduceat(n[at], first), [*first[1:], len(at)]
        for k in np.flatnonzero((total >= least) & (following[first] != 0)):
            longer = [*prefix, int(following[first[k]])]
            yield longer, int(total[k])
            if depth + 1 < LONGEST:
                yield from grow(longer, at[first[k] : last[k]], depth + 1)

    if len(n):
        yield from grow([int(c[0]) for c in columns[:depth]], np.arange(len(n)), depth)


def grow_prefixes(dealt: DataFrame, least: int) -> DataFrame:
    """(w, f) of frequent phrases, from pointers with depth: each prefix of so many words is grown in the task that has all its pointers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = np.stack([c.to_numpy() for c in batch.columns])
                held = [np.concatenate([held[0], rows], 1) if held else rows]
            if not held or not held[0].shape[1]:
                continue
            rows, held = held[0], []
            depth, n, words = rows[0], rows[1], rows[2:]
            same = depth[1:] == depth[:-1]
            for k in range(LONGEST - 1):
                same &= (words[k][1:] == words[k][:-1]) | (depth[1:] <= k)
            first = np.concatenate([[0], np.flatnonzero(~same) + 1])
            if batch is not None:  # the last prefix may go on in the next batch
                held = [rows[:, first[-1] :]]
                first = first[:-1]
            ends = [*first[1:], rows.shape[1] - (held[0].shape[1] if held else 0)] if len(first) else []
            found: list[tuple[list[int], int]] = []
            for a, b in zip(first, ends, strict=True):
                if n[a:b].sum() >= least:
                    found += grown([w[a:b] for w in words], n[a:b], int(depth[a]), least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.list_(pa.int64())), pa.array([f for _, f in found], pa.int64())], ["w", "f"])

    prefix = [F.when(F.col("depth") > k, F.col(w)) for k, w in enumerate(W[:-1])]
    dealt = dealt.withColumns({f"p{k}": p for k, p in enumerate(prefix)})
    by = ["depth", *(f"p{k}" for k in range(len(prefix)))]
    return dealt.repartition(*by).sortWithinPartitions(*by).select("depth", "n", *W).select(F.col("depth").cast("long"), "n", *W).mapInArrow(of, "w array<long>, f long")


def phrases(docs: DataFrame, least: int = 100, lang: str = "lang", text: str = "text", heavy: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(w, f): the keys of the words of each phrase of 1 to 5 words that occurs at least `least` times, and its count; and the table of words (key, lang, word, n)."""
    spark, heavy = docs.sparkSession, heavy or HEAVY
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE))
    for salt in itertools.count():
        words = kept(count_words(source, salt), "words")
        if not words_share_a_key(words):
            break
    often = words.where(F.col("n") >= least)
    send = spark.sparkContext.broadcast
    known = send(_keys(often, "key"))
    counted = kept(frequent_pairs(source, known, salt, least, parts), "pairs")
    todo = kept(pointers(source, known, send(_keys(counted, "key")), salt), "pointers")
    tasks, found = [], [often.select(F.array("key").alias("w"), F.col("n").alias("f"))]
    named = known.value is not None
    if named:
        found.append(named_pairs(counted, known))
    for depth in range(1, LONGEST):
        prefix = W[:depth]
        sizes = todo.where(F.col(prefix[-1]) != 0).groupBy(*prefix).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("f"))
        if depth > 1:
            sizes = kept(sizes.where(F.col("f") >= least), "prefixes")
        if depth > 2 or (depth > 1 and not named):
            found.append(sizes.select(F.array(*prefix).alias("w"), "f"))
        hot = kept(sizes.where(F.col("m") > heavy).select(*prefix), "hot")
        if hot.isEmpty():
            tasks.append(todo.withColumn("depth", F.lit(depth)))
            todo = None
            break
        tasks.append(todo.join(hot, prefix, "left_anti").withColumn("depth", F.lit(depth)))
        todo = todo.join(hot, prefix, "left_semi")
    if todo is not None:  # prefixes of LONGEST - 1 words that are still heavy: only their last word is open
        found.append(todo.where(F.col(W[-1]) != 0).groupBy(*W).agg(F.sum("n").alias("f")).where(F.col("f") >= least).select(F.array(*W).alias("w"), "f"))
    dealt = tasks[0]
    for t in tasks[1:]:
        dealt = dealt.unionByName(t)
    out = grow_prefixes(dealt, least)
    if named:
        out = out.where(F.size("w") > 2)
    for f in found:
        out = out.unionByName(f)
    return kept(out, "phrases"), words


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang: str = "lang", text: str = "text", heavy: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` collocations of each language.

    Null texts are empty, a null lang is `und`; empty texts have no words; repeated rows count again; texts of any length are read part by part;
    an empty table, or one without frequent phrases, gives no rows. Ties go by a, then by phrase. Other columns are not read.

    A candidate inside a longer one of equal count is dropped. It is enough to look at longer ones by one word: counts never grow with
    length, so if any longer candidate has its count, those between have it too.
    """
    known, words = phrases(docs, least, lang, text, heavy)
    many = F.size("w")
    candidates = known.where(many > 1)
    inner = candidates.where(many > 2).select(F.explode(F.array(F.slice("w", 1, many - 1), F.slice("w", 2, many - 1))).alias("w"), F.col("f").alias("longer"))
    open_ = candidates.join(inner.groupBy("w").agg(F.max("longer").alias("longer")), "w", "left").where("longer is null or longer < f")
    cuts = open_.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), many - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("w", 1, F.col("k")), "right": F.slice("w", F.col("k") + 1, many - F.col("k"))})
    cuts = cuts.join(known.select(F.col("w").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("w").alias("right"), F.col("f").alias("r")), "right")
    # names of the words, and how many the language has
    named = open_.select("w", F.posexplode("w").alias("at", "key")).join(words.where(F.col("n") >= least).select("key", "lang", "word"), "key")
    named = named.groupBy("w").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(named, "w").join(sizes, "lang")
    scored = scored.withColumn("up", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 100, top: int = 2000) -> str:
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
seqs AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w, count(*) AS m FROM pieces GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(len(w) * m) AS HUGEINT) AS n FROM seqs GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, m FROM (SELECT lang, w, m, k, unnest(range(1, len(w) - k + 2)) AS i FROM seqs, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, g, CAST(sum(m) AS HUGEINT) AS f FROM grams GROUP BY lang, k, g HAVING sum(m) >= {least}),
c AS (SELECT lang, k AS size, g, string_split(g, ' ') AS w, f AS a FROM f WHERE k > 1),
inside AS (SELECT lang, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, size - k + 2)]) AS g, k AS size, a AS longer FROM c, range(2, {LONGEST}) t(k) WHERE k < size),
dropped AS (SELECT DISTINCT c.lang, c.g FROM c JOIN inside i ON c.lang = i.lang AND c.g = i.g AND c.size = i.size WHERE 100 * i.longer >= 100 * c.a),
cuts AS (SELECT lang, g, w, a, unnest(range(1, size)) AS k FROM c ANTI JOIN dropped USING (lang, g)),
scored AS (SELECT cuts.lang, cuts.g, a, cuts.k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = array_to_string(cuts.w[1:cuts.k], ' ') AND l.k = cuts.k
  JOIN f r ON r.lang = cuts.lang AND r.g = array_to_string(cuts.w[cuts.k + 1:], ' ') AND r.k = len(cuts.w) - cuts.k JOIN sizes ON sizes.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= {top}"""
