"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item (an item of fewer words is one window). The windows are a hash set that
is broadcast if it takes at most BROADCAST bytes, else joined by shuffle. Training texts are first sieved: every window of
m words holds a run of g = min(8, m) words that starts at a multiple of m - g + 1, so only those runs of a text are
hashed and looked up. Texts with a hit there are verified: all their windows are compared as strings with the set.

The sieve is one scan without a shuffle; what is verified is the distinct texts that it lets through. A passage that a
third of all rows shares makes hits in proportion to those rows and no larger group than one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagatlas.llm.common import LOWER, UPPER, cut, let

#: Everything in ASCII but digits and lower-case letters separates words; A-Z are lower-cased before.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, RUN = 13, 8
BROADCAST, SALTS = 64 << 20, 16
#: Runs of what isn't a separator, A-Z included, in texts as they are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def _starts(n: Column, length: int, step: int = 1) -> Column:
    """The first positions (from 1) of runs of `length` among n words."""
    return F.when(n >= length, F.sequence(F.lit(1), n - F.lit(length - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _run_hashes(w: Column, length: int, step: int = 1) -> Column:
    return F.transform(_starts(F.size(w), length, step), lambda i: F.xxhash64(F.slice(w, i, length)))


def _grams(w: Column, length: int) -> Column:
    return F.transform(_starts(F.size(w), length), lambda i: F.struct(i.alias("at"), F.lit(length).alias("m"), F.array_join(F.slice(w, i, length), " ").alias("gram")))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, m, gram, runs): an item's windows of m words, space-joined, and the hashes of the runs that the sieve looks up; item may be null."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    m = F.least(F.size("w"), F.lit(size))
    windows = let(F.struct("w", m.alias("m")), lambda x: F.transform(F.sequence(F.lit(1), F.size(x["w"]) - x["m"] + 1), lambda i: F.slice(x["w"], i, x["m"])))
    w = w.select("item", m.alias("m"), F.explode(windows).alias("v")).distinct()
    run = F.least(F.col("m"), F.lit(RUN))
    runs = F.transform(F.sequence(F.lit(1), F.size("v") - run + 1), lambda i: F.xxhash64(F.slice("v", i, run)))
    return w.select("item", "m", F.array_join("v", " ").alias("gram"), runs.alias("runs"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """(text, at, m, items): for each distinct text with a window of the benchmark, where (from 1) it is and in which items."""
    grams = cut(benchmark_windows(benchmark, size))
    lengths = [r.m for r in grams.select("m").distinct().orderBy("m").collect()]  # at most 13
    small = (grams.agg(F.sum(F.length("gram") + F.coalesce(F.length("item"), F.lit(0)) + 24 + 8 * F.size("runs"))).first()[0] or 0) <= BROADCAST
    side = F.broadcast if small else (lambda df: df)
    texts = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    if not lengths:
        return docs.sparkSession.createDataFrame([], "text string, at int, m int, items array<string>")
    looked = let(words(F.col("text")), lambda w: F.concat(*[_run_hashes(w, min(m, RUN), m - min(m, RUN) + 1) for m in lengths]))
    runs = grams.select(F.explode("runs").alias("run")).distinct()
    sieved = texts.select("text", F.explode(looked).alias("run")).join(side(runs), "run", "left_semi").select("text").distinct()
    sieved = cut(sieved)
    at = let(words(F.col("text")), lambda w: F.concat(*[_grams(w, m) for m in lengths]))
    of_gram = grams.groupBy("m", "gram").agg(F.collect_set("item").alias("items"))
    return sieved.select("text", F.explode(at).alias("x")).select("text", "x.*").join(side(of_gram), ["m", "gram"]).select("text", "at", "m", "items")


def _salted(docs: DataFrame, text: str) -> Column:
    """A number below SALTS for a row, by all of its values: copies of a text in different rows get different ones."""
    whole = [c for c in docs.columns if c != text and "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    return F.pmod(F.xxhash64(F.lit(1), *whole), F.lit(SALTS)).cast("int")


def _of_rows(docs: DataFrame, found: DataFrame, text: str, columns: list[str], **more: Column) -> DataFrame:
    """row (a struct of columns), more, and what found (key, ...) says of the row's text; rows of equal texts are spread by a salt."""
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a row without a text has a key of its own, so that no task gets them all
    key = F.coalesce(F.sha2(F.col(text), 256), F.monotonically_increasing_id().cast("string")) if not docs.columns == [text] else F.sha2(F.col(text), 256)
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"), _salted(docs, text).alias("salt"), *[c.alias(n) for n, c in more.items()])
    return rows.join(spread, ["key", "salt"], "left")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", share: int = 20, keep_text: bool = True) -> DataFrame:
    """docs (without the text where keep_text is false) with n_words, n_hit (words inside a window's occurrence), n_items, items_sha256 and contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. A null or empty text has no words and no hits; benchmark items
    that are null or empty have no windows. Items without an id hit like any others; since nothing names them, neither n_items nor
    items_sha256 counts them. Repeated rows agree; an empty benchmark hits nothing. Existing columns of the new names are
    replaced, others pass through.
    """
    found = hits(docs, benchmark, size, text).withColumn("key", F.sha2("text", 256)).select("key", "at", "m", "items")
    order = Window.partitionBy("key").orderBy("at", "m")
    ended = F.coalesce(F.max(F.col("at") + F.col("m")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("at") + F.col("m") - F.greatest("at", ended))
    of_text = found.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    of_text = of_text.select("key", "hit", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    columns = [c for c in docs.columns if keep_text or c != text] or docs.columns
    # a split is faster than a count of matches
    got = _of_rows(docs, of_text, text, columns, n_words=F.size(words(F.col(text))).cast("long")).withColumn("hit", F.coalesce("hit", F.lit(0).cast("long")))
    return got.select(
        *[F.col("row").getField(c).alias(c) for c in columns if c not in added], "n_words", F.col("hit").alias("n_hit"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((F.col("hit") > 0) & (share * F.col("hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """docs whose text lacks the words that are hit, with the separators before them; other texts stay as they are.

    Null and empty texts stay; repeated rows agree; columns of any name pass through."""
    spans = hits(docs, benchmark, size, text).groupBy(F.sha2("text", 256).alias("key")).agg(F.collect_set(F.struct("at", (F.col("at") + F.col("m")).alias("end"))).alias("spans"))
    own = F.col("row").getField(text)
    pieces = F.regexp_extract_all(own, F.lit(f"[{WORD[2:-2]}]*{WORD}"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists("spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["end"])))
    tail = F.regexp_extract(own, rf"[{WORD[2:-2]}]*\z", 0)
    clean = F.when(F.col("spans").isNull(), own).otherwise(F.concat(F.array_join(kept, ""), tail))
    return _of_rows(docs, spans, text, docs.columns).select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
