"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tagatlas-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors don't recompute what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: like cut(), but compressed, and later readers take only the columns they use."""
    out = new_folder(df.sparkSession, what)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with number, 0 for the first row in order: rows are sorted by ranges, only the ranges' counts meet in one place."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    ranges = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", before.alias("before"))
    got = rows.withColumn("part", part).join(F.broadcast(ranges), "part")
    return got.withColumn("number", F.col("before") + F.col("at") - F.shiftleft("part", 33)).drop("at", "part", "before")


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, seed: int = 11) -> DataFrame:
    """(doc_id, text, y) of at most per_class documents for each label 0 and 1, the same ones on every run.

    docs and labels have doc_id; usable is a condition on doc_id. Rows without an id or a label are not used;
    where a document has several labels the largest counts, where several rows share an id the least text counts.
    The ids are chosen by a seeded hash, so the sample doesn't depend on the order or the partitions of the rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.where(usable).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    known = known.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    # two top-k lists; together at most 2 * per_class rows, which bounds the broadcast
    ids = known.where("y = 1").orderBy("_h", "doc_id").limit(per_class).unionByName(known.where("y = 0").orderBy("_h", "doc_id").limit(per_class)).drop("_h")
    text = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return text.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
