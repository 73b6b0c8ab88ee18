"""A corpus pipeline of five stages, each of which works on what the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Toxic documents go; one document of each near-duplicate component stays; contaminated documents go; sources are mixed
(documents repeat as often as the mix takes them); what is left is written as token shards and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagatlas.llm import decontaminate, mixing, simhash, sstable, toxicity
from tagatlas.llm.common import new_folder, table


def _wrapped(docs: DataFrame) -> DataFrame:
    """text beside the whole row, so that no column of docs meets one that an operator adds."""
    return docs.select("text", F.struct(*docs.columns).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the operator's threshold; the machine learns from the labelled rows of docs.

    Null and empty texts are scored like any others; repeated rows go or stay together; an empty table stays empty."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_wrapped(docs), machine).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that with the smallest id, one without an id only if none has one. Ids may repeat."""
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in windows of the benchmark. Null and empty texts stay; repeated rows go or stay together."""
    got = decontaminate.contamination(_wrapped(docs), table(spark, sf_dir, "benchmark"))
    return got.where("not contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by the mix of their sources; those without words stay once, the null source is a source."""
    return mixing.repeated(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards and reads them back, a row for every row of docs; null texts are empty, null ids come first."""
    return sstable.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_shards", token_shards)]

#: The stages train a model, compare fingerprints and encode tokens, which SQL can't express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
