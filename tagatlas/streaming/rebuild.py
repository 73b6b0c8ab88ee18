"""Keeping a classified layer up to date: what arrives in a folder of ways is classified and added, once a run."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tagatlas.operators import features

WAYS = "way_id bigint, tags map<string,string>"


def classify_new(spark: SparkSession, ways_folder: str, out_folder: str, checkpoint_folder: str, schema: StructType | str = WAYS) -> StreamingQuery:
    """Classifies the Parquet files that have come since the last run and appends their line features, by class; then ends.

    The classifier keeps no state, so the run is exact once and resumes from its checkpoint after a loss."""
    ways = spark.readStream.schema(schema).parquet(ways_folder)
    rows = features.lines(ways).drop("buffer_px")
    return rows.writeStream.format("parquet").option("path", out_folder).option("checkpointLocation", checkpoint_folder).partitionBy("class").trigger(availableNow=True).outputMode("append").start()


def comfort_counts(spark: SparkSession, ways_folder: str, out_folder: str, checkpoint_folder: str, schema: StructType | str = WAYS) -> StreamingQuery:
    """Counts by class and comfort of all ways so far, as a Parquet table that each run writes anew by its executors."""
    counts = features.lines(spark.readStream.schema(schema).parquet(ways_folder)).groupBy("class", "comfort").agg(F.count("*").alias("n_ways"))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out_folder)
    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).outputMode("complete").start()
