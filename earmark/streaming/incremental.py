"""Keeping an index up to date from a folder that new vectors arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from earmark.functions.columns import track_of_segment
from earmark.operators.vectors import append_to_index, l2_normalize

VECTOR_SCHEMA = T.StructType([T.StructField("cand_id", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])


def new_track_vectors(arriving: DataFrame, index: DataFrame) -> DataFrame:
    """Unit vectors of the tracks that `index` lacked when the stream was started."""
    known = index.select(track_of_segment(F.col("cand_id")).alias("track_id")).distinct().withColumn("_known", F.lit(True))
    named = l2_normalize(arriving).withColumn("track_id", track_of_segment(F.col("cand_id")))
    return named.join(known, "track_id", "left").where("_known IS NULL").select("cand_id", "track_id", "vector")


def follow_folder(spark: SparkSession, arriving: str, index: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take in what has arrived since the last call and stop.

    The file source remembers which files it has read, and the Parquet sink commits a batch once,
    so a restarted run neither loses nor repeats vectors.
    """
    stream = spark.readStream.schema(VECTOR_SCHEMA).parquet(arriving)
    return (
        new_track_vectors(stream, index)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def follow_index(spark: SparkSession, arriving: str, path: str, checkpoint: str) -> StreamingQuery:
    """Take what has arrived since the last call into the stored index at `path`, and stop.

    Each batch becomes a version of the index: its segments get their cells, known ones are skipped by the newest
    version and changed ones replace the old. A batch is named by the checkpoint and its number, so one that runs again
    after a stop is taken in once.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        append_to_index(batch.sparkSession, path, batch, f"{checkpoint}#{number}")

    stream = spark.readStream.schema(VECTOR_SCHEMA).parquet(arriving)
    return stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
