"""Tables that the registered queries read, all derived from the given Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions.columns import segment_id
from earmark.operators import vectors as V
from earmark.operators.distribution import number_rows
from earmark.operators.fusion import to_track_grain
from earmark.session import cut_lineage

# Dimensions that survive in each kind of masked copy, and how hard it makes the search.
MASKS = {60: "mild", 10: "moderate", 6: "severe"}
# Segment vectors are the first scale of a query, means of two neighbours the second.
SCALE_WEIGHTS = {1000: 0.6, 2000: 0.4}
HITS_PER_SEGMENT = 10

_shared: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a table that many queries of one application start from, so it is built once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = cut_lineage(build())
    return _shared[key]


def forget() -> None:
    """Build the shared tables anew from here on."""
    _shared.clear()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbouring vectors make one track: `(track_id, segment_idx, vector)`."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("track"), F.expr("vec_id div 5")).alias("track_id"),
        F.expr("vec_id % 5").alias("segment_idx"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(cand_id, vector)` with unit vectors."""
    named = segments(spark, sf_dir).select(segment_id(F.col("track_id"), F.col("segment_idx")).alias("cand_id"), "vector")
    return V.l2_normalize(named)


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each segment that keep only the leading dimensions."""
    keep = F.array(*[F.lit(m) for m in MASKS])
    return segments(spark, sf_dir).withColumn("m", F.explode(keep)).select(
        F.concat("track_id", F.lit("_m"), F.col("m").cast("string")).alias("query_id"),
        "track_id",
        "m",
        "segment_idx",
        F.transform("vector", lambda x, i: F.when(i < F.col("m"), x).otherwise(0.0)).alias("vector"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors of both scales: `(query_id, scale, scale_weight, segment_idx, vector)`."""
    single = masked(spark, sf_dir).select("query_id", "segment_idx", "vector")
    pooled = V.pool_vectors(single.withColumnRenamed("query_id", "track_id"), 2, 1).select(
        F.col("track_id").alias("query_id"), F.col("window_idx").alias("segment_idx"), "vector"
    )
    both = None
    for (scale, weight), part in zip(SCALE_WEIGHTS.items(), (single, pooled)):
        labelled = part.select(
            "query_id", F.lit(scale).alias("scale"), F.lit(weight).alias("scale_weight"), "segment_idx", "vector"
        )
        both = labelled if both is None else both.unionByName(labelled)
    return V.l2_normalize(both)


def wider_scales(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    """Means of as many neighbouring segments as a scale has seconds, for the queries that ask for them."""
    single = masked(spark, sf_dir).select(F.col("query_id").alias("track_id"), "segment_idx", "vector")
    parts = [
        V.pool_vectors(single.join(wanted.where(F.col("scale") == 1000 * n).select(F.col("query_id").alias("track_id")).hint("merge"), "track_id", "left_semi"), n, 1).select(
            F.col("track_id").alias("query_id"), F.lit(1000 * n).alias("scale"), F.col("window_idx").alias("segment_idx"), "vector"
        )
        for n in (3, 5)
    ]
    return V.l2_normalize(parts[0].unionByName(parts[1]))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query was made from: `(query_id, track_id, transform_type, severity)`."""
    severity = F.create_map(*[x for m, s in MASKS.items() for x in (F.lit(m), F.lit(s))])
    return masked(spark, sf_dir).where(F.col("segment_idx") == 0).select(
        "query_id",
        "track_id",
        F.concat(F.lit("mask_"), F.col("m").cast("string")).alias("transform_type"),
        severity[F.col("m")].alias("severity"),
    )


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latency for each query: 200 ms and eight times the value of the event that has its number."""
    place = F.create_map(*[x for i, m in enumerate(MASKS) for x in (F.lit(m), F.lit(i))])
    number = F.regexp_extract("track_id", "([0-9]+)", 1).cast("bigint") * len(MASKS) + place[F.col("m")]
    asked = masked(spark, sf_dir).where(F.col("segment_idx") == 0).select("query_id", number.alias("event_id"))
    events = table(spark, sf_dir, "events").select("event_id", (F.lit(200.0) + F.col("value") * 8).alias("latency_ms"))
    return asked.join(events, "event_id").select("query_id", "latency_ms")


def segment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search of every query segment; candidates are catalogue segments."""
    return _once(
        spark, sf_dir, "segment_hits",
        lambda: V.knn_cosine(queries(spark, sf_dir), corpus(spark, sf_dir), HITS_PER_SEGMENT),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits with tracks as candidates."""
    return _once(spark, sf_dir, "hits", lambda: to_track_grain(segment_hits(spark, sf_dir)))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user, in order of time, as one signal: `(track_id, idx, value)`.

    The divisor is a prime, so results are no short decimals that sit between two rounded values.
    """
    numbered = number_rows(
        table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"),
        ["user_id"],
        {"day": F.to_date("ts"), "hour": F.hour("ts")},
        [F.col("ts"), F.col("event_id")],
        "idx",
    )
    return numbered.select(
        F.col("user_id").alias("track_id"), "idx", (F.col("value") / 509.0 - 0.5).alias("value")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and ranked tracks of each query, from all hits."""
    from earmark.operators import fusion as Q

    def build() -> DataFrame:
        found = hits(spark, sf_dir)
        return Q.combined_score(Q.aggregate_candidates(found), Q.temporal_runs(found))

    return _once(spark, sf_dir, "candidates", build)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each query with its best track and latency."""
    from earmark.operators import fusion as Q

    named = truth(spark, sf_dir).join(latency(spark, sf_dir), "query_id")
    return _once(spark, sf_dir, "summary", lambda: Q.top_match_summary(named, candidates(spark, sf_dir)))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, used as given cells."""
    labelled = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("int").alias("track_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return V.pool_vectors(labelled).withColumnRenamed("track_id", "cell_id")
