"""Fusing the votes of many query segments into ranked candidates.

Input is `hits(query_id, scale, segment_idx, scale_weight, cand_id, rank, similarity)`, where
`scale` is the segment length in whole milliseconds and `rank` starts at 1 inside each segment. No operator here sees which candidate is right.

Decisions about segments are taken on the table of top hits, which has one row for each segment,
and come back to the hits by a semi join on the whole segment key. Votes are summed by
`(query_id, cand_id)` with partial sums before the shuffle. Full rankings use `rank_within`, so a
query with very many segments or candidates is not sorted by one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earmark.functions.columns import track_of_segment
from earmark.operators.distribution import join_hot, rank_within, runs
from earmark.session import cut_lineage

SEGMENT = ["query_id", "scale", "segment_idx"]
CANDIDATE = ["query_id", "cand_id"]
# Segments whose order is settled inside one task.
SEGMENT_BLOCK = 4096


@dataclass(frozen=True)
class ScoreWeights:
    """Shares of the signals in the combined score; they are normalised to sum to 1."""

    # Default weights.
    similarity: float = 0.35
    rank_1: float = 0.30
    rank_5: float = 0.15
    match_ratio: float = 0.10
    temporal: float = 0.15

    def normalised(self) -> dict[str, float]:
        total = sum(vars(self).values())
        return {k: (v / total if total > 0 else v) for k, v in vars(self).items()}


@dataclass(frozen=True)
class FusionConfig:
    """Settings of the whole chain."""

    threshold: float = 0.2
    min_keep: float = 0.3
    keep_ratio: float = 0.6
    keep_floor: int = 5
    weights: ScoreWeights = field(default_factory=ScoreWeights)
    rerank_top: int = 5
    min_quality: float = 0.0
    min_confidence: float = 0.0


def to_track_grain(hits: DataFrame) -> DataFrame:
    """Hits with tracks as candidates: best similarity of a track in a segment, ranked anew."""
    per_segment = W.partitionBy(*SEGMENT).orderBy(F.col("similarity").desc(), "cand_id")
    return (
        hits.withColumn("cand_id", track_of_segment(F.col("cand_id")))
        .groupBy(*SEGMENT, "scale_weight", "cand_id")
        .agg(F.max("similarity").alias("similarity"))
        .withColumn("rank", F.row_number().over(per_segment))
    )


def _beside(rows: DataFrame, per_query: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    """Put what is known of each query beside its rows, which may be a large part of the table."""
    return join_hot(rows, per_query, ["query_id"], F.col(spread_by), how)


def top_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each segment."""
    return hits.where(F.col("rank") == 1).select(
        *SEGMENT, F.col("cand_id").alias("top_id"), F.col("similarity").alias("top_similarity")
    )


def segment_counts(hits: DataFrame) -> DataFrame:
    """Segments with at least one hit for each query."""
    return hits.where(F.col("rank") == 1).groupBy("query_id").agg(F.count(F.lit(1)).alias("num_segments"))


# ---------------------------------------------------------------- Q1 - Q4


def _pass_threshold(tops: DataFrame, threshold: float | DataFrame, min_keep: float) -> DataFrame:
    if isinstance(threshold, DataFrame):
        tops = _beside(tops, threshold.select("query_id", "threshold"), "segment_idx")
    else:
        tops = tops.withColumn("threshold", F.lit(float(threshold)))
    passes = F.col("top_similarity") >= F.col("threshold")
    fate = (
        tops.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(passes).alias("_kept"))
        .select("query_id", (F.col("_kept") < F.col("_n") * min_keep).alias("_keep_all"))
    )
    return _beside(tops, fate, "segment_idx").where(passes | F.col("_keep_all")).drop("threshold", "_keep_all")


def _best_share(tops: DataFrame, ratio: float, floor: int) -> DataFrame:
    if ratio >= 1.0:
        return tops
    # Exact copies give long queries the same top similarity in very many segments.
    tie_bins = [F.col("scale"), F.expr(f"segment_idx div {SEGMENT_BLOCK}")]
    order = [F.col("scale"), F.col("segment_idx")]
    ranked = rank_within(tops, ["query_id"], "top_similarity", order, "_place", "_n", tie_bins)
    share = F.greatest(F.lit(floor), (F.col("_n") * F.lit(ratio)).cast("int"))
    keep = F.when(F.col("_n") > floor, share).otherwise(F.col("_n"))
    return ranked.where(F.col("_place") <= keep).drop("_place", "_n")


def _only(hits: DataFrame, tops: DataFrame) -> DataFrame:
    return hits.join(tops.select(*SEGMENT), SEGMENT, "left_semi")


def filter_segments(hits: DataFrame, threshold: float | DataFrame, min_keep: float = 0.3) -> DataFrame:
    """Keep segments whose top similarity reaches the threshold.

    A query that would keep less than `min_keep` of its segments keeps them all. `threshold` is a
    number, or a table `(query_id, threshold)`.
    """
    return _only(hits, _pass_threshold(top_hits(hits), threshold, min_keep))


def adaptive_threshold(
    hits: DataFrame, base: float = 0.2, sensitivity: float = 0.1, threshold: float | None = None
) -> DataFrame:
    """Threshold of each query from its mean top similarity, between 0.1 and 0.4."""
    adapted = F.greatest(
        F.lit(0.1), F.least(F.lit(0.4), F.lit(base) - (F.col("mean_top_similarity") - 0.5) * sensitivity)
    )
    if threshold is not None:
        adapted = F.greatest(F.lit(threshold - 0.02), adapted)
    means = top_hits(hits).groupBy("query_id").agg(F.avg("top_similarity").alias("mean_top_similarity"))
    return means.withColumn("threshold", adapted)


def keep_best_segments(hits: DataFrame, ratio: float, floor: int = 5) -> DataFrame:
    """Keep the best `ratio` of the segments of each query by top similarity, at least `floor`."""
    return _only(hits, _best_share(top_hits(hits), ratio, floor))


def select_segments(
    hits: DataFrame, threshold: float | DataFrame, min_keep: float = 0.3, ratio: float = 0.6, floor: int = 5
) -> DataFrame:
    """`filter_segments`, then `keep_best_segments`, with one join to the hits."""
    return _only(hits, _best_share(_pass_threshold(top_hits(hits), threshold, min_keep), ratio, floor))


def temporal_runs(hits: DataFrame, block: int = SEGMENT_BLOCK) -> DataFrame:
    """How steadily a candidate leads: longest and total runs of equal top hits over segment order."""
    found = runs(top_hits(hits), ["query_id"], ["scale", "segment_idx"], "top_id", block)
    lengths = found.groupBy("query_id", F.col("top_id").alias("cand_id")).agg(
        F.max("length").alias("longest_run"), F.sum("length").alias("total_run")
    )
    return _beside(lengths, segment_counts(hits), "cand_id").select(
        *CANDIDATE,
        "longest_run",
        "total_run",
        (F.col("longest_run") / F.col("num_segments") * 0.5 + F.col("total_run") / F.col("num_segments") * 0.5).alias(
            "temporal_score"
        ),
    )


# ---------------------------------------------------------------- Q5, Q6


def aggregate_candidates(hits: DataFrame) -> DataFrame:
    """Votes and similarity statistics of each candidate of each query.

    Similarities are multiplied by the weight of their scale, which suits scores. `own_similarity` is
    the best one as searched, without weights; limits on similarity are compared with it.
    """
    s = F.col("similarity") * F.col("scale_weight")
    w = s * s * F.col("scale_weight")
    votes = hits.groupBy(*CANDIDATE).agg(
        F.count(F.lit(1)).alias("match_count"),
        F.count_if(F.col("rank") == 1).alias("rank_1_count"),
        F.count_if(F.col("rank") <= 5).alias("rank_5_count"),
        F.sum(w).alias("_w"),
        F.sum(s * w).alias("_sw"),
        F.avg(s).alias("avg_similarity"),
        F.max(s).alias("max_similarity"),
        F.min(s).alias("_min"),
        F.avg(F.log(F.when(s > 0, s))).alias("_log"),
        F.avg("rank").alias("avg_rank"),
        F.min("rank").alias("min_rank"),
        F.max("similarity").alias("own_similarity"),
    )
    weighted = F.when(F.col("_w") > 0, F.col("_sw") / F.col("_w")).otherwise(F.col("avg_similarity"))
    return _beside(votes, segment_counts(hits), "cand_id").select(
        *CANDIDATE,
        "num_segments",
        "match_count",
        "rank_1_count",
        "rank_5_count",
        weighted.alias("weighted_similarity"),
        F.when(F.col("_min") > 0, F.exp("_log")).alias("geometric_similarity"),
        "avg_similarity",
        "max_similarity",
        "avg_rank",
        "min_rank",
        "own_similarity",
        (F.col("match_count") / F.col("num_segments")).alias("match_ratio"),
    )


def combined_score(votes: DataFrame, temporal: DataFrame, weights: ScoreWeights = ScoreWeights()) -> DataFrame:
    """Score and rank the candidates of each query."""
    share = weights.normalised()
    # Mixture and exponents.
    enhanced = F.coalesce(
        0.7 * F.col("weighted_similarity") + 0.3 * F.col("geometric_similarity"), F.col("weighted_similarity")
    )
    r1 = F.col("rank_1_count") / F.col("num_segments")
    r5 = F.col("rank_5_count") / F.col("num_segments")
    score = (
        share["similarity"] * enhanced
        + share["rank_1"] * F.pow(r1, F.lit(1.5))
        + share["rank_5"] * r5
        + share["match_ratio"] * F.col("match_ratio")
        + share["temporal"] * F.pow("temporal_score", F.lit(1.2))
    )
    scored = (
        votes.join(temporal.select(*CANDIDATE, "temporal_score"), CANDIDATE, "left")
        .withColumn("temporal_score", F.coalesce("temporal_score", F.lit(0.0)))
        .withColumn("mean_similarity", F.greatest("weighted_similarity", "max_similarity"))
        .withColumn("combined_score", score)
    )
    return rank_within(
        scored, ["query_id"], "combined_score", [F.col("mean_similarity").desc(), F.col("cand_id")]
    )


# ---------------------------------------------------------------- Q7 - Q12


def second_stage_rerank(candidates: DataFrame, hits: DataFrame, top_n: int = 5) -> DataFrame:
    """Reorder the first `top_n` candidates by how consistent their segment hits are."""
    top = candidates.where(F.col("rank") <= top_n)
    spread = F.stddev_pop("similarity")
    seen = (
        hits.join(top.select(*CANDIDATE), CANDIDATE, "left_semi")
        .groupBy(*CANDIDATE)
        .agg(
            F.avg("similarity").alias("_avg"),
            spread.alias("_std"),
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("rank") == 1).alias("_r1"),
            (F.min("scale") != F.max("scale")).alias("_many_scales"),
        )
    )
    scale_consistency = F.when(~F.col("_many_scales"), 1.0).when(
        F.col("_avg") > 0, 1.0 - F.col("_std") / F.col("_avg")
    ).otherwise(0.0)
    # Shares of the signals.
    rerank = (
        0.35 * F.col("_avg")
        + 0.25 * F.col("consistency_score")
        + 0.20 * F.col("_r1") / F.col("_n")
        + 0.10 * F.col("_n") / F.col("num_segments")
        + 0.10 * F.col("scale_consistency")
    )
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "cand_id")
    reordered = (
        top.join(seen, CANDIDATE)
        .withColumn("consistency_score", 1.0 / (1.0 + F.col("_std")))
        .withColumn("scale_consistency", scale_consistency)
        .withColumn("rerank_score", rerank)
        .withColumn("rank", F.row_number().over(order))
        .drop("_avg", "_std", "_n", "_r1", "_many_scales")
    )
    nothing = {n: F.lit(None).cast("double") for n in ("consistency_score", "scale_consistency", "rerank_score")}
    return reordered.unionByName(candidates.where(F.col("rank") > top_n).withColumns(nothing))


def quality_score(candidates: DataFrame, min_quality: float = 0.0) -> DataFrame:
    """Quality of each candidate and whether it reaches `min_quality`."""
    # Shares of the signals.
    quality = (
        0.30 * F.col("rank_1_count") / F.col("num_segments")
        + 0.25 * F.col("match_count") / F.col("num_segments")
        + 0.25 * F.col("temporal_score")
        + 0.20 * F.least("combined_score", F.lit(1.0))
    )
    return candidates.withColumn("quality_score", quality).withColumn(
        "validated", F.col("quality_score") >= min_quality
    )


def confidence(candidates: DataFrame) -> DataFrame:
    """Confidence from the gap between the two leaders, votes, runs, coverage and quality."""
    lead = candidates.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("combined_score"))).alias("_top"),
        F.max(F.when(F.col("rank") == 2, F.col("combined_score"))).alias("_second"),
        F.count(F.lit(1)).alias("_n"),
    )
    gap = F.when(F.col("_top") > 0, (F.col("_top") - F.col("_second")) / F.col("_top")).otherwise(0.0)
    quality = F.coalesce(F.col("quality_score"), F.lit(0.0)) if "quality_score" in candidates.columns else F.lit(0.0)
    # Shares of the signals.
    base = (
        0.25 * F.least(gap * 2, F.lit(1.0))
        + 0.25 * F.col("rank_1_count") / F.col("num_segments")
        + 0.20 * F.col("temporal_score")
        + 0.15 * F.least(F.col("match_count") / F.col("num_segments") * 2, F.lit(1.0))
        + 0.15 * quality
    )
    if "rerank_score" in candidates.columns:
        base = F.coalesce(F.least(F.lit(1.0), base + F.col("rerank_score") * 0.1), base)
    return (
        _beside(candidates, lead, "cand_id")
        .withColumn("confidence", F.when(F.col("_n") > 1, base).otherwise(0.5))
        .drop("_top", "_second", "_n")
    )


def confidence_rerank(candidates: DataFrame) -> DataFrame:
    """Rank by confidence times score, then score."""
    weighted = candidates.drop("rank").withColumn("_weighted", F.col("confidence") * F.col("combined_score"))
    order = [F.col("combined_score").desc(), F.col("cand_id")]
    return rank_within(weighted, ["query_id"], "_weighted", order).drop("_weighted")


def min_confidence_filter(candidates: DataFrame, threshold: float) -> DataFrame:
    """Drop candidates below the threshold, unless a query would lose all of them."""
    if threshold <= 0:
        return candidates
    best = candidates.groupBy("query_id").agg(F.max("confidence").alias("_best"))
    keep = (F.col("confidence") >= threshold) | (F.col("_best") < threshold)
    return _beside(candidates, best, "cand_id").where(keep).drop("_best")


def unweighted(candidates: DataFrame) -> Column:
    """The similarity to compare with limits: without scale weights where candidates have it."""
    return F.col("own_similarity" if "own_similarity" in candidates.columns else "mean_similarity")


def similarity_gate(candidates: DataFrame, severities: DataFrame) -> DataFrame:
    """Keep candidates whose similarity suits the severity of the query; unknown counts as mild."""
    # Least similarity by severity.
    limit = F.when(F.col("severity") == "severe", 0.85).when(F.col("severity") == "moderate", 0.90).otherwise(0.95)
    return _beside(candidates, severities.select("query_id", "severity"), "cand_id", "left").where(
        unweighted(candidates) >= limit
    )


def fuse(hits: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """The whole chain from hits to ranked candidates with scores and confidences."""
    kept = cut_lineage(select_segments(hits, config.threshold, config.min_keep, config.keep_ratio, config.keep_floor))
    scored = combined_score(aggregate_candidates(kept), temporal_runs(kept), config.weights)
    if config.rerank_top:
        scored = cut_lineage(second_stage_rerank(scored, kept, config.rerank_top))
    judged = confidence(quality_score(scored, config.min_quality))
    return min_confidence_filter(confidence_rerank(judged), config.min_confidence)


# ---------------------------------------------------------------- Q13, Q14


def reciprocal_rank_fusion(hits: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Sum of similarity times scale weight over rank, after a threshold inside each segment."""
    segment = W.partitionBy(*SEGMENT)
    order = segment.orderBy("rank")
    passes = F.col("similarity") >= threshold
    kept = (
        hits.withColumn("_any", F.max(passes).over(segment))
        .where(passes | (~F.col("_any") & (F.col("rank") == 1)))
        .withColumn("rank", F.row_number().over(order))
    )
    fused = kept.groupBy(*CANDIDATE).agg(
        F.sum(F.col("similarity") * F.col("scale_weight") / F.col("rank")).alias("score"),
        F.greatest(F.lit(0.0), F.max("similarity")).alias("similarity"),
        F.min("rank").alias("min_rank"),
        F.count(F.lit(1)).alias("segment_count"),
        F.count_if(F.col("rank") <= 5).alias("rank_5_count"),
        F.count_if(F.col("rank") <= 10).alias("rank_10_count"),
    )
    return rank_within(fused, ["query_id"], "score", [F.col("cand_id")])


def adjacent_boost(candidates: DataFrame, hits: DataFrame, weight: float = 0.15, depth: int = 10) -> DataFrame:
    """Raise the score by `1 + weight` for each pair of neighbouring segments that both list the candidate."""
    seen = hits.where(F.col("rank") <= depth).select(*SEGMENT, "cand_id")
    shifted = seen.withColumn("segment_idx", F.col("segment_idx") + 1)
    pairs = (
        seen.join(shifted, [*SEGMENT, "cand_id"], "left_semi")
        .groupBy(*CANDIDATE)
        .agg(F.count(F.lit(1)).alias("adjacent_pairs"))
    )
    boosted = (
        candidates.drop("rank")
        .join(pairs, CANDIDATE, "left")
        .withColumn("adjacent_pairs", F.coalesce("adjacent_pairs", F.lit(0)))
        .withColumn("score", F.col("score") * F.pow(F.lit(1.0 + weight), F.col("adjacent_pairs")))
    )
    return rank_within(boosted, ["query_id"], "score", [F.col("cand_id")])


# ---------------------------------------------------------------- Q15 - Q19


def run_boost(hits: DataFrame, step: float = 0.05, block: int = SEGMENT_BLOCK) -> DataFrame:
    """Raise similarity by `step` for each further segment in the candidate's longest unbroken run."""
    keys = ["query_id", "scale", "cand_id"]
    marked = hits.select(*keys, "segment_idx", F.lit(0).alias("_same"))
    found = runs(marked, keys, ["segment_idx"], "_same", block, gaps_end_runs=True)
    longest = found.groupBy(*keys).agg(F.max("length").alias("longest_run"))
    boosted = F.least(F.lit(1.0), F.col("similarity") * (1.0 + (F.col("longest_run") - 1) * step))
    return hits.join(longest, keys).withColumn(
        "similarity", F.when(F.col("longest_run") >= 2, boosted).otherwise(F.col("similarity"))
    )


def band_reweight(hits: DataFrame, ratios: DataFrame) -> DataFrame:
    """Raise similarity when the query is mostly low or bass frequencies, capped at 1.

    `ratios(query_id, low_ratio, bass_ratio)`.
    """
    low = F.when(F.col("low_ratio") > 0.6, 1.05).otherwise(1.0)
    bass = F.when(F.col("bass_ratio") > 0.4, 1.0 + 0.1 * F.col("bass_ratio")).otherwise(1.0)
    after_low = F.when(F.col("low_ratio") > 0.6, F.least(F.lit(1.0), F.col("similarity") * low)).otherwise(F.col("similarity"))
    after_bass = F.when(F.col("bass_ratio") > 0.4, F.least(F.lit(1.0), after_low * bass)).otherwise(after_low)
    return (
        _beside(hits, ratios.select("query_id", "low_ratio", "bass_ratio"), "cand_id", "left")
        .withColumn("similarity", after_bass)
        .drop("low_ratio", "bass_ratio")
    )


def ensemble_variants(candidates: DataFrame, k: int) -> DataFrame:
    """Merge the candidate lists of several variants of one query; variant `original` counts most.

    `candidates(query_id, variant, cand_id, combined_score, confidence, rank_1_count, temporal_score)`.
    """
    # Weight of the unchanged query and of its variants.
    weight = F.when(F.col("variant") == "original", 1.0).otherwise(0.7)
    merged = candidates.groupBy(*CANDIDATE).agg(
        F.avg(F.col("combined_score") * weight).alias("combined_score"),
        F.avg(F.col("confidence") * weight).alias("confidence"),
        F.sum("rank_1_count").alias("rank_1_count"),
        F.avg("temporal_score").alias("temporal_score"),
        F.count(F.lit(1)).alias("variant_count"),
        F.array_sort(F.collect_set("variant")).alias("variants"),
    )
    order = W.partitionBy("query_id").orderBy(F.col("combined_score").desc(), "cand_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_scales(parts: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    """Stack the hits of several scales with weights that sum to 1; other lengths mean equal weights."""
    if len(parts) != len(weights):
        weights = [1.0] * len(parts)
    total = float(sum(weights))
    shares = [w / total if total > 0 else w for w in weights]
    labelled = [p.withColumn("scale_weight", F.lit(share)) for p, share in zip(parts, shares)]
    return reduce(DataFrame.unionByName, labelled)


def scale_decision(hits: DataFrame, variants: DataFrame, initial_k: int | Column = 20) -> DataFrame:
    """Which queries deserve more scales and a deeper search.

    The trigger is how many segments agree with the most frequent top hit.
    `variants(query_id, transform_type, severity)` may hold NULLs; `initial_k` is a number or one of its columns.
    """
    first = F.lit(initial_k) if isinstance(initial_k, int) else initial_k
    agree = top_hits(hits).groupBy("query_id", "top_id").agg(F.count(F.lit(1)).alias("_votes"))
    share = agree.groupBy("query_id").agg((F.max("_votes") / F.sum("_votes")).alias("agreement"))
    severity = F.coalesce(F.col("severity"), F.lit("mild"))
    kind = F.coalesce(F.lower("transform_type"), F.lit(""))
    # Least agreement by severity, caps of the deeper search, extra scales and weights.
    enough = F.when(severity == "severe", 0.75).when(severity == "moderate", 0.88).otherwise(0.0)
    deep = kind.contains("song_a_in_song_b") | kind.contains("embedded_sample")
    cap = (
        F.when(deep, 200)
        .when(kind.contains("low_pass_filter"), 100)
        .when(severity == "severe", 100)
        .when(severity == "moderate", 60)
        .otherwise(40)
    )
    more = F.col("agreement") < enough
    extra = F.from_json(
        F.lit('[{"scale":3000,"weight":0.3},{"scale":5000,"weight":0.4}]'), "array<struct<scale:int,weight:double>>"
    )
    # Both have a row for each query, too many to broadcast.
    return share.join(variants.hint("merge"), "query_id", "left").select(
        "query_id",
        "agreement",
        more.alias("needs_scales"),
        F.when(more, extra).alias("extra_scales"),
        F.when(more, F.least(first * 2, cap)).otherwise(first).alias("k"),
    )


def confident_match(hits: DataFrame, by_scale: bool = False) -> DataFrame:
    """Candidates that lead so clearly that no further search is needed; with `by_scale` in each scale alone."""
    if by_scale:
        alone = confident_match(hits.withColumn("query_id", F.struct("query_id", "scale")))
        return alone.select("query_id.query_id", "query_id.scale", *[c for c in alone.columns if c != "query_id"])
    led = top_hits(hits).groupBy("query_id", F.col("top_id").alias("cand_id")).agg(
        F.count(F.lit(1)).alias("rank_1_count"),
        F.max("top_similarity").alias("max_similarity"),
        F.avg("top_similarity").alias("mean_similarity"),
    )
    r1, best, mean = F.col("rank_1_ratio"), F.col("max_similarity"), F.col("mean_similarity")
    # Limits of a clear lead.
    clear = ((r1 >= 0.8) & (best >= 0.90)) | (best >= 0.95) | ((mean >= 0.92) & (r1 >= 0.7))
    return (
        _beside(led, segment_counts(hits), "cand_id")
        .withColumn("rank_1_ratio", F.col("rank_1_count") / F.col("num_segments"))
        .withColumn("confidence", F.least(F.lit(1.0), mean * r1))
        .withColumn("confident", clear & (F.col("confidence") >= 0.95))
        .select(*CANDIDATE, "rank_1_ratio", "max_similarity", "mean_similarity", "confidence", "confident")
    )


# ---------------------------------------------------------------- Q20 - Q23


def rollup_to_track(candidates: DataFrame) -> DataFrame:
    """Segment candidates to track candidates: best score and similarity, summed votes, ranked anew."""
    rolled = (
        candidates.withColumn("cand_id", track_of_segment(F.col("cand_id")))
        .groupBy(*CANDIDATE)
        .agg(
            F.max("combined_score").alias("combined_score"),
            F.max("mean_similarity").alias("mean_similarity"),
            F.max(unweighted(candidates)).alias("own_similarity"),
            F.sum("rank_1_count").alias("rank_1_count"),
            F.sum("match_count").alias("match_count"),
        )
    )
    return rank_within(rolled, ["query_id"], "combined_score", [F.col("mean_similarity").desc(), F.col("cand_id")])


def project_filter(candidates: DataFrame, counts: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Keep candidates whose project meets the criteria; tracks without a project pass.

    `counts(track_id, project_type, total_notes, midi_tracks, automation_tracks)`; criteria are
    `project_type`, `min_notes`, `min_tracks` and `has_automation`.
    """
    tests: list[Column] = []
    if "project_type" in criteria:
        tests.append(F.col("project_type") == criteria["project_type"])
    if "min_notes" in criteria:
        tests.append(F.coalesce("total_notes", F.lit(0)) >= criteria["min_notes"])
    if "min_tracks" in criteria:
        tests.append(F.coalesce("midi_tracks", F.lit(0)) >= criteria["min_tracks"])
    if criteria.get("has_automation"):
        tests.append(F.coalesce("automation_tracks", F.lit(0)) > 0)
    if not tests:
        return candidates
    meets = F.coalesce(reduce(Column.__and__, tests), F.lit(False))
    misses = counts.where(~meets).select(F.col("track_id").alias("_track")).distinct()
    return candidates.withColumn("_track", track_of_segment(F.col("cand_id"))).join(misses, "_track", "left_anti").drop("_track")


def top_match_summary(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each query; queries without any get NULL, 0 and rank -1.

    Other columns of `queries` are carried along. An `error` column is added when missing.
    """
    first = candidates.where(F.col("rank") == 1).select(
        "query_id",
        F.col("cand_id").alias("top_match_id"),
        unweighted(candidates).alias("top_match_similarity"),
        F.col("rank").alias("top_match_rank"),
    )
    out = queries.join(first, "query_id", "left").withColumns(
        {
            "top_match_similarity": F.coalesce("top_match_similarity", F.lit(0.0)),
            "top_match_rank": F.coalesce("top_match_rank", F.lit(-1)),
        }
    )
    return out if "error" in queries.columns else out.withColumn("error", F.lit(None).cast("string"))


def store_limit(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """The list stored for each query, best first: all its candidates, or the first `limit`."""
    kept = candidates if limit is None else candidates.where(F.col("rank") <= limit)
    entry = F.struct("rank", "cand_id", "mean_similarity", "combined_score")
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("top_candidates"))
