"""Evaluation: the only place where the right answer joins the candidates.

`truth(query_id, track_id, transform_type, severity)` names every query, also those that failed or
found nothing. `candidates(query_id, cand_id, rank, ...)` may be at segment or track grain; ranks
are counted over distinct tracks. `summary` has one row for each query with `top_match_id`,
`top_match_rank`, `top_match_similarity` and `latency_ms`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earmark.functions.columns import track_of_segment
from earmark.operators.distribution import exact_quantiles, join_one_row, rank_within
from earmark.session import cut_lineage

# Pass limits by severity, and the overall latency limits.
RECALL_LIMITS = {
    "mild": {"recall_at_1": 0.90, "recall_at_5": 0.95, "recall_at_10": 0.98},
    "moderate": {"recall_at_1": 0.75, "recall_at_5": 0.85, "recall_at_10": 0.90},
    "severe": {"recall_at_1": 0.50, "recall_at_5": 0.70, "recall_at_10": 0.80},
}
SIMILARITY_LIMITS = {"mild": 0.85, "moderate": 0.70, "severe": 0.50}
LATENCY_LIMITS = {"mean_latency_ms": 1000.0, "p95_latency_ms": 2000.0}
SEVERITIES = ("mild", "moderate", "severe")


# ---------------------------------------------------------------- E1 - E4


def track_ranks(candidates: DataFrame) -> DataFrame:
    """Candidates at track grain: each track once, at the place of its best candidate."""
    best = (
        candidates.withColumn("cand_id", track_of_segment(F.col("cand_id")))
        .groupBy("query_id", "cand_id")
        .agg(F.min("rank").alias("_rank"))
        .withColumn("_order", -F.col("_rank").cast("double"))
    )
    return rank_within(best, ["query_id"], "_order", [F.col("cand_id")]).select("query_id", "cand_id", "rank")


def true_ranks(candidates: DataFrame, truth: DataFrame, grain: str = "track") -> DataFrame:
    """`truth` with the rank of the right track, NULL when it was not found."""
    ranked = track_ranks(candidates) if grain == "segment" else candidates
    found = ranked.select("query_id", F.col("cand_id").alias("track_id"), F.col("rank").alias("true_rank"))
    return truth.join(found, ["query_id", "track_id"], "left")


def _recall(k: int) -> Column:
    return F.avg(F.coalesce((F.col("true_rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}")


def recall_at_k(
    candidates: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 5, 10, 20), group: Sequence[str] = (), grain: str = "track"
) -> DataFrame:
    """Share of all queries whose right track is among the first `k` tracks."""
    ranks = true_ranks(candidates, truth, grain)
    return ranks.groupBy(*group).agg(F.count(F.lit(1)).alias("queries"), *[_recall(k) for k in ks])


def _correct(summary: DataFrame, truth: DataFrame) -> DataFrame:
    own = [c for c in summary.columns if c == "query_id" or c not in truth.columns]
    right = track_of_segment(F.col("top_match_id")) == F.col("track_id")
    return truth.join(summary.select(*own), "query_id", "left").withColumn("correct", F.coalesce(right, F.lit(False)))


def _with_quantiles(stats: DataFrame, source: DataFrame, group: Sequence[str], value: str, names: Mapping[str, float]) -> DataFrame:
    quantiles = exact_quantiles(source, group, value, names)
    if not group:
        return join_one_row(stats, quantiles)
    return stats.join(quantiles, list(group), "left")


def rank_distribution(candidates: DataFrame, summary: DataFrame, truth: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Ranks of correct top matches, and of the right track wherever it was found."""
    rows = cut_lineage(
        _correct(summary, truth)
        .join(true_ranks(candidates, truth).select("query_id", "true_rank"), "query_id")
        .withColumn("top_rank", F.when(F.col("correct"), F.col("top_match_rank")))
    )
    stats = rows.groupBy(*group).agg(
        F.avg("top_rank").alias("mean_rank"),
        F.stddev_samp("top_rank").alias("std_rank"),
        F.min("top_rank").alias("min_rank"),
        F.max("top_rank").alias("max_rank"),
        F.count_if("correct").alias("num_correct"),
        F.count(F.lit(1)).alias("num_total"),
        F.avg(F.col("correct").cast("double")).alias("correct_rate"),
        F.count("true_rank").alias("num_found"),
        F.avg("true_rank").alias("mean_true_rank"),
        F.max("true_rank").alias("max_true_rank"),
    )
    stats = _with_quantiles(stats, rows, group, "top_rank", {"median_rank": 0.5, "p95_rank": 0.95})
    return _with_quantiles(stats, rows, group, "true_rank", {"median_true_rank": 0.5, "p95_true_rank": 0.95})


def rank_histogram(candidates: DataFrame, truth: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Queries by the rank of the right track; NULL counts the ones without it."""
    return true_ranks(candidates, truth).groupBy(*group, "true_rank").agg(F.count(F.lit(1)).alias("queries"))


def similarity_stats(summary: DataFrame, truth: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Similarity of correct top matches, and the mean over all queries."""
    rows = _correct(summary, truth).withColumn("_sim", F.when(F.col("correct"), F.col("top_match_similarity")))
    stats = rows.groupBy(*group).agg(
        F.avg("_sim").alias("mean_similarity_correct"),
        F.stddev_samp("_sim").alias("std_similarity_correct"),
        F.min("_sim").alias("min_similarity_correct"),
        F.max("_sim").alias("max_similarity_correct"),
        F.avg("top_match_similarity").alias("mean_similarity_all"),
    )
    return _with_quantiles(stats, rows, group, "_sim", {"median_similarity_correct": 0.5})


def latency_stats(summary: DataFrame, group: Sequence[str] = (), value: str = "latency_ms") -> DataFrame:
    """Mean, median, sample deviation, extremes and 95th percentile of a latency column."""
    stats = summary.groupBy(*group).agg(
        F.avg(value).alias("mean_latency_ms"),
        F.stddev_samp(value).alias("std_latency_ms"),
        F.min(value).alias("min_latency_ms"),
        F.max(value).alias("max_latency_ms"),
    )
    return _with_quantiles(stats, summary, group, value, {"median_latency_ms": 0.5, "p95_latency_ms": 0.95})


# ---------------------------------------------------------------- E5 - E8


def metrics_by_group(
    candidates: DataFrame, summary: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 5, 10, 20), grain: str = "track"
) -> DataFrame:
    """All metrics overall, for each transform and for each severity: `(level, name, count, ...)`.

    Every query counts once in each level. All quantiles come from one pass over the values, which
    are stacked with the name of their metric.
    """
    levels = F.array(
        F.struct(F.lit("overall").alias("level"), F.lit("all").alias("name")),
        F.struct(F.lit("transform").alias("level"), F.col("transform_type").alias("name")),
        F.struct(F.lit("severity").alias("level"), F.col("severity").alias("name")),
    )
    rows = cut_lineage(
        _correct(summary, truth)
        .join(true_ranks(candidates, truth, grain).select("query_id", "true_rank"), "query_id")
        .select(
            "transform_type",
            "severity",
            "true_rank",
            "correct",
            F.when(F.col("correct"), F.col("top_match_rank")).alias("rank"),
            F.when(F.col("correct"), F.col("top_match_similarity")).alias("similarity"),
            "top_match_similarity",
            "latency_ms",
        )
    )
    by = ["level", "name"]
    spread = rows.withColumn("_l", F.explode(levels)).select("_l.*", *rows.columns)
    stats = spread.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        *[_recall(k) for k in ks],
        F.count_if("correct").alias("num_correct"),
        F.avg("rank").alias("mean_rank"),
        F.avg("true_rank").alias("mean_true_rank"),
        F.avg("similarity").alias("mean_similarity_correct"),
        F.stddev_samp("similarity").alias("std_similarity_correct"),
        F.min("similarity").alias("min_similarity_correct"),
        F.max("similarity").alias("max_similarity_correct"),
        F.avg("top_match_similarity").alias("mean_similarity_all"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.stddev_samp("latency_ms").alias("std_latency_ms"),
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    stacked = spread.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                    for n in ("rank", "true_rank", "similarity", "latency_ms")
                ]
            )
        ).alias("_m"),
    ).select(*by, "_m.*")
    quantiles = exact_quantiles(stacked, [*by, "metric"], "value", {"median": 0.5, "p95": 0.95})
    pick = lambda metric, q: F.max(F.when(F.col("metric") == metric, F.col(q)))
    wide = quantiles.groupBy(*by).agg(
        pick("rank", "median").alias("median_rank"),
        pick("rank", "p95").alias("p95_rank"),
        pick("true_rank", "median").alias("median_true_rank"),
        pick("similarity", "median").alias("median_similarity_correct"),
        pick("latency_ms", "median").alias("median_latency_ms"),
        pick("latency_ms", "p95").alias("p95_latency_ms"),
    )
    return stats.join(wide, by, "left")


def _limits(
    recall: Mapping[str, Mapping[str, float]], similarity: Mapping[str, float], latency: Mapping[str, float]
) -> list[tuple[str, str, str, float]]:
    rows = []
    for severity, limits in recall.items():
        rows += [("severity", severity, metric, float(limit)) for metric, limit in limits.items()]
        rows.append(("severity", severity, "mean_similarity_correct", float(similarity.get(severity, 0.0))))
    return rows + [("overall", "all", metric, float(limit)) for metric, limit in latency.items()]


def pass_fail(
    metrics: DataFrame,
    recall: Mapping[str, Mapping[str, float]] = RECALL_LIMITS,
    similarity: Mapping[str, float] = SIMILARITY_LIMITS,
    latency: Mapping[str, float] = LATENCY_LIMITS,
) -> DataFrame:
    """One row for each check of `metrics_by_group` against its limit; latency must stay below."""
    rows = _limits(recall, similarity, latency)
    limits = metrics.sparkSession.createDataFrame(rows, "level string, name string, metric string, threshold double")
    checked = sorted({r[2] for r in rows})
    stacked = metrics.select(
        "level",
        "name",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual")) for m in checked])).alias("_m"),
    ).select("level", "name", "_m.*")
    actual = F.coalesce("actual", F.lit(0.0))
    passed = F.when(F.col("metric").contains("latency"), actual <= F.col("threshold")).otherwise(actual >= F.col("threshold"))
    return stacked.join(F.broadcast(limits), ["level", "name", "metric"]).select(
        "level", "name", "metric", "threshold", actual.alias("actual"), passed.alias("passed")
    )


def overall_status(checks: DataFrame) -> DataFrame:
    """Share of passed checks and the verdict: PASS from 80 %, WARNING from 50 %, else FAIL."""
    rate = F.when(F.col("total_checks") > 0, F.col("passed_checks") / F.col("total_checks") * 100).otherwise(0.0)
    return (
        checks.agg(F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed_checks"))
        .withColumn("pass_rate", rate)
        .withColumn("status", F.when(rate >= 80, "PASS").when(rate >= 50, "WARNING").otherwise("FAIL"))
    )


def suite_summary(metrics: DataFrame) -> DataFrame:
    """The summary table: one row for each severity."""
    return metrics.where(F.col("level") == "severity").select(
        F.col("name").alias("severity"),
        "count",
        "recall_at_1",
        "recall_at_5",
        "recall_at_10",
        "mean_rank",
        F.col("mean_similarity_correct").alias("mean_similarity"),
        "mean_latency_ms",
    )


# ---------------------------------------------------------------- E9 - E11


def failures(summary: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries whose best track is not the right one, with the reason."""
    reason = (
        F.when(F.col("top_match_rank").isNull() | (F.col("top_match_rank") == -1), F.lit("No matches found"))
        .when(
            F.col("top_match_similarity") < 0.5,
            F.format_string("Low similarity: %.3f", F.col("top_match_similarity")),
        )
        .otherwise(F.concat(F.lit("Wrong match: "), "top_match_id", F.lit(" (expected "), "track_id", F.lit(")")))
    )
    return _correct(summary, truth).where(~F.col("correct")).select(
        "query_id", "track_id", "transform_type", "severity", "top_match_id", "top_match_similarity", "top_match_rank",
        reason.alias("reason"),
    )


def capture_failures(failed: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` failures of each transform by query id."""
    order = W.partitionBy("transform_type").orderBy("query_id")
    return failed.withColumn("failure_no", F.row_number().over(order)).where(F.col("failure_no") <= n)


def failure_details(failed: DataFrame, candidates: DataFrame, projects: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Failures with their first candidates, the expected id and project metadata as one nested record."""
    entry = F.struct("rank", "cand_id", F.col("mean_similarity").alias("similarity"))
    lists = (
        candidates.where(F.col("rank") <= top)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("top_matches"))
    )
    out = failed.join(lists, "query_id", "left").withColumn("expected_id", F.col("track_id"))
    if projects is not None:
        record = F.struct(*[c for c in projects.columns if c != "track_id"]).alias("project")
        out = out.join(projects.select("track_id", record), "track_id", "left")
    return out


# ---------------------------------------------------------------- E12, E13

PHASE_METRICS = ("total_queries", "recall_at_1", "recall_at_5", "recall_at_10", "mean_rank", "mean_similarity")


def phase_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Overall metrics of two phases and their differences, one row for each metric.

    Both inputs have one row with the columns of `PHASE_METRICS`; missing values count as 0.
    """
    def long(df: DataFrame, phase: str) -> DataFrame:
        values = F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"))
                for m in PHASE_METRICS
            ]
        )
        return df.select(F.lit(phase).alias("phase"), F.explode(values).alias("_m")).select("phase", "_m.*")

    both = long(first, "phase1").unionByName(long(second, "phase2"))
    value = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("value")))
    return both.groupBy("metric").agg(value("phase1").alias("phase1"), value("phase2").alias("phase2")).withColumn(
        "difference", F.col("phase2") - F.col("phase1")
    )


def phase_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both suite summaries with a phase label."""
    return first.withColumn("phase", F.lit("phase1")).unionByName(second.withColumn("phase", F.lit("phase2")))


# ---------------------------------------------------------------- E14 - E19


def bottlenecks(summary: DataFrame, value: str = "latency_ms") -> tuple[DataFrame, DataFrame]:
    """Latency statistics with population deviation, and the rows slower than the 95th percentile."""
    stats = _with_quantiles(
        summary.agg(
            F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
        ),
        summary,
        (),
        value,
        {"median": 0.5, "p95": 0.95, "p99": 0.99},
    )
    limit = stats.select(F.col("p95").alias("_p95"))
    slow = join_one_row(summary, limit).where(F.col(value) > F.col("_p95")).drop("_p95")
    return stats, slow


def segment_recall_estimate(hits: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """Share of a query's segments that list the right track in their first `k`, and whether more scales help."""
    segment = ["query_id", "scale", "segment_idx"]
    own = (
        hits.where(F.col("rank") <= k)
        .select(*segment, track_of_segment(F.col("cand_id")).alias("track_id"))
        .join(truth.select("query_id", "track_id"), ["query_id", "track_id"], "left_semi")
        .select(*segment).distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"))
    )
    total = hits.where(F.col("rank") == 1).groupBy("query_id").agg(F.count(F.lit(1)).alias("_all"))
    estimate = F.coalesce(F.col("_found") / F.col("_all"), F.lit(0.0))
    # Estimate below which more scales are searched; mild needs 95 % of its 0.90.
    limit = F.when(F.col("severity") == "severe", 0.75).when(F.col("severity") == "moderate", 0.88).otherwise(0.90 * 0.95)
    return truth.join(total, "query_id", "left").join(own, "query_id", "left").select(
        "query_id", "severity", estimate.alias("estimated_recall"), (estimate < limit).alias("needs_scales")
    )


def per_query_recall(candidates: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """0 or 1 for each `k`, and the mean similarity of the candidates that belong to the right track."""
    own = (
        candidates.select("query_id", track_of_segment(F.col("cand_id")).alias("track_id"), "rank", "mean_similarity")
        .groupBy("query_id", "track_id")
        .agg(F.min("rank").alias("_rank"), F.avg("mean_similarity").alias("mean_similarity"))
    )
    hit = lambda k: F.coalesce((F.col("_rank") <= k).cast("double"), F.lit(0.0)).alias(f"recall_at_{k}")
    return truth.join(own, ["query_id", "track_id"], "left").select(
        "query_id", "track_id", *[hit(k) for k in ks], F.coalesce("mean_similarity", F.lit(0.0)).alias("mean_similarity")
    )


def threshold_grid_search(summary: DataFrame, truth: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Recall@1 of the queries whose top similarity reaches each threshold; `best` marks the first maximum.

    Each query is put into the step of the grid it reaches, so a row is counted once and the totals
    of a threshold are sums over the steps above it.
    """
    steps = sorted({float(t) for t in grid})
    rows = _correct(summary, truth)
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("top_match_similarity")))
    counted = rows.groupBy(reached.alias("_step")).agg(F.count(F.lit(1)).alias("_n"), F.count_if("correct").alias("_c"))
    points = rows.sparkSession.createDataFrame(
        [(i + 1, t, 0, 0) for i, t in enumerate(steps)], "_step int, threshold double, _n bigint, _c bigint"
    )
    # At most one row for each step of the grid from here on.
    sums = points.select("_step", "threshold", "_n", "_c").unionByName(
        counted.select("_step", F.lit(None).cast("double").alias("threshold"), "_n", "_c")
    ).groupBy("_step").agg(F.max("threshold").alias("threshold"), F.sum("_n").alias("_n"), F.sum("_c").alias("_c"))
    above = W.orderBy(F.col("_step").desc())
    totals = sums.select(
        "threshold", F.sum("_n").over(above).alias("queries"), F.sum("_c").over(above).alias("correct")
    ).where(F.col("threshold").isNotNull())
    recall = F.when(F.col("queries") > 0, F.col("correct") / F.col("queries")).otherwise(0.0)
    best = W.orderBy(F.col("recall_at_1").desc(), "threshold")
    return totals.withColumn("recall_at_1", recall).withColumn("best", F.row_number().over(best) == 1)


def phase_of_config(name: Column) -> Column:
    """Phase named in a configuration path."""
    low = F.lower(name)
    return (
        F.when(low.rlike("phase_?1"), F.lit("phase1")).when(low.rlike("phase_?2"), F.lit("phase2")).otherwise(F.lit("unknown"))
    )


def run_summary(summary: DataFrame, variants: DataFrame, config_name: str) -> DataFrame:
    """Totals of a run, its transform types and severities, and its phase."""
    kinds = summary.groupBy("transform_type", "severity").agg(F.count(F.lit(1)).alias("_n"))
    totals = kinds.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_queries"),
        F.array_sort(F.collect_set("transform_type")).alias("transform_types"),
        F.array_sort(F.collect_set("severity")).alias("severities"),
    )
    planned = variants.agg(F.count(F.lit(1)).alias("total_transforms"))
    return join_one_row(totals, planned).withColumn("phase", phase_of_config(F.lit(config_name)))


def sla_flags(summary: DataFrame, target_ms: float = 600.0, warning_ms: float = 650.0) -> DataFrame:
    """Mark each query as within the latency target and beyond the warning level."""
    return summary.withColumn("within_target", F.col("latency_ms") <= target_ms).withColumn(
        "exceeds_warning", F.col("latency_ms") > warning_ms
    )


def sla_shares(flags: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of queries within the target and beyond the warning level."""
    return flags.groupBy(*group).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.col("within_target").cast("double")).alias("within_target"),
        F.avg(F.col("exceeds_warning").cast("double")).alias("exceeds_warning"),
    )


# ---------------------------------------------------------------- E20, E21


def scenario_metrics(verdicts: DataFrame) -> DataFrame:
    """Totals over `verdicts(matched, similarity, rank)`; medians are the upper ones, never interpolated."""
    stats = verdicts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("matched").alias("passed"),
        F.count_if(~F.col("matched")).alias("failed"),
        F.avg(F.col("matched").cast("double")).alias("recall"),
        F.coalesce(F.avg("rank"), F.lit(1.0)).alias("mean_rank"),
        F.avg("similarity").alias("mean_similarity"),
        F.count("rank").alias("_ranks"),
    )
    upper = lambda value, out: exact_quantiles(verdicts, (), value, {out: 0.5}, interpolate=False)
    return (
        join_one_row(join_one_row(stats, upper("rank", "median_rank")), upper("similarity", "median_similarity"))
        .withColumn("median_rank", F.coalesce("median_rank", F.lit(1.0)))
        .drop("_ranks")
    )


def report_series(metrics: DataFrame, similarity: Mapping[str, float] = SIMILARITY_LIMITS) -> DataFrame:
    """Data of the four report plots in long form: `(plot, series, name, value)`."""
    by_severity = F.col("level") == "severity"
    by_transform = F.col("level") == "transform"
    recalls = ["recall_at_1", "recall_at_5", "recall_at_10"]
    limit = F.create_map(*[x for k, v in similarity.items() for x in (F.lit(k), F.lit(float(v)))])

    def point(plot: str, series: str, value: Column) -> Column:
        return F.struct(F.lit(plot).alias("plot"), F.lit(series).alias("series"), value.cast("double").alias("value"))

    points = F.when(
        by_severity,
        F.array(
            *[point("recall_by_severity", r, F.col(r)) for r in recalls],
            point("similarity_by_severity", "mean_similarity", F.col("mean_similarity_correct")),
            point("similarity_by_severity", "threshold", limit[F.col("name")]),
        ),
    ).when(
        by_transform,
        F.array(
            *[point("recall_by_transform", r, F.col(r)) for r in recalls],
            point("latency_by_transform", "mean_latency_ms", F.col("mean_latency_ms")),
        ),
    )
    return metrics.where(by_severity | by_transform).select("name", F.explode(points).alias("_p")).select(
        "_p.plot", "_p.series", "name", "_p.value"
    )
