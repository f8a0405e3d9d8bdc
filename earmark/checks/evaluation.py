"""Registered queries for evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.checks.matching_sql import P
from earmark.checks.support import Query, r6, tidy
from earmark.operators import evaluate as E
from earmark.checks.fusion import project_counts, _segment_candidates

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            ORACLES[name] = P.sql(sql)
        return fn

    return wrap


def r6s(*names: str) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


def _recalls(ks=(1, 5, 10, 20)) -> str:
    return ", ".join(f"avg(CASE WHEN true_rank <= {k} THEN 1.0 ELSE 0.0 END) AS recall_at_{k}" for k in ks)


_RECALL_NAMES = ["recall_at_1", "recall_at_5", "recall_at_10", "recall_at_20"]


@register("recall_at_k", f"SELECT severity, queries, {r6s(*_RECALL_NAMES)} FROM (SELECT severity, count(*) AS queries, {_recalls()} FROM judged GROUP BY severity)")
def recall_at_k(spark, sf):
    return E.recall_at_k(X.candidates(spark, sf), X.truth(spark, sf), group=["severity"])


@register(
    "recall_at_k_segments",
    f"SELECT queries, {r6s(*_RECALL_NAMES)} FROM (SELECT count(*) AS queries, {_recalls()} FROM truth t LEFT JOIN ("
    "SELECT query_id, track_id, row_number() OVER (PARTITION BY query_id ORDER BY r, track_id) AS true_rank FROM (SELECT query_id, split_part(cand_id, '_seg_', 1) AS track_id, min(rank) AS r FROM ("
    "SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, mean_similarity DESC, cand_id) AS rank FROM seg_scores) GROUP BY ALL)) USING (query_id, track_id))",
)
def recall_at_k_segments(spark, sf):
    return E.recall_at_k(_segment_candidates(spark, sf), X.truth(spark, sf), grain="segment")


@register(
    "rank_distribution",
    f"SELECT severity, {r6s('mean_rank', 'std_rank')}, min_rank, max_rank, num_correct, num_total, {r6('correct_rate')} AS correct_rate, num_found, {r6('mean_true_rank')} AS mean_true_rank, max_true_rank, "
    f"{r6s('median_rank', 'p95_rank', 'median_true_rank', 'p95_true_rank')} FROM (SELECT severity, avg(tr) AS mean_rank, stddev_samp(tr) AS std_rank, min(tr) AS min_rank, max(tr) AS max_rank, count(*) FILTER (WHERE correct) AS num_correct, "
    "count(*) AS num_total, avg(CAST(correct AS INT)) AS correct_rate, count(true_rank) AS num_found, avg(true_rank) AS mean_true_rank, max(true_rank) AS max_true_rank, quantile_cont(tr, 0.5) AS median_rank, "
    "quantile_cont(tr, 0.95) AS p95_rank, quantile_cont(true_rank, 0.5) AS median_true_rank, quantile_cont(true_rank, 0.95) AS p95_true_rank FROM (SELECT *, CASE WHEN correct THEN top_match_rank END AS tr FROM judged) GROUP BY severity)",
)
def rank_distribution(spark, sf):
    return E.rank_distribution(X.candidates(spark, sf), X.summary(spark, sf), X.truth(spark, sf), ["severity"])


@register("rank_histogram", "SELECT severity, true_rank, count(*) AS queries FROM judged GROUP BY ALL")
def rank_histogram(spark, sf):
    return E.rank_histogram(X.candidates(spark, sf), X.truth(spark, sf), ["severity"])


_SIM_NAMES = ["mean_similarity_correct", "std_similarity_correct", "min_similarity_correct", "max_similarity_correct", "mean_similarity_all", "median_similarity_correct"]
_SIM = (
    "avg(sim) AS mean_similarity_correct, stddev_samp(sim) AS std_similarity_correct, min(sim) AS min_similarity_correct, max(sim) AS max_similarity_correct, "
    "avg(top_match_similarity) AS mean_similarity_all, quantile_cont(sim, 0.5) AS median_similarity_correct"
)


@register(
    "similarity_stats",
    f"SELECT transform_type, {r6s(*_SIM_NAMES)} FROM (SELECT transform_type, {_SIM} FROM (SELECT *, CASE WHEN correct THEN top_match_similarity END AS sim FROM judged) GROUP BY transform_type)",
)
def similarity_stats(spark, sf):
    return E.similarity_stats(X.summary(spark, sf), X.truth(spark, sf), ["transform_type"])


_LAT_NAMES = ["mean_latency_ms", "std_latency_ms", "min_latency_ms", "max_latency_ms", "median_latency_ms", "p95_latency_ms"]


def _latency(v: str) -> str:
    return (
        f"avg({v}) AS mean_latency_ms, stddev_samp({v}) AS std_latency_ms, min({v}) AS min_latency_ms, max({v}) AS max_latency_ms, "
        f"quantile_cont({v}, 0.5) AS median_latency_ms, quantile_cont({v}, 0.95) AS p95_latency_ms"
    )


_LAT = _latency("latency_ms")


@register("latency_stats", f"SELECT {r6s(*_LAT_NAMES)} FROM (SELECT {_LAT} FROM lat)")
def latency_stats(spark, sf):
    return E.latency_stats(X.latency(spark, sf))


@register(
    "latency_stats_events",
    f"SELECT event_type, {r6s(*_LAT_NAMES)} FROM (SELECT event_type, {_latency('value')} FROM events GROUP BY event_type)",
)
def latency_stats_events(spark, sf):
    """The same statistics over the values of all events."""
    return E.latency_stats(X.table(spark, sf, "events"), ["event_type"], "value")


_METRIC_COLUMNS = (
    f"count(*) AS count, {_recalls()}, count(*) FILTER (WHERE correct) AS num_correct, avg(tr) AS mean_rank, avg(true_rank) AS mean_true_rank, {_SIM}, {_LAT}, "
    "quantile_cont(tr, 0.5) AS median_rank, quantile_cont(tr, 0.95) AS p95_rank, quantile_cont(true_rank, 0.5) AS median_true_rank"
)
P.add(
    "metrics",
    f"SELECT l.level, l.name, {_METRIC_COLUMNS} FROM (SELECT *, CASE WHEN correct THEN top_match_rank END AS tr, CASE WHEN correct THEN top_match_similarity END AS sim, "
    "unnest([{'level': 'overall', 'name': 'all'}, {'level': 'transform', 'name': transform_type}, {'level': 'severity', 'name': severity}]) AS l FROM judged) GROUP BY l.level, l.name"
)
_METRIC_DOUBLES = [*_RECALL_NAMES, "mean_rank", "mean_true_rank", *_SIM_NAMES, *_LAT_NAMES, "median_rank", "p95_rank", "median_true_rank"]


def _metrics(spark, sf):
    return X._once(spark, sf, "metrics", lambda: E.metrics_by_group(X.candidates(spark, sf), X.summary(spark, sf), X.truth(spark, sf)))


@register("metrics_by_group", f"SELECT level, name, count, num_correct, {r6s(*_METRIC_DOUBLES)} FROM metrics")
def metrics_by_group(spark, sf):
    return E.metrics_by_group(X.candidates(spark, sf), X.summary(spark, sf), X.truth(spark, sf))


_limit_rows = ", ".join(
    f"('{level}', '{name}', '{metric}', CAST({limit} AS DOUBLE))" for level, name, metric, limit in E._limits(E.RECALL_LIMITS, E.SIMILARITY_LIMITS, E.LATENCY_LIMITS)
)
P.add(
    "checked",
    "SELECT level, name, metric, threshold, coalesce(actual, 0.0) AS actual, CASE WHEN metric LIKE '%latency%' THEN coalesce(actual, 0.0) <= threshold ELSE coalesce(actual, 0.0) >= threshold END AS passed "
    "FROM (SELECT level, name, recall_at_1, recall_at_5, recall_at_10, mean_similarity_correct, mean_latency_ms, p95_latency_ms FROM metrics) "
    "UNPIVOT INCLUDE NULLS (actual FOR metric IN (recall_at_1, recall_at_5, recall_at_10, mean_similarity_correct, mean_latency_ms, p95_latency_ms)) "
    f"JOIN (VALUES {_limit_rows}) t(level, name, metric, threshold) USING (level, name, metric)",
)


@register("pass_fail", f"SELECT level, name, metric, threshold, {r6('actual')} AS actual, passed FROM checked")
def pass_fail(spark, sf):
    return E.pass_fail(_metrics(spark, sf))


@register(
    "overall_status",
    f"SELECT total_checks, passed_checks, {r6('rate')} AS pass_rate, CASE WHEN rate >= 80 THEN 'PASS' WHEN rate >= 50 THEN 'WARNING' ELSE 'FAIL' END AS status FROM ("
    "SELECT *, passed_checks / total_checks * 100 AS rate FROM (SELECT count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed_checks FROM checked))",
)
def overall_status(spark, sf):
    return E.overall_status(E.pass_fail(_metrics(spark, sf)))


_SUITE = f"SELECT name AS severity, count, {r6s('recall_at_1', 'recall_at_5', 'recall_at_10', 'mean_rank')}, {r6('mean_similarity_correct')} AS mean_similarity, {r6('mean_latency_ms')} AS mean_latency_ms FROM metrics WHERE level = 'severity'"


@register("suite_summary", _SUITE)
def suite_summary(spark, sf):
    return E.suite_summary(_metrics(spark, sf))


P.add(
    "failed",
    "SELECT query_id, track_id, transform_type, severity, top_match_id, top_match_similarity, top_match_rank, CASE WHEN top_match_rank = -1 THEN 'No matches found' "
    "WHEN top_match_similarity < 0.5 THEN 'Low similarity: ' || printf('%.3f', top_match_similarity) ELSE 'Wrong match: ' || top_match_id || ' (expected ' || track_id || ')' END AS reason FROM judged WHERE NOT correct",
)
_FAIL = f"query_id, track_id, transform_type, severity, top_match_id, {r6('top_match_similarity')} AS top_match_similarity, top_match_rank, reason"


@register("failures", f"SELECT {_FAIL} FROM failed")
def failures(spark, sf):
    return E.failures(X.summary(spark, sf), X.truth(spark, sf))


P.add("captured", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transform_type ORDER BY query_id) AS failure_no FROM failed) WHERE failure_no <= 10")


@register("capture_failures", f"SELECT {_FAIL}, failure_no FROM captured")
def capture_failures(spark, sf):
    return E.capture_failures(failures(spark, sf))


@register(
    "failure_details",
    f"SELECT f.query_id, f.track_id AS expected_id, f.reason, p.project_type, p.total_notes, c.rank, c.cand_id, {r6('c.mean_similarity')} AS similarity FROM captured f "
    "LEFT JOIN proj p USING (track_id) LEFT JOIN (SELECT * FROM cands WHERE rank <= 5) c ON c.query_id = f.query_id",
)
def failure_details(spark, sf):
    nested = E.failure_details(capture_failures(spark, sf), X.candidates(spark, sf), project_counts(spark, sf))
    return nested.select("query_id", "expected_id", "reason", "project.project_type", "project.total_notes", F.inline_outer("top_matches"))


def _phase(spark, sf, transforms):
    """Metrics of one phase, which covers some of the transforms."""
    keep = X.truth(spark, sf).where(F.col("transform_type").isin(*transforms))
    own = X.summary(spark, sf).join(keep.select("query_id"), "query_id", "left_semi")
    return E.metrics_by_group(X.candidates(spark, sf), own, keep)


def _overall(metrics):
    return metrics.where("level = 'overall'").select(
        F.col("count").alias("total_queries"), "recall_at_1", "recall_at_5", "recall_at_10", "mean_rank", F.col("mean_similarity_correct").alias("mean_similarity")
    )


PHASES = {"phase1": ("mask_16", "mask_10"), "phase2": ("mask_6",)}


def _phase_sql(phase: str) -> str:
    names = ", ".join(f"'{t}'" for t in PHASES[phase])
    return P.parts["metrics"].replace("FROM judged)", f"FROM judged WHERE transform_type IN ({names}))")


P.add("phase_one", _phase_sql("phase1"))
P.add("phase_two", _phase_sql("phase2"))
_NAMES = {"total_queries": "count", "recall_at_1": "recall_at_1", "recall_at_5": "recall_at_5", "recall_at_10": "recall_at_10", "mean_rank": "mean_rank", "mean_similarity": "mean_similarity_correct"}


@register(
    "phase_comparison",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r6('CAST(coalesce(a.' + c + ', 0) AS DOUBLE)')} AS phase1, {r6('CAST(coalesce(b.' + c + ', 0) AS DOUBLE)')} AS phase2, "
        f"{r6('CAST(coalesce(b.' + c + ', 0) AS DOUBLE) - CAST(coalesce(a.' + c + ', 0) AS DOUBLE)')} AS difference FROM phase_one a, phase_two b WHERE a.level = 'overall' AND b.level = 'overall'"
        for m, c in _NAMES.items()
    ),
)
def phase_comparison(spark, sf):
    return E.phase_comparison(_overall(_phase(spark, sf, PHASES["phase1"])), _overall(_phase(spark, sf, PHASES["phase2"])))


@register("phase_union", " UNION ALL ".join(_SUITE.replace("FROM metrics", f", '{p}' AS phase FROM {t}") for p, t in (("phase1", "phase_one"), ("phase2", "phase_two"))))
def phase_union(spark, sf):
    return E.phase_union(E.suite_summary(_phase(spark, sf, PHASES["phase1"])), E.suite_summary(_phase(spark, sf, PHASES["phase2"])))


@register(
    "bottlenecks",
    f"SELECT {r6s('mean', 'std', 'min', 'max', 'median', 'p95', 'p99')} FROM (SELECT avg(latency_ms) AS mean, stddev_pop(latency_ms) AS std, min(latency_ms) AS min, max(latency_ms) AS max, "
    "quantile_cont(latency_ms, 0.5) AS median, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99 FROM lat)",
)
def bottlenecks(spark, sf):
    return E.bottlenecks(X.latency(spark, sf))[0]


@register("bottleneck_rows", f"SELECT query_id, {r6('latency_ms')} AS latency_ms FROM lat WHERE latency_ms > (SELECT quantile_cont(latency_ms, 0.95) FROM lat)")
def bottleneck_rows(spark, sf):
    return E.bottlenecks(X.latency(spark, sf))[1]


@register(
    "segment_recall_estimate",
    f"SELECT query_id, severity, {r6('e')} AS estimated_recall, e < CASE severity WHEN 'severe' THEN 0.75 WHEN 'moderate' THEN 0.88 ELSE 0.9 * 0.95 END AS needs_scales FROM ("
    "SELECT t.query_id, t.severity, coalesce(f.n / s.num_segments, 0.0) AS e FROM truth t LEFT JOIN nseg s USING (query_id) LEFT JOIN ("
    "SELECT h.query_id, count(DISTINCT (h.scale, h.segment_idx)) AS n FROM hits h JOIN truth t ON t.query_id = h.query_id AND t.track_id = h.cand_id WHERE h.rank <= 5 GROUP BY h.query_id) f USING (query_id))",
)
def segment_recall_estimate(spark, sf):
    return E.segment_recall_estimate(X.hits(spark, sf), X.truth(spark, sf))


@register(
    "per_query_recall",
    "SELECT t.query_id, t.track_id, "
    + ", ".join(f"CASE WHEN c.rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_at_{k}" for k in (1, 5, 10))
    + f", {r6('coalesce(c.mean_similarity, 0.0)')} AS mean_similarity FROM truth t LEFT JOIN cands c ON c.query_id = t.query_id AND c.cand_id = t.track_id",
)
def per_query_recall(spark, sf):
    return E.per_query_recall(X.candidates(spark, sf), X.truth(spark, sf))


GRID = [round(0.1 + 0.05 * i, 2) for i in range(11)]


@register(
    "threshold_grid_search",
    f"SELECT threshold, queries, correct, {r6('recall')} AS recall_at_1, row_number() OVER (ORDER BY recall DESC, threshold) = 1 AS best FROM ("
    "SELECT g.threshold, count(j.query_id) AS queries, count(*) FILTER (WHERE j.correct) AS correct, CASE WHEN count(j.query_id) > 0 THEN count(*) FILTER (WHERE j.correct) / count(j.query_id) ELSE 0.0 END AS recall "
    f"FROM (VALUES {', '.join(f'(CAST({g} AS DOUBLE))' for g in GRID)}) g(threshold) LEFT JOIN judged j ON j.top_match_similarity >= g.threshold GROUP BY g.threshold)",
)
def threshold_grid_search(spark, sf):
    return E.threshold_grid_search(X.summary(spark, sf), X.truth(spark, sf), GRID)


@register(
    "run_summary",
    "SELECT count(*) AS total_queries, (SELECT count(*) FROM truth) AS total_transforms, '[\"' || array_to_string(list_sort(list(DISTINCT transform_type)), '\",\"') || '\"]' AS transform_types, "
    "'[\"' || array_to_string(list_sort(list(DISTINCT severity)), '\",\"') || '\"]' AS severities, 'phase2' AS phase FROM summary",
)
def run_summary(spark, sf):
    return E.run_summary(X.summary(spark, sf), X.truth(spark, sf), "configs/matrix_Phase_2.yaml")


@register("sla_flags", f"SELECT query_id, {r6('latency_ms')} AS latency_ms, latency_ms <= 600 AS within_target, latency_ms > 650 AS exceeds_warning FROM lat")
def sla_flags(spark, sf):
    return E.sla_flags(X.latency(spark, sf))


@register(
    "sla_shares",
    f"SELECT severity, queries, {r6s('within_target', 'exceeds_warning')} FROM (SELECT severity, count(*) AS queries, avg(CAST(latency_ms <= 600 AS INT)) AS within_target, avg(CAST(latency_ms > 650 AS INT)) AS exceeds_warning FROM summary GROUP BY severity)",
)
def sla_shares(spark, sf):
    return E.sla_shares(E.sla_flags(X.summary(spark, sf)), ["severity"])


@register(
    "scenario_metrics",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE m) AS passed, count(*) FILTER (WHERE NOT m) AS failed, {r6('avg(CAST(m AS INT))')} AS recall, {r6('coalesce(avg(true_rank), 1.0)')} AS mean_rank, "
    f"{r6('avg(s)')} AS mean_similarity, {r6('CAST(list_sort(list(true_rank) FILTER (WHERE true_rank IS NOT NULL))[count(true_rank) // 2 + 1] AS DOUBLE)')} AS median_rank, "
    f"{r6('list_sort(list(s))[count(*) // 2 + 1]')} AS median_similarity FROM (SELECT coalesce(true_rank <= 10, false) AS m, top_match_similarity AS s, true_rank FROM judged)",
)
def scenario_metrics(spark, sf):
    ranks = E.true_ranks(X.candidates(spark, sf), X.truth(spark, sf)).select("query_id", "true_rank")
    verdicts = X.summary(spark, sf).join(ranks, "query_id").select(
        F.coalesce(F.col("true_rank") <= 10, F.lit(False)).alias("matched"), F.col("top_match_similarity").alias("similarity"), F.col("true_rank").alias("rank")
    )
    return E.scenario_metrics(verdicts)


_series = [
    *[("recall_by_severity", r, r, "severity") for r in _RECALL_NAMES[:3]],
    ("similarity_by_severity", "mean_similarity", "mean_similarity_correct", "severity"),
    ("similarity_by_severity", "threshold", "CASE name WHEN 'mild' THEN 0.85 WHEN 'moderate' THEN 0.70 ELSE 0.50 END", "severity"),
    *[("recall_by_transform", r, r, "transform") for r in _RECALL_NAMES[:3]],
    ("latency_by_transform", "mean_latency_ms", "mean_latency_ms", "transform"),
]


@register(
    "report_series",
    " UNION ALL ".join(f"SELECT '{p}' AS plot, '{s}' AS series, name, {r6('CAST(' + v + ' AS DOUBLE)')} AS value FROM metrics WHERE level = '{level}'" for p, s, v, level in _series),
)
def report_series(spark, sf):
    return E.report_series(_metrics(spark, sf))
