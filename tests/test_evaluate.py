import numpy as np
import pytest

from earmark.operators import evaluate as E


@pytest.fixture(scope="module")
def tables(spark):
    truth = spark.createDataFrame(
        [("q1", "track1", "noise", "mild"), ("q2", "track2", "noise", "severe"), ("q3", "track3", "crop", "severe"), ("q4", "track4", "crop", "severe")],
        "query_id string, track_id string, transform_type string, severity string",
    )
    candidates = spark.createDataFrame(
        [("q1", "track1", 1, 0.9), ("q2", "track10", 1, 0.6), ("q2", "track2", 2, 0.5), ("q3", "track9", 1, 0.4)],
        "query_id string, cand_id string, rank int, mean_similarity double",
    )
    summary = spark.createDataFrame(
        [("q1", "track1", 1, 0.9, 100.0), ("q2", "track10", 1, 0.6, 200.0), ("q3", "track9", 1, 0.4, 300.0), ("q4", None, -1, 0.0, 400.0)],
        "query_id string, top_match_id string, top_match_rank int, top_match_similarity double, latency_ms double",
    )
    return truth, candidates, summary


def test_recall_counts_every_query_and_compares_whole_ids(tables):
    truth, candidates, _ = tables
    r = E.recall_at_k(candidates, truth, [1, 2]).first()
    assert (r.queries, r.recall_at_1, r.recall_at_2) == (4, 0.25, 0.5)  # track2 is not track10, and q4 counts


def test_recall_grows_with_k(tables):
    truth, candidates, _ = tables
    r = E.recall_at_k(candidates, truth, [1, 5, 10, 20]).first()
    assert r.recall_at_1 <= r.recall_at_5 <= r.recall_at_10 <= r.recall_at_20


def test_segments_of_one_track_take_one_place(spark, tables):
    truth, _, _ = tables
    segments = spark.createDataFrame([("q1", "track7_seg_0000", 1), ("q1", "track7_seg_0001", 2), ("q1", "track1_seg_0000", 3)], "query_id string, cand_id string, rank int")
    assert E.recall_at_k(segments, truth, [2], grain="segment").first().recall_at_2 == 0.25


def test_metrics_and_checks(tables):
    truth, candidates, summary = tables
    m = {(r.level, r.name): r for r in E.metrics_by_group(candidates, summary, truth).collect()}
    assert set(m) == {("overall", "all"), ("transform", "noise"), ("transform", "crop"), ("severity", "mild"), ("severity", "severe")}
    assert m["overall", "all"].mean_latency_ms == 250.0
    assert m["overall", "all"].p95_latency_ms == pytest.approx(np.quantile([100, 200, 300, 400], 0.95))
    assert m["severity", "severe"].mean_rank is None and m["severity", "severe"].num_correct == 0
    checks = {(r.name, r.metric): r.passed for r in E.pass_fail(E.metrics_by_group(candidates, summary, truth)).collect()}
    assert checks["mild", "recall_at_1"] and not checks["severe", "recall_at_1"] and checks["all", "p95_latency_ms"]
    assert len(checks) == 10


@pytest.mark.parametrize("passed, status", [(8, "PASS"), (5, "WARNING"), (4, "FAIL")])
def test_overall_status(spark, passed, status):
    checks = spark.createDataFrame([(i < passed,) for i in range(10)], "passed boolean")
    assert E.overall_status(checks).first().status == status


def test_no_checks_is_a_failure(spark):
    assert E.overall_status(spark.createDataFrame([], "passed boolean")).first().status == "FAIL"


def test_failure_reasons(tables):
    truth, candidates, summary = tables
    rows = {r.query_id: r.reason for r in E.failures(summary, truth).collect()}
    assert rows == {"q2": "Wrong match: track10 (expected track2)", "q3": "Low similarity: 0.400", "q4": "No matches found"}
    assert E.capture_failures(E.failures(summary, truth), 1).count() == 2
    details = {r.query_id: r for r in E.failure_details(E.failures(summary, truth), candidates).collect()}
    assert [m["cand_id"] for m in details["q2"].top_matches] == ["track10", "track2"]


def test_latency_of_five_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in (100, 200, 300, 400, 500)], "latency_ms double")
    r = E.latency_stats(df).first()
    assert (r.mean_latency_ms, r.median_latency_ms, r.p95_latency_ms) == (300.0, 300.0, 480.0)
    assert r.std_latency_ms == pytest.approx(np.std([100, 200, 300, 400, 500], ddof=1))
    stats, slow = E.bottlenecks(df)
    assert stats.first()["std"] == pytest.approx(np.std([100, 200, 300, 400, 500])) and [r.latency_ms for r in slow.collect()] == [500.0]


def test_grid_search_takes_the_first_best(tables):
    truth, _, summary = tables
    rows = {r.threshold: r for r in E.threshold_grid_search(summary, truth, [0.0, 0.5, 0.7, 0.8, 0.95]).collect()}
    assert [rows[t].queries for t in (0.0, 0.5, 0.7, 0.8, 0.95)] == [4, 2, 1, 1, 0]
    assert [t for t, r in rows.items() if r.best] == [0.7]


def test_scenario_median_is_the_upper_one(spark):
    v = spark.createDataFrame([(True, 0.9, 1), (True, 0.8, 4), (False, 0.1, None), (False, 0.2, None)], "matched boolean, similarity double, rank int")
    r = E.scenario_metrics(v).first()
    assert (r.median_rank, r.median_similarity, r.recall, r.mean_rank) == (4.0, 0.8, 0.5, 2.5)


def test_phases(spark):
    one = spark.createDataFrame([(10, 0.5, 0.6, 0.7, 1.0, 0.8)], ", ".join(f"{m} double" if m != "total_queries" else f"{m} int" for m in E.PHASE_METRICS))
    rows = {r.metric: r for r in E.phase_comparison(one, one.withColumn("recall_at_1", one.recall_at_1 + 0.25)).collect()}
    assert rows["recall_at_1"].difference == pytest.approx(0.25) and rows["total_queries"].difference == 0
