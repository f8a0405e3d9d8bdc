import pytest
from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.functions import registry
from earmark.operators import fusion as Q
from earmark.operators import vectors as V
from earmark.pipeline import MatchConfig, judge, match, store
from earmark.streaming.incremental import follow_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("config", [MatchConfig(k=10), MatchConfig(k=10, fusion="rrf"), MatchConfig(k=10, search="cells", nlist=8, nprobe=8)])
def test_recall_falls_with_severity(spark, tmp_path, config):
    registry.metric("ranked")(lambda candidates, summary, truth: candidates.groupBy("query_id").count())
    found = match(X.queries(spark, SF), X.corpus(spark, SF), config)
    run = judge(found, X.latency(spark, SF), X.truth(spark, SF))
    recall = {r.name: r.recall_at_1 for r in run.metrics.where("level = 'severity'").collect()}
    assert recall["mild"] > recall["moderate"] > recall["severe"]
    assert run.status.first().status in ("PASS", "WARNING", "FAIL")
    store(run, str(tmp_path), "run_1")
    assert spark.read.option("header", True).csv(str(tmp_path / "suite_summary")).count() == 3
    assert spark.read.json(str(tmp_path / "ranked")).count() == run.candidates.select("query_id").distinct().count()


def test_project_criteria_filter_candidates(spark):
    projects = spark.createDataFrame([("track1", "ableton", 5, 1, 0)], "track_id string, project_type string, total_notes int, midi_tracks int, automation_tracks int")
    found = match(X.queries(spark, SF).where("query_id = 'track1_m60'"), X.corpus(spark, SF), MatchConfig(project_criteria={"min_notes": 10}), projects=projects)
    assert found.count() > 0 and found.where("cand_id = 'track1'").count() == 0


def test_unknown_settings(spark):
    q, c = X.queries(spark, SF), X.corpus(spark, SF)
    for config in (MatchConfig(search="graph"), MatchConfig(fusion="sum")):
        with pytest.raises(ValueError):
            match(q, c, config)


def test_cell_search_loses_little(spark):
    q, c = X.queries(spark, SF), X.corpus(spark, SF)
    exact = V.knn_cosine(q, c, 1).select("query_id", "scale", "segment_idx", "cand_id")
    near = V.ivf_search(q, c, 1, 6, nlist=12).select("query_id", "scale", "segment_idx", "cand_id")
    assert exact.join(near, exact.columns, "left_semi").count() / exact.count() > 0.8


def test_stream_takes_in_new_tracks_once(spark, tmp_path):
    corpus = X.corpus(spark, SF)
    arriving, out, state = (str(tmp_path / n) for n in ("arriving", "index", "state"))
    known = corpus.where("cand_id < 'track3'")
    corpus.where("cand_id < 'track5'").write.parquet(arriving)
    follow_folder(spark, arriving, known, out, state).awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == corpus.where("cand_id < 'track5' AND cand_id >= 'track3'").count()
    corpus.where("cand_id >= 'track5'").write.mode("append").parquet(arriving)
    follow_folder(spark, arriving, known, out, state).awaitTermination()
    spark.catalog.refreshByPath(out)
    both = spark.read.parquet(out)
    assert both.count() == corpus.count() - known.count() == both.select("cand_id").distinct().count()


def test_fusion_plan_reads_hits_from_files_once_per_stage(spark):
    """The plan of a fused result starts at a written table, not at the search."""
    plan = Q.fuse(X.hits(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "mapinarrow" not in plan.lower() and "cross" not in plan.lower()
    assert X.hits(spark, SF).where(F.col("rank") == 1).count() > 0


def test_limits_have_rows_on_both_sides(spark):
    """The registered queries decide something: each limit lets some rows pass and holds others."""
    from earmark import checks

    run = lambda name: checks.QUERIES[name](spark, SF)
    candidates = X.candidates(spark, SF).count()
    assert 0 < run("similarity_gate").count() < candidates
    assert 0 < run("store_limit").count() < candidates
    assert {r.confident for r in run("confident_match").collect()} == {True, False}
    similar = [r.passed for r in run("pass_fail").where("metric = 'mean_similarity_correct'").collect()]
    assert set(similar) == {True, False}


def test_a_run_stored_again_replaces_itself(spark, tmp_path):
    from earmark.pipeline import read_runs
    from earmark.sources.manifest import run_catalog

    run = judge(X.candidates(spark, SF), X.latency(spark, SF), X.truth(spark, SF))
    for run_id in ("a", "b", "b"):
        store(run, str(tmp_path), run_id, phase="phase2")
    asked = X.truth(spark, SF).count()
    listed = {r.run_id: (r.total_queries, r.phase, r.state) for r in run_catalog(read_runs(spark, str(tmp_path))).collect()}
    assert listed == {k: (asked, "phase2", "complete") for k in "ab"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/query_summary").count() == 2 * asked
    stored = spark.read.json(f"{tmp_path}/query_results/run_id=a").selectExpr("inline(top_candidates)")
    assert stored.count() == run.candidates.count()
