import math

import pytest
from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.operators import evaluate as E
from earmark.operators import fusion as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "query_id string, scale int, segment_idx int, scale_weight double, cand_id string, rank int, similarity double"


@pytest.fixture(scope="module")
def hits(spark):
    # Three segments: A leads the first two, B the third.
    rows = [
        ("q", 1, 0, 1.0, "A", 1, 0.9), ("q", 1, 0, 1.0, "B", 2, 0.5),
        ("q", 1, 1, 1.0, "A", 1, 0.8), ("q", 1, 1, 1.0, "C", 2, 0.2),
        ("q", 1, 2, 1.0, "B", 1, 0.4), ("q", 1, 2, 1.0, "A", 2, 0.3),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def by_id(df):
    return {r.cand_id: r for r in df.collect()}


def test_filter_keeps_all_when_too_few_pass(hits):
    assert Q.filter_segments(hits, 0.5).count() == 4
    assert Q.filter_segments(hits, 0.85, min_keep=0.34).count() == 6
    assert Q.filter_segments(hits, 0.85, min_keep=0.33).count() == 2


def test_adaptive_threshold(hits):
    # Mean of the top similarities is 0.7: 0.2 - 0.2 * 0.1.
    assert Q.adaptive_threshold(hits).first().threshold == pytest.approx(0.18)
    assert Q.adaptive_threshold(hits, sensitivity=10.0).first().threshold == pytest.approx(0.1)


def test_keep_best_segments(spark, hits):
    assert Q.keep_best_segments(hits, 0.5).count() == 6  # not more than five segments
    many = [("q", 1, i, 1.0, "A", 1, 1.0 if i % 2 else 0.5 + i / 100) for i in range(20)]
    kept = {r.segment_idx for r in Q.keep_best_segments(spark.createDataFrame(many, SCHEMA), 0.35).collect()}
    assert kept == {1, 3, 5, 7, 9, 11, 13}  # int(20 * 0.35), ties by position


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_temporal_runs(hits, block):
    got = by_id(Q.temporal_runs(hits, block))
    assert (got["A"].longest_run, got["A"].total_run) == (2, 2)
    assert got["A"].temporal_score == pytest.approx(2 / 3)
    assert got["B"].temporal_score == pytest.approx(1 / 3)


def test_aggregate_and_score(hits):
    votes = by_id(Q.aggregate_candidates(hits))
    a = votes["A"]
    s = [0.9, 0.8, 0.3]
    assert a.weighted_similarity == pytest.approx(sum(x**3 for x in s) / sum(x**2 for x in s))
    assert a.geometric_similarity == pytest.approx((0.9 * 0.8 * 0.3) ** (1 / 3))
    assert (a.match_count, a.rank_1_count, a.rank_5_count, a.min_rank) == (3, 2, 3, 1)
    scored = by_id(Q.combined_score(Q.aggregate_candidates(hits), Q.temporal_runs(hits)))
    w = Q.ScoreWeights().normalised()
    want = (
        w["similarity"] * (0.7 * a.weighted_similarity + 0.3 * a.geometric_similarity) + w["rank_1"] * (2 / 3) ** 1.5
        + w["rank_5"] + w["match_ratio"] + w["temporal"] * (2 / 3) ** 1.2
    )
    assert scored["A"].combined_score == pytest.approx(want)
    assert [scored[c]["rank"] for c in "ABC"] == [1, 2, 3]


def test_weights_sum_to_one():
    assert sum(Q.ScoreWeights(1, 2, 3, 4, 5).normalised().values()) == pytest.approx(1.0)


def test_geometric_mean_needs_positive_similarities(spark):
    rows = [("q", 1, 0, 1.0, "A", 1, 0.5), ("q", 1, 1, 1.0, "A", 1, -0.1)]
    assert Q.aggregate_candidates(spark.createDataFrame(rows, SCHEMA)).first().geometric_similarity is None


def test_single_candidate_has_medium_confidence(spark):
    h = spark.createDataFrame([("q", 1, 0, 1.0, "A", 1, 0.5)], SCHEMA)
    assert Q.fuse(h).first().confidence == 0.5


def test_confidence_of_the_leader(hits):
    judged = by_id(Q.confidence(Q.quality_score(Q.combined_score(Q.aggregate_candidates(hits), Q.temporal_runs(hits)))))
    a, b = judged["A"], judged["B"]
    gap = (a.combined_score - b.combined_score) / a.combined_score
    want = 0.25 * min(2 * gap, 1) + 0.25 * 2 / 3 + 0.2 * 2 / 3 + 0.15 + 0.15 * a.quality_score
    assert a.confidence == pytest.approx(want)


def test_min_confidence_never_empties_a_query(hits):
    done = Q.fuse(hits)
    assert Q.min_confidence_filter(done, 2.0).count() == done.count()


def test_rrf_and_adjacent_boost(hits):
    fused = by_id(Q.reciprocal_rank_fusion(hits, 0.35))
    assert fused["A"].score == pytest.approx(1.7) and "C" not in fused
    assert fused["B"].score == pytest.approx(0.5 / 2 + 0.4)
    boosted = by_id(Q.adjacent_boost(Q.reciprocal_rank_fusion(hits, 0.35), hits, 0.1))
    assert boosted["A"].score == pytest.approx(1.7 * 1.1**2)
    assert boosted["B"].score == pytest.approx(0.65)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_run_boost(hits, block):
    got = {(r.segment_idx, r.cand_id): r for r in Q.run_boost(hits, block=block).collect()}
    assert got[0, "A"].similarity == pytest.approx(0.9 * 1.1) and got[0, "A"].longest_run == 3
    assert got[0, "B"].similarity == 0.5


def test_confident_match_counts_all_segments(spark):
    sure = [("q", 1, i, 1.0, "A", 1, 0.99) for i in range(4)]
    mixed = [("r", 1, i, 1.0, "A" if i else "B", 1, 0.99) for i in range(4)]
    got = {(r.query_id, r.cand_id): r.confident for r in Q.confident_match(spark.createDataFrame(sure + mixed, SCHEMA)).collect()}
    assert got == {("q", "A"): True, ("r", "A"): False, ("r", "B"): False}


def test_gate_may_empty_a_query(spark):
    c = spark.createDataFrame([("m", "A", 0.94), ("s", "A", 0.86), ("n", "A", 0.96)], "query_id string, cand_id string, mean_similarity double")
    sev = spark.createDataFrame([("m", "mild"), ("s", "severe"), ("n", None)], "query_id string, severity string")
    assert {r.query_id for r in Q.similarity_gate(c, sev).collect()} == {"s", "n"}


def test_merge_scales_with_wrong_weights(hits):
    shares = {r.scale_weight for r in Q.merge_scales([hits, hits], [1.0]).collect()}
    assert shares == {0.5}


def test_ranking_never_sees_the_answer(spark):
    """Shuffled labels leave the candidates as they are, and only the evaluation changes."""
    found = X.hits(spark, SF)
    before = Q.fuse(found).select("query_id", "cand_id", "rank")
    truth = X.truth(spark, SF)
    shifted = truth.withColumn("track_id", F.concat(F.lit("track"), ((F.regexp_extract("track_id", "([0-9]+)", 1).cast("int") + 1) % 100).cast("string")))
    after = Q.fuse(found).select("query_id", "cand_id", "rank")
    assert before.exceptAll(after).count() == 0
    right = E.recall_at_k(before, truth, [1]).first().recall_at_1
    wrong = E.recall_at_k(before, shifted, [1]).first().recall_at_1
    assert right > 0.5 > wrong


def test_one_very_long_query(spark):
    """One query holds most segments, all with equal top similarity; nothing is lost."""
    n = 20000
    long = spark.range(n).select(F.lit("q").alias("query_id"), F.lit(1).alias("scale"), F.col("id").cast("int").alias("segment_idx"), F.lit(1.0).alias("scale_weight"),
                                 F.when(F.col("id") < 15000, "A").otherwise("B").alias("cand_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("similarity"))
    kept = Q.keep_best_segments(long, 0.8)
    assert kept.count() == 16000 and kept.agg(F.max("segment_idx")).first()[0] == 15999
    got = by_id(Q.temporal_runs(long, 1000))
    assert (got["A"].longest_run, got["B"].longest_run) == (15000, 5000)


def test_store_limit_and_summary(spark, hits):
    done = Q.fuse(hits)
    stored = Q.store_limit(done).first()
    assert [e["rank"] for e in stored.top_candidates] == [1, 2, 3]
    assert [e["rank"] for e in Q.store_limit(done, 1).first().top_candidates] == [1]
    asked = spark.createDataFrame([("q",), ("nothing",)], "query_id string")
    rows = {r.query_id: r for r in Q.top_match_summary(asked, done).collect()}
    assert (rows["nothing"].top_match_id, rows["nothing"].top_match_similarity, rows["nothing"].top_match_rank) == (None, 0.0, -1)
    assert rows["q"].top_match_id == "A"
    assert not math.isnan(rows["q"].top_match_similarity)
