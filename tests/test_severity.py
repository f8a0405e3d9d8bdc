"""Settings by severity, the second round of scales, and frequency content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark import pipeline
from earmark.operators import fusion as Q
from earmark.operators import signal as A
from earmark.operators import vectors as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rounds(spark):
    """Both rounds, and which queries each search was given."""
    asked, knn = [], V.knn

    def counted(queries, corpus, k, *a, **o):
        asked.append({r.query_id: r.k for r in queries.select("query_id", "k").distinct().collect()})
        return knn(queries, corpus, k, *a, **o)

    V.knn = counted
    try:
        variants = X.truth(spark, SF).select("query_id", "transform_type", "severity")
        found = pipeline.search_by_severity(X.queries(spark, SF), X.corpus(spark, SF), variants, lambda w: X.wider_scales(spark, SF, w), 10)
        hits = found.hits.cache()
        hits.count()
    finally:
        V.knn = knn
    return found._replace(hits=hits), asked


def test_settled_queries_are_not_searched_twice(spark, rounds):
    found, (first, second) = rounds
    severity = {r.query_id: r.severity for r in found.settings.collect()}
    assert set(first) == set(severity)
    assert 0 < len(second) < len(first)
    assert set(second) == {r.query_id for r in found.again.collect()}
    assert "mild" not in {severity[q] for q in second}
    wide = {r.query_id for r in found.hits.where("scale >= 3000").select("query_id").distinct().collect()}
    assert wide == set(second)


def test_depths_follow_severity(rounds):
    found, (first, second) = rounds
    severity = {r.query_id: r.severity for r in found.settings.collect()}
    assert {severity[q]: k for q, k in first.items()} == {"mild": 20, "moderate": 22, "severe": 26}
    assert all(k == min(2 * first[q], {"severe": 100, "moderate": 60}[severity[q]]) for q, k in second.items())


def test_weights_of_a_query_sum_to_one(rounds):
    found, _ = rounds
    sums = found.hits.select("query_id", "scale", "scale_weight").distinct().groupBy("query_id").agg(F.sum("scale_weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in sums)


def test_match_by_severity_ranks_tracks(spark):
    variants = X.truth(spark, SF).select("query_id", "transform_type", "severity")
    few = F.col("query_id").startswith("track1")
    found = pipeline.match_by_severity(X.queries(spark, SF).where(few), X.corpus(spark, SF), variants.where(few), lambda w: X.wider_scales(spark, SF, w), gate=True)
    rows = found.collect()
    assert rows and all(r.own_similarity >= 0.85 for r in rows)
    assert {r.cand_id for r in rows if r["rank"] == 1 and r.query_id == "track1_m60"} == {"track1"}


def test_queries_without_a_variant_are_searched_too(spark):
    none = X.truth(spark, SF).select("query_id", "transform_type", "severity").limit(0)
    one = X.queries(spark, SF).where("query_id = 'track2_m60'")
    found = pipeline.search_by_severity(one, X.corpus(spark, SF), none, lambda w: X.wider_scales(spark, SF, w), 7)
    assert found.hits.groupBy("scale", "segment_idx").count().count() == one.count() and found.again.count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Twelve tracks of five vectors in a folder of tables, and what is known of their masked copies in a file."""
    sf = str(tmp_path_factory.mktemp("small"))
    vectors = np.random.default_rng(3).normal(size=(60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    X.truth(spark, sf).select("query_id", "transform_type", "severity").write.parquet(f"{sf}/variants")
    return sf, spark.read.parquet(f"{sf}/variants")


def test_depths_reach_the_search_without_a_broadcast(spark, small, monkeypatch):
    """What is written by both rounds: no table with a row for each query, read from a file, is sent to the driver."""
    sf, variants = small
    written, cut = [], pipeline.cut_lineage
    monkeypatch.setattr(pipeline, "cut_lineage", lambda df: (written.append(plan(df)), cut(df))[1])
    knn = V.knn
    monkeypatch.setattr(V, "knn", lambda queries, *a, **o: (written.append(plan(queries)), knn(queries, *a, **o))[1])
    found = pipeline.search_by_severity(X.queries(spark, sf), X.corpus(spark, sf), variants, lambda w: X.wider_scales(spark, sf, w), 10)
    written.append(plan(found.hits))
    salted = [p for p in written if "_salt" in p]
    assert len(salted) >= 4 and found.again.count() > 0
    assert not [p for p in salted if any("Broadcast" in line and "_salt" in line for line in p.splitlines())]
    depth = {r.query_id: r.k for r in found.settings.collect()}
    per_segment = found.hits.where("scale = 1000").groupBy("query_id", "segment_idx").count().collect()
    assert len(per_segment) == 180 and all(1 <= r["count"] <= depth[r.query_id] for r in per_segment)


def test_agreement_and_wider_scales_meet_queries_without_a_broadcast(spark, small):
    sf, variants = small
    hits = spark.createDataFrame([(q, 1000, i, 1.0, t, 1, 0.5) for q, i, t in [("track1_m6", 0, "a"), ("track1_m6", 1, "b"), ("track2_m60", 0, "a"), ("none", 0, "a")]], "query_id string, scale int, segment_idx long, scale_weight double, cand_id string, rank int, similarity double")
    decided = Q.scale_decision(hits, variants, 20)
    assert "Broadcast" not in plan(decided)
    assert {r.query_id: (r.agreement, r.needs_scales, r.k) for r in decided.collect()} == {"track1_m6": (0.5, True, 40), "track2_m60": (1.0, False, 20), "none": (1.0, False, 20)}
    wanted = pipeline.cut_lineage(spark.createDataFrame([("track1_m6", 3000), ("track1_m6", 5000), ("track2_m10", 3000)], "query_id string, scale int"))
    wide = X.wider_scales(spark, sf, wanted)
    assert "Broadcast" not in plan(wide)
    got = wide.groupBy("query_id", "scale").count().collect()
    assert {(r.query_id, r.scale): r["count"] for r in got} == {("track1_m6", 3000): 3, ("track1_m6", 5000): 1, ("track2_m10", 3000): 3}


def test_thresholds_meet_settings_without_a_broadcast(spark, tmp_path):
    """The settings have a row for each query. Votes get the threshold of their query, by its severity and mean top similarity."""
    spark.createDataFrame([("mild", "x", "mild", 20), ("low", "x", "moderate", 22), ("hard", "x", "severe", 26), ("unasked", "x", "mild", 20)], "query_id string, transform_type string, severity string, k int").write.parquet(f"{tmp_path}/s")
    rows = [(q, 1000, i, 1.0, c, r, s) for q, s in (("mild", 1.0), ("low", 1.0), ("hard", 0.9), ("unknown", 1.0)) for i in range(2) for r, c in ((1, "a"), (2, "b"))]
    hits = spark.createDataFrame(rows, "query_id string, scale int, segment_idx long, scale_weight double, cand_id string, rank int, similarity double")
    settings = spark.read.parquet(f"{tmp_path}/s")
    limits = pipeline.severity_thresholds(pipeline.TwoRounds(hits, settings, settings))
    assert "Broadcast" not in plan(limits)
    assert {r.query_id: round(r.threshold, 6) for r in limits.collect()} == {"mild": 0.15, "low": 0.22, "hard": 0.18}
    kept = Q.filter_segments(hits, limits)
    assert sorted({r.query_id for r in kept.collect()}) == ["hard", "low", "mild"]


# ---------------------------------------------------------------- frequency content


def tone(spark, hz, rate, seconds, track, extra=0.0):
    n = int(rate * seconds)
    rng = np.random.default_rng(1)
    v = np.sin(2 * np.pi * hz * np.arange(n) / rate) + extra * rng.normal(size=n)
    return [(track, i, float(x)) for i, x in enumerate(v)]


def plain_features(v, size, hop, frame, edges, rate, bands):
    out = {}
    for s in range((len(v) - size) // hop + 1):
        logs = []
        for start in range(-(-s * hop // (frame // 2)) * (frame // 2), s * hop + size - frame + 1, frame // 2):
            x = v[start : start + frame] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame))
            power = np.array([abs(np.sum(x * np.exp(-2j * np.pi * k * np.arange(frame) / frame))) ** 2 for k in range(frame // 2 + 1)])
            hz = np.arange(frame // 2 + 1) * rate / frame
            e = [power[(hz >= lo) & ((hz < hi) | (i == bands - 1))].sum() for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
            logs.append(np.log(np.maximum(e, A.LEAST_ENERGY)))
        f = np.concatenate([np.mean(logs, axis=0), np.std(logs, axis=0)])
        out[s] = f / np.linalg.norm(f)
    return out


@pytest.mark.parametrize("block", [7, 100, 65536])
def test_features_of_all_block_sizes(spark, block):
    rate, frame, size, hop = 800, 32, 160, 80
    rows = tone(spark, 90, rate, 0.7, 1, 0.1) + tone(spark, 210, rate, 0.43, 2, 0.1) + tone(spark, 50, rate, 0.1, 3)
    samples = spark.createDataFrame(rows, "track_id long, idx long, value double")
    got = A.spectral_features(samples, 0.2, 0.5, 8, rate, block, frame).collect()
    edges = A.mel_edges(4, rate / 2)
    want = {}
    for t in (1, 2, 3):
        v = np.array([x for track, _, x in rows if track == t])
        want |= {(t, s): f for s, f in plain_features(v, size, hop, frame, edges, rate, 4).items()}
    assert {(r.track_id, r.segment_idx) for r in got} == set(want)
    assert all(np.allclose(r.vector, want[r.track_id, r.segment_idx], atol=1e-9) for r in got)


def test_ratios_tell_low_from_high(spark):
    rate = 8000
    samples = spark.createDataFrame(tone(spark, 80, rate, 1, 1) + tone(spark, 1800, rate, 1, 2) + tone(spark, 0, rate, 1, 3), "track_id long, idx long, value double")
    got = {r.track_id: r for r in A.band_ratios(samples, rate, frame=512).collect()}
    assert got[1].low_ratio > 1.9 and got[1].bass_ratio > 0.9 and got[2].low_ratio < 0.1
    assert (got[3].low_ratio, got[3].bass_ratio) == (0.0, 0.0)


def test_features_need_no_padding(spark):
    samples = spark.createDataFrame(tone(spark, 440, 44100, 0.3, 1, 0.2), "track_id long, idx long, value double")
    r = A.spectral_features(samples, 0.2).first()
    assert len(r.vector) == 64 and all(abs(x) > 1e-6 for x in r.vector)
    with pytest.raises(ValueError):
        A.spectral_features(samples, 0.2, dim=5)
