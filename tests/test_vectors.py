import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators import vectors as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 8))
    base[40:80] = base[40] + 0.01 * rng.normal(size=(40, 8))  # a third of the corpus in one spot
    base[90] = base[91]  # equal vectors
    corpus = spark.createDataFrame([(f"track{i // 4}_seg_{i % 4:04d}", [float(x) for x in v]) for i, v in enumerate(base)], "cand_id string, vector array<double>").cache()
    q = np.vstack([base[::9] + 0.05 * rng.normal(size=base[::9].shape), base[90:91]])
    queries = spark.createDataFrame([(f"q{i}", i % 3, [float(x) for x in v]) for i, v in enumerate(q)], "query_id string, segment_idx int, vector array<double>").cache()
    return queries, corpus


def brute(queries, corpus, k, metric):
    c = corpus.collect()
    m = np.array([r.vector for r in c])
    out = {}
    for r in queries.collect():
        v = np.array(r.vector)
        if metric == "l2":
            s = -((m - v) ** 2).sum(axis=1)
        elif metric == "cosine":
            s = (m @ v) / np.linalg.norm(m, axis=1) / np.linalg.norm(v)
        else:
            s = m @ v
        s = np.round(s * V.SCORE_GRID) / V.SCORE_GRID
        order = sorted(range(len(c)), key=lambda i: (-s[i], c[i].cand_id))[:k]
        out[r.query_id] = [(c[i].cand_id, n + 1) for n, i in enumerate(order)]
    return out


def grouped(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r.query_id, []).append((r.cand_id, r["rank"]))
    return {k: sorted(v, key=lambda x: x[1]) for k, v in out.items()}


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 7}, {"broadcast_bytes": 200}])
def test_knn_is_exact(data, metric, options):
    assert grouped(V.knn(*data, 6, metric, **options)) == brute(*data, 6, metric)


@pytest.mark.parametrize("metric", V.METRICS)
def test_knn_of_many_queries_in_a_small_corpus(data, metric):
    queries, corpus = data
    few = corpus.where("cand_id < 'track2'").cache()
    assert few.count() < 60 < corpus.count()
    turned = corpus.select(corpus.cand_id.alias("query_id"), "vector")
    assert grouped(V.knn(turned, few, 6, metric, broadcast_bytes=60 * 8 * len(corpus.first().vector))) == brute(turned, few, 6, metric)


def test_knn_with_more_hits_than_corpus(data):
    queries, corpus = data
    assert V.knn(queries, corpus.limit(3), 10).count() == queries.count() * 3


def test_knn_rejects_unknown_metric(data):
    with pytest.raises(ValueError):
        V.knn(*data, 3, "hamming")


def test_l2_distance_and_similarity(data):
    r = V.knn_l2(*data, 1).first()
    assert r.similarity == pytest.approx(1 / (1 + r.distance))


def test_all_cells_equal_exact_search(data):
    queries, corpus = data
    centroids = corpus.limit(5).select(F.monotonically_increasing_id().cast("int").alias("cell_id"), "vector")
    found = V.ivf_search(queries, corpus, 6, 5, centroids.cache(), block_rows=11)
    assert grouped(found) == brute(queries, corpus, 6, "cosine")


def test_lsh_with_one_wide_bucket_equals_exact_search(data):
    queries, corpus = data
    found = V.ann_search(queries, corpus, 6, [[[0.0] * 7 + [1.0]]], 1e6, block_rows=10)
    # Products of one sign share a bucket, so repeat the search without the sign.
    both = V.ann_search(queries, corpus, 6, [[[0.0] * 8]], 1e6, block_rows=10)
    assert grouped(both) == brute(queries, corpus, 6, "cosine")
    assert found.count() <= both.count()


def test_normalisation(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "vector array<double>")
    assert [r.vector for r in V.l2_normalize(df).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert V.l2_normalize(df, "none") is df
    with pytest.raises(ValueError):
        V.l2_normalize(df, "l1")


def test_index_round_trip_and_update(spark, data, tmp_path):
    _, corpus = data
    path = str(tmp_path / "index")
    V.write_index(V.build_index(corpus.where("cand_id < 'track2'"), {"index_type": "flat"}), path)
    stored = V.read_index(spark, path)
    assert stored.meta.first().num_vectors == stored.table.count() and stored.centroids is None
    fresh, counts = V.update_index(stored, corpus)
    c = counts.first()
    assert c.added_vectors == fresh.count() and c.added_vectors + c.skipped_vectors == corpus.count()
    assert fresh.join(stored.table, "track_id", "left_semi").count() == 0
    with pytest.raises(ValueError):
        V.build_index(corpus, {"index_type": "hnsw"})


def test_pair_matrix_in_small_blocks(spark):
    rng = np.random.default_rng(8)
    q, t = rng.normal(size=(9, 4)), rng.normal(size=(7, 4))
    q[3] = q[4]
    queries = spark.createDataFrame([("q", i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id string, segment_idx int, vector array<double>")
    tracks = spark.createDataFrame([("t", i, [float(x) for x in v]) for i, v in enumerate(t)], "track_id string, segment_idx int, vector array<double>")
    pairs = spark.createDataFrame([("q", "t")], "query_id string, track_id string")
    r = V.pair_similarity_matrix(pairs, queries, tracks, block=2).first()
    s = np.round((q @ t.T) * V.SCORE_GRID) / V.SCORE_GRID
    best = np.sort(s.ravel())[::-1][: int(63 * 0.2)]
    assert r.pairs == 63
    assert r.max_similarity == pytest.approx(s.max())
    assert r.mean_similarity == pytest.approx(s.mean())
    assert r.p95_similarity == pytest.approx(np.percentile(s, 95))
    assert r.weighted_top_similarity == pytest.approx(np.average(best, weights=np.exp(2 * best)))
    assert (r.best_query_segment, r.best_track_segment) == tuple(np.unravel_index(s.argmax(), s.shape))


def test_cache_misses_after_changed_content_or_model(spark):
    a = spark.createDataFrame([("t1", "x"), ("t2", "y")], "track_id string, text string")
    b = spark.createDataFrame([("t1", "x"), ("t2", "changed")], "track_id string, text string")
    cache = V.cache_keys(a, "text", {"dim": 4})
    hits, misses = V.cache_lookup(V.cache_keys(b, "text", {"dim": 4}), cache)
    assert [r.track_id for r in hits.collect()] == ["t1"] and [r.track_id for r in misses.collect()] == ["t2"]
    assert V.cache_lookup(V.cache_keys(b, "text", {"dim": 5}), cache)[0].count() == 0


def test_search_depth():
    assert V.search_depth(3, 10**9) == 60 and V.search_depth(5000, 10**9) == 20000 and V.search_depth(3, 7) == 7


def test_stored_cells_are_searched_with_their_centroids(spark, data, tmp_path):
    _, corpus = data
    path = str(tmp_path / "cells")
    rows = corpus.count()
    V.write_index(V.build_index(corpus.where("cand_id < 'track2'"), {"index_type": "ivf", "nlist": 6}), path)
    first = V.append_to_index(spark, path, corpus).first()
    again = V.append_to_index(spark, path, corpus).first()
    assert first.added_vectors > 0 and again.added_vectors == 0
    index = V.read_index(spark, path)
    assert index.table.count() == index.meta.first().num_vectors == rows
    assert sum(1 for _ in (tmp_path / "cells/vectors").rglob("*.parquet")) <= 3 * 6
    # Every vector finds itself in the one nearest cell.
    turned = corpus.select(corpus.cand_id.alias("query_id"), "vector")
    own = V.ivf_search(turned, index.table, 1, 1, index.centroids)
    assert own.where("similarity > 0.999999").count() == rows
    with pytest.raises(ValueError):
        V.ivf_search(turned, index.table, 1, 1)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 5}, {"broadcast_bytes": 300}])
def test_rows_with_equal_keys_are_queries_of_their_own(spark, options):
    corpus = spark.createDataFrame([(f"c{i}", [float(i == j) for j in range(4)]) for i in range(4)], "cand_id string, vector array<double>")
    rows = [("a", [1.0, 0.5, 0.0, 0.0])] * 2 + [("a", [0.0, 0.0, 1.0, 0.5])] + [("b", [0.0, 0.0, 0.0, 1.0])] * 17
    found = V.knn(spark.createDataFrame(rows, "query_id string, vector array<double>"), corpus, 2, **options)
    got = sorted((r.query_id, r.cand_id, r["rank"]) for r in found.collect())
    assert got == sorted([("a", "c0", 1), ("a", "c1", 2)] * 2 + [("a", "c2", 1), ("a", "c3", 2)] + [("b", "c3", 1), ("b", "c0", 2)] * 17)


@pytest.mark.parametrize("bad", [[1.0, 0.0, 5.0], None, [1.0, None]])
def test_ragged_and_null_vectors_raise(spark, bad):
    query = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    corpus = spark.createDataFrame([("a", [0.0, 1.0]), ("b", bad)], "cand_id string, vector array<double>")
    with pytest.raises(Exception, match="expected|null"):
        V.knn(query, corpus, 1).collect()


def test_depth_of_restricted_search(data):
    queries, corpus = data
    tracks = corpus.selectExpr("split_part(cand_id, '_seg_', 1) AS track_id").distinct()
    deep = V.restricted_search(queries, corpus, tracks)
    segments = {r.query_id: r["count"] for r in queries.groupBy("query_id").count().collect()}
    assert all(r["rank"] <= V.search_depth(segments[r.query_id], corpus.count()) for r in deep.collect())
    assert deep.count() >= V.restricted_search(queries, corpus, tracks, 5).count()


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 5}])
def test_searches_of_nothing_and_in_nothing_are_empty(data, options):
    queries, corpus = data
    assert V.knn(queries.limit(0), corpus, 3, **options).count() == 0
    assert V.knn(queries, corpus.limit(0), 3, **options).count() == 0


def test_a_large_table_is_counted_before_it_is_collected(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "i long, vector array<double>")
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    assert sorted(V._bounded(rows, 20)["i"].to_pylist()) == list(range(20))
    collected = []
    monkeypatch.setattr(type(rows), "toArrow", lambda df: collected.append(df))
    assert V._bounded(rows, 19) is None and V._bounded(rows, 0) is None and not collected
