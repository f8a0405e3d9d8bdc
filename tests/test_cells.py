"""Searches that prune, and versions of a stored index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators import cells as C
from earmark.operators import vectors as V
from earmark.streaming.incremental import follow_index


def frame(spark, name, rows):
    return spark.createDataFrame([(f"{name}{i // 4}_seg_{i % 4:04d}", [float(x) for x in v]) for i, v in enumerate(rows)], f"{name}_id string, vector array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty tight clusters, one with a third of the corpus, and queries near some of them."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(20, 16))
    of = np.append(rng.integers(0, 20, 800), np.full(400, 3))
    corpus = centres[of] + 0.05 * rng.normal(size=(1200, 16))
    corpus[100] = corpus[101]
    queries = corpus[::40] + 0.02 * rng.normal(size=(30, 16))
    return frame(spark, "query", queries).cache(), frame(spark, "cand", corpus).repartition(24).cache()


def hits(found, value="similarity"):
    return sorted((r.query_id, r["rank"], r.cand_id, round(r[value], 9)) for r in found.collect())


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 50}])
def test_bounds_lose_nothing(clustered, metric, options):
    queries, corpus = clustered
    for k in (1, 7, 500, 2000):
        found = C.search_cells(queries, corpus, k, nlist=20, metric=metric, **options)
        assert hits(found.hits) == hits(V.knn(queries, corpus, k, metric))


def test_few_cells_are_compared_where_there_are_clusters(clustered):
    queries, corpus = clustered
    found = C.search_cells(queries, corpus, 5, nlist=20, first=1)
    r = found.compared.agg(F.avg("cells").alias("cells"), F.count("*").alias("n")).first()
    assert r.n == 30 and r.cells <= 6
    bounded = C.search_cells(queries, corpus, 5, nlist=20, first=1, max_cells=2)
    assert bounded.compared.agg(F.max("cells")).first()[0] <= 2 + 1


def test_upper_bounds_hold():
    rng = np.random.default_rng(2)
    for metric in V.METRICS:
        q, members = rng.normal(size=(40, 6)), rng.normal(size=(300, 6)) * rng.uniform(0.2, 3, (300, 1))
        q, members = C._space(q, metric), C._space(members, metric)
        centres = rng.normal(size=(9, 6))
        own = rng.integers(0, 9, 300)
        radius = np.array([np.sqrt(((members[own == c] - centres[c]) ** 2).sum(axis=1)).max() for c in range(9)])
        bounds = C.upper_bounds(q, centres, radius, metric)
        scores = V._scores(q, members, metric)
        for c in range(9):
            assert (scores[:, own == c] <= bounds[:, [c]] + 1e-8).all()


def test_cells_of_odd_sizes(spark, clustered):
    """Empty cells, searches of nothing, and a depth beyond the corpus."""
    queries, corpus = clustered
    far = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([np.eye(16)[:4], 100 * np.eye(16)[:1]]))]
    centroids = spark.createDataFrame(far, "cell_id int, vector array<double>")
    assert hits(C.search_cells(queries, corpus, 3, centroids).hits) == hits(V.knn(queries, corpus, 3))
    assert C.search_cells(queries.limit(0), corpus, 3, centroids).hits.count() == 0
    assert C.search_cells(queries, corpus.limit(2), 9, centroids).hits.count() == 60


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 50}, {"broadcast_bytes": 30 * 16 * 8 - 1, "block_rows": 9}])
def test_depth_of_each_row(clustered, options):
    queries, corpus = clustered
    deep = queries.withColumn("depth", F.when(F.hash("query_id") % 3 == 0, None).otherwise(F.abs(F.hash("query_id")) % 5).cast("int"))
    got = {}
    for r in V.knn(deep, corpus, "depth", **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.cand_id))
    whole = {}
    for r in V.knn(queries, corpus, 5).collect():
        whole.setdefault(r.query_id, []).append((r["rank"], r.cand_id))
    want = {r.query_id: sorted(whole[r.query_id])[: r.depth or 0] for r in deep.collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_no_row_is_searched_deeper_than_it_asks():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    depth = np.array([0, 1, 50, 2, 3])
    best = V._Best(rng.normal(size=(5, 8)), depth, "cosine")
    for lo in range(0, 900, 90):
        best.offer(pa.array([f"c{i}" for i in range(lo, lo + 90)]), rng.normal(size=(90, 8)))
        best.settle()
        assert best.held <= depth.sum()
    assert np.bincount(np.asarray(best.found["row"]), minlength=5).tolist() == depth.tolist()


def test_restricted_search_goes_as_deep_as_each_query_asks(clustered, monkeypatch):
    queries, corpus = clustered
    asked = []
    knn = V.knn
    monkeypatch.setattr(V, "knn", lambda q, c, k, **o: asked.append((k, q.select("_depth").distinct().count())) or knn(q, c, k, **o))
    tracks = corpus.selectExpr("split_part(cand_id, '_seg_', 1) AS track_id").distinct()
    V.restricted_search(queries.withColumn("query_id", F.expr("split_part(query_id, '_seg_', 1)")), corpus, tracks).count()
    assert asked[0][0] == "_depth" and asked[0][1] > 1


def test_a_shared_floor_leaves_few_hits_to_merge(spark):
    rng = np.random.default_rng(5)
    corpus = frame(spark, "cand", rng.normal(size=(6400, 8))).repartition(64).cache()
    queries = frame(spark, "query", rng.normal(size=(40, 8)))
    few = V._few_queries(queries, 10, V.BROADCAST_BYTES)
    schema = V._hit_schema(queries.select("query_id").withColumn(V.ROW, F.lit(0).cast("bigint")), ["query_id", V.ROW], corpus)

    def last(shared):
        return V._hits_of_tasks(spark, few, ["query_id", V.ROW], corpus, schema, 10, "cosine", shared, 3200).count()

    without, pruned = last(False), last(True)
    assert without >= 64 * 40 * 10 * 0.9 and pruned <= 4 * 40 * 10
    assert hits(V.knn(queries, corpus, 10, shared_floor=True, floor_rows=3200)) == hits(V.knn(queries, corpus, 10))


def test_more_centroids_than_a_task_holds(clustered):
    queries, corpus = clustered
    centroids = corpus.limit(40).select(F.monotonically_increasing_id().cast("int").alias("cell_id"), "vector").cache()
    of = lambda df: sorted((r.query_id, r.cell_id) for r in df.collect())
    for n in (1, 3):
        assert of(V.assign_cells(queries, centroids, n, broadcast_bytes=300)) == of(V.assign_cells(queries, centroids, n))


def test_cells_are_trained_on_a_sample(clustered):
    _, corpus = clustered
    assert V.train_cells(corpus, 6, sample_rows=10).count() == 6


# ---------------------------------------------------------------- versions


def ids(index):
    return sorted(r.cand_id for r in index.table.select("cand_id").collect())


@pytest.fixture
def stored(spark, clustered, tmp_path):
    _, corpus = clustered
    path = str(tmp_path / "index")
    V.write_index(V.build_index(corpus.where("cand_id < 'cand2'"), {"index_type": "ivf", "nlist": 8}), path)
    return path, corpus


@pytest.mark.parametrize("stop", ["description", "centroids", "vectors"])
def test_a_stop_between_writes_leaves_the_old_version(spark, stored, monkeypatch, stop):
    path, corpus = stored
    before, queries = ids(V.read_index(spark, path)), corpus.limit(5).withColumnRenamed("cand_id", "query_id")

    def fail(*args, **kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        if stop == "description":
            m.setattr(V, "_write_version", fail)
        elif stop == "centroids":
            m.setattr(C, "measure_cells", fail)
        else:
            whole = V._write_part
            m.setattr(V, "_write_part", lambda table, *a: (whole(table.limit(3), *a), fail()))
        with pytest.raises(RuntimeError):
            V.append_to_index(spark, path, corpus)
    index = V.read_index(spark, path)
    assert ids(index) == before and index.meta.first().num_vectors == len(before)
    V.append_to_index(spark, path, corpus)
    index = V.read_index(spark, path)
    assert ids(index) == ids(V.Index(corpus, None)) and index.meta.first().num_vectors == len(ids(index))
    assert hits(V.ivf_search(queries, index.table, 4, centroids=index.centroids)) == hits(V.knn(queries, corpus, 4))


def test_changed_segments_replace_old_ones(spark, stored):
    path, corpus = stored
    V.append_to_index(spark, path, corpus)
    turned = corpus.where("cand_id LIKE 'cand1%_seg_0002'").withColumn("vector", F.transform("vector", lambda x: -x))
    n = turned.count()
    counts = V.append_to_index(spark, path, turned.unionByName(corpus.limit(0))).first()
    assert (counts.changed_vectors, counts.added_vectors, counts.skipped_vectors) == (n, 0, 0)
    again = V.append_to_index(spark, path, turned).first()
    assert (again.changed_vectors, again.skipped_vectors) == (0, n)
    index = V.read_index(spark, path)
    assert ids(index) == ids(V.Index(corpus, None)) and index.meta.first().num_vectors == corpus.count()
    mine = turned.limit(4).withColumnRenamed("cand_id", "query_id").cache()
    assert all(r.query_id == r.cand_id for r in V.ivf_search(mine, index.table, 1, centroids=index.centroids).collect())
    # Turned back, so the old vector must come to light again, then compacted.
    V.append_to_index(spark, path, corpus)
    V.compact_index(spark, path)
    index = V.read_index(spark, path)
    assert index.table.count() == corpus.count() and [v["parts"] for v in V.index_versions(spark, path)][-1] == [V.index_versions(spark, path)[-1]["version"]]
    back = corpus.where("cand_id LIKE 'cand1%_seg_0002'").limit(4).withColumnRenamed("cand_id", "query_id")
    assert all(r.query_id == r.cand_id for r in V.ivf_search(back, index.table, 1, centroids=index.centroids).collect())
    assert V.read_index(spark, path, 1).table.count() == corpus.where("cand_id < 'cand2'").count()


def test_the_stream_brings_an_index_up_to_date(spark, stored, tmp_path):
    path, corpus = stored
    arriving, state = str(tmp_path / "arriving"), str(tmp_path / "state")
    plain = corpus.select("cand_id", "vector")
    plain.where("cand_id < 'cand5'").write.parquet(arriving)
    follow_index(spark, arriving, path, state).awaitTermination()
    assert ids(V.read_index(spark, path)) == ids(V.Index(corpus.where("cand_id < 'cand5'"), None))
    plain.where("cand_id >= 'cand5'").write.mode("append").parquet(arriving)
    follow_index(spark, arriving, path, state).awaitTermination()
    index = V.read_index(spark, path)
    assert ids(index) == ids(V.Index(corpus, None)) and "cell_id" in index.table.columns
    # A batch that ran before its checkpoint was written runs again and changes nothing.
    versions = len(V.index_versions(spark, path))
    batch = V.index_versions(spark, path)[-1]["batch"]
    turned = corpus.withColumn("vector", F.transform("vector", lambda x: -x))
    assert V.append_to_index(spark, path, turned, batch).first().changed_vectors == 0
    assert len(V.index_versions(spark, path)) == versions
