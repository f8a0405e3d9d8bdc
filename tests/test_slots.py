"""Slots planned for a wanted recall, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators import slots as S
from earmark.operators import vectors as V

DIM = 16


def frames(spark, corpus, queries):
    c = [(f"t{i // 10}_seg_{i % 10:04d}", [float(x) for x in v]) for i, v in enumerate(corpus)]
    q = [(f"q{i}", i % 3, [float(x) for x in v]) for i, v in enumerate(queries)]
    return (
        spark.createDataFrame(q, "query_id string, segment_idx int, vector array<double>").cache(),
        spark.createDataFrame(c, "cand_id string, vector array<double>").cache(),
    )


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, DIM))
    corpus = (centres[:, None] + 0.1 * rng.normal(size=(60, 50, DIM))).reshape(-1, DIM)
    return frames(spark, corpus, corpus[::7] + 0.05 * rng.normal(size=corpus[::7].shape))


def share_found(hits, exact):
    key = ["query_id", "segment_idx", "cand_id"]
    return exact.join(hits.select(key), key, "left_semi").count() / exact.count()


def test_collisions_are_those_of_random_directions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for distance in (0.1, 0.6):
        y = rng.normal(size=x.shape)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        cosine = 1 - distance**2 / 2
        y = x * cosine + y / np.linalg.norm(y, axis=1, keepdims=True) * np.sqrt(1 - cosine**2)
        directions = rng.normal(size=(4000, 2, DIM))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        cells = [np.floor(np.einsum("nwd,nd->nw", directions, v) / 0.3) for v in (x, y)]
        same = (cells[0] == cells[1]).all(axis=1).mean()
        one, few, all_near = S.collisions(np.array([distance]), DIM, 2, 0.3, (1, 3, 5))
        assert abs(one[0] - same) < 0.05
        assert one[0] <= few[0] <= all_near[0]


def test_wanted_recall_with_few_comparisons(clustered):
    queries, corpus = clustered
    exact = V.knn_cosine(queries, corpus, 10).cache()
    found = S.search_slots(queries, corpus, 10, 0.9)
    assert found.by_slots and found.plan.compared <= 0.2 and found.plan.recall >= 0.9
    assert share_found(found.hits, exact) >= 0.9
    p = found.plan
    pairs = S.slot_pairs(queries, corpus, p.projections, p.bucket_length, p.probes).agg(F.sum("pairs")).first()[0]
    assert pairs < 0.2 * queries.count() * corpus.count()


def test_exact_where_slots_do_not_pay(spark):
    # Without clusters the best hits are hardly nearer than any others.
    rng = np.random.default_rng(6)
    queries, corpus = frames(spark, rng.normal(size=(400, DIM)), rng.normal(size=(60, DIM)))
    found = S.search_slots(queries, corpus, 10, 0.95)
    assert not found.by_slots
    assert share_found(found.hits, V.knn_cosine(queries, corpus, 10)) == 1.0


def test_nothing_to_search(spark, clustered):
    queries, corpus = clustered
    for q, c in ((queries.limit(0), corpus), (queries, corpus.limit(0))):
        found = S.search_slots(q, c, 5)
        assert found.hits.count() == 0 and found.plan.compared == 1.0
    assert S.slot_pairs(queries.limit(0), corpus, [[[1.0] * DIM]], 1.0).count() == 0


def test_copies_and_extra_columns(spark, clustered):
    # A third of the corpus is one vector; a column of the queries has a name that plans use too.
    queries, corpus = clustered
    one = corpus.limit(1).withColumn("cand_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda i: F.concat(F.lit("copy_seg_"), i.cast("string")))))
    hot = corpus.unionByName(one)
    found = S.search_slots(queries.withColumn("pairs", F.lit(1)), hot, 5, 0.9, worth=1.0)
    exact = V.knn_cosine(queries, hot, 5)
    # Copies tie and the smaller id goes first on both ways.
    assert share_found(found.hits, exact) >= 0.9
