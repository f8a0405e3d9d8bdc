import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earmark.operators import cells as C
from earmark.operators import vectors as V


def frame(spark, name, m):
    return spark.createDataFrame([(f"{name}{i}", [float(x) for x in v]) for i, v in enumerate(m)], f"{name}_id string, vector array<double>")


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e25])
@pytest.mark.parametrize("block_rows", [7, 8192])
def test_the_best_equal_brute_force_whatever_is_offered(metric, scale, block_rows):
    rng = np.random.default_rng(2)
    c = np.tile(rng.normal(size=(700, 6)), (3, 1))  # each vector three times, so ties go by ids
    c[5] = 0.0
    q = rng.normal(size=(30, 6))
    q[10:20, 2:] = 0.0
    c, q = c * scale, q * scale
    ids = pa.array([f"c{i}" for i in rng.permutation(len(c))])
    depth = np.arange(30) % 5
    best = V._Best(q, depth, metric, block_rows=block_rows)
    for lo in range(0, len(c), 900):
        best.offer(ids.slice(lo, 900), c[lo : lo + 900])
    got = {}
    for r in best.found.to_pylist():
        got.setdefault(r["row"], []).append(r["id"])
    unit = V._unit if metric == "cosine" else lambda m: m
    s, names = V._scores(unit(q), unit(c), metric), ids.to_pylist()
    want = {i: [names[j] for j in sorted(range(len(c)), key=lambda j: (-s[i, j], names[j]))[: depth[i]]] for i in range(30) if depth[i]}
    assert got == want


def test_most_pairs_are_compared_in_single_precision(monkeypatch):
    rng = np.random.default_rng(6)
    made = []
    scores = V._scores
    monkeypatch.setattr(V, "_scores", lambda q, c, m: made.append(len(q) * len(c)) or scores(q, c, m))
    best = V._Best(rng.normal(size=(100, 16)), 10, "cosine")
    best.offer(pa.array([f"c{i}" for i in range(20_000)]), rng.normal(size=(20_000, 16)))
    assert len(best.found) == 1000 and sum(made) < 0.05 * 100 * 20_000


def best_and_compared(q, c, depth, metric, monkeypatch):
    """The best ids of each row, those by brute force, and the share of pairs that were compared."""
    compared = []
    for name in ("_above", "_all"):
        real = getattr(V._Best, name)
        at = -2 if name == "_above" else -1
        monkeypatch.setattr(V._Best, name, lambda self, *a, real=real, at=at: compared.append(len(a[0]) * len(a[at])) or real(self, *a))
    best = V._Best(q, depth, metric)
    ids = pa.array([f"c{i}" for i in np.random.default_rng(1).permutation(len(c))])
    for lo in range(0, len(c), 9000):
        best.offer(ids.slice(lo, 9000), c[lo : lo + 9000])
    got = {}
    for r in best.found.to_pylist():
        got.setdefault(r["row"], []).append(r["id"])
    s, names = V._scores(V._unit(q) if metric == "cosine" else q, V._unit(c) if metric == "cosine" else c, metric), ids.to_pylist()
    depth = np.broadcast_to(depth, len(q))
    want = {i: [names[j] for j in sorted(range(len(c)), key=lambda j: (-s[i, j], names[j]))[: depth[i]]] for i in range(len(q)) if depth[i]}
    return got, want, sum(compared) / (len(q) * len(c))


@pytest.mark.parametrize("metric", ["cosine", "ip"])
@pytest.mark.parametrize("lead", [1, 4])
def test_rows_that_end_in_zeros_meet_few_candidates(metric, lead, monkeypatch):
    rng = np.random.default_rng(9)
    c = V._unit(rng.normal(size=(18_000, 48)))
    c[6000:12_000] = c[:6000]  # ties, and with one element a product is just the length that bounds it
    q = rng.normal(size=(60, 48))
    q[:, lead:] = 0.0
    got, want, share = best_and_compared(q, c, 10, metric, monkeypatch)
    assert got == want
    assert share < 0.4


@pytest.mark.parametrize("lead", [1, 4])
def test_rows_that_end_in_zeros_meet_few_candidates_by_distance(lead, monkeypatch):
    rng = np.random.default_rng(10)
    c = V._unit(rng.normal(size=(18_000, 48)))
    c[6000:12_000] = c[:6000]
    c[7] = 0.0
    q = V._unit(rng.normal(size=(60, 48)))
    q[:, lead:] = 0.0
    q[3] = 0.0
    got, want, share = best_and_compared(q, c, 10, "l2", monkeypatch)
    assert got == want
    assert share < 0.6


def test_rows_of_many_depths_meet_few_candidates(monkeypatch):
    rng = np.random.default_rng(11)
    c = V._unit(rng.normal(size=(18_000, 48)))
    q = rng.normal(size=(90, 48))
    q[30:60, 5:] = 0.0
    q[60:, 2:] = 0.0
    depth = np.array([20, 0, 35] * 30)
    got, want, share = best_and_compared(q, c, depth, "cosine", monkeypatch)
    assert got == want
    assert share < 0.45


def test_memory_does_not_grow_with_what_is_offered():
    rng = np.random.default_rng(6)
    best = V._Best(rng.normal(size=(1000, 4)), 3, "cosine")
    ids, c = pa.array([f"c{i}" for i in range(50_000)]), rng.normal(size=(50_000, 4))
    tracemalloc.start()
    best.offer(ids, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # the scores of all pairs at once have 400 MB


def test_no_row_is_copied_for_the_blocks_of_the_other_side(spark):
    rng = np.random.default_rng(7)
    queries, corpus = frame(spark, "query", rng.normal(size=(50, 4))), frame(spark, "cand", rng.normal(size=(60, 4)))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan(V.knn(queries, corpus, 3, broadcast_bytes=0, block_rows=2))
    centroids = corpus.limit(4).select(F.monotonically_increasing_id().cast("int").alias("cell_id"), "vector").cache()
    assert "explode" not in plan(C.search_cells(queries, corpus, 3, centroids, broadcast_bytes=0, block_rows=2).hits)


def test_many_parts_of_a_corpus_and_buckets_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    queries = frame(spark, "query", rng.normal(size=(90, 4))).withColumn("_bucket", F.hash("query_id") % 3)
    queries = V._number(queries)
    corpus = frame(spark, "cand", rng.normal(size=(120, 4))).withColumn("_bucket", F.hash("cand_id") % 3)
    monkeypatch.setattr(V, "PACK_ROWS", 8)
    schema = V._hit_schema(queries, ["query_id", V.ROW], corpus)
    found = V._blocked_topk(queries, ["query_id", V.ROW], corpus, schema, 200, "ip", 3, part_bytes=2000)
    got = sorted((r.query_id, r.cand_id) for r in found.collect())
    c = corpus.collect()
    assert got == sorted((r.query_id, s.cand_id) for r in queries.collect() for s in c if r["_bucket"] == s["_bucket"])
