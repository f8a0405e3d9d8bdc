"""Group helpers against brute force, with one group that holds most rows and many ties."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.functions.columns import value_bin
from earmark.operators.distribution import exact_quantiles, join_hot, number_all, number_rows, rank_within, runs
from earmark.session import cut_lineage


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 7}"
        value = rng.choice([1.0, 1.0, 0.0, -2.5, rng.uniform(-1, 1), rng.uniform(0, 1000)])
        rows.append((key, i, value))
    return spark.createDataFrame(rows, "k string, i int, v double").cache()


def test_value_bin_never_decreases(spark):
    values = sorted([0.0, -0.0, 1e-12, -1e-12, 0.5, 1.0, 2.0, -3.0, 1e30, -1e30, *np.random.default_rng(1).normal(size=500).tolist()])
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(value_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("tie_block", [None, 64])
def test_rank_within(skewed, tie_block):
    ties = [F.expr(f"i div {tie_block}")] if tie_block else []
    got = {(r.k, r.i): (r.rank, r.n) for r in rank_within(skewed, ["k"], "v", [F.col("i")], "rank", "n", ties).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append(r)
    for k, rows in groups.items():
        for place, r in enumerate(sorted(rows, key=lambda r: (-r.v, r.i)), 1):
            assert got[k, r.i] == (place, len(rows))


def test_number_rows(skewed):
    got = number_rows(skewed, ["k"], {"b": F.expr("i div 100")}, [F.col("i")], "n").collect()
    for k in {r.k for r in got}:
        own = sorted((r.i, r.n) for r in got if r.k == k)
        assert [n for _, n in own] == list(range(len(own)))


def test_number_all(skewed):
    got = number_all(skewed.repartition(7), [F.col("v"), F.col("i")], "n", 1).collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.v, r.i))] == list(range(1, len(got) + 1))


def test_exact_quantiles(skewed):
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(skewed, ["k"], "v", wanted).collect()}
    upper = {r.k: r.m for r in exact_quantiles(skewed, ["k"], "v", {"m": 0.5}, interpolate=False).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append(r.v)
    for k, values in groups.items():
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert upper[k] == sorted(values)[len(values) // 2]


def test_exact_quantiles_without_groups(skewed):
    got = exact_quantiles(skewed, [], "v", {"m": 0.5}).collect()
    assert got[0].m == pytest.approx(np.median([r.v for r in skewed.collect()]))


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
@pytest.mark.parametrize("gaps", [False, True])
def test_runs(spark, block, gaps):
    rng = random.Random(9)
    rows = [("hot" if s else "cold", s, i, rng.choice("aab")) for s in (0, 1, 2) for i in range(60) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "k string, s int, i int, c string")
    got = sorted((r.k, r.c, r.length) for r in runs(df, ["k"], ["s", "i"], "c", block, gaps).collect())
    want, last = [], None
    for k, s, i, c in sorted(rows):
        if last and last[0] == k and last[1] == c and (not gaps or last[2] == i - 1):
            want[-1][2] += 1
        else:
            want.append([k, c, 1])
        last = (k, c, i)
    assert got == sorted(map(tuple, want))


def test_join_hot_keeps_every_row(skewed):
    stats = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k = 'hot'")
    joined = join_hot(skewed, stats, ["k"], F.col("i"))
    assert joined.count() == skewed.count()
    assert joined.where("n IS NOT NULL").count() == skewed.where("k = 'hot'").count()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_statistics_read_from_a_file_are_not_broadcast(spark, tmp_path, how):
    """A row for each of many groups takes little room in a file, and sixteen copies of each row a lot of the driver's memory."""
    spark.createDataFrame([(f"q{i}", i) for i in range(400)] + [(None, -1), ("q7", 700)], "q string, s int").write.parquet(f"{tmp_path}/stats")
    stats = spark.read.parquet(f"{tmp_path}/stats")
    rows = [("q7" if i % 3 else f"q{i}", i) for i in range(600)] + [(None, 600)]
    joined = join_hot(spark.createDataFrame(rows, "q string, i int"), stats, ["q"], F.col("i"), how)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    known = {f"q{i}": [i] for i in range(400)} | {"q7": [7, 700]}
    want = [(q, i, s) for q, i in rows for s in known.get(q, [None] if how == "left" else [])]
    assert sorted(map(repr, map(tuple, joined.collect()))) == sorted(map(repr, want))


def test_written_tables_leave_no_shuffles(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffles()
    written = cut_lineage(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.collect_list("id").alias("ids")))
    for _ in range(100):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left
    assert sorted((r.k, len(r.ids)) for r in written.collect()) == [(k, 100) for k in range(50)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
