"""The chain from samples to checks, and what a second run repeats."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark import chain
from earmark.operators import signal as A

RATE = 800
CONFIG = chain.ChainConfig(length_sec=0.5, overlap=0.5, dim=16, sample_rate=RATE, frame=64, nlist=3, k=5)
ALL = ["vectors", "centroids", "placed", "cells", "queries", "hits", "candidates", "summary", "metrics", "checks"]


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(14)
    rows = []
    for t in range(8):
        n = 1600
        v = np.sin(2 * np.pi * (30 + 40 * t) * np.arange(n) / RATE) * (1 + 0.5 * np.sin(2 * np.pi * (t + 1) * np.arange(n) / n)) + 0.05 * rng.normal(size=n)
        rows += [(f"track{t}", i, float(x)) for i, x in enumerate(v)]
    catalogue = spark.createDataFrame(rows, "track_id string, idx bigint, value double").cache()
    asked = A.add_noise(catalogue, 20.0, 1).withColumn("track_id", F.concat("track_id", F.lit("_n"))).select("track_id", "idx", "value").cache()
    truth = spark.createDataFrame([(f"track{t}_n", f"track{t}", "add_noise", "mild", 100.0 + t) for t in range(8)], "query_id string, track_id string, transform_type string, severity string, latency_ms double")
    return catalogue, asked, truth


def test_digest_is_of_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, [2.0]), (2, None, [2.0])], "x int, y string, v array<double>")
    same = chain.table_digest(df)
    assert chain.table_digest(df.repartition(3).select("v", "y", "x")) == same
    assert len({same, chain.table_digest(df.distinct()), chain.table_digest(df.limit(0)), chain.table_digest(df.withColumn("x", F.col("x") + 1)), chain.table_digest(df.withColumnRenamed("x", "z"))}) == 5
    chain.table_digest(df.withColumn("m", F.create_map(F.lit("k"), F.col("x"))))


def test_a_second_run_repeats_only_what_changed(spark, given, tmp_path):
    catalogue, asked, truth = given
    run = lambda c=CONFIG, q=asked: chain.run_chain(spark, str(tmp_path / "stages"), catalogue, q, truth, c)
    first, ran = run()
    assert ran == ALL
    top = {r.query_id: r.cand_id for r in first["candidates"].table.where("rank = 1").collect()}
    assert sum(q.removesuffix("_n") == c for q, c in top.items()) >= 7
    assert run()[1] == []
    assert run(replace(CONFIG, threshold=0.3))[1] == ["candidates", *[n for n in ALL[7:]]]
    assert run(replace(CONFIG, k=4))[1] == ALL[5:]
    assert run(q=asked.withColumn("value", F.col("value") * 0.5))[1][:2] == ["queries", "hits"]
    assert run()[1] == []


def test_a_stopped_stage_runs_again(spark, given, tmp_path):
    catalogue, asked, truth = given
    stages = chain.Stages(spark, str(tmp_path / "stages"))
    source = stages.source(truth)

    def broken(t):
        return t.withColumn("x", F.raise_error(F.lit("stopped")))

    with pytest.raises(Exception, match="stopped"):
        stages.run("a", broken, source)
    again = chain.Stages(spark, str(tmp_path / "stages"))
    assert again.run("a", lambda t: t, source).table.count() == 8 and again.ran == ["a"]
    assert chain.Stages(spark, str(tmp_path / "stages")).run("a", broken, source).table.count() == 8
