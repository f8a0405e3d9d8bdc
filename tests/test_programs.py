"""Variants from a table against the same steps applied one after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.functions import registry
from earmark.operators import programs as V
from earmark.operators import signal as A
from earmark.plans import variants as plans

RATE = 4000
LENGTHS = {"a": 5003, "b": 2100, "c": 3, "d": 1}

STEPS = {
    "copy": [],
    "gain": [("gain", {"db": "-6"})],
    "crop": [("crop", {"start_sec": "0.2", "duration_sec": "0.6"})],
    "crop_rest": [("crop", {"start_sec": "0.3"})],
    "chop": [("slice_chop", {"remove_start": "0.1", "remove_end": "0.15"})],
    "chop_all": [("slice_chop", {"remove_start": "1", "remove_end": "1"})],
    "fast": [("speed_change", {"speed": "1.3"})],
    "slow": [("speed_change", {"rate": "0.61"})],
    "faster_than_some": [("speed_change", {"speed": "2.5"})],
    "white": [("add_noise", {"snr_db": "10", "seed": "5"})],
    "pink": [("add_noise", {"snr_db": "6", "noise_type": "pink", "seed": "3"})],
    "vinyl": [("add_noise", {"snr_db": "6", "noise_type": "vinyl", "seed": "4"})],
    "reverb": [("apply_reverb", {"delay_ms": "40", "wet_mix": "0.5"})],
    "no_reverb": [("apply_reverb", {"delay_ms": "0"})],
    "high": [("high_pass_filter", {"freq_hz": "300"})],
    "low": [("low_pass_filter", {"freq_hz": "700"})],
    "highs": [("boost_highs", {"gain_db": "9", "freq_hz": "900"})],
    "lows": [("boost_lows", {})],
    "phone": [("telephone_filter", {})],
    "compressed": [("apply_compression", {"threshold_db": "-20", "ratio": "4"})],
    "limited": [("apply_limiting", {"ceiling_db": "-9"})],
    "bands": [("apply_multiband_compression", {})],
    "mixed": [("overlay_vocals", {"overlay_path": "other", "level_db": "3"})],
    "unknown": [("not_a_transform", {"x": "1"}), ("gain", {"db": "2"})],
    "chain": [
        ("gain", {"db": "3"}), ("slice_chop", {"remove_start": "0.05", "remove_end": "0.05"}), ("speed_change", {"speed": "0.9"}),
        ("add_noise", {"snr_db": "20", "noise_type": "pink"}), ("apply_reverb", {"delay_ms": "15"}), ("apply_multiband_compression", {}),
        ("apply_limiting", {"ceiling_db": "-3"}),
    ],
}


def as_steps(steps):
    return [{"type": kind, "params": params} for kind, params in steps]


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, float(x)) for k, n in LENGTHS.items() for i, x in enumerate(rng.uniform(-1, 1, n) * np.sin(np.arange(n) / 400))]
    return spark.createDataFrame(rows, "track_id string, idx bigint, value double").repartition(5).cache()


@pytest.fixture(scope="module")
def other(samples):
    # Shorter than its track in one case, missing in another.
    return samples.where("track_id <> 'd' AND idx < 3000").withColumn("value", F.col("value") * F.col("value")).cache()


def table(spark, steps, tracks=tuple(LENGTHS)):
    rows = [(t, name, [(kind, params) for kind, params in given]) for name, given in steps.items() for t in tracks]
    return spark.createDataFrame(rows, f"track_id string, variant_id string, steps {V.STEPS}")


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.variant_id, r.track_id), {})[r.idx] = r.value
    for values in out.values():
        assert sorted(values) == list(range(len(values)))
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


@pytest.fixture(scope="module")
def one_by_one(spark, samples, other):
    parts = [
        A.apply_chain(samples, as_steps(steps), RATE, overlays={"other": other}).select("track_id", F.lit(name).alias("variant_id"), "idx", "value")
        for name, steps in STEPS.items()
    ]
    out = {}
    for part in parts:
        out |= arrays(part)
    return out


@pytest.mark.parametrize("block", [211, A.BLOCK])
def test_same_as_steps_one_by_one(spark, samples, other, one_by_one, block):
    got = arrays(V.apply_programs(samples, table(spark, STEPS), RATE, block, {"other": other}))
    assert set(got) == set(one_by_one)
    for key, expected in one_by_one.items():
        assert got[key].shape == expected.shape, key
        np.testing.assert_allclose(got[key], expected, rtol=0, atol=1e-9, err_msg=str(key))


def test_tracks_have_their_own_variants(spark, samples):
    rows = [("a", "v", [("gain", {"db": "6"})]), ("b", "v", [("gain", {"db": "-6"})]), ("b", "w", None), ("zz", "v", []), (None, "v", []), ("a", None, [])]
    plan = spark.createDataFrame(rows, f"track_id string, variant_id string, steps {V.STEPS}").withColumn("value", F.lit(1)).withColumn("blk", F.lit(1))
    got = arrays(V.apply_programs(samples, plan, RATE, 500))
    plain = arrays(samples.withColumn("variant_id", F.lit("x")))
    assert set(got) == {("v", "a"), ("v", "b"), ("w", "b")}
    np.testing.assert_allclose(got["v", "a"], plain["x", "a"] * 10 ** 0.3)
    np.testing.assert_allclose(got["v", "b"], plain["x", "b"] * 10 ** -0.3)
    np.testing.assert_array_equal(got["w", "b"], plain["x", "b"])


def test_nothing_to_do(spark, samples):
    assert V.apply_programs(samples.limit(0), table(spark, STEPS), RATE, overlays={"other": samples}).count() == 0
    assert V.apply_programs(samples, table(spark, STEPS).limit(0), RATE).count() == 0


def test_plan_does_not_grow_with_variants(spark, samples):
    def size(count):
        steps = {f"v{i}": [("gain", {"db": str(-i / 100)}), ("speed_change", {"speed": str(1 + i / 5000)})] for i in range(count)}
        made = V.apply_programs(samples, table(spark, steps, ("b", "c")), RATE)
        return len(made._jdf.queryExecution().analyzed().toString().splitlines()), made

    few, _ = size(3)
    many, made = size(1000)
    assert few == many
    counted = made.groupBy("track_id").agg(F.countDistinct("variant_id").alias("v"), F.count("*").alias("n")).collect()
    assert {r.track_id: r.v for r in counted} == {"b": 1000, "c": 1000}
    assert {r.track_id: r.n for r in counted}["b"] == sum(int(2100 / (1 + i / 5000)) for i in range(1000))


def test_hot_tracks_are_dealt_by_block(spark):
    # A third of all rows is one track; no task of a pass has more than a part of it.
    hot = spark.range(60_000).select(F.lit("hot").alias("track_id"), F.col("id").alias("idx"), F.sin("id").alias("value"))
    small = spark.range(120_000).select(F.concat(F.lit("t"), F.floor(F.col("id") / 1000)).alias("track_id"), (F.col("id") % 1000).alias("idx"), F.cos("id").alias("value"))
    samples = hot.unionByName(small)
    plan = samples.select("track_id").distinct().select("track_id", F.lit("v").alias("variant_id"), F.lit(None).cast(V.STEPS).alias("steps"))
    plan = plan.withColumn("steps", F.array(F.struct(F.lit("low_pass_filter").alias("type"), F.create_map(F.lit("freq_hz"), F.lit("500")).alias("params"))))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, "true") for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        made = V.apply_programs(samples, plan, RATE, 1000)
        by_task = [r["count"] for r in made.where("track_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(by_task) == 60_000
    assert len(by_task) >= 12 and max(by_task) <= 15_000


def test_refused_steps(spark, samples):
    with pytest.raises(ValueError, match="no overlay signal"):
        V.apply_programs(samples, table(spark, {"x": STEPS["mixed"]}), RATE)
    with pytest.raises(ValueError, match="twice"):
        V.apply_programs(samples, table(spark, {"x": []}, ("a", "a")), RATE)
    with pytest.raises(Exception, match="pitch_shift is not supported"):
        V.apply_programs(samples, table(spark, {"x": [("pitch_shift", {})]}), RATE)
    registry.transform("plugged_in")(lambda s: s)
    try:
        with pytest.raises(Exception, match="use apply_chain"):
            V.apply_programs(samples, table(spark, {"x": [("plugged_in", {})]}), RATE)
    finally:
        registry._transforms.pop("plugged_in")


def test_steps_of_a_plan(spark, samples):
    matrix = {
        "gain": {"enabled": True, "parameters": [{"db": -3, "severity": "mild"}, {"db": -9, "severity": "severe"}]},
        "combine_chain": {"enabled": True, "chains": [{"name": "c", "severity": "mild", "transforms": [
            {"type": "gain", "params": {"db": 6}}, {"type": "slice_chop", "params": {"remove_start": 0.1}}, {"type": "gain", "params": {"db": -6}}]}]},
    }
    tracks = spark.createDataFrame([("a",), ("b",)], "id string")
    plan = V.steps_of_plan(plans.expand_matrix(tracks, matrix), plans.expand_chains(tracks, matrix))
    got = arrays(V.apply_programs(samples, plan, RATE, 700))
    assert len(got) == 6 and len({v for v, _ in got}) == 6
    plain = arrays(samples.withColumn("variant_id", F.lit("x")))
    chained = [v for (name, track), v in got.items() if track == "a" and len(v) != LENGTHS["a"]]
    assert len(chained) == 1
    np.testing.assert_allclose(chained[0], plain["x", "a"][400:])
