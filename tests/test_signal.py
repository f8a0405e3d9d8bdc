import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.functions import registry
from earmark.operators import signal as A

SR = 10
LENGTHS = {"a": 97, "b": 40, "c": 3, "d": 1}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(2)
    return {k: rng.uniform(-1, 1, n) for k, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def samples(spark, signals):
    rows = [(k, i, float(x)) for k, v in signals.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "track_id string, idx bigint, value double").repartition(5).cache()


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.track_id, []).append((r.idx, r.value))
    for k, v in out.items():
        v.sort()
        assert [i for i, _ in v] == list(range(len(v))), k
    return {k: np.array([x for _, x in v]) for k, v in out.items()}


OPERATORS = {
    "crop": lambda s, b: A.crop(s, 1.0, 3.0, SR, b),
    "crop_middle": lambda s, b: A.crop_middle(s, 2.0, SR, b),
    "crop_end": lambda s, b: A.crop_end(s, 2.0, SR, b),
    "slice_chop": lambda s, b: A.slice_chop(s, 1.0, 1.5, SR, b),
    "peak_normalize": lambda s, b: A.peak_normalize(s, 0.5, block=b),
    "limit": lambda s, b: A.limit(s, -1.0, b),
    "compress_envelope": lambda s, b: A.compress_envelope(s, -10.0, 4.0, 900.0, SR, b),
    "add_noise": lambda s, b: A.add_noise(s, 20.0, 1, b),
    "pink": lambda s, b: A.add_colored_noise(s, 20.0, "pink", 1, SR, octaves=3, block=b),
    "reverb": lambda s, b: A.reverb_taps(s, 1200.0, sample_rate=SR, half_width=4, block=b),
    "faster": lambda s, b: A.speed_resample(s, 1.3, b),
    "slower": lambda s, b: A.speed_resample(s, 0.45, b),
    "filter": lambda s, b: A.fir_filter(s, "band_pass", 0.5, 2.0, sample_rate=SR, half_width=11, block=b),
    "multiband": lambda s, b: A.multiband_compress(s, SR, 0.5, 2.0, 6, b),
    "embed": lambda s, b: A.embed_sample(s, s.where("idx < 4"), "middle", 1.5, -3.0, sample_rate=SR, block=b),
    "song": lambda s, b: A.song_in_song(s, s, 1.0, 1.5, 5.0, 0.0, "end", sample_rate=SR, block=b),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_blocks_do_not_show_in_the_result(samples, name):
    """A track cut into blocks of seven samples sounds like one that fits a single block."""
    small, large = arrays(OPERATORS[name](samples, 7)), arrays(OPERATORS[name](samples, 65536))
    assert small.keys() == large.keys()
    for k in small:
        np.testing.assert_allclose(small[k], large[k], atol=1e-12)


def test_crop_lengths(samples):
    got = {k: len(v) for k, v in arrays(A.crop(samples, 1.0, 3.0, SR)).items()}
    assert got == {"a": 30, "b": 30, "c": 3, "d": 1}  # whole track when less than half a second is left
    assert {k: len(v) for k, v in arrays(A.slice_chop(samples, 1.0, 1.0, SR)).items()} == {"a": 77, "b": 20, "c": 3, "d": 1}


def test_crop_middle_is_centred(samples, signals):
    np.testing.assert_allclose(arrays(A.crop_middle(samples, 2.0, SR))["b"], signals["b"][10:30])


def test_filter_is_a_convolution(samples, signals):
    kernel = A.fir_kernel("low_pass", None, 2.0, SR, 5)
    got = arrays(A.fir_filter(samples, "low_pass", None, 2.0, sample_rate=SR, half_width=5))
    for k, v in signals.items():
        np.testing.assert_allclose(got[k], np.convolve(np.pad(v, 5), kernel, "valid"), atol=1e-12)
    assert sum(kernel) == pytest.approx(1.0)
    assert sum(A.fir_kernel("high_pass", 2.0, None, SR, 5)) == pytest.approx(0.0, abs=1e-12)


def test_noise_has_the_wanted_power(spark):
    n = 4000
    tone = spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("idx"), (F.sin(F.col("id") * 0.3) * 0.1).alias("value"))
    clean = arrays(tone)["t"]
    for kind in ("white", "pink", "vinyl"):
        noise = arrays(A.add_colored_noise(tone, 12.0, kind, 4, 1000, clicks_per_second=5.0, click_ms=8.0))["t"] - clean
        snr = 10 * math.log10((clean**2).mean() / (noise**2).mean())
        assert snr == pytest.approx(12.0, abs=0.3 if kind == "white" else 1e-6), kind


def test_noise_is_repeatable_and_seeded(samples):
    one, two = arrays(A.add_noise(samples, 10.0, 1)), arrays(A.add_noise(samples.repartition(3), 10.0, 1))
    np.testing.assert_array_equal(one["a"], two["a"])
    assert not np.allclose(one["a"], arrays(A.add_noise(samples, 10.0, 2))["a"])


def test_resampling_keeps_the_ends(samples, signals):
    for speed in (0.3, 0.9, 1.7):
        got = arrays(A.speed_resample(samples, speed))
        assert len(got["a"]) == int(97 / speed)
        np.testing.assert_allclose(got["a"], np.interp(np.linspace(0, 96, len(got["a"])), np.arange(97), signals["a"]), atol=1e-9)
    assert len(arrays(A.speed_resample(samples, 1.7)).get("d", [])) == 0


def test_reverb(samples, signals):
    got = arrays(A.reverb_taps(samples, 1000.0, 0.5, 0.4, False, SR))["a"]
    want = signals["a"].copy()
    for tap in (10, 13, 17, 21, 27):
        want[tap:] += signals["a"][:-tap] * 0.4 * 0.1
    if np.abs(want).max() > 0.99:
        want /= np.abs(want).max()
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert A.reverb_taps(samples, 0.0) is samples


def test_limit_report(spark):
    df = spark.createDataFrame([("t", i, 1.0 if i < 2 else 0.1) for i in range(8)], "track_id string, idx bigint, value double")
    assert A.limit_report(df, -1.0).first().clip_percentage == 25.0
    assert max(arrays(A.limit(df, 0.0))["t"]) == pytest.approx(10 ** (-3 / 20), rel=1e-6)


def test_tile(samples, signals):
    got = arrays(A.tile(samples, 50, 7))
    np.testing.assert_allclose(got["c"], np.tile(signals["c"], 17)[:50])
    np.testing.assert_allclose(got["a"], signals["a"][:50])


def test_chain_uses_plug_ins_and_skips_unknown_steps(samples, signals):
    registry.transform("negate")(lambda s, factor: s.withColumn("value", -F.col("value") * factor))
    steps = [{"type": "negate", "params": {"factor": 2.0}}, {"type": "nothing"}, {"type": "gain", "params": {"db": -20.0}}]
    np.testing.assert_allclose(arrays(A.apply_chain(samples, steps, SR))["a"], -0.2 * signals["a"])


@pytest.mark.parametrize("overlap", [0.0, 0.5, 0.75])
def test_segments(samples, signals, overlap):
    hop = int(20 * (1 - overlap)) if overlap else 20
    rows = {(r.track_id, r.segment_idx): r for r in A.segment(samples, 2.0, overlap, SR).collect()}
    assert len([1 for t, _ in rows if t == "a"]) == (97 - 20) // hop + 1 and not [1 for t, _ in rows if t == "c"]
    assert rows["a", 1].segment_id == "a_seg_0001" and rows["a", 1].start_sample == hop
    got = {}
    for r in A.segment_samples(samples, 2.0, overlap, SR, block=7).collect():
        got.setdefault((r.track_id, r.segment_idx), {})[r.pos] = r.value
    assert got.keys() == rows.keys()
    for (t, i), parts in got.items():
        np.testing.assert_allclose([parts[p] for p in range(20)], signals[t][i * hop : i * hop + 20])


def test_features_are_unit_vectors(samples):
    for r in A.segment_features(samples, 2.0, 0.5, 7, SR, block=7).collect():
        assert len(r.vector) == 7 and np.linalg.norm(r.vector) == pytest.approx(1.0)


@pytest.mark.parametrize("span", [0, 1, 3, 8, 50, 500])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 200])
def test_sliding_peak(span, n):
    values = np.random.default_rng(n + span).normal(size=n)
    want = [np.abs(values[max(0, i - span) : i + 1]).max() for i in range(n)]
    assert A.sliding_peak(values, span).tolist() == want


@pytest.mark.parametrize("taps", [3, 65, 301])
def test_convolution_by_both_ways(taps):
    rng = np.random.default_rng(taps)
    values, half = rng.normal(size=500), rng.normal(size=taps // 2 + 1)
    kernel = np.concatenate([half[:0:-1], half])
    assert np.allclose(A.convolved(values, kernel), np.convolve(values, kernel)[taps // 2 :][:500], atol=1e-12)


def level(kind, low, high, at, rate=44100):
    kernel = np.array(A.fir_kernel(kind, low, high, rate))
    k = np.arange(len(kernel)) - len(kernel) // 2
    return 20 * np.log10(abs((kernel * np.exp(-2j * np.pi * at / rate * k)).sum()) + 1e-12)


@pytest.mark.parametrize("edge", [250.0, 400.0, 3000.0, 8000.0])
def test_filters_meet_their_edge(edge):
    assert -7 < level("low_pass", None, edge, edge) < -5 and level("low_pass", None, edge, edge / 4) > -0.5
    assert -7 < level("high_pass", edge, None, edge) < -5 and level("high_pass", edge, None, edge / 4) < -40
    if edge * 4 < 22050:
        assert level("low_pass", None, edge, edge * 4) < -40 and level("high_pass", edge, None, edge * 4) > -0.5


def test_chain_refuses_what_it_cannot_do(spark):
    s = spark.createDataFrame([("t", i, 0.1) for i in range(5)], "track_id string, idx long, value double")
    for step in ({"type": "pitch_shift", "params": {"semitones": 2}}, {"type": "re_encode"}, {"type": "speed_change", "params": {"speed": 1.1, "preserve_pitch": "yes"}}):
        with pytest.raises(NotImplementedError):
            A.apply_chain(s, [step])
    with pytest.raises(ValueError):
        A.apply_chain(s, [{"type": "overlay_vocals", "params": {"overlay_path": "none"}}])
    assert A.apply_chain(s, [{"type": "nobody_knows"}]).count() == 5


def test_steps_of_a_plan_have_numbers_as_text(spark):
    s = spark.createDataFrame([("t", i, 0.01 * i) for i in range(50)], "track_id string, idx long, value double")
    steps = [{"type": "gain", "params": {"db": -6.0}}, {"type": "add_noise", "params": {"snr_db": 20, "noise_type": "white", "seed": 3}}]
    text = [{**step, "params": {k: str(v) for k, v in step["params"].items()}} for step in steps]
    first, second = ({r.idx: r.value for r in A.apply_chain(s, x, 10).collect()} for x in (steps, text))
    assert second == pytest.approx(first)
