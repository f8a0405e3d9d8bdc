"""Recursive filters in blocks against plain loops over whole tracks."""

import math

import numpy as np
import pytest

from earmark.operators import recursive as R

RATE = 1000


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(9)
    return {"a": rng.uniform(-1, 1, 3000), "b": np.r_[np.zeros(300), rng.uniform(-1, 1, 500), np.zeros(200)], "c": np.ones(1)}


@pytest.fixture(scope="module")
def samples(spark, signals):
    rows = [(k, i, float(x)) for k, v in signals.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "track_id string, idx bigint, value double").repartition(5).cache()


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.track_id, {})[r.idx] = r.value
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def plain(x, b, a):
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = (sum(b[i] * x[n - i] for i in range(len(b)) if n >= i) - sum(a[j] * y[n - j] for j in range(1, len(a)) if n >= j)) / a[0]
    return y


FILTERS = {
    "low": R.butterworth("low_pass", 40, RATE, 2)[0], "high": R.butterworth("high_pass", 5, RATE, 2)[0],
    "one pole": ([0.001], [1.0, -0.999]), "three": ([1.0, 0.5, 0.25, 0.1], [2.0, -1.2, 0.5, -0.05]), "none": ([2.0], [1.0]),
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_a_section_in_pieces(name, signals):
    b, a = FILTERS[name]
    section, x = R.Section(b, a), signals["a"]
    y, z = [], np.zeros(section.order)
    for lo, hi in ((0, 7), (7, 7), (7, 1100), (1100, 3000)):
        part, z = section.run(x[lo:hi], z)
        y.append(part)
    assert np.allclose(np.concatenate(y), plain(x, b, a), atol=1e-9)


@pytest.mark.parametrize("block, fan", [(7, 5), (100, 4), (65536, 4096)])
def test_blocks_agree_with_a_plain_loop(samples, signals, block, fan):
    for name in ("low", "one pole"):
        b, a = FILTERS[name]
        got = arrays(R.recursive_filter(samples, b, a, block, fan))
        assert set(got) == set(signals)
        assert all(np.allclose(got[k], plain(signals[k], b, a), atol=1e-9) for k in signals)


def test_zero_phase_keeps_a_pulse_in_place(spark):
    x = np.zeros(801)
    x[400] = 1.0
    samples = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(x)], "track_id string, idx bigint, value double")
    got = arrays(R.recursive_pass(samples, "low_pass", 60, RATE, 4, block=100))["p"]
    assert got.argmax() == 400 and np.allclose(got, got[::-1], atol=1e-9)
    one_way = arrays(R.recursive_pass(samples, "low_pass", 60, RATE, 4, zero_phase=False))["p"]
    assert one_way.argmax() > 400


def test_butterworth_halves_the_power_at_its_edge():
    for kind in ("low_pass", "high_pass"):
        for order in (2, 4, 6):
            z = np.exp(-2j * np.pi * 60 / RATE)
            gain = abs(np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in R.butterworth(kind, 60, RATE, order)]))
            assert gain == pytest.approx(math.sqrt(0.5))
    for bad in (("band", 60, RATE, 2), ("low_pass", 60, RATE, 3), ("low_pass", 600, RATE, 2)):
        with pytest.raises(ValueError):
            R.butterworth(*bad)


@pytest.mark.parametrize("block", [7, 65536])
def test_envelope_agrees_with_a_plain_loop(samples, signals, block):
    got = arrays(R.follow_compress(samples, -20.0, 5.0, 1.0, 3.0, RATE, block))
    attack, release, t = math.exp(-1.0), math.exp(-1 / 3), 0.1
    for k, x in signals.items():
        env = R.followed(x, attack, release)
        y = np.where(env > t, x * (t + (env - t) / 5.0) / np.maximum(env, 1e-12), x)
        assert np.allclose(got[k], y, atol=1e-9)
