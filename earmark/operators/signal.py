"""Signal transforms over `samples(track_id, idx, value)`, for all tracks in one job.

`idx` counts from 0 without gaps. A recording may be very long, so no operator puts a whole track
into one task. A track is cut into blocks of `block` samples: `(track_id, block)` is the key of
joins and windows, neighbouring samples that a window needs are copied into the block as a halo,
and statistics of a track are summed first and then joined back once for each block.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.functions import registry
from earmark.functions.columns import segment_id
from earmark.operators.vectors import l2_normalize
from earmark.session import cut_lineage

SAMPLE_RATE = 44100
BLOCK = 65536
# Kernels from this length on are multiplied in the frequency domain.
LONG_KERNEL = 192

# Send the block functions to workers with the task, so they need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------- blocks


def with_stats(samples: DataFrame, *aggs: Column, block: int = BLOCK) -> DataFrame:
    """Add `n`, the length of the track, and further statistics of the track to each sample."""
    stats = samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), *aggs)
    per_block = stats.withColumn("_blk", F.explode(F.expr(f"sequence(0L, bigint((n - 1) div {block}))")))
    return samples.withColumn("_blk", F.expr(f"bigint(idx div {block})")).join(per_block, ["track_id", "_blk"]).drop("_blk")


def windowed(samples: DataFrame, before: int, after: int, columns: Callable[[W], Mapping[str, Column]], block: int = BLOCK) -> DataFrame:
    """Add columns computed over a window in sample order that reaches `before` and `after` samples far."""
    reach = F.expr(f"sequence(greatest(0L, bigint((idx - {after}) div {block})), bigint((idx + {before}) div {block}))")
    in_order = W.partitionBy("track_id", "_blk").orderBy("idx")
    return (
        samples.withColumn("_blk", F.explode(reach))
        .withColumns(dict(columns(in_order)))
        .where(F.expr(f"idx div {block} = _blk"))
        .drop("_blk")
    )


def blockwise(samples: DataFrame, before: int, after: int, sources: Sequence[str], made: Mapping[str, Callable[[Mapping[str, np.ndarray]], np.ndarray]], block: int = BLOCK) -> DataFrame:
    """Add columns made from whole arrays of samples, one array for each block.

    Each function gets the columns `sources` of a block as arrays in sample order, which reach `before`
    and `after` samples beyond the block as far as the track goes, and returns one as long.
    """
    reach = F.expr(f"sequence(greatest(0L, bigint((idx - {after}) div {block})), bigint((idx + {before}) div {block}))")
    schema = T.StructType([*samples.schema.fields, *[T.StructField(name, T.DoubleType()) for name in made]])
    names = schema.fieldNames()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        own = rows["idx"].to_numpy() // block == key[1].as_py()
        arrays = {c: rows[c].to_numpy() for c in sources}
        kept = rows.filter(pa.array(own))
        for name, fn in made.items():
            kept = kept.append_column(name, pa.array(fn(arrays)[own]))
        return kept.select(names)

    return samples.withColumn("_blk", F.explode(reach)).groupBy("track_id", "_blk").applyInArrow(run, schema)


def sliding_peak(values: np.ndarray, span: int) -> np.ndarray:
    """Largest size among each sample and the `span` before it, in two passes whatever the span.

    The array is cut at multiples of the window. Running maxima from the left and from the right of
    each piece cover any window that reaches over one cut.
    """
    width, n = span + 1, len(values)
    padded = np.zeros(-(-n // width) * width)
    padded[:n] = np.abs(values)
    pieces = padded.reshape(-1, width)
    left = np.maximum.accumulate(pieces, axis=1).ravel()
    right = np.maximum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(n) - span
    return np.where(first >= 0, np.maximum(left[:n], right[np.maximum(first, 0)]), np.maximum.accumulate(padded[:n]) if n else left[:n])


def convolved(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The signal filtered by a symmetric kernel; it is zero outside the array."""
    half, n = len(kernel) // 2, len(values)
    if len(kernel) < LONG_KERNEL:
        return np.convolve(values, kernel)[half : half + n]
    size = 1 << (n + len(kernel) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(values, size) * np.fft.rfft(kernel, size), size)[half : half + n]


def _plain(samples: DataFrame, value: Column | str = "value") -> DataFrame:
    return samples.select("track_id", "idx", F.col(value).alias("value") if isinstance(value, str) else value.alias("value"))


def db_to_linear(db: float) -> float:
    return 10.0 ** (db / 20.0)


def _peak() -> Column:
    return F.max(F.abs("value")).alias("_peak")


# ---------------------------------------------------------------- A1 - A3


def _cut(sized: DataFrame, start: Column, end: Column, sample_rate: int) -> DataFrame:
    """Samples from `start` to before `end`; the whole track when less than half a second is left."""
    short = (end - start) < sample_rate * 0.5
    cut = sized.withColumn("_from", F.when(short, 0).otherwise(start)).withColumn("_to", F.when(short, F.col("n")).otherwise(end))
    return cut.where((F.col("idx") >= F.col("_from")) & (F.col("idx") < F.col("_to"))).select(
        "track_id", (F.col("idx") - F.col("_from")).alias("idx"), "value"
    )


def _crop_at(sized: DataFrame, start_sec: Column, duration_sec: float | None, sample_rate: int) -> DataFrame:
    start = F.greatest(F.lit(0), F.least((start_sec * sample_rate).cast("bigint"), F.col("n") - 1))
    end = F.col("n") if duration_sec is None else F.least(start + int(duration_sec * sample_rate), F.col("n"))
    return _cut(sized, start, end, sample_rate)


def crop(samples: DataFrame, start_sec: float, duration_sec: float | None, sample_rate: int = SAMPLE_RATE, block: int = BLOCK) -> DataFrame:
    return _crop_at(with_stats(samples, block=block), F.lit(float(start_sec)), duration_sec, sample_rate)


def crop_first(samples: DataFrame, duration_sec: float = 10.0, sample_rate: int = SAMPLE_RATE, block: int = BLOCK) -> DataFrame:
    return crop(samples, 0.0, duration_sec, sample_rate, block)


def crop_middle(samples: DataFrame, duration_sec: float = 10.0, sample_rate: int = SAMPLE_RATE, block: int = BLOCK) -> DataFrame:
    spare = F.col("n") / sample_rate - duration_sec
    return _crop_at(with_stats(samples, block=block), F.when(spare < 0, 0.0).otherwise(spare / 2.0), duration_sec, sample_rate)


def crop_end(samples: DataFrame, duration_sec: float = 10.0, sample_rate: int = SAMPLE_RATE, block: int = BLOCK) -> DataFrame:
    spare = F.col("n") / sample_rate - duration_sec
    return _crop_at(with_stats(samples, block=block), F.when(spare < 0, 0.0).otherwise(spare), duration_sec, sample_rate)


def slice_chop(samples: DataFrame, head_sec: float, tail_sec: float, sample_rate: int = SAMPLE_RATE, block: int = BLOCK) -> DataFrame:
    """Drop seconds from both ends."""
    start = F.least(F.lit(int(head_sec * sample_rate)), F.col("n"))
    end = F.greatest(start, F.col("n") - int(tail_sec * sample_rate))
    return _cut(with_stats(samples, block=block), start, end, sample_rate)


# ---------------------------------------------------------------- A4 - A8


def gain_db(samples: DataFrame, db: float) -> DataFrame:
    return samples.withColumn("value", F.col("value") * db_to_linear(db))


def peak_normalize(samples: DataFrame, threshold: float = 1.0, to: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Scale a track to peak `to` when its peak is above the threshold."""
    scaled = F.when(F.col("_peak") > threshold, F.col("value") / F.col("_peak") * to).otherwise(F.col("value"))
    return _plain(with_stats(samples, _peak(), block=block), scaled)


def _ceiling(ceiling_db: float) -> Column:
    """The requested ceiling, or 3 dB below the peak when that is lower."""
    peak_db = 20.0 * F.log10(F.col("_peak") + 1e-10)
    return F.pow(F.lit(10.0), F.least(F.lit(ceiling_db), peak_db - 3.0) / 20.0)


def limit(samples: DataFrame, ceiling_db: float, block: int = BLOCK) -> DataFrame:
    """Clip at the ceiling; a result above 0.99 is scaled down to it."""
    sized = with_stats(samples, _peak(), block=block).withColumn("_top", _ceiling(ceiling_db))
    clipped = F.greatest(-F.col("_top"), F.least(F.col("_top"), F.col("value")))
    left = F.least("_peak", "_top")
    return _plain(sized, F.when(left > 0.99, clipped / left * 0.99).otherwise(clipped))


def limit_report(samples: DataFrame, ceiling_db: float, block: int = BLOCK) -> DataFrame:
    """Share of samples that `limit` clips, in percent of each track."""
    sized = with_stats(samples, _peak(), block=block).withColumn("_top", _ceiling(ceiling_db))
    clipped = F.count_if(F.abs("value") > F.col("_top"))
    return sized.groupBy("track_id").agg((clipped / F.count(F.lit(1)) * 100).alias("clip_percentage"))


def compress_static(samples: DataFrame, threshold_db: float, ratio: float) -> DataFrame:
    """Reduce what is above the threshold by the ratio, sample by sample."""
    t = db_to_linear(threshold_db)
    size = F.abs("value")
    return samples.withColumn("value", F.when(size > t, F.signum("value") * (t + (size - t) / ratio)).otherwise(F.col("value")))


def _compressed(value: Column, envelope: Column, threshold: Column, ratio: float) -> Column:
    return F.when(envelope > threshold, value * ((threshold + (envelope - threshold) / ratio) / envelope)).otherwise(value)


def compress_envelope(
    samples: DataFrame, threshold_db: float, ratio: float, release_ms: float = 100.0, sample_rate: int = SAMPLE_RATE, block: int = BLOCK
) -> DataFrame:
    """Reduce the level while the sliding peak of the last `release_ms` is above the threshold."""
    span = int(release_ms * sample_rate / 1000.0)
    enveloped = blockwise(samples, span, 0, ["value"], {"_env": lambda a: sliding_peak(a["value"], span)}, block)
    reduced = _plain(enveloped, _compressed(F.col("value"), F.col("_env"), F.lit(db_to_linear(threshold_db)), ratio))
    return peak_normalize(reduced, 1.0, 0.99, block)


# ---------------------------------------------------------------- A9 - A11


def overlay_mix(samples: DataFrame, other: DataFrame, level_db: float = -6.0, block: int = BLOCK) -> DataFrame:
    """Add a second signal of the same track id at a level, as long as the shorter of both."""
    second = other.select("track_id", "idx", F.col("value").alias("_other"))
    mixed = samples.join(second, ["track_id", "idx"]).withColumn("value", F.col("value") + F.col("_other") * db_to_linear(level_db))
    return peak_normalize(_plain(mixed), 1.0, block=block)


def uniforms(*key: Column | str) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from the digest of a key, the same on every run and partitioning."""
    digest = F.md5(F.concat_ws("|", *key).cast("binary"))
    number = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return number(1), number(9)


def hashed_normal(*key: Column | str) -> Column:
    """A standard normal number from a key (Box-Muller)."""
    u1, u2 = uniforms(*key)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def _power() -> Column:
    return F.avg(F.col("value") * F.col("value")).alias("_power")


def add_noise(samples: DataFrame, snr_db: float, seed: int, block: int = BLOCK) -> DataFrame:
    """Add white noise at a signal-to-noise ratio."""
    spread = F.sqrt(F.col("_power") / 10.0 ** (snr_db / 10.0))
    noise = hashed_normal(F.lit(str(seed)), F.col("track_id").cast("string"), F.col("idx").cast("string"))
    noisy = with_stats(samples, _power(), block=block).withColumn("value", F.col("value") + noise * spread)
    return peak_normalize(_plain(noisy), 1.0, block=block)


def add_colored_noise(
    samples: DataFrame,
    snr_db: float,
    kind: str,
    seed: int,
    sample_rate: int = SAMPLE_RATE,
    octaves: int = 8,
    clicks_per_second: float = 2.0,
    click_ms: float = 1.0,
    half_width: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add pink noise, or the clicks and the hiss of a record, at a signal-to-noise ratio.

    Pink noise is the sum of white noises that are held for 1, 2, 4, ... samples.
    """
    key = [F.lit(str(seed)), F.col("track_id").cast("string")]
    sized = with_stats(samples, _power(), block=block).withColumn("_wanted", F.col("_power") / 10.0 ** (snr_db / 10.0))
    if kind == "pink":
        held = [hashed_normal(*key, F.shiftright("idx", k).cast("string"), F.lit(str(k))) for k in range(octaves)]
        parts = sized.withColumn("_noise", sum(held[1:], held[0]))
    elif kind in ("vinyl", "crackle"):
        raw = sized.withColumn("_v", F.col("value")).withColumn(
            "value", hashed_normal(*key, F.col("idx").cast("string")) * F.sqrt(F.col("_wanted") * 0.3)
        )
        kernel = fir_kernel("high_pass", 5000.0, None, sample_rate, half_width)
        hiss = _convolve(raw, {"_hiss": kernel}, block)
        clicks = _clicks(samples, seed, sample_rate, clicks_per_second, click_ms)
        parts = (
            hiss.join(clicks, ["track_id", "idx"], "left")
            .withColumn("_noise", F.col("_hiss") + F.coalesce("_click", F.lit(0.0)))
            .withColumn("value", F.col("_v"))
        )
    else:
        return add_noise(samples, snr_db, seed, block)
    made = cut_lineage(parts.select("track_id", "idx", "value", "_noise", "_wanted"))
    scaled = with_stats(made, F.avg(F.col("_noise") * F.col("_noise")).alias("_got"), block=block)
    factor = F.when(F.col("_got") > 0, F.sqrt(F.col("_wanted") / F.col("_got"))).otherwise(1.0)
    return peak_normalize(_plain(scaled, F.col("value") + F.col("_noise") * factor), 1.0, block=block)


def _clicks(samples: DataFrame, seed: int, sample_rate: int, per_second: float, click_ms: float) -> DataFrame:
    """Decaying 8 kHz bursts at hashed places; bursts that meet add up."""
    half = int(sample_rate * click_ms / 1000.0) // 2
    place, size = uniforms(F.lit(str(seed)), F.col("track_id").cast("string"), F.lit("click"), F.col("_j").cast("string"))
    count = (F.col("n") / sample_rate * per_second).cast("bigint")
    starts = (
        samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
        .where(count > 0)
        .withColumn("_j", F.explode(F.sequence(F.lit(1).cast("bigint"), count)))
        .withColumn("_at", F.floor(place * F.col("n")))
        .withColumn("_size", size + 0.5)
        .withColumn("_from", F.greatest(F.lit(0), F.col("_at") - half))
        .withColumn("_len", F.least("n", F.col("_at") + half) - F.col("_from"))
        .where(F.col("_len") > 0)
    )
    t = F.when(F.col("_len") > 1, F.col("_i") / (F.col("_len") - 1)).otherwise(0.0)
    burst = F.exp(-50.0 * t) * F.sin(2.0 * math.pi * 8000.0 * t) * F.col("_size")
    return (
        starts.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_len") - 1)))
        .groupBy("track_id", (F.col("_from") + F.col("_i")).alias("idx"))
        .agg(F.sum(burst).alias("_click"))
    )


# ---------------------------------------------------------------- A12, A13

# Delays of the echoes as multiples of the first one.
TAP_FACTORS = (1.0, 1.3, 1.7, 2.1, 2.7)


def reverb_taps(
    samples: DataFrame,
    delay_ms: float,
    wet: float = 0.3,
    decay: float = 0.5,
    smooth: bool = True,
    sample_rate: int = SAMPLE_RATE,
    half_width: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add five echoes, low-passed at 8 kHz when `smooth`.

    Echoes later than the end of the track are dropped and the others share the weight. A track
    that ends before the first echo gets one echo of its first sample at its last.
    """
    if delay_ms <= 0:
        return samples
    first = max(1, int(delay_ms / 1000.0 * sample_rate))
    taps = [int(first * f) for f in TAP_FACTORS]
    sized = with_stats(samples, F.max(F.when(F.col("idx") == 0, F.col("value"))).alias("_head"), block=block)
    echoed = windowed(sized, max(taps), 0, lambda w: {f"_t{i}": F.lag("value", tap, 0.0).over(w) for i, tap in enumerate(taps)}, block)
    fitting = sum((F.lit(tap) < F.col("n")).cast("int") for tap in taps)
    echoes = sum(F.when(F.lit(tap) < F.col("n"), F.col(f"_t{i}")).otherwise(0.0) for i, tap in enumerate(taps))
    short = F.when((F.col("idx") == F.col("n") - 1) & (F.col("n") > 1), F.col("_head") * (decay * wet)).otherwise(0.0)
    tail = F.when(fitting > 0, echoes * decay * (F.lit(wet) / fitting)).otherwise(short)
    out = _plain(echoed, F.col("value") + tail)
    if smooth:
        cutoff = min(8000.0, sample_rate * 0.5 * 0.8)
        out = fir_filter(out, "low_pass", None, cutoff, sample_rate=sample_rate, half_width=half_width, block=block)
    return peak_normalize(out, 0.99, block=block)


def speed_resample(samples: DataFrame, speed: float, block: int = BLOCK) -> DataFrame:
    """Play faster or slower: linear interpolation on an even grid of `int(n / speed)` points.

    Every source sample yields the grid points between itself and the next one, by whole-number
    arithmetic, so nothing is joined.
    """
    paired = windowed(with_stats(samples, block=block), 0, 1, lambda w: {"_next": F.lead("value").over(w)}, block)
    m = F.floor(F.col("n") / F.lit(float(speed))).cast("bigint")
    sized = paired.withColumn("_m", m).where(F.col("_m") > 0)
    last, points = F.col("n") - 1, F.col("_m") - 1
    single = (points == 0) | (last == 0)
    low = F.expr("(idx * (_m - 1) + n - 2) div (n - 1)")
    high = F.expr("((idx + 1) * (_m - 1) + n - 2) div (n - 1) - 1")
    from_j = F.when(single, F.lit(0)).otherwise(low)
    to_j = F.when(points == 0, F.when(F.col("idx") == 0, 0).otherwise(-1)).when(last == 0, points).otherwise(
        F.when(F.col("idx") == last, points).otherwise(high)
    )
    grid = sized.withColumns({"_lo": from_j.cast("bigint"), "_hi": to_j.cast("bigint")}).where("_lo <= _hi")
    spread = grid.withColumn("_j", F.explode(F.sequence("_lo", "_hi")))
    share = F.when(single, 0.0).otherwise((F.col("_j") * last - F.col("idx") * points) / points)
    value = F.col("value") + F.coalesce(F.col("_next") - F.col("value"), F.lit(0.0)) * share
    return spread.select("track_id", F.col("_j").alias("idx"), value.alias("value"))


# ---------------------------------------------------------------- A14, A15


def _clamped(freq: float, sample_rate: int, low: float = 0.01, high: float = 0.99) -> float:
    """Frequency as a share of the highest one the rate can hold, kept inside the band."""
    return max(low, min(high, freq / (sample_rate * 0.5)))


def _low_pass(share: float, half_width: int) -> list[float]:
    taps = []
    for k in range(-half_width, half_width + 1):
        ideal = share if k == 0 else math.sin(math.pi * share * k) / (math.pi * k)
        taps.append(ideal * (0.54 + 0.46 * math.cos(math.pi * k / (half_width + 1))))
    total = sum(taps)
    return [t / total for t in taps]


def kernel_half_width(edge_hz: float, sample_rate: int) -> int:
    """Samples on each side of a kernel whose transition is as wide as its edge frequency.

    So a low-pass is down by half at its edge and by far more at twice the edge, at any rate.
    """
    # Fixed value: transition of a Hamming window in multiples of rate / length.
    return max(1, math.ceil(3.3 / _clamped(edge_hz, sample_rate)))


def fir_kernel(kind: str, low_hz: float | None, high_hz: float | None, sample_rate: int, half_width: int | None = None) -> list[float]:
    """Symmetric windowed-sinc kernel, so the filter does not shift the signal.

    Its length follows from the lowest edge and the rate unless `half_width` is given.
    """
    if half_width is None:
        half_width = kernel_half_width(min(f for f in (low_hz, high_hz) if f is not None), sample_rate)
    unit = [1.0 if k == half_width else 0.0 for k in range(2 * half_width + 1)]
    if kind in ("low_pass", "boost_lows"):
        return _low_pass(_clamped(high_hz, sample_rate), half_width)
    if kind in ("high_pass", "boost_highs"):
        return [u - t for u, t in zip(unit, _low_pass(_clamped(low_hz, sample_rate), half_width))]
    if kind == "band_pass":
        low = _clamped(low_hz, sample_rate, high=0.98)
        high = max(low + 0.01, min(0.99, high_hz / (sample_rate * 0.5)))
        return [b - a for a, b in zip(_low_pass(low, half_width), _low_pass(high, half_width))]
    raise ValueError(f"unknown filter: {kind}")


def _convolve(samples: DataFrame, kernels: Mapping[str, Sequence[float]], block: int) -> DataFrame:
    """Add one filtered copy of the signal for each kernel; the signal is zero outside the track."""
    half = max(len(k) for k in kernels.values()) // 2
    made = {name: (lambda a, k=np.array(kernel): convolved(a["value"], k)) for name, kernel in kernels.items()}
    return blockwise(samples, half, half, ["value"], made, block)


def fir_filter(
    samples: DataFrame,
    kind: str,
    low_hz: float | None = None,
    high_hz: float | None = None,
    gain: float | None = None,
    sample_rate: int = SAMPLE_RATE,
    half_width: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Low-pass, high-pass, band-pass, or a boost of the lows or highs by `gain` dB.

    `low_hz` is the lower edge of what passes and `high_hz` the upper one. Edges are held between 1 %
    and 99 % of the highest frequency. The kernel is as long as its lowest edge needs.
    """
    filtered = _convolve(samples, {"_band": fir_kernel(kind, low_hz, high_hz, sample_rate, half_width)}, block)
    if not kind.startswith("boost"):
        return _plain(filtered, "_band")
    boosted = _plain(filtered, F.col("value") + F.col("_band") * (db_to_linear(gain) - 1.0))
    return peak_normalize(boosted, 0.99, block=block)


# Edge, distance of the threshold below the band's peak, fallback threshold and ratio.
BANDS = {"low": (6.0, -15.0, 6.0), "mid": (5.0, -12.0, 10.0), "high": (7.0, -18.0, 5.0)}
LOW_EDGE_HZ, HIGH_EDGE_HZ = 400.0, 4000.0


def multiband_compress(
    samples: DataFrame, sample_rate: int = SAMPLE_RATE, low_edge_hz: float = LOW_EDGE_HZ, high_edge_hz: float = HIGH_EDGE_HZ,
    half_width: int | None = None, block: int = BLOCK
) -> DataFrame:
    """Compress lows, mids and highs on their own and add them up again."""
    kernels = {
        "_low": fir_kernel("low_pass", None, low_edge_hz, sample_rate, half_width),
        "_high": fir_kernel("high_pass", high_edge_hz, None, sample_rate, half_width),
    }
    split = cut_lineage(
        _convolve(samples, kernels, block)
        .withColumn("_mid", F.col("value") - F.col("_low") - F.col("_high"))
        .select("track_id", "idx", "_low", "_mid", "_high")
    )
    peaks = [F.max(F.abs(f"_{b}")).alias(f"_peak_{b}") for b in BANDS]
    span = int(50.0 * sample_rate / 1000.0)
    made = {f"_env_{b}": (lambda a, c=f"_{b}": sliding_peak(a[c], span)) for b in BANDS}
    enveloped = blockwise(with_stats(split, *peaks, block=block), span, 0, [f"_{b}" for b in BANDS], made, block)
    total = None
    for band, (below, fallback, ratio) in BANDS.items():
        peak_db = 20.0 * F.log10(F.col(f"_peak_{band}") + 1e-10)
        threshold = F.pow(F.lit(10.0), F.when(peak_db > -60, peak_db - below).otherwise(fallback) / 20.0)
        part = _compressed(F.col(f"_{band}"), F.col(f"_env_{band}"), threshold, ratio)
        total = part if total is None else total + part
    summed = with_stats(cut_lineage(_plain(enveloped, total)), _peak(), block=block)
    louder = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("value") * 1.15))
    return _plain(summed, F.when(F.col("_peak") > 0.99, F.col("value") / F.col("_peak") * 0.99).otherwise(louder))


# ---------------------------------------------------------------- A16 - A19


def _with_effect(sample: DataFrame, effect: str | None, params: Mapping[str, float], length: int, block: int) -> DataFrame:
    """The optional change of an embedded sample."""
    if effect is None:
        return sample
    if effect == "eq":
        return gain_db(sample, params.get("gain_db", 0.0))
    if effect == "compression":
        return compress_static(sample, params.get("threshold_db", -10.0), params.get("ratio", 4.0))
    if effect == "speed":
        return speed_resample(sample, params.get("speed", 1.0), block).where(F.col("idx") < length)
    raise ValueError(f"unknown effect: {effect}")


def _mix_at(background: DataFrame, sample: DataFrame, start: Column, volume_db: float, block: int) -> DataFrame:
    """Add the sample to the background from `start`, a column over the background's statistics."""
    placed = with_stats(background, block=block).withColumn("_at", F.col("idx") - start)
    own = sample.select("track_id", F.col("idx").alias("_at"), F.col("value").alias("_sample"))
    mixed = placed.join(own, ["track_id", "_at"], "left")
    value = F.col("value") + F.coalesce(F.col("_sample") * db_to_linear(volume_db), F.lit(0.0))
    return peak_normalize(_plain(mixed, value), 1.0, block=block)


def _start(position: str, spare_sec: Column, length: int, sample_rate: int) -> Column:
    share = {"middle": 0.5, "end": 1.0}.get(position, 0.0)
    at = (spare_sec * share * sample_rate).cast("bigint")
    return F.greatest(F.lit(0), F.least(at, F.col("n") - length))


def tile(sample: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Cut each track to `length` samples, or repeat it until it is as long."""
    sized = with_stats(sample.where(F.col("idx") < length), block=block)
    repeats = F.explode(F.expr(f"sequence(idx, bigint({length - 1}), n)"))
    return sized.select("track_id", repeats.alias("idx"), "value")


def embed_sample(
    background: DataFrame, sample: DataFrame, position: str = "start", duration_sec: float = 1.5, volume_db: float = 0.0,
    effect: str | None = None, params: Mapping[str, float] | None = None, sample_rate: int = SAMPLE_RATE, block: int = BLOCK,
) -> DataFrame:
    """Mix a sample of the same track id into the background; a short sample is repeated."""
    length = int(duration_sec * sample_rate)
    piece = _with_effect(tile(sample, length, block), effect, params or {}, length, block)
    spare = F.col("n") / sample_rate - duration_sec
    return _mix_at(background, piece, _start(position, spare, length, sample_rate), volume_db, block)


def song_in_song(
    first: DataFrame, second: DataFrame, start_sec: float, duration_sec: float, total_sec: float, volume_db: float = 0.0, position: str = "start",
    effect: str | None = None, params: Mapping[str, float] | None = None, sample_rate: int = SAMPLE_RATE, block: int = BLOCK,
) -> DataFrame:
    """Mix a part of the first signal into the second, which is cut or repeated to `total_sec`.

    A part that runs past the end of the first signal is silent there.
    """
    length, total = int(duration_sec * sample_rate), int(total_sec * sample_rate)
    start = F.greatest(F.lit(0), F.least(F.lit(int(start_sec * sample_rate)), F.col("n") - 1))
    part = (
        with_stats(first, block=block).withColumn("_from", start)
        .where((F.col("idx") >= F.col("_from")) & (F.col("idx") < F.col("_from") + length))
        .select("track_id", (F.col("idx") - F.col("_from")).alias("idx"), "value")
    )
    piece = _with_effect(part, effect, params or {}, length, block)
    spare = F.lit(float(total_sec - duration_sec))
    return _mix_at(tile(second, total, block), piece, _start(position, spare, length, sample_rate), volume_db, block)


# Steps that are known but need a vocoder or a codec, which this library leaves out.
NOT_SUPPORTED = ("pitch_shift", "time_stretch", "re_encode")


def _played(samples: DataFrame, speed: float, preserve_pitch: bool | str, block: int) -> DataFrame:
    if str(preserve_pitch).lower() in ("true", "1", "yes", "on"):
        raise NotImplementedError("speed_change with preserve_pitch is not supported")
    return speed_resample(samples, speed, block)


def typed(value: object) -> object:
    """Numbers of a plan come as text; other text stays."""
    if not isinstance(value, str):
        return value
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def apply_chain(
    samples: DataFrame, steps: Sequence[Mapping[str, object]], sample_rate: int = SAMPLE_RATE, block: int = BLOCK,
    overlays: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Apply `{type, params}` steps in order, as `plans.variants` gives them; numbers may be text.

    `overlays` has the signals that `overlay_vocals` steps name as `overlay_path`. Registered
    transforms are known too. Known steps that are left out of this library raise an error; types
    that nobody knows are skipped.
    """
    rate = {"sample_rate": sample_rate, "block": block}

    def overlay(s: DataFrame, overlay_path: str, level_db: float | None = None, gain_db: float = -6.0) -> DataFrame:
        if overlay_path not in (overlays or {}):
            raise ValueError(f"no overlay signal is given for {overlay_path}")
        return overlay_mix(s, overlays[overlay_path], level_db or gain_db, block)

    known: dict[str, Callable[..., DataFrame]] = {
        "gain": lambda s, db: gain_db(s, db),
        "crop": lambda s, start_sec=0.0, duration_sec=None: crop(s, start_sec, duration_sec, **rate),
        "slice_chop": lambda s, remove_start=0.0, remove_end=0.0: slice_chop(s, remove_start, remove_end, **rate),
        "overlay_vocals": overlay,
        "speed_change": lambda s, speed=None, rate=None, preserve_pitch=False: _played(s, speed or rate, preserve_pitch, block),
        "add_noise": lambda s, snr_db=20.0, noise_type="white", seed=0: add_colored_noise(s, snr_db, noise_type, seed, sample_rate, block=block),
        "apply_reverb": lambda s, delay_ms, wet_mix=0.3, decay=0.5: reverb_taps(s, delay_ms, wet_mix, decay, **rate),
        "high_pass_filter": lambda s, freq_hz=150.0: fir_filter(s, "high_pass", freq_hz, None, **rate),
        "low_pass_filter": lambda s, freq_hz=6000.0: fir_filter(s, "low_pass", None, freq_hz, **rate),
        "boost_highs": lambda s, gain_db=6.0, freq_hz=3000.0: fir_filter(s, "boost_highs", freq_hz, None, gain_db, **rate),
        "boost_lows": lambda s, gain_db=6.0, freq_hz=200.0: fir_filter(s, "boost_lows", None, freq_hz, gain_db, **rate),
        "telephone_filter": lambda s, low_freq=300.0, high_freq=3000.0: fir_filter(s, "band_pass", low_freq, high_freq, **rate),
        "apply_compression": lambda s, threshold_db=-10.0, ratio=10.0: compress_envelope(s, threshold_db, ratio, **rate),
        "apply_limiting": lambda s, ceiling_db=-1.0: limit(s, ceiling_db, block),
        "apply_multiband_compression": lambda s: multiband_compress(s, **rate),
        **registry.transforms(),
    }
    out, applied = samples, 0
    for step in steps:
        kind = str(step.get("type"))
        transform = known.get(kind)
        if transform is None and kind in NOT_SUPPORTED:
            raise NotImplementedError(f"{kind} is not supported")
        if transform is None:
            continue
        # Most steps read their input more than once.
        given = {k: typed(v) for k, v in dict(step.get("params") or {}).items()}
        out = transform(cut_lineage(out) if applied else out, **given)
        applied += 1
    return out


def apply_variants(
    samples: DataFrame, variants: Sequence[Mapping[str, object]], sample_rate: int = SAMPLE_RATE, block: int = BLOCK,
    overlays: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """`(track_id, variant_id, idx, value)`: every track changed by every variant, in one job.

    A variant is `{variant_id, steps}`, where steps are those of `apply_chain` and apply in order.
    Variants that begin alike share these steps: a step with one and the same input is planned once.
    The test matrix is configuration, so the number of variants is that of the plan and not of the data.
    """
    done: dict[tuple[str, ...], DataFrame] = {(): samples}
    parts = []
    for variant in variants:
        path: tuple[str, ...] = ()
        for step in variant["steps"]:
            longer = (*path, json.dumps(step, sort_keys=True))
            if longer not in done:
                made = apply_chain(done[path], [step], sample_rate, block, overlays)
                done[longer] = cut_lineage(made)
            path = longer
        parts.append(done[path].select("track_id", F.lit(str(variant["variant_id"])).alias("variant_id"), "idx", "value"))
    return reduce(DataFrame.unionByName, parts)


def mono_mixdown(samples: DataFrame) -> DataFrame:
    """Mean over the channels of `(track_id, channel, idx, value)`."""
    return samples.groupBy("track_id", "idx").agg(F.avg("value").alias("value"))


# ---------------------------------------------------------------- A20, A21


def _grid(length_sec: float, overlap: float, sample_rate: int) -> tuple[int, int]:
    size = int(length_sec * sample_rate)
    hop = int(size * (1 - overlap)) if overlap and overlap > 0 else size
    if size < 1 or hop < 1:
        raise ValueError("segments and their distance must be at least one sample long")
    return size, hop


def segment(samples: DataFrame, length_sec: float, overlap: float = 0.0, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """Full windows of each track with their place in seconds and samples."""
    size, hop = _grid(length_sec, overlap, sample_rate)
    sizes = samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    start = F.col("segment_idx") * hop
    return sizes.withColumn("segment_idx", F.explode(F.expr(f"sequence(0L, bigint((n - {size}) div {hop}))"))).select(
        "track_id",
        "segment_idx",
        segment_id(F.col("track_id").cast("string"), F.col("segment_idx")).alias("segment_id"),
        (start / sample_rate).alias("start"),
        ((start + size) / sample_rate).alias("end"),
        F.lit(size / sample_rate).alias("duration"),
        start.alias("start_sample"),
        (start + size).alias("end_sample"),
    )


def segment_samples(samples: DataFrame, length_sec: float, overlap: float = 0.0, sample_rate: int = SAMPLE_RATE, block: int = BLOCK) -> DataFrame:
    """Samples with the number of every full window they belong to, and their place in it."""
    size, hop = _grid(length_sec, overlap, sample_rate)
    sized = with_stats(samples, block=block).where(F.col("n") >= size)
    first = f"greatest(0L, bigint((idx - {size} + {hop}) div {hop}))"
    last = f"least(bigint(idx div {hop}), bigint((n - {size}) div {hop}))"
    kept = [c for c in samples.columns if c not in ("track_id", "idx")]
    return (
        sized.where(F.expr(f"{first} <= {last}"))
        .select("track_id", "idx", *kept, F.explode(F.expr(f"sequence({first}, {last})")).alias("segment_idx"))
        .withColumn("pos", F.col("idx") - F.col("segment_idx") * hop)
    )


FEATURES = ("mean", "std", "rms", "crossings", "peak")


def segment_features(
    samples: DataFrame, length_sec: float, overlap: float = 0.0, dim: int = 5, sample_rate: int = SAMPLE_RATE, block: int = BLOCK
) -> DataFrame:
    """One unit vector for each segment from time-domain features, padded or cut to `dim`."""
    crossing = F.signum("value") != F.signum(F.col("_previous"))
    with_previous = windowed(samples, 1, 0, lambda w: {"_previous": F.lag("value").over(w)}, block)
    marked = with_previous.withColumn("_cross", F.coalesce(crossing, F.lit(False)))
    stats = (
        segment_samples(marked, length_sec, overlap, sample_rate, block)
        .groupBy("track_id", "segment_idx")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"),
            F.avg((F.col("_cross") & (F.col("pos") > 0)).cast("double")).alias("crossings"),
            F.max(F.abs("value")).alias("peak"),
        )
    )
    padded = F.slice(F.concat(F.array(*FEATURES), F.array_repeat(F.lit(0.0), max(0, dim - len(FEATURES)))), 1, dim)
    return l2_normalize(stats.select("track_id", "segment_idx", padded.alias("vector")))


# ---------------------------------------------------------------- frequency content

# Samples of a frame; frames overlap by half.
FRAME = 2048
# Energies below this count as it, so that silence has a logarithm.
LEAST_ENERGY = 1e-10


def mel(hz: float) -> float:
    return 2595.0 * math.log10(1.0 + hz / 700.0)


def mel_edges(bands: int, top_hz: float) -> list[float]:
    """Edges in Hz of bands that are equally wide on the mel scale, from 0 to `top_hz`."""
    return [700.0 * (10.0 ** (mel(top_hz) * i / bands / 2595.0) - 1.0) for i in range(bands + 1)]


def frame_energies(frames: np.ndarray, edges: Sequence[float], sample_rate: int) -> np.ndarray:
    """Energy of each frame in each band, after a Hann window. Bins at the last edge belong to the last band."""
    size = frames.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    band = np.searchsorted(np.asarray(edges), np.fft.rfftfreq(size, 1.0 / sample_rate), "right") - 1
    hz = np.fft.rfftfreq(size, 1.0 / sample_rate)
    band[np.isclose(hz, edges[-1])] = len(edges) - 2
    out = np.zeros((len(frames), len(edges) - 1))
    for b in range(len(edges) - 1):
        out[:, b] = power[:, band == b].sum(axis=1)
    return out


def _by_frames(samples: DataFrame, frame: int, block: int, sums: Callable[[np.ndarray, np.ndarray], Mapping[str, np.ndarray]], made: str) -> DataFrame:
    """What `sums` makes of the frames that begin in each block: it gets their starts and samples.

    A block brings the samples that its last frame reaches beyond it. Frames begin at multiples of half their size
    and lie within their track.
    """
    hop = max(1, frame // 2)
    reach = F.expr(f"sequence(greatest(0L, bigint((idx - {frame - 1}) div {block})), bigint(idx div {block}))")
    schema = T.StructType([samples.schema["track_id"], *T.StructType.fromDDL(made).fields])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        idx, values = rows["idx"].to_numpy(), rows["value"].to_numpy()
        low = key[1].as_py() * block
        starts = np.arange(-(-low // hop) * hop, low + block, hop)
        starts = starts[starts + frame <= idx[-1] + 1]
        offset = int(idx[0])
        out = sums(starts, values[(starts - offset)[:, None] + np.arange(frame)[None, :]]) if len(starts) else None
        n = len(next(iter(out.values()))) if out else 0
        columns = {"track_id": pa.array([key[0].as_py()] * n, rows["track_id"].type)}
        for f in schema.fields[1:]:
            columns[f.name] = pa.array(out[f.name]) if n else pa.array([], pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64())
        return pa.table(columns)

    return samples.select("track_id", "idx", "value").withColumn("_blk", F.explode(reach)).groupBy("track_id", "_blk").applyInArrow(run, schema)


def spectral_features(
    samples: DataFrame, length_sec: float, overlap: float = 0.0, dim: int = 64, sample_rate: int = SAMPLE_RATE, block: int = BLOCK, frame: int = FRAME
) -> DataFrame:
    """One unit vector for each segment: mean and spread of the logarithmic energy in `dim / 2` mel bands over its frames.

    Frames lie within the segment. Each block sums what its frames add to each segment; only these sums are
    shuffled again. A segment shorter than a frame has no vector.
    """
    if dim < 2 or dim % 2:
        raise ValueError("half of the elements are means, half spreads: dim must be even")
    size, hop = _grid(length_sec, overlap, sample_rate)
    bands = dim // 2
    edges = mel_edges(bands, sample_rate / 2)

    def sums(starts: np.ndarray, frames: np.ndarray) -> Mapping[str, np.ndarray]:
        energy = np.log(np.maximum(frame_energies(frames, edges, sample_rate), LEAST_ENERGY))
        first, last = np.maximum(0, -(-(starts + frame - size) // hop)), starts // hop
        n = np.maximum(last - first + 1, 0)
        row = np.repeat(np.arange(len(starts)), n)
        segment = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        seen, of = np.unique(segment, return_inverse=True)
        add = lambda v: np.bincount(of, v[row], len(seen))
        out = {"segment_idx": seen.astype(np.int64), "frames": np.bincount(of, minlength=len(seen)).astype(np.int64)}
        for b in range(bands):
            out[f"s{b}"], out[f"q{b}"] = add(energy[:, b]), add(energy[:, b] ** 2)
        return out

    made = "segment_idx bigint, frames bigint, " + ", ".join(f"s{b} double, q{b} double" for b in range(bands))
    added = _by_frames(samples, frame, block, sums, made).groupBy("track_id", "segment_idx").agg(
        F.sum("frames").alias("frames"), *[F.sum(f"{c}{b}").alias(f"{c}{b}") for b in range(bands) for c in "sq"]
    )
    whole = added.join(samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")), "track_id").where(F.col("segment_idx") * hop + size <= F.col("n"))
    mean = [F.col(f"s{b}") / F.col("frames") for b in range(bands)]
    spread = [F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{b}") / F.col("frames") - m * m)) for b, m in enumerate(mean)]
    return l2_normalize(whole.select("track_id", "segment_idx", F.array(*mean, *spread).alias("vector")))


def band_ratios(samples: DataFrame, sample_rate: int = SAMPLE_RATE, block: int = BLOCK, frame: int = FRAME, top_hz: float = 2000.0) -> DataFrame:
    """`(track_id, low_ratio, bass_ratio)` of whole tracks, from the energy below `top_hz`.

    The range is cut into eight mel bands. `low_ratio` is the mean energy of the lower four over that of all,
    `bass_ratio` the mean of the lowest over its sum with the mean of the next three. Silence has ratios 0.
    """
    edges = mel_edges(8, min(top_hz, sample_rate / 2))

    def sums(starts: np.ndarray, frames: np.ndarray) -> Mapping[str, np.ndarray]:
        total = frame_energies(frames, edges, sample_rate).sum(axis=0)
        return {f"e{b}": total[b : b + 1] for b in range(8)}

    energy = _by_frames(samples, frame, block, sums, ", ".join(f"e{b} double" for b in range(8))).groupBy("track_id").agg(*[F.sum(f"e{b}").alias(f"e{b}") for b in range(8)])
    mean = lambda lo, hi: sum((F.col(f"e{b}") for b in range(lo + 1, hi)), F.col(f"e{lo}")) / (hi - lo)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return energy.select("track_id", ratio(mean(0, 4), mean(0, 8)).alias("low_ratio"), ratio(mean(0, 1), mean(0, 1) + mean(1, 4)).alias("bass_ratio"))
