"""Variants as data: every track is changed by the steps that its rows of a table name.

`variants(track_id, variant_id, steps)` is a table like any other: parameters are columns, each track may have its own
variants, and their number changes neither the plan nor its size. A step becomes a few operations, each of
which needs a block of samples, its neighbourhood and sums of the whole signal. All variants take their first operation
in one pass, then all take their second, whatever kinds these are; a variant that is through is set aside.

Signals travel as arrays, one row for each block of `block` samples, and become rows of samples at the end only. A pass
sums the signals from the numbers beside the arrays, sends each block the parts of arrays that it needs, and
makes the new block in one task. The largest group is a block and its neighbourhood, however long a track is and however many
variants it has.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.functions import registry
from earmark.operators.signal import (
    BANDS, BLOCK, HIGH_EDGE_HZ, LOW_EDGE_HZ, NOT_SUPPORTED, SAMPLE_RATE, TAP_FACTORS,
    convolved, db_to_linear, fir_kernel, hashed_normal, sliding_peak, typed, uniforms,
)
from earmark.session import bound_batches, cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = "array<struct<type: string, params: map<string, string>>>"
OPS = "array<struct<op: string, params: map<string, double>, text: string, seed: string>>"
KEYS = ("track_id", "variant_id")
# Signals of a variant while a step is under way: its own one, and up to two that the next operation uses up.
SIGNALS = ("value", "second", "third")
SUMS = {"len": T.LongType(), "head": T.DoubleType(), **{f"peak_{s}": T.DoubleType() for s in SIGNALS}, **{f"square_{s}": T.DoubleType() for s in SIGNALS}}
# As in `add_colored_noise`.
OCTAVES, CLICKS_PER_SECOND, CLICK_MS, HISS_HZ = 8, 2.0, 1.0, 5000.0
CRACKLE = ("vinyl", "crackle")


# ---------------------------------------------------------------- from steps to operations


def _op(op: str, text: str | None = None, seed: str | None = None, **params: float | None) -> dict:
    return {"op": op, "params": {k: float(v) for k, v in params.items() if v is not None}, "text": text, "seed": seed}


def _normalize(threshold: float, to: float = 1.0) -> dict:
    return _op("normalize", threshold=threshold, to=to)


def _filter(rate: int, kind: str, low: float | None, high: float | None) -> dict:
    half = len(_kernel(kind, low, high, rate)) // 2
    return _op("filter", kind, low=low, high=high, before=half, after=half)


def _boost(rate: int, kind: str, low: float | None, high: float | None, gain_db: float) -> list[dict]:
    op = _filter(rate, kind, low, high)
    return [{**op, "op": "boost", "params": {**op["params"], "factor": db_to_linear(gain_db) - 1.0}}, _normalize(0.99)]


# Kernels that a task has made.
_KERNELS: dict[tuple, np.ndarray] = {}


def _kernel(kind: str, low: float | None, high: float | None, rate: int) -> np.ndarray:
    key = (kind, low, high, rate)
    if key not in _KERNELS:
        if len(_KERNELS) >= 64:
            _KERNELS.clear()
        _KERNELS[key] = np.array(fir_kernel(kind, low, high, rate))
    return _KERNELS[key]


def lowered(steps: Sequence[Mapping[str, object]] | None, rate: int, registered: Collection[str] = ()) -> list[dict]:
    """The operations behind the steps of a variant. Types that nobody knows are skipped, as in `apply_chain`."""

    def overlay(overlay_path, level_db=None, gain_db=-6.0):
        return [_op("mix", str(overlay_path), factor=db_to_linear(level_db or gain_db)), _normalize(1.0)]

    def speed_change(speed=None, rate=None, preserve_pitch=False):
        if str(preserve_pitch).lower() in ("true", "1", "yes", "on"):
            raise NotImplementedError("speed_change with preserve_pitch is not supported")
        return [_op("resample", speed=speed or rate)]

    def noise(snr_db=20.0, noise_type="white", seed=0):
        ratio, seed = 10.0 ** (snr_db / 10.0), str(seed)
        if noise_type == "pink":
            make = [_op("pink", seed=seed)]
        elif noise_type in CRACKLE:
            half = len(_kernel("high_pass", HISS_HZ, None, rate)) // 2
            make = [_op("crackle", seed=seed, ratio=ratio, before=half, after=half)]
        else:
            return [_op("white", seed=seed, ratio=ratio), _normalize(1.0)]
        return [*make, _op("add", ratio=ratio), _normalize(1.0)]

    def reverb(delay_ms, wet_mix=0.3, decay=0.5):
        if delay_ms <= 0:
            return []
        first = max(1, int(delay_ms / 1000.0 * rate))
        echo = _op("echo", first=first, wet=wet_mix, decay=decay, before=int(first * TAP_FACTORS[-1]))
        return [echo, _filter(rate, "low_pass", None, min(8000.0, rate * 0.5 * 0.8)), _normalize(0.99)]

    def compression(threshold_db=-10.0, ratio=10.0):
        squeeze = _op("compress", threshold=db_to_linear(threshold_db), ratio=ratio, before=int(100.0 * rate / 1000.0))
        return [squeeze, _normalize(1.0, 0.99)]

    def multiband():
        half = max(len(_kernel("low_pass", None, LOW_EDGE_HZ, rate)), len(_kernel("high_pass", HIGH_EDGE_HZ, None, rate))) // 2
        return [_op("split", before=half, after=half), _op("bands", before=int(50.0 * rate / 1000.0)), _op("louder")]

    def seconds(value):
        return None if value is None else int(value * rate)

    known: dict[str, Callable[..., list[dict]]] = {
        "gain": lambda db: [_op("scale", factor=db_to_linear(db))],
        "crop": lambda start_sec=0.0, duration_sec=None: [_op("crop", start=seconds(start_sec), length=seconds(duration_sec))],
        "slice_chop": lambda remove_start=0.0, remove_end=0.0: [_op("chop", start=seconds(remove_start), end=seconds(remove_end))],
        "overlay_vocals": overlay,
        "speed_change": speed_change,
        "add_noise": noise,
        "apply_reverb": reverb,
        "high_pass_filter": lambda freq_hz=150.0: [_filter(rate, "high_pass", freq_hz, None)],
        "low_pass_filter": lambda freq_hz=6000.0: [_filter(rate, "low_pass", None, freq_hz)],
        "boost_highs": lambda gain_db=6.0, freq_hz=3000.0: _boost(rate, "boost_highs", freq_hz, None, gain_db),
        "boost_lows": lambda gain_db=6.0, freq_hz=200.0: _boost(rate, "boost_lows", None, freq_hz, gain_db),
        "telephone_filter": lambda low_freq=300.0, high_freq=3000.0: [_filter(rate, "band_pass", low_freq, high_freq)],
        "apply_compression": compression,
        "apply_limiting": lambda ceiling_db=-1.0: [_op("limit", ceiling=ceiling_db)],
        "apply_multiband_compression": multiband,
    }
    out = []
    for step in steps or ():
        kind = str(step["type"])
        if kind in registered:
            raise NotImplementedError(f"{kind} is a registered transform of whole tables; use apply_chain")
        if kind in NOT_SUPPORTED:
            raise NotImplementedError(f"{kind} is not supported")
        if kind in known:
            out += known[kind](**{k: typed(v) for k, v in dict(step["params"] or {}).items() if v is not None})
    return out


def programs(variants: DataFrame, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """`(track_id, variant_id, ops)` of `variants(track_id, variant_id, steps)`."""
    plan = variants.select("track_id", F.col("variant_id").cast("string").alias("variant_id"), F.col("steps").cast(STEPS).alias("steps"))
    schema = T.StructType([plan.schema["track_id"], plan.schema["variant_id"], T.StructField("ops", T.DataType.fromDDL(OPS))])
    # Registered transforms are known in the driver only, so their names go along.
    registered = tuple(registry.transforms())

    def run(batches):
        kind = pa.list_(pa.struct([("op", pa.string()), ("params", pa.map_(pa.string(), pa.float64())), ("text", pa.string()), ("seed", pa.string())]))
        for batch in batches:
            ops = [
                [{**op, "params": list(op["params"].items())} for op in lowered(steps, sample_rate, registered)]
                for steps in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ops, kind)], names=["track_id", "variant_id", "ops"])

    return plan.mapInArrow(run, schema)


def steps_of_plan(matrix: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """`(track_id, variant_id, steps)` of the tables that `expand_matrix` and `expand_chains` give."""
    single = matrix.select(
        F.col("orig_id").alias("track_id"), F.col("transformed_id").alias("variant_id"),
        F.array(F.struct(F.col("transform_type").alias("type"), "params")).cast(STEPS).alias("steps"),
    )
    if chains is None:
        return single
    in_order = F.array_sort(F.collect_list(F.struct("step", F.col("step_type").alias("type"), F.map_entries("params").alias("params"))))
    steps = F.transform(in_order, lambda s: F.struct(s["type"].alias("type"), F.map_from_entries(s["params"]).alias("params")))
    many = chains.groupBy(F.col("orig_id").alias("track_id"), F.col("transformed_id").alias("variant_id")).agg(steps.cast(STEPS).alias("steps"))
    return single.unionByName(many)


# ---------------------------------------------------------------- blocks as rows


def packed(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(track_id, blk, value)`: one array for each block of a track, with what sums of the signal need beside it."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))), lambda s: s["value"])
    arrays = samples.groupBy("track_id", F.expr(f"bigint(idx div {block})").alias("blk")).agg(in_order.alias("value"))
    nothing = F.lit(None).cast("array<double>")
    return arrays.select(
        "track_id", "blk", "value", nothing.alias("second"), nothing.alias("third"),
        F.size("value").cast("bigint").alias("len"),
        F.element_at("value", 1).alias("head"),
        F.array_max(F.transform("value", F.abs)).alias("peak_value"),
        *[F.lit(0.0).alias(f"peak_{s}") for s in SIGNALS[1:]],
        F.aggregate("value", F.lit(0.0), lambda total, x: total + x * x).alias("square_value"),
        *[F.lit(0.0).alias(f"square_{s}") for s in SIGNALS[1:]],
    )


def unpacked(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Samples of the blocks."""
    return blocks.select(*KEYS, "blk", F.posexplode("value").alias("_at", "value")).select(*KEYS, (F.col("blk") * block + F.col("_at")).alias("idx"), "value")


def _sums(state: DataFrame) -> DataFrame:
    whole = state.groupBy(*KEYS).agg(
        F.sum("len").alias("n"),
        F.max(F.when(F.col("blk") == 0, F.col("head"))).alias("_head"),
        *[F.max(f"peak_{s}").alias(f"_peak_{s}") for s in SIGNALS],
        *[F.sum(f"square_{s}").alias(f"_square_{s}") for s in SIGNALS],
    )
    return whole.select(*KEYS, "n", "_head", *[f"_peak_{s}" for s in SIGNALS], *[(F.col(f"_square_{s}") / F.col("n")).alias(f"_power_{s}") for s in SIGNALS])


def _param(name: str, default: float | None = None) -> Column:
    value = F.try_element_at(F.col("_op.params"), F.lit(name))
    return value if default is None else F.coalesce(value, F.lit(default))


def _with_extent(wanted: DataFrame, rate: int) -> DataFrame:
    """How far an operation reaches, what it leaves out in front, and how long its result is."""
    n, kind = F.col("n"), F.col("_op.op")
    start = F.when(kind == "crop", F.greatest(F.lit(0), F.least(_param("start").cast("bigint"), n - 1))).otherwise(F.least(_param("start").cast("bigint"), n))
    end = F.when(kind == "crop", F.least(start + F.coalesce(_param("length").cast("bigint"), n), n)).otherwise(F.greatest(start, n - _param("end").cast("bigint")))
    # Less than half a second left: the whole track stays.
    cut = kind.isin("crop", "chop") & ((end - start) >= rate * 0.5)
    length = F.when(kind == "resample", F.floor(n / _param("speed")).cast("bigint")).when(cut, end - start).otherwise(n)
    return wanted.select(
        "*", _param("before", 0.0).cast("bigint").alias("_before"), _param("after", 0.0).cast("bigint").alias("_after"),
        F.when(cut, start).otherwise(F.lit(0)).cast("bigint").alias("_from"), length.alias("_m"), (kind == "resample").alias("_resampled"),
    )


# For block `blk` of the input, the samples of the result that need any of it; for block `_to` of the result, the samples it needs.
_SINGLE, _LAST, _POINTS = "(_m = 1 OR n = 1)", "(n - 1)", "(_m - 1)"
_MADE_FROM = f"CASE WHEN NOT _resampled THEN _lo - _from - _after WHEN {_SINGLE} THEN 0L ELSE (greatest(0L, _lo - 1) * {_POINTS} + n - 2) div {_LAST} END"
_MADE_TO = (
    f"CASE WHEN NOT _resampled THEN _hi - _from + _before WHEN _lo > 0 AND {_SINGLE} THEN -1L WHEN {_SINGLE} OR _hi >= {_LAST} THEN {_POINTS} "
    f"ELSE ((_hi + 1) * {_POINTS} + n - 2) div {_LAST} - 1 END"
)
_NEED_FROM = f"CASE WHEN NOT _resampled THEN _first + _from - _before WHEN {_SINGLE} THEN 0L ELSE (_first * {_LAST}) div {_POINTS} END"
_NEED_TO = f"CASE WHEN NOT _resampled THEN _end + _from + _after WHEN {_SINGLE} THEN 0L ELSE (_end * {_LAST}) div {_POINTS} + 1 END"


def _dealt(active: DataFrame, wanted: DataFrame, block: int) -> DataFrame:
    """Each block of the result with the parts of the input that it needs, as `_to`, `_at` and the arrays from there."""
    # The sums meet the blocks by block, so a long track isn't one task's.
    by_block = wanted.withColumn("blk", F.explode(F.expr(f"sequence(0L, bigint((n - 1) div {block}))")))
    met = active.select(*KEYS, "blk", "len", "_todo", *SIGNALS).join(by_block, [*KEYS, "blk"])
    met = met.where("_m > 0").withColumns({"_lo": F.col("blk") * block, "_hi": F.col("blk") * block + F.col("len") - 1})
    made = met.withColumns({"_made_from": F.greatest(F.lit(0), F.expr(_MADE_FROM)), "_made_to": F.least(F.expr(_MADE_TO), F.expr(_POINTS))}).where("_made_from <= _made_to")
    sent = made.withColumn("_to", F.explode(F.expr(f"sequence(bigint(_made_from div {block}), bigint(_made_to div {block}))")))
    sent = sent.withColumns({"_first": F.col("_to") * block, "_end": F.least(F.col("_to") * block + block - 1, F.expr(_POINTS))})
    sent = sent.withColumns({"_at": F.greatest(F.col("_lo"), F.expr(_NEED_FROM)), "_till": F.least(F.col("_hi"), F.expr(_NEED_TO))}).where("_at <= _till")
    part = lambda s: F.slice(F.col(s), (F.col("_at") - F.col("_lo") + 1).cast("int"), (F.col("_till") - F.col("_at") + 1).cast("int"))
    return sent.withColumns({s: part(s) for s in SIGNALS})


def _noise() -> Column:
    """For the samples of a part, the numbers that its noise is made of."""
    key = [F.col("_op.seed"), F.col("track_id").cast("string")]
    places = F.sequence("_at", "_till")

    def held(i: Column) -> Column:
        each = [hashed_normal(*key, F.shiftright(i, k).cast("string"), F.lit(str(k))) for k in range(OCTAVES)]
        return sum(each[1:], each[0])

    kind = F.col("_op.op")
    one = F.transform(places, lambda i: hashed_normal(*key, i.cast("string")))
    return F.when(kind == "pink", F.transform(places, held)).when(kind.isin("white", "crackle"), one).otherwise(F.col("second"))


def _clicks(wanted: DataFrame, rate: int, block: int) -> DataFrame:
    """`(track_id, variant_id, _to, _clicks)`: the clicks that reach into each block, a few for any length of track."""
    half = int(rate * CLICK_MS / 1000.0) // 2
    place, size = uniforms(F.col("_op.seed"), F.col("track_id").cast("string"), F.lit("click"), F.col("_j").cast("string"))
    count = (F.col("n") / rate * CLICKS_PER_SECOND).cast("bigint")
    each = (
        wanted.where((F.col("_op.op") == "crackle") & (count > 0))
        .withColumn("_j", F.explode(F.sequence(F.lit(1).cast("bigint"), count)))
        .withColumn("_at", F.floor(place * F.col("n")))
        .withColumn("_from", F.greatest(F.lit(0), F.col("_at") - half))
        .withColumn("_len", F.least("n", F.col("_at") + half) - F.col("_from"))
        .where(F.col("_len") > 0)
    )
    click = F.struct(F.col("_from").alias("start"), F.col("_len").alias("len"), (size + 0.5).alias("size"))
    blocks = F.explode(F.expr(f"sequence(bigint(_from div {block}), bigint((_from + _len - 1) div {block}))"))
    return each.select(*KEYS, blocks.alias("_to"), click.alias("_c")).groupBy(*KEYS, "_to").agg(F.array_sort(F.collect_list("_c")).alias("_clicks"))


# ---------------------------------------------------------------- operations on a block


class Part:
    """The samples a block of the result needs. They begin at `at`; the block begins at `first` and has `size` samples."""

    def __init__(self, rows: pa.Table, block: int, rate: int):
        rows = rows.sort_by("_at")
        row = rows.drop_columns(list(SIGNALS)).slice(0, 1).to_pylist()[0]
        self.p, self.text, self.rate, self.row = dict(row["_op"]["params"]), row["_op"]["text"], rate, row
        self.op, self.at, self.n, self.m = row["_op"]["op"], row["_at"], row["n"], row["_m"]
        self.first = row["_to"] * block
        self.size = min(block, self.m - self.first)
        # Parts follow one another without gaps; a signal is there in all of them or in none.
        self.signals = {s: np.concatenate([x.values.to_numpy() for x in rows[s]]) for s in SIGNALS if rows[s].null_count == 0}
        self.value = self.signals["value"]

    def peak(self, signal: str = "value") -> float:
        return self.row[f"_peak_{signal}"]

    def power(self, signal: str = "value") -> float:
        return self.row[f"_power_{signal}"]

    def own(self, values: np.ndarray) -> np.ndarray:
        """The block's own samples of an array that has its neighbourhood."""
        skip = self.first + self.row["_from"] - self.at
        return values[skip : skip + self.size]

    def filtered(self, kind: str, low: float | None, high: float | None, values: np.ndarray | None = None) -> np.ndarray:
        return self.own(convolved(self.value if values is None else values, _kernel(kind, low, high, self.rate)))


def _squeezed(value: np.ndarray, envelope: np.ndarray, threshold: float, ratio: float) -> np.ndarray:
    loud = envelope > threshold
    safe = np.where(loud, envelope, 1.0)
    return np.where(loud, value * ((threshold + (envelope - threshold) / ratio) / safe), value)


def _resample(part: Part) -> np.ndarray:
    last, points = part.n - 1, part.m - 1
    if last == 0 or points == 0:
        return np.full(part.size, part.value[0])
    j = np.arange(part.first, part.first + part.size, dtype=np.int64)
    i = j * last // points
    here, there = part.value[i - part.at], part.value[np.minimum(i + 1, last) - part.at]
    return here + (there - here) * ((j * last - i * points) / points)


def _limit(part: Part) -> np.ndarray:
    top = 10.0 ** (min(part.p["ceiling"], 20.0 * math.log10(part.peak() + 1e-10) - 3.0) / 20.0)
    clipped, left = np.clip(part.value, -top, top), min(part.peak(), top)
    return clipped / left * 0.99 if left > 0.99 else clipped


def _echo(part: Part) -> np.ndarray:
    taps = [t for t in (int(part.p["first"] * f) for f in TAP_FACTORS) if t < part.n]
    out = part.own(part.value).copy()
    if taps:
        tail = np.zeros(part.size)
        for tap in taps:
            # Before the track begins there is silence.
            source = np.arange(part.first - tap, part.first - tap + part.size)
            tail += np.where(source >= 0, part.value[np.maximum(source - part.at, 0)], 0.0)
        return out + tail * part.p["decay"] * (part.p["wet"] / len(taps))
    if part.n > 1 and part.first + part.size == part.n:
        out[-1] += part.row["_head"] * (part.p["decay"] * part.p["wet"])
    return out


def _crackle(part: Part) -> np.ndarray:
    wanted = part.power() / part.p["ratio"]
    noise = part.filtered("high_pass", HISS_HZ, None, part.signals["second"] * math.sqrt(wanted * 0.3))
    for click in part.row["_clicks"] or ():
        t = np.arange(click["len"]) / (click["len"] - 1) if click["len"] > 1 else np.zeros(1)
        burst = np.exp(-50.0 * t) * np.sin(2.0 * math.pi * 8000.0 * t) * click["size"]
        a, z = max(click["start"], part.first), min(click["start"] + click["len"], part.first + part.size)
        noise[a - part.first : z - part.first] += burst[a - click["start"] : z - click["start"]]
    return noise


def _add(part: Part) -> np.ndarray:
    wanted, got = part.power() / part.p["ratio"], part.power("second")
    return part.value + part.signals["second"] * (math.sqrt(wanted / got) if got > 0 else 1.0)


def _split(part: Part) -> dict[str, np.ndarray]:
    low, high = part.filtered("low_pass", None, LOW_EDGE_HZ), part.filtered("high_pass", HIGH_EDGE_HZ, None)
    return {"value": low, "second": part.own(part.value) - low - high, "third": high}


def _bands(part: Part) -> np.ndarray:
    span, total = int(part.p["before"]), np.zeros(part.size)
    for signal, (below, fallback, ratio) in zip(SIGNALS, BANDS.values()):
        peak_db = 20.0 * math.log10(part.peak(signal) + 1e-10)
        threshold = 10.0 ** ((peak_db - below if peak_db > -60 else fallback) / 20.0)
        band = part.signals[signal]
        total += _squeezed(part.own(band), part.own(sliding_peak(band, span)), threshold, ratio)
    return total


def _mix(part: Part) -> np.ndarray:
    other = part.signals["second"]
    size = min(len(part.value), len(other))
    return part.value[:size] + other[:size] * part.p["factor"]


MADE: dict[str, Callable[[Part], np.ndarray | dict[str, np.ndarray]]] = {
    "scale": lambda part: part.value * part.p["factor"],
    "normalize": lambda part: part.value / part.peak() * part.p["to"] if part.peak() > part.p["threshold"] else part.value,
    "crop": lambda part: part.value,
    "chop": lambda part: part.value,
    "resample": _resample,
    "limit": _limit,
    "mix": _mix,
    "echo": _echo,
    "filter": lambda part: part.filtered(part.text, part.p.get("low"), part.p.get("high")),
    "boost": lambda part: part.own(part.value) + part.filtered(part.text, part.p.get("low"), part.p.get("high")) * part.p["factor"],
    "compress": lambda part: _squeezed(part.own(part.value), part.own(sliding_peak(part.value, int(part.p["before"]))), part.p["threshold"], part.p["ratio"]),
    "white": lambda part: part.value + part.signals["second"] * math.sqrt(part.power() / part.p["ratio"]),
    "pink": lambda part: {"value": part.value, "second": part.signals["second"]},
    "crackle": lambda part: {"value": part.own(part.value), "second": _crackle(part)},
    "add": _add,
    "split": _split,
    "bands": _bands,
    "louder": lambda part: part.value / part.peak() * 0.99 if part.peak() > 0.99 else np.clip(part.value * 1.15, -0.99, 0.99),
}


def _pass(dealt: DataFrame, state: T.StructType, block: int, rate: int) -> DataFrame:
    names = state.fieldNames()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = Part(rows, block, rate)
        made = MADE[part.op](part)
        made = made if isinstance(made, dict) else {"value": made}
        value = made["value"]
        out = {
            "track_id": key[0].as_py(), "variant_id": key[1].as_py(), "blk": key[2].as_py(), "_todo": part.row["_todo"] - 1,
            "len": len(value), "head": float(value[0]) if len(value) else None, **{s: made.get(s) for s in SIGNALS},
        }
        for s in SIGNALS:
            values = made.get(s)
            some = values is not None and len(values) > 0
            out[f"peak_{s}"] = float(np.abs(values).max()) if some else 0.0
            out[f"square_{s}"] = float(np.dot(values, values)) if some else 0.0
        return pa.table({c: pa.array([out[c]], rows.schema.field(c).type if c in KEYS else _arrow(c)) for c in names})

    # Dealt by all keys: a plan that is dealt by track already would be taken as it is, with a whole track in one task.
    return dealt.repartition(*KEYS, "_to").groupBy(*KEYS, "_to").applyInArrow(run, state)


def _arrow(name: str) -> pa.DataType:
    if name in SIGNALS:
        return pa.list_(pa.float64())
    return {"blk": pa.int64(), "len": pa.int64(), "_todo": pa.int32()}.get(name, pa.float64())


# ---------------------------------------------------------------- all variants


def apply_programs(
    samples: DataFrame, variants: DataFrame, sample_rate: int = SAMPLE_RATE, block: int = BLOCK, overlays: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """`(track_id, variant_id, idx, value)` for each row of `variants(track_id, variant_id, steps)`.

    Steps are those of `signal.apply_chain`, with numbers as text, and give the same samples as there. `overlays` has the signals
    that `overlay_vocals` names. A row without steps, or with null for them, copies its track; rows whose
    track has no samples, and null ids, give nothing; extra columns are not read. A track may not have one
    variant_id twice. Registered transforms work on whole tables and raise an error here.

    The plan has a pass for each operation of the longest variant and none for further variants.
    """
    bound_batches(samples.sparkSession)
    ops = cut_lineage(programs(variants.where("track_id IS NOT NULL AND variant_id IS NOT NULL"), sample_rate))
    # One row for each place in a program and kind of operation, bounded by the longest program.
    found = ops.select(F.posexplode("ops").alias("at", "o")).select("at", F.col("o.op").alias("op"), F.when(F.col("o.op") == "mix", F.col("o.text")).alias("path")).distinct().collect()
    missing = {r.path for r in found if r.op == "mix"} - set(overlays or {})
    if missing:
        raise ValueError(f"no overlay signal is given for {sorted(missing)}")
    if ops.groupBy(*KEYS).count().where("count > 1").limit(1).count():
        raise ValueError("a track has one variant_id twice")

    blocks = cut_lineage(packed(samples.where("track_id IS NOT NULL"), block))
    # Variants meet the blocks of their track by block, so neither a long track nor one with many variants is one task's.
    per_track = blocks.groupBy("track_id").agg(F.max("blk").alias("_last"))
    places = ops.select(*KEYS, F.size("ops").alias("_todo")).join(per_track, "track_id").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")))
    state = blocks.join(places.drop("_last"), ["track_id", "blk"])
    schema = T.StructType([
        blocks.schema["track_id"], T.StructField("variant_id", T.StringType()), T.StructField("blk", T.LongType()), T.StructField("_todo", T.IntegerType()),
        *[T.StructField(s, T.ArrayType(T.DoubleType())) for s in SIGNALS], *[T.StructField(name, kind) for name, kind in SUMS.items()],
    ])
    state = state.select(*schema.fieldNames())
    ready = []
    for at in range(1 + max((r.at for r in found), default=-1)):
        state = cut_lineage(state)
        ready.append(state.where("_todo = 0"))
        active, kinds = state.where("_todo > 0"), {r.op for r in found if r.at == at}
        steps = ops.where(F.size("ops") > at).select(*KEYS, F.get("ops", F.lit(at)).alias("_op"))
        wanted = _with_extent(_sums(active).join(steps, [*KEYS]), sample_rate)
        dealt = _dealt(active, wanted, block)
        if kinds & {"white", "pink", "crackle"}:
            dealt = dealt.withColumn("second", _noise())
        if "crackle" in kinds:
            dealt = dealt.join(_clicks(wanted, sample_rate, block), [*KEYS, "_to"], "left")
        else:
            dealt = dealt.withColumn("_clicks", F.lit(None).cast("array<struct<start: bigint, len: bigint, size: double>>"))
        if "mix" in kinds:
            dealt = _with_overlay(dealt, overlays, {r.path for r in found if r.at == at and r.op == "mix"}, block)
        dealt = dealt.select(
            *KEYS, "_to", "_at", "_todo", *SIGNALS, "_op", "n", "_m", "_from", "_head", "_clicks", *[f"_{x}_{s}" for x in ("peak", "power") for s in SIGNALS]
        )
        state = _pass(dealt, schema, block, sample_rate)
    return unpacked(reduce(DataFrame.unionByName, [*ready, state]).select(*KEYS, "blk", "value"), block)


def _with_overlay(dealt: DataFrame, overlays: Mapping[str, DataFrame], paths: set[str], block: int) -> DataFrame:
    """The block of the overlay as the second signal; blocks that it doesn't reach are left out."""
    others = [packed(overlays[p], block).select("track_id", F.lit(p).alias("_path"), F.col("blk").alias("_to"), F.col("value").alias("_other")) for p in sorted(paths)]
    mixed = dealt.withColumn("_path", F.when(F.col("_op.op") == "mix", F.col("_op.text")))
    met = mixed.join(reduce(DataFrame.unionByName, others), ["track_id", "_path", "_to"], "left")
    return met.where("_path IS NULL OR _other IS NOT NULL").withColumn("second", F.coalesce("_other", "second"))
