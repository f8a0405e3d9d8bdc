"""Recursive filters over `samples(track_id, idx, value)` of any length.

A filter's state after a block is an affine map of its state before: a fixed matrix for the block's length, and what the
block adds from rest. Each block is reduced to that, the maps are composed along a track in groups of bounded
size, and a second pass runs every block from the state it begins with. The envelope follower isn't affine, but
forgets: a block of it is run from as far back as its state still matters.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.operators.signal import BLOCK, SAMPLE_RATE, blockwise, peak_normalize
from earmark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Samples that are filtered by one matrix product, and maps that one task composes.
CHUNK = 256
FAN = 4096
# Part of a state that may be left when it counts as forgotten.
FORGOTTEN = 1e-13


class Section:
    """A filter `a[0] y[n] = b[0] x[n] + b[1] x[n-1] + ... - a[1] y[n-1] - ...` with its state as a vector."""

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        order = max(len(b), len(a)) - 1
        self.b = np.zeros(order + 1)
        self.a = np.zeros(order + 1)
        self.b[: len(b)], self.a[: len(a)] = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
        self.order = order
        # z' = step z + enter x, y = z[0] + b[0] x
        self.step = np.zeros((order, order))
        self.step[:, :1] = -self.a[1:, None]
        self.step[:-1, 1:] += np.eye(order - 1) if order > 1 else 0
        self.enter = self.b[1:] - self.a[1:] * self.b[0]

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.step, int(n))

    def _matrices(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n samples: output from the state, output from the input, and state from the input."""
        states, impulse = [np.eye(self.order)], [self.b[0]]
        for i in range(n):
            impulse.append((states[-1] @ self.enter)[0] if self.order else 0.0)
            states.append(states[-1] @ self.step)
        lag = np.arange(n)[:, None] - np.arange(n)[None, :]
        through = np.where(lag >= 0, np.asarray(impulse)[np.maximum(lag, 0)], 0.0)
        return np.array([s[0] for s in states[:n]]), through, np.array([states[n - 1 - i] @ self.enter for i in range(n)])

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and last state from the state z, in matrix products over chunks."""
        if not self.order:
            return self.b[0] * x, z
        out = np.empty(len(x))
        whole = len(x) // CHUNK * CHUNK
        for lo, size in ((0, CHUNK), (whole, len(x) - whole)):
            rows = x[lo : lo + (whole if lo == 0 and size == CHUNK else size)].reshape(-1, size) if size else None
            if rows is None or not len(rows):
                continue
            from_state, through, into = self._matrices(size)
            y, added, jump = rows @ through.T, rows @ into, self.power(size)
            for i in range(len(rows)):
                y[i] += from_state @ z
                z = jump @ z + added[i]
            out[lo : lo + rows.size] = y.ravel()
        return out, z


def _states(maps: DataFrame, section: Section, fan: int) -> DataFrame:
    """`(track_id, pos, state)`: the state before each map of `maps(track_id, pos, n, added)`, from rest.

    Groups of `fan` neighbouring maps are composed into one, and these likewise, until a track has one group.
    """
    maps = cut_lineage(maps)
    kind = maps.schema["track_id"].dataType.simpleString()
    last = maps.agg(F.max("pos")).first()[0]
    grouped = maps.withColumn("grp", F.expr(f"pos div {fan}"))

    def compose(key: tuple, rows: pa.Table) -> pa.Table:
        rows, z = rows.sort_by("pos"), np.zeros(section.order)
        n = np.asarray(rows["n"])
        jumps = {int(k): section.power(k) for k in np.unique(n)}
        for k, added in zip(n.tolist(), rows["added"].to_pylist()):
            z = jumps[k] @ z + np.asarray(added)
        return pa.table({"track_id": rows["track_id"].slice(0, 1), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "added": pa.array([z.tolist()], pa.list_(pa.float64()))})

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        z, out = np.asarray(rows["entry"][0].as_py()), []
        n = np.asarray(rows["n"])
        jumps = {int(k): section.power(k) for k in np.unique(n)}
        for k, added in zip(n.tolist(), rows["added"].to_pylist()):
            out.append(z.tolist())
            z = jumps[k] @ z + np.asarray(added)
        return pa.table({"track_id": rows["track_id"], "pos": rows["pos"], "state": pa.array(out, pa.list_(pa.float64()))})

    if last is not None and last >= fan:
        above = grouped.groupBy("track_id", "grp").applyInArrow(compose, f"track_id {kind}, pos bigint, n bigint, added array<double>")
        entry = _states(above, section, fan).select("track_id", F.col("pos").alias("grp"), F.col("state").alias("entry"))
        grouped = grouped.join(entry, ["track_id", "grp"])
    else:
        grouped = grouped.withColumn("entry", F.array_repeat(F.lit(0.0), section.order))
    return grouped.groupBy("track_id", "grp").applyInArrow(fill, f"track_id {kind}, pos bigint, state array<double>")


def recursive_filter(samples: DataFrame, b: Sequence[float], a: Sequence[float], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Every track filtered from rest by `a[0] y[n] = b[0] x[n] + ... - a[1] y[n-1] - ...`."""
    section = Section(b, a)
    cut = cut_lineage(samples.select("track_id", "idx", "value").withColumn("pos", F.expr(f"idx div {block}")))
    kind = cut.schema["track_id"].dataType.simpleString()

    def from_rest(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        _, z = section.run(rows["value"].to_numpy(), np.zeros(section.order))
        return pa.table({"track_id": rows["track_id"].slice(0, 1), "pos": rows["pos"].slice(0, 1), "n": pa.array([rows.num_rows], pa.int64()), "added": pa.array([z.tolist()], pa.list_(pa.float64()))})

    def from_state(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        y, _ = section.run(left["value"].to_numpy(), np.asarray(right["state"][0].as_py()))
        return pa.table({"track_id": left["track_id"], "idx": left["idx"], "value": pa.array(y)})

    maps = cut.groupBy("track_id", "pos").applyInArrow(from_rest, f"track_id {kind}, pos bigint, n bigint, added array<double>")
    states = _states(maps, section, fan)
    return cut.groupBy("track_id", "pos").cogroup(states.groupBy("track_id", "pos")).applyInArrow(from_state, f"track_id {kind}, idx bigint, value double")


def turned(samples: DataFrame) -> DataFrame:
    """Every track from its end to its start."""
    sizes = samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n"))
    return samples.join(sizes, "track_id").select("track_id", (F.col("_n") - 1 - F.col("idx")).alias("idx"), "value")


def butterworth(kind: str, hz: float, sample_rate: int = SAMPLE_RATE, order: int = 4) -> list[tuple[list[float], list[float]]]:
    """Coefficients of second-order sections of a low- or high-pass with an even order, by the bilinear transform."""
    if kind not in ("low_pass", "high_pass") or order < 2 or order % 2:
        raise ValueError("low_pass or high_pass of an even order")
    if not 0 < hz < sample_rate / 2:
        raise ValueError("the edge must lie below half the sample rate")
    w = 2 * math.pi * hz / sample_rate
    out = []
    for i in range(order // 2):
        alpha = math.sin(w) * math.cos(math.pi * (2 * i + 1) / (2 * order))
        c = math.cos(w)
        side = (1 - c) / 2 if kind == "low_pass" else (1 + c) / 2
        middle = 1 - c if kind == "low_pass" else -(1 + c)
        out.append(([side, middle, side], [1 + alpha, -2 * c, 1 - alpha]))
    return out


def recursive_pass(samples: DataFrame, kind: str, hz: float, sample_rate: int = SAMPLE_RATE, order: int = 4, zero_phase: bool = True, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Butterworth low- or high-pass; with `zero_phase` forwards and then backwards, both from rest."""
    out = samples
    for _ in range(2 if zero_phase else 1):
        for b, a in butterworth(kind, hz, sample_rate, order):
            out = recursive_filter(out, b, a, block, fan)
        out = turned(out) if zero_phase else out
    return out


def followed(values: np.ndarray, attack: float, release: float) -> np.ndarray:
    """Envelope that moves towards each sample's size by `1 - attack` where it rises and `1 - release` where it falls."""
    out, e = np.empty(len(values)), 0.0
    for i, a in enumerate(np.abs(values).tolist()):
        e = a + (e - a) * (attack if a > e else release)
        out[i] = e
    return out


def follow_compress(
    samples: DataFrame, threshold_db: float, ratio: float, attack_ms: float = 10.0, release_ms: float = 100.0, sample_rate: int = SAMPLE_RATE, block: int = BLOCK
) -> DataFrame:
    """Reduce the level where an attack and release envelope is above the threshold.

    Each sample moves the envelope by at least a fixed part towards its size, so what was before `reach`
    samples weighs less than `FORGOTTEN`; blocks start that far back.
    """
    attack, release = (math.exp(-1000.0 / (ms * sample_rate)) for ms in (attack_ms, release_ms))
    reach = math.ceil(math.log(FORGOTTEN) / math.log(max(attack, release)))
    enveloped = blockwise(samples, reach, 0, ["value"], {"_env": lambda a: followed(a["value"], attack, release)}, block)
    t = F.lit(10.0 ** (threshold_db / 20.0))
    level = F.when(F.col("_env") > t, F.col("value") * ((t + (F.col("_env") - t) / ratio) / F.col("_env"))).otherwise(F.col("value"))
    return peak_normalize(enveloped.select("track_id", "idx", level.alias("value")), 1.0, 0.99, block)
