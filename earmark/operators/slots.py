"""Projection slots for a wanted recall.

How often a slot holds both a query and a vector depends on their distance alone, as directions are random. So a bounded
sample of distances is enough to choose: those of queries to their exact best hits say what a plan finds, those to any vectors
say what it compares.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.operators.vectors import ann_search, knn, knn_cosine, random_projections, slotted
from earmark.session import cut_lineage

# Queries and vectors that distances are taken from.
SAMPLE_QUERIES, SAMPLE_VECTORS = 256, 1024
# Distances are counted on this grid, so what reaches the driver is at most 129 counts.
GRID = 64
# Plans that are compared: directions of a table, and lengths of a cell in spreads of any two vectors along a direction.
WIDTHS = range(1, 13)
LENGTHS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
DRAWS = 1000


class SlotPlan(NamedTuple):
    """Arguments of `ann_search`, the share of exact hits they should find, and comparisons as a share of all pairs."""

    projections: list[list[list[float]]]
    bucket_length: float
    probes: int
    recall: float
    compared: float


class Found(NamedTuple):
    """Hits, the plan, and whether the plan was taken; else the hits are exact."""

    hits: DataFrame
    plan: SlotPlan
    by_slots: bool


def collisions(distances: np.ndarray, dim: int, width: int, length: float, probes: Sequence[int], seed: int = 5) -> list[np.ndarray]:
    """For each number of probes, the share of pairs of unit vectors at each distance that meet in one table.

    Along a random direction the query and what of the other vector is orthogonal to it are independent normal numbers.
    Cells have a border at zero, where most vectors are, so the query's place counts too.
    """
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((DRAWS, 1, width)) / math.sqrt(dim)
    other = rng.standard_normal((DRAWS, len(distances), width)) / math.sqrt(dim)
    cosine = (1.0 - distances**2 / 2)[None, :, None]
    moved = np.floor((at * cosine + other * np.sqrt(np.maximum(0.0, 1.0 - cosine**2))) / length) - np.floor(at / length)
    place = at / length - np.floor(at / length)
    away = np.abs(moved).sum(axis=2)
    # The one border that lies between, lower ones first, and how many are nearer to the query.
    borders = np.concatenate([place, 1.0 - place], axis=2)[:, 0]
    nearer = np.argsort(np.argsort(borders, axis=1), axis=1)
    crossed = np.abs(moved).argmax(axis=2)
    crossed = np.where(np.take_along_axis(moved, crossed[..., None], axis=2)[..., 0] > 0, crossed + width, crossed)
    before = np.take_along_axis(nearer, crossed, axis=1)
    return [((away == 0) | ((away == 1) & (before < n - 1))).mean(axis=0) for n in probes]


def _distances(hits: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distances of unit vectors on the grid, and the share of hits at each."""
    apart = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("similarity")))
    counts = sorted(hits.groupBy(F.round(apart * GRID).cast("int").alias("d")).count().where("d IS NOT NULL").collect())
    total = sum(n for _, n in counts)
    return np.array([d / GRID for d, _ in counts]), np.array([n / total for _, n in counts])


def _some(df: DataFrame, rows: int) -> DataFrame:
    """A bounded sample, the same in every run."""
    return cut_lineage(df.orderBy(F.xxhash64("vector"), "vector").limit(rows))


def plan_slots(
    queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.9, tables: int = 16,
    sample_queries: int = SAMPLE_QUERIES, sample_vectors: int = SAMPLE_VECTORS, seed: int = 11,
) -> SlotPlan:
    """The cheapest slots, by cosine, that should find the share `recall` of the exact top `k`, with at most `tables` tables.

    A sample of `sample_queries` queries is searched exactly, and compared with a sample of `sample_vectors` vectors.
    Two standard errors of a share of so many queries are added to the wanted recall. Where no plan compares less than all
    pairs, and without queries or vectors, all vectors share one slot, which is the exact search.
    """
    first = corpus.select(F.size("vector")).first() or queries.select(F.size("vector")).first()
    dim = first[0] if first else 1
    best = SlotPlan([[[0.0] * dim]], 1.0, 1, 1.0, 1.0)
    asked = _some(queries, sample_queries)
    near, found = _distances(knn_cosine(asked, corpus, k))
    if not len(near):
        return best
    far, met = _distances(knn_cosine(asked, _some(corpus.select("cand_id", "vector"), sample_vectors), sample_vectors))
    wanted = min(0.999, recall + 2 * math.sqrt(recall * (1 - recall) / asked.count()))
    usual = max(1.0 / GRID, float(far[np.searchsorted(np.cumsum(met), 0.5)])) / math.sqrt(dim)
    for width in WIDTHS:
        for factor in LENGTHS:
            probes = (1, 1 + width, 1 + 2 * width)
            both = collisions(np.concatenate([near, far]), dim, width, factor * usual, probes)
            for n, share in zip(probes, both):
                missed, cost = 1.0 - share[: len(near)], float(share[len(near) :] @ met)
                for count in range(1, tables + 1):
                    if count * cost >= best.compared:
                        break
                    finds = float(found @ (1.0 - missed**count))
                    if finds >= wanted:
                        best = SlotPlan(random_projections(dim, count, width, seed), factor * usual, n, finds, count * cost)
                        break
    return best


def slot_pairs(queries: DataFrame, corpus: DataFrame, projections: Sequence[Sequence[Sequence[float]]], bucket_length: float, probes: int = 1) -> DataFrame:
    """For each table that brings any together: `slots` with both sides, `pairs` to compare, and those of the `largest` slot.

    Only slots and their counts are shuffled. A pair that meets in several tables counts in each.
    """

    def counted(df: DataFrame, probes: int, name: str) -> DataFrame:
        return slotted(df.select("vector"), projections, bucket_length, probes).groupBy("_bucket").agg(F.count(F.lit(1)).alias(name))

    both = counted(queries, probes, "_q").join(counted(corpus, 1, "_c"), "_bucket").withColumn("_pairs", F.col("_q") * F.col("_c"))
    return both.groupBy(F.col("_bucket.table").alias("table")).agg(
        F.count(F.lit(1)).alias("slots"), F.sum("_pairs").alias("pairs"), F.max("_pairs").alias("largest")
    )


def search_slots(queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.9, worth: float = 0.2, **options) -> Found:
    """Top `k` by cosine with a wanted recall: by slots where their plan compares at most the share `worth` of all pairs, else exactly.

    `options` are those of `plan_slots`. The plan says what to expect, so callers can see which way was taken.
    """
    plan = plan_slots(queries, corpus, k, recall, **options)
    if plan.compared > worth:
        return Found(knn(queries, corpus, k, "cosine"), plan, False)
    return Found(ann_search(queries, corpus, k, plan.projections, plan.bucket_length, probes=plan.probes), plan, True)
