"""Exact search by cells: radii and the triangle inequality say which cells a query needs.

A cell is known by its centroid, its radius (the distance of its farthest member) and its size. No member
can score better with a query than the centroid's distance and the radius allow. A query is compared
with its best cells first, and its last score there decides which further cells could still change the
result. Query sets that fit go to every task and the corpus is read where it lies; larger ones meet their cells in blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.operators.vectors import (
    BLOCK_ROWS, BROADCAST_BYTES, METRICS, QUERY_CHUNK, ROW, W, _Best, _blocked_topk, _depths, _few_cells, _few_queries, _finish, _hit_schema,
    _matrix, _number, _query_keys, _unit, assign_cells, l2_normalize, train_cells,
)
from earmark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells that a query is compared with before its last score is taken, at least.
FIRST_CELLS = 4
# Room for rounding: scores lie on a grid, bounds do not.
MARGIN = 1e-8
# Cells up to this number are named in the filter on the corpus, which prunes folders of a stored index.
NAMED_CELLS = 1_000


class CellSearch(NamedTuple):
    """Hits as of `knn`, and for each query row how many cells and vectors it was compared with."""

    hits: DataFrame
    compared: DataFrame


def _space(m: np.ndarray, metric: str) -> np.ndarray:
    return _unit(m) if metric == "cosine" else m


def measure_cells(members: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """Centroids with the `radius` and `size` of their cells, from `members(cell_id, vector)`.

    Distances are those of the metric's space: between unit vectors for `cosine`. Cells without members
    have size 0 and radius 0.
    """
    scaled = l2_normalize(members.select("cell_id", "vector")) if metric == "cosine" else members.select("cell_id", "vector")
    cells = _few_cells(centroids.select("cell_id", "vector"), 8 * BROADCAST_BYTES)
    if cells is None:
        both = scaled.join(centroids.select("cell_id", F.col("vector").alias("_centre")), "cell_id")
        away = F.zip_with("vector", "_centre", lambda x, y: (x - y) * (x - y))
        spread = both.select("cell_id", F.sqrt(F.aggregate(away, F.lit(0.0), lambda a, x: a + x)).alias("far"), F.lit(1).cast("bigint").alias("n"))
    else:
        shared = members.sparkSession.sparkContext.broadcast((np.asarray(cells["cell_id"]), _matrix(cells["vector"])))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, centres = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.asarray(batch.column("cell_id"))
                d = _matrix(batch.column("vector"), centres.shape[1]) - centres[np.searchsorted(ids, own)]
                far = np.sqrt((d * d).sum(axis=1))
                order = np.argsort(own, kind="stable")
                at = np.flatnonzero(np.diff(own[order], prepend=own[order][0] - 1))
                yield pa.record_batch(
                    [pa.array(own[order][at]), pa.array(np.maximum.reduceat(far[order], at)), pa.array(np.diff(np.append(at, len(own))))], names=["cell_id", "far", "n"]
                )

        kind = centroids.schema["cell_id"].dataType.simpleString()
        spread = scaled.mapInArrow(measure, f"cell_id {kind}, far double, n bigint")
    found = spread.groupBy("cell_id").agg(F.max("far").alias("radius"), F.sum("n").alias("size"))
    return centroids.select("cell_id", "vector").join(found, "cell_id", "left").fillna(0, ["radius", "size"])


def upper_bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """The best score that a member of each cell could have with each query row (in the metric's space)."""
    product = q @ centres.T
    squares = (q * q).sum(axis=1)[:, None]
    if metric == "ip":
        return product + np.sqrt(squares) * radius[None, :]
    away = np.sqrt(np.maximum(squares + (centres * centres).sum(axis=1)[None, :] - 2.0 * product, 0.0))
    nearest = np.maximum(away - radius[None, :], 0.0)
    if metric == "l2":
        return -nearest * nearest
    # Of unit vectors: 1 - d^2 / 2, and by the inner product.
    return np.minimum(1.0 - nearest * nearest / 2.0, product + radius[None, :])


class Cells:
    """Centroids, radii and sizes as arrays, with the choice of cells for query rows."""

    def __init__(self, ids: np.ndarray, centres: np.ndarray, radius: np.ndarray, size: np.ndarray, metric: str, first: int):
        self.ids, self.centres, self.radius, self.size = ids, centres, radius, size
        self.metric, self.first = metric, first

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds by (query row, cell); minus infinity for empty cells."""
        out = upper_bounds(_space(q, self.metric), self.centres, self.radius, self.metric)
        out[:, self.size == 0] = -np.inf
        return out

    def opening(self, bounds: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The cells that rows are compared with first, as a matrix of flags: the best ones until they hold `depth` vectors."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1)
        before = held - self.size[order]
        chosen = ((before < depth[:, None]) | (np.arange(order.shape[1]) < self.first)[None, :]) & (self.size[order] > 0)
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, chosen, axis=1)
        return out

    def following(self, bounds: np.ndarray, opening: np.ndarray, floor: np.ndarray, max_cells: int | None) -> np.ndarray:
        """Further cells that could hold a better hit than the last one; `max_cells` bounds all cells of a row."""
        out = ~opening & (bounds >= (floor - MARGIN * (1 + np.abs(np.where(np.isfinite(floor), floor, 0.0))))[:, None]) & (self.size > 0)
        if max_cells is not None:
            order = np.argsort(-np.where(out, bounds, -np.inf), axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            out &= place < (max_cells - opening.sum(axis=1))[:, None]
        return out


def _chosen(queries: DataFrame, shared, k: int | str, keys: list[str], max_cells: int | None, floors: bool, with_vectors: bool) -> DataFrame:
    """Cells of each query row: `(_row, _bucket)` and, where they are to travel, the row itself.

    Without `floors` the opening cells, with them (in a column `_floor`) the following ones.
    """
    shown = [*keys, "vector"] if with_vectors else [ROW]
    fields = [queries.schema[c] for c in shown]
    schema = T.StructType([*fields, T.StructField("_bucket", T.LongType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_CHUNK):
                part = batch.slice(at, QUERY_CHUNK)
                bounds = cells.bounds(_matrix(part.column("vector"), cells.centres.shape[1]))
                flags = cells.opening(bounds, np.broadcast_to(_depths(part, k), part.num_rows))
                if floors:
                    flags = cells.following(bounds, flags, np.asarray(part.column("_floor")), max_cells)
                rows, cols = np.nonzero(flags)
                out = pa.Table.from_batches([part.select(shown)]).take(pa.array(rows))
                yield from out.append_column("_bucket", pa.array(cells.ids[cols].astype(np.int64))).to_batches()

    return queries.mapInArrow(choose, schema)


def _places_of(few: pa.Table, rows: np.ndarray) -> np.ndarray:
    """Where in `few` the query rows of some numbers are."""
    numbers = np.asarray(few[ROW])
    order = np.argsort(numbers)
    return order[np.searchsorted(numbers[order], rows)]


def _scan(spark: SparkSession, few: pa.Table, keys: list[str], corpus: DataFrame, pairs: DataFrame, schema: T.StructType, k: int | str, metric: str, floor: np.ndarray | None) -> DataFrame:
    """Hits of query rows in the cells of `pairs(_row, _bucket)`; rows go to all tasks and the corpus stays where it is."""
    found = pairs.toArrow()
    cell, row = np.asarray(found["_bucket"]), np.asarray(found[ROW])
    order = np.argsort(cell, kind="stable")
    ids, at = np.unique(cell[order], return_index=True)
    wanted = dict(zip(ids.tolist(), np.split(_places_of(few, row[order]), at[1:])))
    shared = spark.sparkContext.broadcast((few.select(keys), _matrix(few["vector"]), _depths(few, k), floor, wanted))
    names = schema.fieldNames()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_rows, q, depth, floor, wanted = shared.value
        best = _Best(q, depth, metric, floor)
        for batch in batches:
            own = np.asarray(batch.column("cell_id"))
            for c in np.unique(own).tolist():
                if c in wanted:
                    inside = pa.array(np.flatnonzero(own == c))
                    best.offer(batch.column("cand_id").take(inside), _matrix(batch.column("vector").take(inside), q.shape[1]), wanted[c])
        if best.found is not None:
            yield from best.table(key_rows, "cand_id").select(names).to_batches()

    read = corpus.where(F.col("cell_id").isin(ids.tolist())) if len(ids) <= NAMED_CELLS else corpus
    return read.select("cand_id", "vector", "cell_id").mapInArrow(search, schema)


def search_cells(
    queries: DataFrame,
    corpus: DataFrame,
    k: int | str,
    centroids: DataFrame | None = None,
    nlist: int | None = None,
    metric: str = "cosine",
    max_cells: int | None = None,
    first: int = FIRST_CELLS,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> CellSearch:
    """Top `k` of each query row as in `knn`, comparing it only with cells that could change its result.

    `max_cells` bounds the cells of a query row, best ones first, beyond those that hold its first `k` vectors;
    then hits may be missed. Centroids without radii are measured on the corpus; `build_index` stores them.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if "cell_id" in corpus.columns and centroids is None:
        raise ValueError("a corpus with cells needs the centroids of these cells")
    spark = queries.sparkSession
    centroids = train_cells(corpus, nlist) if centroids is None else centroids
    placed = corpus if "cell_id" in corpus.columns else cut_lineage(assign_cells(corpus.select("cand_id", "vector"), centroids))
    if "radius" not in centroids.columns:
        centroids = measure_cells(placed, centroids, metric)
    table = _few_cells(centroids, 8 * BROADCAST_BYTES)
    if table is None:
        raise ValueError("the bounds of so many cells cannot be held by a task; use fewer cells, or nprobe")
    radius, size = np.asarray(table["radius"]).astype(np.float64), np.asarray(table["size"]).astype(np.int64)
    shared = spark.sparkContext.broadcast((np.asarray(table["cell_id"]), _matrix(table["vector"]), radius, size, metric, first))
    user = _query_keys(queries)
    numbered = _number(queries.select(*user, "vector"))
    keys = [*user, ROW]
    schema = _hit_schema(numbered, keys, corpus)
    few = _few_queries(numbered, k, broadcast_bytes)

    def hits_in(pairs: DataFrame, floor: np.ndarray | None) -> DataFrame:
        if few is not None:
            return _scan(spark, few, keys, placed, pairs, schema, k, metric, floor)
        members = placed.select("cand_id", "vector", F.col("cell_id").cast("bigint").alias("_bucket"))
        return _blocked_topk(pairs, keys, members, schema, k, metric, block_rows)

    opening = cut_lineage(_chosen(numbered, shared, k, keys, None, False, few is None))
    near = cut_lineage(hits_in(opening, None))
    limit = F.lit(k) if isinstance(k, int) else F.col(k)
    order = W.partitionBy(ROW).orderBy(F.col("score").desc())
    last = near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == limit).select(ROW, F.col("score").alias("_floor"))
    floored = numbered.join(last, ROW, "left").fillna(float("-inf"), ["_floor"])
    following = cut_lineage(_chosen(floored, shared, k, keys, max_cells, True, few is None))
    floor = None
    if few is not None:
        floor = np.full(few.num_rows, -np.inf)
        lasts = last.toArrow()
        floor[_places_of(few, np.asarray(lasts[ROW]))] = np.asarray(lasts["_floor"])
    far = hits_in(following, floor)
    sizes = centroids.select(F.col("cell_id").cast("bigint").alias("_bucket"), "size")
    both = opening.select(ROW, "_bucket").unionByName(following.select(ROW, "_bucket")).join(sizes, "_bucket")
    counted = both.groupBy(ROW).agg(F.count(F.lit(1)).alias("cells"), F.sum("size").alias("vectors"))
    compared = numbered.select(*keys).join(counted, ROW, "left").fillna(0, ["cells", "vectors"]).drop(ROW)
    return CellSearch(_finish(near.unionByName(far), k, metric), compared)
