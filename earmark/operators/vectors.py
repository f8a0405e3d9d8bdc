"""Vector search, index tables and vector comparisons.

Scores are computed as matrix products over Arrow batches inside tasks. Spark decides where the
rows go: a query set that is small enough, which is checked, is broadcast and the corpus is read
once without a shuffle; beyond that both sides are split into blocks that meet by an equi-join key.
The result is the same either way: each query row gets its own best `k`, also where several rows
carry equal keys. A task never returns more than `k` hits for a query row, so pairs are never
materialised. Vectors must be of one length and without nulls; anything else raises an error.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from earmark.functions.columns import track_of_segment
from earmark.session import bound_batches, cut_lineage

# Most bytes of vectors that may be sent to every task. Larger sides are split into blocks.
BROADCAST_BYTES = 32 << 20
# Most hits that a task may hold for the queries it was sent.
TASK_HITS = 4_000_000
# Vectors on each side of one block product, and those that travel as one row of packed vectors.
BLOCK_ROWS = 8_192
PACK_ROWS = 8_192
# Above so many bytes a corpus is read by many tasks; then a sample of so many vectors gives each query a floor, and
# hits of tasks are merged in so many groups before they meet.
FLOOR_BYTES = 1 << 30
FLOOR_ROWS = 50_000
MERGE_GROUPS = 32
# New hits that a task gathers before it sorts them among the best so far.
PENDING_HITS = 1 << 18
# Query rows and candidates multiplied at a time, which bounds the score matrix in a task.
QUERY_CHUNK = 1_024
CANDIDATE_CHUNK = 2_048
# Candidates that rows without a floor are compared with first, if they ask for few hits.
FIRST_CHUNK = 512
# Scores are compared on a grid of 2^-30, so equal vectors tie and the tie goes to the smaller id.
SCORE_GRID = float(2**30)

# Send the block product to workers with the task, so they need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Column with the number of a query row.
ROW = "_query_row"

METRICS = ("cosine", "ip", "l2")
INDEX_TYPES = ("flat", "ivf", "lsh")


# ---------------------------------------------------------------- V1, V8


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vectors: DataFrame, mode: str = "l2", column: str = "vector") -> DataFrame:
    """Divide by the L2 norm. A zero vector stays as it is; mode `none` passes everything through."""
    if mode == "none":
        return vectors
    if mode != "l2":
        raise ValueError(f"unknown normalisation: {mode}")
    length = norm(F.col(column))
    # The one-element array binds the norm once. As a plain column the optimizer would copy it into
    # the inner function and compute it again for every dimension.
    lengths = F.array(F.when(length > 0, length).otherwise(1.0))
    scaled = F.transform(lengths, lambda n: F.transform(F.col(column), lambda x: x / n))
    return vectors.withColumn(column, F.element_at(scaled, 1))


# ---------------------------------------------------------------- block products


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix. All must have the first one's length, or `dim` where it is given."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, dim or 0))
    flat = array.flatten()
    if array.null_count or flat.null_count:
        raise ValueError("a vector, or an element of one, is null")
    lengths = pc.list_value_length(array).to_numpy()
    dim = int(lengths[0]) if dim is None else dim
    if (lengths != dim).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))[:3]} elements where {dim} are expected")
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(array), dim)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1.0)


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Higher is better: the inner product, or the negative squared distance."""
    product = q @ c.T
    if metric == "l2":
        squares = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * product
        product = -np.maximum(squares, 0.0)
    return np.round(product * SCORE_GRID) / SCORE_GRID


def _places(rows: np.ndarray) -> np.ndarray:
    """Position inside each run of equal numbers."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")


def _leading(m: np.ndarray) -> np.ndarray:
    """Elements of each row up to its last one that is not 0, at least 1."""
    used = m != 0
    return np.where(used.any(axis=1), m.shape[1] - np.argmax(used[:, ::-1], axis=1), 1) if m.shape[1] else np.ones(len(m), np.int64)


def _few_true(flags: np.ndarray) -> np.ndarray:
    """Places of the flags that are set, eight at a time where hardly any is."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    eights = np.flatnonzero(flags.view(np.uint64))
    at, inside = np.nonzero(flags.reshape(-1, 8)[eights])
    return eights[at] * 8 + inside


class _Best:
    """The best candidates seen so far for each query row of one task, each row to its own depth `k`.

    Only scores of at least `floor` are taken, where a lower bound of a row's last score is known. Candidates are
    compared in single precision with the floor, less the rounding that this allows, and only those that pass get
    their score. Candidates too short for the floors are not compared. Matrices of scores have at most `QUERY_CHUNK` by `CANDIDATE_CHUNK` elements, whatever is offered.
    """

    def __init__(self, queries: np.ndarray, k: int | np.ndarray, metric: str, floor: np.ndarray | None = None, block_rows: int = BLOCK_ROWS):
        self.rows, self.candidates, self.slab = min(block_rows, QUERY_CHUNK), min(block_rows, CANDIDATE_CHUNK), block_rows
        self.q = _unit(queries) if metric == "cosine" else queries
        self.k, self.metric = np.broadcast_to(np.asarray(k, np.int64), len(queries)), metric
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.astype(np.float64)
        self.squares = (self.q * self.q).sum(axis=1)
        # By l2 the order is that of q.c - |c|^2 / 2, which is a product too.
        with np.errstate(over="ignore"):
            self.narrow = self.q.astype(np.float32)
        if metric == "l2":
            self.narrow = np.hstack([np.ones((len(self.q), 1), np.float32), self.narrow])
        self.lead = _leading(self.narrow)
        self.parts: list[pa.Table] = []
        self.pending = self.held = 0

    def _like(self, rows: np.ndarray, least: float = 0.0) -> Iterator[np.ndarray]:
        """Rows of like depth, floor and number of leading elements, which are compared together."""
        rows = rows[self.k[rows] > 0]
        kind = np.ceil(2 * np.log2(self.lead[rows])).astype(np.int64)
        order = np.lexsort((self._needed(rows, self._as_products(self.floor[rows], rows), least), self.k[rows], kind))
        rows, kind = rows[order], kind[order]
        cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(rows)]
        return (rows[at : min(at + self.rows, hi)] for lo, hi in zip(cuts, cuts[1:]) for at in range(lo, hi, self.rows))

    def offer(self, ids: pa.Array, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compare with all query rows, or with the given ones."""
        among = np.arange(len(self.k)) if rows is None else rows
        for lo in range(0, len(vectors), self.slab):
            self._offer(ids.slice(lo, self.slab), vectors[lo : lo + self.slab], among)

    def _offer(self, ids: pa.Array, c: np.ndarray, among: np.ndarray) -> None:
        """Long candidates first. A product is at most both lengths, so the short ones are left out where a row can't reach its floor with them.

        Lengths are those of the elements that the rows use, which are few where rows end in zeros.
        """
        wide = self.metric == "l2"
        c = _unit(c) if self.metric == "cosine" else c
        squares = (c * c).sum(axis=1)
        size = np.sqrt(squares.max() + (squares.max() ** 2 / 4 if wide else 0.0))
        least = squares.min() / 2 if wide else 0.0
        with np.errstate(over="ignore"):
            narrow = np.hstack([-squares[:, None] / 2, c]).astype(np.float32) if wide else c.astype(np.float32)
        lead = None
        for some in self._like(among, least):
            if lead != (lead := int(self.lead[some].max())):
                length = np.sqrt((c[:, : lead - wide] ** 2).sum(axis=1))
                order = np.argsort(-length, kind="stable")
                length, near = length[order], np.ascontiguousarray(narrow[order, :lead])
            first, lo = min(self.candidates, FIRST_CHUNK), 0
            while lo < len(c):
                limit, hi = self._limits(some, size, c.shape[1]), lo + self.candidates
                if limit is None:
                    hi = first if not lo and 8 * self.k[some].max() <= first else hi
                else:
                    hi = min(hi, int(np.searchsorted(-length, -self._needed(some, limit, least).min(), side="right")))
                    if lo >= hi:
                        break
                at = order[lo:hi]
                found, cols, score = self._all(some, c[at]) if limit is None else self._above(some, c, at, near[lo:hi], limit)
                if len(found):
                    self.parts.append(pa.table({"row": pa.array(some[found], pa.int64()), "score": score, "id": ids.take(pa.array(at[cols]))}))
                    self.pending += len(found)
                    if self.pending > max(PENDING_HITS, self.held):
                        self.settle()
                lo = hi

    def _as_products(self, floor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (floor + self.squares[rows]) / 2 if self.metric == "l2" else floor

    def _needed(self, rows: np.ndarray, product: np.ndarray, least: float) -> np.ndarray:
        """How long a candidate must be for such a product with each row; `least` is the least that a product loses by l2."""
        length, want = np.sqrt(self.squares[rows]), product.astype(np.float64) + least
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(length > 0, want / length, np.where(want > 0, np.inf, -np.inf))

    def _limits(self, some: np.ndarray, size: float, dim: int) -> np.ndarray | None:
        """What a product in single precision must reach for a score of at least the floor; none if that can't be said."""
        floor, squares = self._as_products(self.floor[some], some), self.squares[some] + (self.metric == "l2")
        slack = (dim + 16) * 2.0**-23 * (np.sqrt(squares) * size + np.abs(floor)) + 2.0**-28
        limit = floor - slack
        # The last product that numbers of single precision hold is near 1e38.
        return limit.astype(np.float32) if np.isfinite(limit).all() and (np.sqrt(squares) * size + np.abs(limit)).max() < 1e30 else None

    def _all(self, some: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of all candidates for each row, whose last scores are its floor from now on."""
        s, k, n = _scores(self.q[some], c, self.metric), self.k[some], len(c)
        kth, less = np.full(len(s), -np.inf), k < n
        if less.any():
            parted = np.partition(s, np.unique(n - k[less]), axis=1)
            kth[less] = parted[less, n - k[less]]
        found, cols = np.nonzero(s >= np.maximum(kth, self.floor[some])[:, None])
        self.floor[some] = np.fmax(self.floor[some], kth)
        return found, cols, s[found, cols]

    def _above(self, some: np.ndarray, c: np.ndarray, at: np.ndarray, near: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates `at`, in single precision `near`, whose scores reach the floors."""
        product = self.narrow[some, : near.shape[1]] @ near.T
        # Most rows have no such candidate, and their largest product is found faster than all are held against the limit.
        reached = np.flatnonzero(product.max(axis=1) >= limit)
        found, cols = np.divmod(_few_true((product[reached] >= limit[reached, None]).ravel()), len(at))
        found = reached[found]
        rows, right = some[found], c[at[cols]]
        score = np.einsum("ij,ij->i", self.q[rows], right)
        if self.metric == "l2":
            score = -np.maximum(self.squares[rows] + (right * right).sum(axis=1) - 2.0 * score, 0.0)
        score = np.round(score * SCORE_GRID) / SCORE_GRID
        keep = score >= self.floor[rows]
        return found[keep], cols[keep], score[keep]

    def settle(self) -> pa.Table | None:
        """Sort what was gathered, keep the best of each row and raise the floors."""
        if not self.parts or not self.pending:
            return self.parts[0] if self.parts else None
        merged = pa.concat_tables(self.parts)
        rows, score = merged["row"].to_numpy(), merged["score"].to_numpy()
        order = np.lexsort((-score, rows))
        rows, score = rows[order], score[order]
        at_k = np.flatnonzero(_places(rows) == self.k[rows] - 1)
        self.floor[rows[at_k]] = np.maximum(self.floor[rows[at_k]], score[at_k])
        kept = score >= self.floor[rows]
        order, rows, score = order[kept], rows[kept], score[kept]
        # Only equal scores of a row go by their ids.
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (score[1:] != score[:-1])
        tie = np.cumsum(new)
        tied = np.flatnonzero(np.bincount(tie)[tie] > 1)
        if len(tied):
            by_id = pa.table({"tie": tie[tied], "id": merged["id"].take(pa.array(order[tied]))})
            order[tied] = order[tied][pc.sort_indices(by_id, [("tie", "ascending"), ("id", "ascending")]).to_numpy()]
        self.parts = [merged.take(pa.array(order[_places(rows) < self.k[rows]])).combine_chunks()]
        self.pending, self.held = 0, self.parts[0].num_rows
        return self.parts[0]

    @property
    def found(self) -> pa.Table | None:
        return self.settle()

    def places(self) -> np.ndarray:
        """Place of each hit among those of its query, from 0."""
        return _places(self.found["row"].to_numpy())

    def table(self, keys: pa.Table, id_name: str) -> pa.Table:
        rows = self.found["row"]
        out = {name: keys[name].take(rows) for name in keys.column_names}
        return pa.table({**out, id_name: self.found["id"], "score": self.found["score"]})


def _hit_schema(queries: DataFrame, keys: Sequence[str], corpus: DataFrame) -> T.StructType:
    fields = [queries.schema[k] for k in keys] + [corpus.schema["cand_id"]]
    return T.StructType(fields + [T.StructField("score", T.DoubleType())])



def _depths(rows: pa.Table | pa.RecordBatch, k: int | str) -> int | np.ndarray:
    """Depth of each row: one number, or the column that holds it; a null depth is 0."""
    return k if isinstance(k, int) else np.asarray(pc.fill_null(rows[k], 0)).astype(np.int64)


def _broadcast_topk(
    spark: SparkSession, query_rows: pa.Table, keys: Sequence[str], corpus: DataFrame, schema: T.StructType, k: int | str, metric: str,
    floor: np.ndarray | None = None,
) -> DataFrame:
    shared = spark.sparkContext.broadcast((query_rows.select(list(keys)), _matrix(query_rows["vector"]), _depths(query_rows, k), floor))
    names = schema.fieldNames()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_rows, q, depth, floor = shared.value
        best = _Best(q, depth, metric, floor)
        for batch in batches:
            best.offer(batch.column("cand_id"), _matrix(batch.column("vector"), q.shape[1] if len(q) else None))
        if best.found is not None:
            yield from best.table(key_rows, "cand_id").select(names).to_batches()

    return corpus.select("cand_id", "vector").mapInArrow(search, schema)


def _last_scores(found: DataFrame, k: int | str, rows: int) -> np.ndarray:
    """The last score of each query row that has all its hits in `found`, minus infinity for others."""
    limit = F.lit(k) if isinstance(k, int) else F.col(k)
    order = W.partitionBy(ROW).orderBy(F.col("score").desc())
    last = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == limit).select(ROW, "score").toArrow()
    out = np.full(rows, -np.inf)
    out[np.asarray(last[ROW])] = np.asarray(last["score"])
    return out


def _sample_floors(spark: SparkSession, few: pa.Table, corpus: DataFrame, schema: T.StructType, k: int | str, metric: str, rows: int) -> np.ndarray:
    """A lower bound of the last score of each query row, from a sample of at most `rows` vectors.

    Any part of the corpus gives a bound, so the sample decides nothing but how much it prunes.
    """
    share = max(1, _estimated_bytes(corpus) // max(1, rows * 8 * max(1, len(few["vector"][0]))))
    sample = corpus.where(F.pmod(F.xxhash64("cand_id"), F.lit(share)) == 0).limit(rows).repartition(spark.sparkContext.defaultParallelism)
    return _last_scores(_broadcast_topk(spark, few, schema.fieldNames()[:-2], sample, schema, k, metric), k, few.num_rows)


def _estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of a table."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 60)


def _broadcast_corpus(
    spark: SparkSession, queries: DataFrame, keys: Sequence[str], corpus_rows: pa.Table, schema: T.StructType, k: int | str, metric: str
) -> DataFrame:
    """Search a corpus that every task holds; each batch of queries is answered in full where it is."""
    shared = spark.sparkContext.broadcast((corpus_rows["cand_id"].combine_chunks(), _matrix(corpus_rows["vector"])))
    names = schema.fieldNames()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for batch in batches:
            if batch.num_rows and len(c):
                best = _Best(_matrix(batch.column("vector"), c.shape[1]), _depths(batch, k), metric)
                best.offer(ids, c)
                if best.found is None:
                    continue
                hits = best.table(pa.Table.from_batches([batch.select(list(keys))]), "cand_id").select(names)
                yield from hits.append_column("rank", pa.array(best.places() + 1, pa.int32())).to_batches()

    ranked = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])
    return queries.select(*keys, "vector").mapInArrow(search, ranked)


def _pack(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows of a partition side by side: `(_bucket, name, _n)`, at most `size` of one bucket in a row of Arrow bytes.

    Rows of a bucket should stand together.
    """
    content = [c for c in rows.columns if c != "_bucket"]
    schema = T.StructType([rows.schema["_bucket"], T.StructField(name, T.BinaryType()), T.StructField("_n", T.LongType())])

    def made(bucket: pa.Scalar, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([bucket], bucket.type), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([table.num_rows], pa.int64())], names=schema.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, held = None, [], 0
        for batch in batches:
            own = batch.column("_bucket")
            codes = own.dictionary_encode() if not pa.types.is_nested(own.type) else pa.array([repr(x) for x in own.to_pylist()]).dictionary_encode()
            codes = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            for lo, hi in zip(starts, np.append(starts[1:], len(codes))):
                if parts and bucket != own[lo]:
                    yield made(bucket, parts)
                    parts, held = [], 0
                bucket = own[lo]
                while lo < hi:
                    part = batch.select(content).slice(lo, min(hi - lo, size - held))
                    parts, held, lo = [*parts, part], held + part.num_rows, lo + part.num_rows
                    if held == size:
                        yield made(bucket, parts)
                        parts, held = [], 0
        if parts:
            yield made(bucket, parts)

    return rows.mapInArrow(pack, schema)


def _by_bucket(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a bucket side by side; a hot bucket lies in many partitions."""
    return rows.repartitionByRange("_bucket", F.xxhash64(key)).sortWithinPartitions("_bucket", key)


def _unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _blocked_topk(
    queries: DataFrame, keys: Sequence[str], corpus: DataFrame, schema: T.StructType, k: int | str, metric: str, block_rows: int, one_bucket: bool = False,
    part_bytes: int = 2 * BROADCAST_BYTES,
) -> DataFrame:
    """Top `k` of each block of queries in each part of the corpus, inside equal values of `_bucket`.

    Both sides become rows of packed vectors, once each, and are multiplied in blocks of `block_rows`. Parts of the corpus, of about `part_bytes`, are held by a task
    while blocks of queries pass by, so nothing is copied for each block of the other side, and a task sends
    at most `k` hits of a query row for a part.
    """
    spark = queries.sparkSession
    bound_batches(spark)
    names = schema.fieldNames()
    c = corpus.select("cand_id", "vector", "_bucket")
    c = cut_lineage(_pack(c if one_bucket else _by_bucket(c, "cand_id"), "_right", PACK_ROWS).withColumn("_at", F.monotonically_increasing_id()))
    held = c.agg(F.sum(F.length("_right"))).first()[0] or 0
    c = c.select("_bucket", "_at", "_right").repartitionByRange(max(1, -(-held // part_bytes)), "_bucket", "_at").select(F.col("_bucket").alias("_in"), "_right")
    q = queries.select(*keys, "vector", "_bucket")
    q = _pack(q if one_bucket else _by_bucket(q, ROW), "_left", PACK_ROWS).select("_bucket", "_left", F.monotonically_increasing_id().alias("_no"))
    q = q.repartition(3 * spark.sparkContext.defaultParallelism)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, best = None, None, None

        def hits() -> Iterator[pa.RecordBatch]:
            if best is not None and best.found is not None:
                yield from best.table(left.select(list(keys)), "cand_id").select(names).to_batches()

        for batch in batches:
            numbers = np.asarray(batch.column("_no"))
            starts = np.flatnonzero(np.diff(numbers, prepend=-1))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)]):
                if numbers[lo] != now:
                    yield from hits()
                    now, left = numbers[lo], _unpacked(batch.column("_left")[lo])
                    best = _Best(_matrix(left["vector"]), _depths(left, k), metric, block_rows=block_rows)
                right = pa.concat_tables([_unpacked(batch.column("_right")[i]) for i in range(lo, hi)])
                best.offer(right["cand_id"].combine_chunks(), _matrix(right["vector"], best.q.shape[1]))
        yield from hits()

    met = q.join(c.hint("shuffle_replicate_nl"), F.col("_bucket") == F.col("_in"))
    return met.select("_no", "_left", "_right").mapInArrow(search, schema)


def _merged(found: DataFrame, k: int | str, groups: int = MERGE_GROUPS) -> DataFrame:
    """Hits of many tasks, merged in groups of tasks: at most `groups * k` hits of a query row are left."""
    limit = F.lit(k) if isinstance(k, int) else F.col(k)
    order = W.partitionBy(ROW, "_group").orderBy(F.col("score").desc(), "cand_id")
    grouped = found.withColumn("_group", F.spark_partition_id() % groups)
    return grouped.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).drop("_place", "_group")


def _finish(found: DataFrame, k: int | str, metric: str) -> DataFrame:
    """Best `k` of each query row over all tasks, as numbered by `_number`."""
    limit = F.lit(k) if isinstance(k, int) else F.col(k)
    order = W.partitionBy(ROW).orderBy(F.col("score").desc(), "cand_id")
    return _similarity(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop(ROW), metric)


def _similarity(ranked: DataFrame, metric: str) -> DataFrame:
    """Scores as similarities, and as distances where those were asked for."""
    if metric == "l2":
        distance = F.when(F.col("score") == 0, 0.0).otherwise(-F.col("score"))
        return ranked.withColumn("distance", distance).withColumn("similarity", 1.0 / (1.0 + F.col("distance"))).drop("score")
    return ranked.withColumnRenamed("score", "similarity")


def _bounded(df: DataFrame, rows: int) -> pa.Table | None:
    """All rows of a table, if it has no more than `rows`. A table that looks large is counted before its rows go to the driver."""
    if rows > 0 and _estimated_bytes(df) > BROADCAST_BYTES and df.limit(rows + 1).count() > rows:
        return None
    head = df.limit(rows + 1).toArrow() if rows > 0 else None
    return head if head is not None and head.num_rows <= rows else None


def _rows_within(df: DataFrame, limit: int) -> int:
    """Vectors of this length that fit in `limit` bytes; the first one tells the length."""
    first = df.select(F.size("vector").alias("n")).first()
    return limit // (8 * max(1, first.n)) if first else 1


def _number(queries: DataFrame) -> DataFrame:
    """Give each query row a number of its own. Numbers depend on partitions, so they are written once."""
    return cut_lineage(queries.withColumn(ROW, F.monotonically_increasing_id()))


def _query_keys(queries: DataFrame) -> list[str]:
    return [c for c in queries.columns if c not in ("vector", "_bucket", ROW)]


# ---------------------------------------------------------------- V2, V3


def _few_queries(queries: DataFrame, k: int | str, broadcast_bytes: int) -> pa.Table | None:
    """All query rows with their numbers, if they and the hits of a task are few enough to go to every task."""
    few = _bounded(queries, _rows_within(queries, broadcast_bytes))
    if few is None:
        return None
    depth = _depths(few, k)
    hits = k * few.num_rows if isinstance(depth, int) else int(depth.sum())
    if hits > TASK_HITS:
        return None
    return few if ROW in few.column_names else few.append_column(ROW, pa.array(range(few.num_rows), pa.int64()))


def _hits_of_tasks(
    spark: SparkSession, few: pa.Table, keys: Sequence[str], corpus: DataFrame, schema: T.StructType, k: int | str, metric: str, shared_floor: bool | None, floor_rows: int
) -> DataFrame:
    """Hits for the last merge. Over a large corpus a floor from a sample and a merge in groups come first."""
    if shared_floor is None:
        shared_floor = _estimated_bytes(corpus) > FLOOR_BYTES
    if not shared_floor or not few.num_rows:
        return _broadcast_topk(spark, few, keys, corpus, schema, k, metric)
    floor = _sample_floors(spark, few, corpus, schema, k, metric, floor_rows)
    return _merged(_broadcast_topk(spark, few, keys, corpus, schema, k, metric, floor), k)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int | str,
    metric: str = "cosine",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    shared_floor: bool | None = None,
    floor_rows: int = FLOOR_ROWS,
) -> DataFrame:
    """Exact top `k` of `corpus(cand_id, vector)` for each query row.

    `k` is a number, or the name of a column of `queries` that gives each row its own depth (none for 0
    or null). Every column of `queries` other than `vector` is returned. Rows with equal keys, or equal
    altogether, are queries of their own with `k` hits each; equal scores go to the smaller id. A side
    whose vectors take at most `broadcast_bytes` goes to every task. When both are larger they are
    cut into blocks; use `ivf_search` when the product of both sizes is out of reach. Which way is
    taken doesn't show in the result.

    A corpus of many tasks is searched with a floor for each query row, the last of its best scores in a
    sample of `floor_rows` vectors: tasks send no hit below it, and their hits are merged in groups
    before all meet. `shared_floor` asks for that or forbids it; without it the size decides.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    keys = _query_keys(queries)
    spark = queries.sparkSession
    taken, stored = queries.select(*keys, "vector"), corpus.select("cand_id", "vector")
    few = _few_queries(taken, k, broadcast_bytes)
    if few is not None:
        schema = _hit_schema(taken.withColumn(ROW, F.lit(0).cast("bigint")), [*keys, ROW], corpus)
        return _finish(_hits_of_tasks(spark, few, [*keys, ROW], stored, schema, k, metric, shared_floor, floor_rows), k, metric)
    few = _bounded(stored, _rows_within(stored, broadcast_bytes))
    if few is not None:
        schema = _hit_schema(taken, keys, corpus)
        return _similarity(_broadcast_corpus(spark, taken, keys, few, schema, k, metric), metric)
    numbered = _number(taken)
    schema = _hit_schema(numbered, [*keys, ROW], corpus)
    one = F.lit(0).alias("_bucket")
    found = _blocked_topk(numbered.select("*", one), [*keys, ROW], stored.select("*", one), schema, k, metric, block_rows, True)
    return _finish(found, k, metric)


def knn_cosine(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    return knn(queries, corpus, k, "cosine", **options)


def knn_ip(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    return knn(queries, corpus, k, "ip", **options)


def knn_l2(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    """As `knn` by squared distance, with `distance` and `similarity = 1 / (1 + distance)`."""
    return knn(queries, corpus, k, "l2", **options)


# ---------------------------------------------------------------- V4


def cell_count(rows: int) -> int:
    """Cells for a corpus: their number and their size both grow with the root of the corpus."""
    return max(1, round(rows**0.5))


# Vectors of the training sample for each cell.
TRAIN_ROWS = 256
# Centroids compared with a vector at a time.
CELL_BLOCK = 4_096


def train_cells(corpus: DataFrame, nlist: int | None = None, seed: int = 7, max_iter: int = 20, sample_rows: int = TRAIN_ROWS) -> DataFrame:
    """K-means centroids of unit vectors: `(cell_id, vector)`. Without `nlist` the corpus size decides.

    The centroids are fitted on about `sample_rows` vectors a cell, chosen by hash; with fewer all are taken.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.count()
    nlist = cell_count(rows) if nlist is None else nlist
    share = max(1, rows // max(1, nlist * sample_rows))
    sample = corpus.where(F.pmod(F.xxhash64("vector"), F.lit(share)) == 0) if share > 1 else corpus
    features = l2_normalize(sample.select("vector")).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(rows, "cell_id int, vector array<double>")


def _few_cells(centroids: DataFrame, broadcast_bytes: int) -> pa.Table | None:
    """All centroids in order of their ids, if every task can hold them."""
    columns = [c for c in ("cell_id", "vector", "radius", "size") if c in centroids.columns]
    cells = _bounded(centroids.select(*columns), _rows_within(centroids, broadcast_bytes))
    return None if cells is None else cells.sort_by("cell_id")


def assign_cells(vectors: DataFrame, centroids: DataFrame, n: int = 1, broadcast_bytes: int = 8 * BROADCAST_BYTES) -> DataFrame:
    """Add the `n` nearest cells to each vector as `cell_id`, one row for each cell.

    Centroids of up to `broadcast_bytes` go to every task, which compares its vectors with blocks of
    them. More centroids are met in blocks of both sides, as in `knn`. Equally near cells go by their ids.
    """
    cells = _few_cells(centroids, broadcast_bytes)
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell_id", centroids.schema["cell_id"].dataType)])
    if cells is None:
        numbered = _number(vectors)
        near = knn(l2_normalize(numbered.select(F.col(ROW).alias("_of"), "vector")), centroids.select(F.col("cell_id").alias("cand_id"), "vector"), n, "l2", broadcast_bytes)
        return numbered.join(near.select("_of", F.col("cand_id").alias("cell_id")), F.col(ROW) == F.col("_of")).select(*schema.fieldNames())
    ids, centres = cells["cell_id"].combine_chunks(), _matrix(cells["vector"])
    shared = vectors.sparkSession.sparkContext.broadcast((ids, centres))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_ids, c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_CHUNK):
                part = batch.slice(at, QUERY_CHUNK)
                best = _Best(_unit(_matrix(part.column("vector"), c.shape[1])), n, "l2")
                for lo in range(0, len(c), CELL_BLOCK):
                    best.offer(cell_ids.slice(lo, CELL_BLOCK), c[lo : lo + CELL_BLOCK])
                if best.found is not None:
                    out = pa.Table.from_batches([part]).take(best.found["row"])
                    yield from out.append_column("cell_id", best.found["id"]).to_batches()

    return vectors.mapInArrow(nearest, schema)


def ivf_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int | str,
    nprobe: int | None = None,
    centroids: DataFrame | None = None,
    nlist: int | None = None,
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
    max_cells: int | None = None,
) -> DataFrame:
    """Top `k` of the corpus by cells. Without `nprobe` the result is exact, or bounded by `max_cells`.

    A query goes on to cells that could still hold a better hit, as `operators.cells` tells from their
    radii. With `nprobe` it looks into the nearest cells whatever they hold, and is exact inside them.
    A `corpus` with a `cell_id` column, as `build_index` makes it, needs the centroids that its cells
    are from. Without centroids the cells are trained here. Rows with equal keys are queries of their
    own, as in `knn`.
    """
    if nprobe is None:
        from earmark.operators.cells import search_cells

        return search_cells(queries, corpus, k, centroids, nlist, metric, max_cells, block_rows=block_rows).hits
    if "cell_id" in corpus.columns and centroids is None:
        raise ValueError("a corpus with cells needs the centroids of these cells")
    keys = [*_query_keys(queries), ROW]
    centroids = train_cells(corpus, nlist) if centroids is None else centroids
    # Both sides are counted by cell and then sent to their cells, so the assignment is written once.
    cells = corpus if "cell_id" in corpus.columns else cut_lineage(assign_cells(corpus.select("cand_id", "vector"), centroids))
    numbered = queries.withColumn(ROW, F.monotonically_increasing_id())
    probes = cut_lineage(assign_cells(numbered, centroids, nprobe)).withColumnRenamed("cell_id", "_bucket")
    schema = _hit_schema(probes, keys, corpus)
    return _finish(_blocked_topk(probes, keys, cells.withColumnRenamed("cell_id", "_bucket"), schema, k, metric, block_rows), k, metric)


# ---------------------------------------------------------------- V5


def slot_width(rows: int, slot_rows: int = BLOCK_ROWS) -> int:
    """Directions that a slot combines, so that slots hold about `slot_rows` vectors however large the corpus is.

    A direction parts unit vectors into about two slots of note.
    """
    return max(1, math.ceil(math.log2(max(1, rows) / slot_rows))) if rows > slot_rows else 1


def random_projections(dim: int, tables: int, width: int = 1, seed: int = 11) -> list[list[list[float]]]:
    """`width` unit directions for each hash table."""
    directions = np.random.default_rng(seed).standard_normal((tables, width, dim))
    return [[[round(float(x), 6) for x in row / np.linalg.norm(row)] for row in table] for table in directions]


def slotted(vectors: DataFrame, projections: Sequence[Sequence[Sequence[float]]], bucket_length: float, probes: int = 1, once: bool = False) -> DataFrame:
    """Unit vectors, once for each slot `_bucket` that they belong to or are looked for in.

    With `once` their slots are written, for plans that read them more than once.
    """
    literal = [[F.array(*map(F.lit, d)) for d in table] for table in projections]

    def moved(cells: Column, j: int, step: int) -> Column:
        return F.transform(cells, lambda c, at: F.when(at == j, c + step).otherwise(c))

    def named(slots: Column, i: int) -> Column:
        return F.transform(slots, lambda s: F.struct(F.lit(i).alias("table"), s["cells"].alias("slot")))

    buckets = []
    for i, table in enumerate(literal):
        along = F.array(*[dot(F.col("vector"), d) / bucket_length for d in table])
        # Bound once: the cells, and how far inside its cell the vector is along each direction.
        place = F.transform(along, lambda x: F.struct(F.floor(x).alias("cell"), (x - F.floor(x)).alias("inside")))
        cells = F.transform(place, lambda p: p["cell"])
        slots = F.array(F.struct(F.lit(-1.0).alias("d"), cells.alias("cells")))
        if probes > 1:
            inside = [F.get(place, F.lit(j))["inside"] for j in range(len(table))]
            near = [
                F.struct((inside[j] if step < 0 else 1 - inside[j]).alias("d"), moved(cells, j, step).alias("cells"))
                for j in range(len(table)) for step in (-1, 1)
            ]
            slots = F.slice(F.array_sort(F.concat(slots, F.array(*near))), 1, probes)
        buckets.append(named(slots, i))
    placed = l2_normalize(vectors).withColumn("_slots", F.flatten(F.array(*buckets)))
    return (cut_lineage(placed) if once else placed).withColumn("_bucket", F.explode("_slots")).drop("_slots")


def ann_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    projections: Sequence[Sequence[Sequence[float]]],
    bucket_length: float,
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
    probes: int = 1,
) -> DataFrame:
    """Approximate top `k`: candidates share a random-projection slot with the query in at least one table.

    A slot is the cell of a vector along all directions of a table together; `slot_width` says how many
    directions suit a corpus. With more `probes` a query also looks into the cells next door, those
    whose border along one direction is nearest first.
    """
    numbered = _number(queries)
    keys = [*_query_keys(queries), ROW]
    schema = _hit_schema(numbered, keys, corpus)
    probed = slotted(numbered, projections, bucket_length, probes, once=True)
    placed = slotted(corpus.select("cand_id", "vector"), projections, bucket_length, once=True)
    found = _blocked_topk(probed, keys, placed, schema, k, metric, block_rows)
    # A pair that met in several tables or probes counts once.
    return _finish(found.groupBy(*keys, "cand_id").agg(F.max("score").alias("score")), k, metric)


# ---------------------------------------------------------------- V6, V7


class Index(NamedTuple):
    """Vectors, a one-row description, and the centroids of the cells where there are any."""

    table: DataFrame
    meta: DataFrame
    centroids: DataFrame | None = None


def build_index(vectors: DataFrame, config: Mapping[str, object], centroids: DataFrame | None = None) -> Index:
    """Index of `vectors(cand_id, vector)`. Cells are trained unless their centroids are given."""
    kind = str(config.get("index_type", "flat"))
    metric = str(config.get("metric", "cosine"))
    if kind not in INDEX_TYPES:
        raise ValueError(f"unknown index type: {kind}")
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    table = l2_normalize(vectors, "l2" if config.get("normalize", True) else "none")
    table = table.withColumn("track_id", track_of_segment(F.col("cand_id")))
    if kind == "ivf":
        nlist = config.get("nlist")
        centroids = train_cells(table, int(nlist) if nlist else None) if centroids is None else centroids
        table = assign_cells(table, centroids)
    meta = table.agg(
        F.count(F.lit(1)).alias("num_vectors"),
        F.max(F.size("vector")).cast("bigint").alias("dimension"),
    ).select(
        "num_vectors",
        "dimension",
        F.lit(kind).alias("index_type"),
        F.lit(metric).alias("metric"),
        F.lit(json.dumps(dict(config), sort_keys=True)).alias("config"),
    )
    return Index(table, meta, centroids if kind == "ivf" else None)


# A stored index is a row of versions. Vectors, centroids and removals lie in parts named by the version that wrote them;
# a version's one-row description lists the parts it is made of and is written last, so readers see all of it or nothing.
_VERSION = (
    "version bigint, parts array<bigint>, removed array<bigint>, centroids bigint, num_vectors bigint, dimension bigint, "
    "index_type string, metric string, config string, batch string"
)


def _write_version(spark: SparkSession, path: str, row: dict[str, object]) -> None:
    """Make a version visible: one committed file, written when all it names is there."""
    data = spark.createDataFrame([tuple(row.values())], _VERSION)
    data.coalesce(1).write.mode("overwrite").json(f"{path}/versions/{row['version']:012d}")


def index_versions(spark: SparkSession, path: str) -> list[dict[str, object]]:
    """Descriptions of all visible versions, oldest first."""
    found = spark.read.schema(_VERSION).json(f"{path}/versions/*").where("version IS NOT NULL").orderBy("version").collect()
    return [r.asDict() for r in found]


def _write_part(table: DataFrame, path: str, version: int, cells: bool) -> DataFrame:
    """Write vectors as a part. Rows of a cell are brought together first and large cells are split, so a cell has few files."""
    where = f"{path}/vectors/part={version}"
    if cells:
        table.hint("rebalance", "cell_id").write.mode("overwrite").partitionBy("cell_id").parquet(where)
    else:
        table.write.mode("overwrite").parquet(where)
    return table.sparkSession.read.schema(table.schema).parquet(where)


def segment_digest(vector: Column) -> Column:
    """Digest by which a changed segment is told from a known one."""
    return F.xxhash64(vector)


def write_index(index: Index, path: str, mode: str = "error") -> None:
    """Store an index as version 1 below `path`; vectors lie in one folder for each cell when there are cells.

    Centroids are stored with the radius and size of their cells.
    """
    from earmark.operators.cells import measure_cells

    spark = index.table.sparkSession
    if mode != "error":
        raise ValueError("an index is written once; take further vectors in with append_to_index")
    table = index.table.withColumn("digest", segment_digest(F.col("vector")))
    written = _write_part(table, path, 1, index.centroids is not None)
    meta = index.meta.first().asDict()
    if index.centroids is not None:
        measure_cells(written, index.centroids, meta["metric"]).write.mode("overwrite").parquet(f"{path}/centroids/part=1")
    _write_version(spark, path, {"version": 1, "parts": [1], "removed": [], "centroids": 1 if index.centroids is not None else None, **meta, "batch": None})


def read_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The newest version of a stored index, or an older one."""
    found = [v for v in index_versions(spark, path) if version in (None, v["version"])]
    if not found:
        raise ValueError(f"no version {version or ''} of an index in {path}")
    now = found[-1]
    parts = [f"{path}/vectors/part={p}" for p in now["parts"]]
    table = spark.read.option("basePath", f"{path}/vectors").parquet(*parts)
    if now["removed"]:
        gone = spark.read.option("basePath", f"{path}/removed").parquet(*[f"{path}/removed/part={p}" for p in now["removed"]])
        gone = gone.select(F.col("cand_id").alias("_gone"), F.col("part").alias("_by"))
        table = table.join(gone, (F.col("cand_id") == F.col("_gone")) & (F.col("part") < F.col("_by")), "left_anti")
    meta = spark.createDataFrame(
        [tuple(now[c] for c in ("num_vectors", "dimension", "index_type", "metric", "config"))], "num_vectors bigint, dimension bigint, index_type string, metric string, config string"
    )
    centroids = spark.read.parquet(f"{path}/centroids/part={now['centroids']}") if now["centroids"] else None
    return Index(table.drop("part"), meta, centroids)


def update_index(index: Index, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `new` whose track is not in the index, ready to append, and counts of tracks and rows.

    New rows are normalised and get the cell of the index's centroids, as `build_index` does. Tracks
    are known by their id: changed segments of a known track are not taken in.
    """
    config = json.loads(index.meta.select("config").first().config)
    incoming = new.withColumn("track_id", track_of_segment(F.col("cand_id")))
    known = index.table.select(track_of_segment(F.col("cand_id")).alias("track_id")).distinct().withColumn("_known", F.lit(True))
    marked = incoming.groupBy("track_id").agg(F.count(F.lit(1)).alias("vectors")).join(known, "track_id", "left")
    is_new = F.col("_known").isNull()
    counts = marked.agg(
        F.count_if(is_new).alias("added_tracks"),
        F.count_if(~is_new).alias("skipped_tracks"),
        F.coalesce(F.sum(F.when(is_new, F.col("vectors"))), F.lit(0)).alias("added_vectors"),
        F.coalesce(F.sum(F.when(~is_new, F.col("vectors"))), F.lit(0)).alias("skipped_vectors"),
    )
    fresh = incoming.join(known, "track_id", "left_anti").select("cand_id", "vector", "track_id")
    fresh = l2_normalize(fresh, "l2" if config.get("normalize", True) else "none")
    if index.centroids is not None:
        fresh = assign_cells(fresh, index.centroids)
    return fresh, counts


def append_to_index(spark: SparkSession, path: str, new: DataFrame, batch: str | None = None) -> DataFrame:
    """Take `new(cand_id, vector)` into a stored index as its next version, and return the counts.

    Segments are known by their id and their digest: unknown ones are added, changed ones replace the old, and the
    rest is skipped, so doing the same again changes nothing. Parts are written first and the description
    last; after a stop between them readers find the old version and the next call writes the parts anew. A `batch`
    that a version names already is not taken in again. Of repeated ids the one with the smallest digest counts.
    """
    from earmark.operators.cells import measure_cells

    versions = index_versions(spark, path)
    now, version = versions[-1], versions[-1]["version"] + 1
    none = ["added_tracks", "skipped_tracks", "added_vectors", "changed_vectors", "skipped_vectors"]
    if batch is not None and any(v["batch"] == batch for v in versions):
        return spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in none])
    index = read_index(spark, path)
    unit = l2_normalize(new.select("cand_id", "vector"), "l2" if json.loads(now["config"]).get("normalize", True) else "none")
    unit = unit.groupBy("cand_id").agg(F.min_by("vector", segment_digest(F.col("vector"))).alias("vector"))
    unit = unit.withColumns({"track_id": track_of_segment(F.col("cand_id")), "digest": segment_digest(F.col("vector"))})
    held = index.table.select("cand_id", F.col("digest").alias("_held"))
    tracks = index.table.select("track_id").distinct().withColumn("_known", F.lit(True))
    marked = cut_lineage(unit.join(held, "cand_id", "left").join(tracks, "track_id", "left"))
    is_new, is_changed = F.col("_held").isNull(), F.col("_held") != F.col("digest")
    counts = cut_lineage(marked.agg(
        F.count_distinct(F.when(F.col("_known").isNull(), F.col("track_id"))).alias("added_tracks"),
        (F.count_distinct("track_id") - F.count_distinct(F.when(is_new | is_changed, F.col("track_id")))).alias("skipped_tracks"),
        F.count_if(is_new).alias("added_vectors"), F.count_if(F.coalesce(is_changed, F.lit(False))).alias("changed_vectors"),
        F.count_if(F.coalesce(~is_changed, F.lit(False))).alias("skipped_vectors"),
    ))
    n = counts.first()
    row = {**now, "version": version, "batch": batch}
    if n.added_vectors or n.changed_vectors:
        fresh = marked.where(is_new | is_changed).select("cand_id", "vector", "track_id", "digest")
        if index.centroids is not None:
            fresh = assign_cells(fresh, index.centroids)
        written = _write_part(fresh.select([c for c in index.table.columns]), path, version, index.centroids is not None)
        if n.changed_vectors:
            marked.where(is_changed).select("cand_id").write.mode("overwrite").parquet(f"{path}/removed/part={version}")
            row["removed"] = [*now["removed"], version]
        if index.centroids is not None:
            grown = measure_cells(written, index.centroids, now["metric"]).select("cell_id", F.col("radius").alias("_far"), F.col("size").alias("_more"))
            # Replaced members still count in the radius, which stays a bound.
            both = index.centroids.join(grown, "cell_id").select("cell_id", "vector", F.greatest("radius", "_far").alias("radius"), (F.col("size") + F.col("_more")).alias("size"))
            both.write.mode("overwrite").parquet(f"{path}/centroids/part={version}")
            row["centroids"] = version
        row["parts"], row["num_vectors"] = [*now["parts"], version], now["num_vectors"] + n.added_vectors
    elif batch is None:
        return counts
    _write_version(spark, path, row)
    return counts


def compact_index(spark: SparkSession, path: str) -> None:
    """Bring all parts of the newest version into one, as a version of its own; older versions stay readable."""
    from earmark.operators.cells import measure_cells

    now, index = index_versions(spark, path)[-1], read_index(spark, path)
    version = now["version"] + 1
    written = _write_part(index.table, path, version, index.centroids is not None)
    if index.centroids is not None:
        measure_cells(written, index.centroids, now["metric"]).write.mode("overwrite").parquet(f"{path}/centroids/part={version}")
    _write_version(spark, path, {**now, "version": version, "parts": [version], "removed": [], "centroids": version if now["centroids"] else None})


# ---------------------------------------------------------------- V9


def model_hash(config: Mapping[str, object]) -> str:
    """First eight hex digits of the digest of the canonical model configuration."""
    return hashlib.md5(json.dumps(dict(config), sort_keys=True).encode()).hexdigest()[:8]


def cache_keys(tracks: DataFrame, content: str, config: Mapping[str, object]) -> DataFrame:
    """Add `cache_key`: track id, 12 hex digits of the content digest, 8 of the model digest."""
    digest = F.substring(F.md5(F.col(content).cast("binary")), 1, 12)
    return tracks.withColumn("cache_key", F.concat_ws("_", "track_id", digest, F.lit(model_hash(config))))


def cache_lookup(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split tracks into those whose key is cached and those that must be embedded again."""
    stored = cache.select("cache_key").distinct()
    return keyed.join(stored, "cache_key", "left_semi"), keyed.join(stored, "cache_key", "left_anti")


def cache_evict(cache: DataFrame, tracks: DataFrame) -> DataFrame:
    """Cache without any entry of the given tracks."""
    return cache.join(tracks.select("track_id").distinct(), "track_id", "left_anti")


def cache_invalidate(cache: DataFrame, keyed: DataFrame) -> DataFrame:
    """Drop entries of known tracks whose content or model configuration changed since."""
    current = keyed.select("track_id", F.col("cache_key").alias("_current"))
    return (
        cache.join(current, "track_id", "left")
        .where(F.col("_current").isNull() | (F.col("_current") == F.col("cache_key")))
        .drop("_current")
    )


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, segments and bytes of the cached vectors, in total."""
    return cache.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("_segments"), F.sum(F.size("vector") * 4).alias("_bytes")
    ).agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum("_segments"), F.lit(0)).alias("segments"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"),
    )


# ---------------------------------------------------------------- V10


# Scores of a pair are summed by bins of this width; only bins that a quantile or a share ends in are sorted.
SCORE_BINS = 512.0

_PAIR_KEY = "query_id", "track_id"


def _packed_blocks(rows: DataFrame, key: str, out: str, block: int) -> DataFrame:
    """The vectors of each block of segments, side by side in order: at most `block` of them."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("segment_idx").cast("bigint").alias("i"), F.col("vector").alias("v"))))
    return rows.groupBy(key, F.expr(f"bigint(segment_idx div {block})").alias(f"_{out}b")).agg(packed.alias(f"_{out}"))


def _block_scores(packed: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    items = packed.values
    return items.field("i").to_numpy(), _matrix(items.field("v"))


def _products(names: Sequence[str], schema: T.StructType, by_bin: bool):
    """Scores of all segments of two blocks: sums by bin, or, for the bins asked for, each score and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in range(batch.num_rows):
                (qi, q), (ti, t) = (_block_scores(batch.column(c)[row]) for c in ("_q", "_t"))
                s = _scores(q, t, "ip").ravel()
                bins = np.floor(s * SCORE_BINS).astype(np.int64)
                if by_bin:
                    order = np.lexsort((np.tile(ti, len(qi)), np.repeat(qi, len(ti)), -s))
                    found, first, count = np.unique(bins[order], return_index=True, return_counts=True)
                    at = np.searchsorted(found, bins)
                    w = np.exp(2 * s)
                    best = order[first]
                    made = {
                        "_bin": found, "_c": count, "_s": np.bincount(at, s), "_w": np.bincount(at, w), "_ws": np.bincount(at, w * s),
                        "_max": s[best], "_bq": qi[best // len(ti)], "_bt": ti[best % len(ti)],
                    }
                else:
                    hit = np.isin(bins, batch.column("_bins")[row].values.to_numpy())
                    score, count = np.unique(s[hit], return_counts=True)
                    made = {"_bin": np.floor(score * SCORE_BINS).astype(np.int64), "s": score, "_c": count}
                for k in _PAIR_KEY:
                    out[k] += [batch.column(k)[row].as_py()] * len(made["_bin"])
                for n, values in made.items():
                    out[n] += values.tolist()
            yield pa.RecordBatch.from_pydict({n: out[n] for n in names}, schema=to_arrow_schema(schema))

    return run


def pair_similarity_matrix(
    pairs: DataFrame, queries: DataFrame, corpus: DataFrame, best_share: float = 0.2, block: int = 256
) -> DataFrame:
    """Compare all segments of a query with all segments of one track, for each given pair.

    `pairs(query_id, track_id)`, `queries(query_id, segment_idx, vector)` and
    `corpus(track_id, segment_idx, vector)`. Both sides are cut into blocks of segments, so the
    product of two long recordings spreads over tasks. A product of two blocks is summed by score bin
    where it is made; scores leave a task only for the few bins that the 95th percentile or the best
    share ends in, and equal ones as one row.
    """
    bound_batches(pairs.sparkSession)
    key = list(_PAIR_KEY)
    blocks = (
        pairs.select(*key).distinct()
        .join(_packed_blocks(queries, "query_id", "q", block), "query_id")
        .join(_packed_blocks(corpus, "track_id", "t", block), "track_id")
        .select(*key, "_q", "_t")
    )
    fields = [pairs.schema[k] for k in key] + [T.StructField("_bin", T.LongType())]
    doubles = lambda *names: [T.StructField(n, T.DoubleType()) for n in names]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    summed = T.StructType([*fields, *longs("_c"), *doubles("_s", "_w", "_ws", "_max"), *longs("_bq", "_bt")])
    best = F.max(F.struct(F.col("_max").alias("s"), (-F.col("_bq")).alias("q"), (-F.col("_bt")).alias("t"))).alias("_best")
    bins = blocks.mapInArrow(_products(summed.fieldNames(), summed, True), summed).groupBy(*key, "_bin").agg(
        *[F.sum(c).alias(c) for c in ("_c", "_s", "_w", "_ws")], best
    )
    group = W.partitionBy(*key)
    # Places count from the highest score, from 0. The percentile lies between two places of the ascending order.
    place = (F.col("_n") - 1) * 0.95
    holds = lambda at: (at >= F.col("_above")) & (at < F.col("_above") + F.col("_c"))
    ranked = cut_lineage(
        bins.withColumn("_n", F.sum("_c").over(group))
        .withColumn("_above", F.coalesce(F.sum("_c").over(group.orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_k", F.greatest(F.lit(1), (F.col("_n") * best_share).cast("bigint")))
        .withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_k") - F.col("_above"))))
        .withColumn("_low", F.col("_n") - 1 - F.floor(place)).withColumn("_high", F.col("_n") - 1 - F.ceil(place))
        .withColumn("_cut", ((F.col("_take") > 0) & (F.col("_take") < F.col("_c"))) | holds(F.col("_low")) | holds(F.col("_high")))
    )
    whole = F.col("_take") == F.col("_c")
    base = ranked.groupBy(*key).agg(
        F.sum("_c").alias("pairs"),
        (F.sum("_s") / F.sum("_c")).alias("mean_similarity"),
        F.max("_best").alias("_best"),
        F.coalesce(F.sum(F.when(whole, F.col("_w"))), F.lit(0.0)).alias("_w"),
        F.coalesce(F.sum(F.when(whole, F.col("_ws"))), F.lit(0.0)).alias("_ws"),
        F.max(place - F.floor(place)).alias("_part"),
    )
    cut = ranked.where("_cut").select(*key, "_bin", "_c", "_above", "_take", "_low", "_high")
    exact = T.StructType([*fields, *doubles("s"), *longs("_c")])
    wanted = cut.groupBy(*key).agg(F.collect_list("_bin").alias("_bins"))
    scores = blocks.join(wanted, key).mapInArrow(_products(exact.fieldNames(), exact, False), exact).groupBy(*key, "_bin", "s").agg(F.sum("_c").alias("_m"))
    upto = W.partitionBy(*key, "_bin").orderBy(F.col("s").desc())
    weight = F.exp(F.col("s") * 2)
    before = F.col("_upto") - F.col("_m")
    used = F.when(F.col("_take") < F.col("_c"), F.greatest(F.lit(0), F.least(F.col("_m"), F.col("_take") - before))).otherwise(0)
    here = lambda at: (at - F.col("_above") >= before) & (at - F.col("_above") < F.col("_upto"))
    border = (
        scores.join(cut, [*key, "_bin"]).withColumn("_upto", F.sum("_m").over(upto))
        .groupBy(*key).agg(
            F.sum(weight * used).alias("_bw"), F.sum(weight * F.col("s") * used).alias("_bws"),
            F.max(F.when(here(F.col("_low")), F.col("s"))).alias("_ls"), F.max(F.when(here(F.col("_high")), F.col("s"))).alias("_hs"),
        )
    )
    joined = base.join(border, key)
    top = (F.col("_ws") + F.col("_bws")) / (F.col("_w") + F.col("_bw"))
    return joined.select(
        *key,
        "pairs",
        F.col("_best.s").alias("max_similarity"),
        "mean_similarity",
        (F.col("_ls") + (F.col("_hs") - F.col("_ls")) * F.col("_part")).alias("p95_similarity"),
        top.alias("weighted_top_similarity"),
        (-F.col("_best.q")).alias("best_query_segment"),
        (-F.col("_best.t")).alias("best_track_segment"),
    ).withColumn(
        "verdict_mean", F.col("mean_similarity")
    ).withColumn(
        "verdict_max", F.greatest("max_similarity", "weighted_top_similarity", "p95_similarity")
    )


# ---------------------------------------------------------------- V11


def search_depth(segments: int, corpus_rows: int) -> int:
    """Depth of a restricted search: 20 hits a segment, at most 20,000 and never more than the corpus."""
    return max(1, min(20 * segments, 20_000, corpus_rows))


def restricted_search(
    queries: DataFrame, corpus: DataFrame, allow: DataFrame, k: int | None = None, **options
) -> DataFrame:
    """Top `k` among the segments of the allowed tracks, then the best hit of each query and track.

    Without `k` each query is searched to the depth of `search_depth` for its number of segments.
    """
    inside = corpus.withColumn("track_id", track_of_segment(F.col("cand_id"))).join(
        allow.select("track_id").distinct(), "track_id", "left_semi"
    ).select("cand_id", "vector")
    if k is None:
        rows = inside.count()
        depth = queries.groupBy("query_id").agg(F.least(20 * F.count(F.lit(1)), F.lit(20_000), F.lit(max(1, rows))).cast("int").alias("_depth"))
        hits = knn(queries.join(depth, "query_id"), inside, "_depth", **options).drop("_depth")
    else:
        hits = knn(queries, inside, k, **options)
    return (
        hits.withColumn("track_id", track_of_segment(F.col("cand_id")))
        .groupBy("query_id", "track_id")
        .agg(
            F.max("similarity").alias("similarity"),
            F.min(F.struct((-F.col("similarity")).alias("s"), "cand_id")).getField("cand_id").alias("cand_id"),
            F.min("rank").alias("rank"),
        )
    )


# ---------------------------------------------------------------- V12


def _partial_sums(vectors: DataFrame) -> DataFrame:
    """Sum and count of the vectors of each track in each Arrow batch."""
    schema = T.StructType(
        [
            vectors.schema["track_id"],
            T.StructField("n", T.LongType()),
            T.StructField("total", T.ArrayType(T.DoubleType())),
        ]
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tracks = batch.column("track_id").dictionary_encode()
            codes = tracks.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            sums = np.add.reduceat(_matrix(batch.column("vector"))[order], starts, axis=0)
            dim = sums.shape[1]
            total = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, dim), pa.int32()), pa.array(sums.ravel()))
            counts = pa.array(np.diff(np.r_[starts, len(codes)]), pa.int64())
            yield pa.RecordBatch.from_arrays([tracks.dictionary.take(pa.array(codes[order][starts])), counts, total], ["track_id", "n", "total"])

    return vectors.select("track_id", "vector").mapInArrow(add_up, schema)


def pool_vectors(vectors: DataFrame, width: int | None = None, stride: int = 1) -> DataFrame:
    """Mean vector of each track, or of every full window of `width` segments each `stride` apart.

    `vectors(track_id, segment_idx, vector)` with segment numbers from 0 without gaps.
    """
    if width is None:
        means = (
            _partial_sums(vectors)
            .select("track_id", "n", F.posexplode("total").alias("_d", "_x"))
            .groupBy("track_id", "_d").agg((F.sum("_x") / F.sum("n")).alias("_x"))
        )
        ordered = F.array_sort(F.collect_list(F.struct("_d", "_x")))
        return means.groupBy("track_id").agg(F.transform(ordered, lambda e: e["_x"]).alias("vector"))
    starts = F.expr(f"filter(sequence(greatest(0L, segment_idx - {width - 1}), bigint(segment_idx)), s -> s % {stride} = 0)")
    members = F.transform(F.array_sort(F.collect_list(F.struct("segment_idx", "vector"))), lambda e: e["vector"])
    summed = F.reduce(
        F.slice(F.col("_m"), 2, width), F.element_at("_m", 1), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)
    )
    return (
        vectors.select("track_id", "segment_idx", "vector", F.explode(starts).alias("window_idx"))
        .groupBy("track_id", "window_idx").agg(members.alias("_m"))
        .where(F.size("_m") == width)
        .select("track_id", "window_idx", F.transform(summed, lambda x: x / float(width)).alias("vector"))
    )


# ---------------------------------------------------------------- V13, V14


def pair_match_verdict(
    pairs: DataFrame, hits: DataFrame, query_means: DataFrame, track_means: DataFrame, sample_mode: bool = False
) -> DataFrame:
    """Is the given track the one the query was made from?

    Matched when search found the track, or when the mean vectors are closer than 0.7 (0.5 for a
    sample inside another song). `hits(query_id, cand_id, rank, similarity)` come from any search.
    """
    # Similarity that counts as a match without a search hit.
    limit = 0.5 if sample_mode else 0.7
    found = (
        hits.select("query_id", track_of_segment(F.col("cand_id")).alias("track_id"), "rank", "similarity")
        .groupBy("query_id", "track_id")
        .agg(F.min("rank").alias("rank"), F.max("similarity").alias("search_similarity"))
    )
    direct = (
        pairs.select("query_id", "track_id").distinct()
        .join(query_means.select("query_id", F.col("vector").alias("_q")), "query_id")
        .join(track_means.select("track_id", F.col("vector").alias("_t")), "track_id")
        .select("query_id", "track_id", dot(F.col("_q"), F.col("_t")).alias("direct_similarity"))
    )
    return direct.join(found, ["query_id", "track_id"], "left").select(
        "query_id",
        "track_id",
        (F.col("rank").isNotNull() | (F.col("direct_similarity") > limit)).alias("matched"),
        F.greatest("search_similarity", "direct_similarity").alias("similarity"),
        "direct_similarity",
        "rank",
    )


def best_rank_over_views(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Best rank of each pair's track over all views; equal ranks go to the higher similarity.

    `hits(query_id, view, cand_id, rank, similarity)`, where a view is a way of pooling segments.
    """
    own = hits.withColumn("track_id", track_of_segment(F.col("cand_id"))).join(
        pairs.select("query_id", "track_id").distinct(), ["query_id", "track_id"], "left_semi"
    )
    best = F.min(F.struct("rank", (-F.col("similarity")).alias("s"), "view"))
    return own.groupBy("query_id", "track_id").agg(best.alias("_b")).select(
        "query_id", "track_id", F.col("_b.rank").alias("best_rank"), (-F.col("_b.s")).alias("similarity"), F.col("_b.view").alias("view")
    )
