"""Importance resampling towards the benchmark's distribution.

Hashed n-gram features are counted over all documents and all target texts; the logarithm of the ratio
is the gain of a feature's bucket and the mean gain of a document its weight. Documents are ranked by
weight plus Gumbel noise in a parallel sort by regular sampling: each task sorts its rows into a run,
regular samples of all runs give the splitters, rows go to the segment between their splitters and
are ordered there, and counts of the segments before make the ranks exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, cut_lineage, take_columns
from earmark.llm.words import LOOSE, LOWER, Words, chunks

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PER_CENT = 25
# Words up to this size get their checksum column by column, longer ones one by one.
SHORT = 64
# Samples that give the splitters, in all, and rows between two samples at least.
SAMPLES = 1 << 16
STEP = 64
# Rows of a segment, about, and segments at most.
SEGMENT_ROWS = 20_000
SEGMENTS = 4096
ORDER = ["score", "doc_id", "n_features", "weight", "run", "pos"]


def _crc_table() -> np.ndarray:
    """The checksum's step for each byte (reflected polynomial 0xEDB88320, a fixed value of CRC-32)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """Entry [n, i, b]: what byte i with value b of a checksum becomes when n more bytes follow."""
    value = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    out = [value]
    for _ in range(SHORT + 1):
        value = CRC[value & np.uint32(255)] ^ (value >> np.uint32(8))
        out.append(value)
    return np.stack(out)


SHIFT = _shift_tables()


def word_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each word."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    short = np.flatnonzero(size <= SHORT)
    order = short[np.argsort(-size[short], kind="stable")]
    at, left = start[order], -size[order]
    c = np.full(len(order), np.uint32(0xFFFFFFFF))
    for p in range(SHORT):
        n = int(np.searchsorted(left, -p, "left"))  # words with more than p bytes
        if not n:
            break
        c[:n] = CRC[(c[:n] ^ data[at[:n] + p]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = ~c
    return out


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature of some texts, the number of its text, and the words of each text.

    Features are words and pairs of neighbouring words. The checksum of a pair is put together from those of
    its words: appending bytes is linear.
    """
    words = Words(data, offsets, LOOSE)
    crc = word_checksums(LOWER[data], words.start, words.end)
    left = np.flatnonzero(words.doc[:-1] == words.doc[1:]) if len(words) else np.zeros(0, np.int64)
    size = (words.end - words.start)[left + 1]
    blank = np.uint32(zlib.crc32(b" "))
    first = SHIFT[1, 0][crc[left] & np.uint32(255)]
    for i in range(1, 4):
        first ^= SHIFT[1, i][crc[left] >> np.uint32(8 * i) & np.uint32(255)]
    first ^= blank
    pair = crc[left + 1].copy()
    near = size <= SHORT
    for i in range(4):
        pair[near] ^= SHIFT[size[near], i, first[near] >> np.uint32(8 * i) & np.uint32(255)]
    folded = LOWER[data]
    for i in np.flatnonzero(~near).tolist():
        pair[i] = zlib.crc32(folded[words.start[left[i] + 1] : words.end[left[i] + 1]].tobytes(), int(first[i]))
    crcs, doc = np.concatenate([crc, pair]), np.concatenate([words.doc, words.doc[left]])
    return (crcs % np.uint32(BUCKETS)).astype(np.int64), doc, np.diff(words.first)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """`(bucket, n)` over all whole texts; one array a task, summed by Spark."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                total += np.bincount(buckets(data, offsets)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from the `text` of both tables: an array of fixed size."""
    spark = documents.sparkSession
    s = bucket_counts(documents).withColumnRenamed("n", "s")
    t = bucket_counts(target).withColumnRenamed("n", "t")
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    both = every.toArrow().sort_by("bucket")
    s, t = np.asarray(both["s"]).astype(np.float64), np.asarray(both["t"]).astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(documents: DataFrame, target: DataFrame) -> DataFrame:
    """`(doc_id, n_features, n_words, weight)` of each row, from `(doc_id, text)` and the target's `text`."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(gains(documents.select("text"), target.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                bucket, doc, n_words = buckets(data, offsets)
                n = np.bincount(doc, minlength=part.num_rows)
                # In whole numbers: sums of doubles are exact below 2^53, and gains below 2^16.
                total = np.bincount(doc, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
                weight = total // np.maximum(n, 1)
                yield pa.record_batch([part.column(0), *[pa.array(v.astype(np.int64)) for v in (n, n_words, weight)]], names=["doc_id", "n_features", "n_words", "weight"])

    return documents.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def _order(score: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Order by score from the highest, then by the other columns from the lowest."""
    return np.lexsort([*rest[::-1], -score])


def _segments(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters each row is not before."""
    n = len(splitters[0])
    ordered = _order(*[np.concatenate([s, c]) for s, c in zip(splitters, columns)])
    passed = np.cumsum(ordered < n)
    out = np.zeros(len(ordered), np.int64)
    out[ordered] = passed
    return out[n:]


def runs(scored: DataFrame) -> DataFrame:
    """The rows with their run (task) and place in it, each run sorted; written once, so both stay."""
    spark = scored.sparkSession
    ordered = scored.withColumn("run", F.spark_partition_id().cast("long"))
    ordered = ordered.sortWithinPartitions(F.col("drawable").desc(), F.col("score").desc(), "doc_id", "n_features", "weight")
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            pos = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(pos)], names=[*batch.schema.names, "pos"])

    return cut_lineage(ordered.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", pos long"))


def ranked(scored: DataFrame, per_cent: int = PER_CENT, samples: int = SAMPLES, step: int = STEP, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows `(doc_id, n_features, weight, score, drawable)` with the rank of those that are drawn.

    `samples` bounds the rows that go to the driver to give splitters. Ranks are exact whatever the
    splitters are; these only decide how even the segments get. Rows equal in all columns are told apart by
    run and place, so a group of them is split like any other rows.
    """
    spark = scored.sparkSession
    kept = runs(scored)
    order = [F.col("score").desc(), *[F.col(c).asc_nulls_first() for c in ORDER[1:]]]
    shown = ["doc_id", "n_features", "weight", "score"]
    drawable = kept.where("drawable")
    n = drawable.count()
    draw = per_cent * n // 100
    n_segments = int(min(SEGMENTS, max(1, -(-n // segment_rows))))
    every = max(step, -(-n // samples))
    least = -(1 << 63)
    key = [F.coalesce(F.col(c), F.lit(least)).alias(c) for c in ORDER]
    # Each run starts at another offset, so that short runs give samples too, in the right proportion.
    sample = drawable.where((F.col("pos") + F.col("run") * 40503) % every == 0).select(*key).toArrow()
    found = [np.asarray(sample[c]) for c in ORDER]
    at = np.arange(1, n_segments) * len(found[0]) // n_segments
    ordered = _order(*found)[at] if len(found[0]) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast([c[ordered] for c in found])

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.asarray(batch.column(batch.schema.get_field_index(c)).fill_null(least)) for c in ORDER]
            yield pa.record_batch([*batch.columns, pa.array(_segments(columns, shared.value))], names=[*batch.schema.names, "segment"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in drawable.drop("drawable").schema.fields)
    dealt = drawable.drop("drawable").mapInArrow(exchange, fields + ", segment long")
    # One row for each segment.
    size = {r.segment: r["count"] for r in dealt.groupBy("segment").count().collect()}
    before, last = [0], 0
    for i in range(n_segments):
        before.append(before[-1] + size.get(i, 0))
        last = i if before[i] < draw else last
    first = F.element_at(F.array(*[F.lit(b).cast("long") for b in before[:-1]]), (F.col("segment") + 1).cast("int"))
    # Segments behind the last drawn row need no order.
    place = first + F.row_number().over(Window.partitionBy("segment").orderBy(*order))
    front = dealt.where(F.col("segment") <= last).withColumn("place", place)
    front = front.select(*shown, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    none = F.lit(None).cast("long").alias("rank")
    return front.unionByName(dealt.where(F.col("segment") > last).select(*shown, none)).unionByName(kept.where("NOT drawable").select(*shown, none))


def resample(
    documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    per_cent: int = PER_CENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """`(doc_id, n_features, weight, score, rank)`: one row for each row of documents; `rank` is null if it isn't drawn.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, in lower case
    (A-Z only). Of the rows with at least `min_words` words, `per_cent` of a hundred are drawn, the highest
    scores first, ties to the smaller id. Null and empty texts have no features, weight 0 and no rank.
    A null id is hashed as an empty one and comes first among equal scores. Repeated rows count each and
    are drawn each; rows of one id with equal scores are ordered by features and weight. An empty target gives gains
    all the same, from its zero counts. An empty table gives an empty one; extra columns are ignored.
    """
    bound_batches(documents.sparkSession)
    docs = take_columns(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    weighed = weigh(docs, take_columns(target, text=target_text))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("drawable", F.col("n_words") >= min_words)
    return ranked(scored.select("doc_id", "n_features", "weight", "score", "drawable"), per_cent)
