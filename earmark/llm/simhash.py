"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.components import components
from earmark.llm.jobs import bound_batches, cut_lineage, deal, take_columns, with_measures
from earmark.llm.words import LOWER, Words, chunks, whole

RADIUS = 4
SHINGLE = 4
SEED = 42
# Rows of one bucket that one task compares with each other; larger buckets are cut into pieces.
PIECE = 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each text; 0 for a text without words."""
    words = Words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(words):
        return out
    joined, start, end = words.spaced(LOWER)
    head = whole(words.doc, SHINGLE)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    begin = np.concatenate([start[head], start[words.first[short]]])
    stop = np.concatenate([end[head + SHINGLE - 1], end[words.first[short + 1] - 1]])
    of = np.concatenate([words.doc[head], short])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin.tolist(), stop.tolist())], dtype=np.uint64)
    order = np.argsort(of, kind="stable")
    of, h = of[order], h[order]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = np.flatnonzero(np.diff(of, prepend=-1))
    total = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    n = np.diff(np.append(at, len(of)))
    out[of[at]] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [fingerprints_of(data, offsets).view(np.int64)]


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, fp)`: one row for each row of documents; `fp` is the 64-bit SimHash as a long.

    Null and empty texts have fingerprint 0. Texts are read whole.
    """
    bound_batches(documents.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", 1 << 18):
                fp = fingerprints_of(data, offsets).view(np.int64)
                yield pa.record_batch([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    taken = take_columns(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return taken.mapInArrow(hashed, "doc_id long, fp long")


def key_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree under at least one mask.

    The 64 bits are cut into m blocks; at most `radius` blocks differ, so some m - radius agree.
    m grows with the number of rows, to keep the expected bucket below a piece. Any m finds the
    same pairs.
    """
    m = radius + 1
    while rows / 2 ** (64 * (m - radius) / m) > PIECE and m < 2 * radius:
        m += 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, m - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adder on 64 lanes at once: the carries and the sums of three bits."""
    half = a ^ b
    return (a & b) | (half & c), half ^ c


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS, block: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of one group whose fingerprints differ in at most `radius` (1 to 4) bits.

    Rows must be sorted by group. Bits are stored in planes: word w of plane b holds bit b of 64
    rows. For a block of (row, word) pairs, the differing bits of each plane go through carry-save
    counters of ones, twos and fours; after every eight planes, words all of whose lanes are beyond
    the radius are abandoned.
    """
    n = len(fp)
    if n < 2:
        return
    at = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    size = np.diff(np.append(at, n))
    n_words = -(-size // 64)
    word_at = np.cumsum(n_words) - n_words
    local = np.arange(n) - np.repeat(at, size)
    lane = np.repeat(word_at * 64, size) + local
    n_lanes = int(n_words.sum()) * 64
    planes = np.zeros((64, n_lanes // 64), np.uint64)
    spread = np.zeros(n_lanes, np.uint8)
    for b in range(64):
        spread[lane] = (fp >> np.uint64(b)) & np.uint64(1)
        planes[b] = np.packbits(spread, bitorder="little").view("<u8")
    spread[:] = 0
    spread[lane] = 1
    real = np.packbits(spread, bitorder="little").view("<u8")
    row_of = np.full(n_lanes, -1, np.int64)
    row_of[lane] = np.arange(n)
    # Row i meets the words from its own one on; in its own word only the lanes after it.
    own = lane // 64
    last = np.repeat(word_at + n_words, size)
    many = last - own
    cut = np.searchsorted(np.cumsum(many), np.arange(block, int(many.sum()) + block, block))
    for lo, hi in zip(np.concatenate([[0], cut[:-1] + 1]), np.minimum(cut + 1, n)):
        if lo >= hi:
            continue
        m = many[lo:hi]
        row = np.repeat(np.arange(lo, hi), m)
        word = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + own[row]
        alive = real[word].copy()
        mine = word == own[row]
        shift = (lane[row[mine]] % 64 + 1).astype(np.uint64)
        alive[mine] &= np.where(shift < 64, ALL << np.minimum(shift, np.uint64(63)), np.uint64(0))
        ones = np.zeros(len(row), np.uint64)
        twos, fours = ones.copy(), ones.copy()
        for b in range(0, 64, 8):
            for quad in (b, b + 4):
                x = [
                    planes[p][word] ^ (np.uint64(0) - ((fp[row] >> np.uint64(p)) & np.uint64(1)))
                    for p in range(quad, quad + 4)
                ]
                first, ones = _carry_save(ones, x[0], x[1])
                second, ones = _carry_save(ones, x[2], x[3])
                carry, twos = _carry_save(twos, first, second)
                alive &= ~(fours & carry)
                fours |= carry
            beyond = fours & (ones | twos) if radius == 4 else fours | _above(ones, twos, radius)
            alive &= ~beyond
            left = np.flatnonzero(alive)
            if len(left) < len(alive):
                row, word, alive, ones, twos, fours = (v[left] for v in (row, word, alive, ones, twos, fours))
            if not len(row):
                break
        if len(row):
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, bit = np.nonzero(bits)
            yield row[k], row_of[word[k] * 64 + bit]


def _above(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, below four, is beyond a radius of 0 to 3."""
    return {0: ones | twos, 1: twos, 2: ones & twos, 3: np.zeros_like(ones)}[radius]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the classes of each pair; a class is named by its smallest row."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _bucket_links(radius: int):
    """Links that hold the classes of each bucket together: a star for each class, not all pairs."""

    def links(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        label = np.arange(len(fp))
        for a, b in close_pairs(fp, group, radius):
            label = join_labels(label, a, b)
        child = np.flatnonzero(label != np.arange(len(fp)))
        return pa.record_batch([pa.array(fp[child].view(np.int64)), pa.array(fp[label[child]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, key = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        for batch in batches:
            fp = np.append(fp, batch.column(4).to_numpy().view(np.uint64))
            key = np.vstack([key, np.column_stack([batch.column(i).to_numpy() for i in range(4)])])
            if len(fp) < 2 * PIECE:
                continue
            group = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1)))
            done = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if done:
                yield links(fp[:done], group[:done])
                fp, key = fp[done:], key[done:]
        if len(fp):
            yield links(fp, np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1))))

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`(u, v)`: links between different fingerprints that join exactly the pairs within the radius.

    `distinct(fp)` has each fingerprint once and should be a stored table. Fingerprints meet in
    buckets by the masks of `key_masks`. A bucket above a piece is cut, and each pair of pieces is a
    group of its own, so no task holds a hot bucket.
    """
    masks = key_masks(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("t"), F.expr(f"fp & {_signed(m)}L").alias("k")) for t, m in enumerate(masks)
    ])).alias("b")).select("b.t", "b.k", "fp")
    large = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > PIECE)
    cut = keyed.join(large, ["t", "k"], "left").withColumn(
        "pieces", F.coalesce(F.ceil(F.col("n") / PIECE), F.lit(1)).cast("long")
    ).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    met = cut.select("t", "k", "own", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"))
    grouped = met.select("t", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = deal(grouped, "t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b")
    return dealt.mapInArrow(_bucket_links(radius), "u long, v long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """`(doc_id, fp, component_id)`: one row for each row of documents.

    Texts whose fingerprints differ in at most `radius` bits are linked, and `component_id` is the
    smallest doc_id that links reach. Empty and null texts share fingerprint 0 and are linked like
    any other. Null ids are kept and count as no id: a component of null ids only has a null
    component_id. Repeated rows stay repeated. An empty table gives an empty one.
    """
    prints = cut_lineage(fingerprints(documents, doc_id, text))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


def one_row_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows without near-duplicates: exactly one row of each component of `near_duplicates` stays, with all columns.

    Rows are numbered and told by their number, so rows with a null id and repeated rows of one id
    are copies like any other. The smallest id stays, of its rows the first; a row without an id only
    where no other has one. The numbered rows are written to the shared folder, as numbers given anew could
    differ.
    """
    numbered = with_measures(documents.withColumn("_row", F.monotonically_increasing_id()), text, ["_print"], _measure, limit=1 << 18)
    rows = cut_lineage(numbered)
    first = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.col("_row").alias("row"))
    classes = cut_lineage(rows.select(F.col("_print").alias("fp"), first.alias("first")).groupBy("fp").agg(F.min("first").alias("first")))
    roots = components(near_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    gone = rows.select("_row").join(stay, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
