"""Benchmark decontamination by spaced-seed hashing.

A mask names the word positions that count; the others may differ. Every position of every benchmark
item and of every document is hashed under each mask; equal hashes are hits, and around each hit the
two texts are compared word by word along the hit's diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, cut_lineage, take_columns
from earmark.llm.words import LOOSE, Words, chunks, mix, utf8

# Any run of words that SHARE accepts matches under one of the masks, wherever its substitutions are:
# 13 words or more under a long mask; items of 4 to 12 words, which match as a whole, under a short one.
# Runs of 13 words with 2 substitutions, 15 with 3, 20 with 4 and 25 with 5 show it for all: any other
# accepted run holds one of these, as one of two parts of 13 words or more is accepted too.
LONG = ("11101011", "11001111", "111001000101", "1110111")
SHORT = ("11101", "1111", "11011", "10111")
OVERLAP = 13
SHARE = 0.8
# Benchmark words that are sent to the tasks at once; a larger benchmark is taken in blocks.
BLOCK_WORDS = 1_000_000

# Pairs of hits made at a time.
PAIRS = 1 << 21

RESULT = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long"


def words_of(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Lower-case words of letters and digits, and their hashes."""
    words = Words(*utf8(pc.utf8_lower(column.fill_null("").cast(pa.large_string()))), spaces=LOOSE)
    return words, words.hashes()


def masked_hashes(values: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each position under a mask; entry i covers the words from i on."""
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(len(mask)))
    for i, used in enumerate(mask):
        if used == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + values[i : i + n]
    return mix(total)


class TestBlock:
    """The items of one block: word hashes one after another, and a sorted table of hashes for each mask."""

    def __init__(self, ids: list, texts: list[str]):
        words, self.values = words_of(pa.array(texts, pa.large_string()))
        self.ids, self.first, self.item = np.array(ids, np.int64), words.first, words.doc
        size = np.diff(words.first)
        # An item below the shortest mask is a mask of its own length.
        tiny = sorted(set(size[(size > 0) & (size < min(map(len, SHORT)))].tolist()))
        self.tables: list[tuple[str, Groups, np.ndarray]] = []
        rules = [(m, size >= OVERLAP) for m in LONG] + [(m, (size < OVERLAP) & (size >= len(m))) for m in SHORT]
        for mask, items in rules + [("1" * n, size == n) for n in tiny]:
            h = masked_hashes(self.values, mask)
            at = np.flatnonzero(items[self.item[: len(h)]] & (self.item[: len(h)] == self.item[len(mask) - 1 :]))
            if len(at):
                seen = np.zeros(1 << 20 if len(h) < 1 << 17 else 1 << 25, bool)
                seen[self.slot(h[at], seen)] = True
                self.tables.append((mask, Groups(h[at], self.item[at], at), seen))

    @staticmethod
    def slot(h: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(seen) - 1)).astype(np.int64)

    def diagonals(self, values: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct rows (document, item, shift) on which some masked runs are equal.

        Runs are met by groups, so a word that is repeated in both texts makes no pairs of its positions: where a
        document and an item have more pairs than diagonals, all diagonals between their outermost hits are taken.
        """
        met = []
        for mask, theirs, seen in self.tables:
            h = masked_hashes(values, mask)
            k = np.flatnonzero(seen[self.slot(h, seen)] & (doc[: len(h)] == doc[len(mask) - 1 :]))
            mine = Groups(h[k], doc[k], k)
            lo, hi = np.searchsorted(theirs.key, mine.key, "left"), np.searchsorted(theirs.key, mine.key, "right")
            n = hi - lo
            left = np.repeat(np.arange(len(n)), n)
            right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            if len(left):
                met.append((mine, theirs, left, right, mine.text[left] * len(self.ids) + theirs.text[right], mine.size[left] * theirs.size[right]))
        if not met:
            return np.zeros((0, 3), np.int64)
        pairs, place = np.unique(np.concatenate([m[4] for m in met]), return_inverse=True)
        total = np.bincount(place, np.concatenate([m[5] for m in met]), len(pairs))
        d, i = pairs // len(self.ids), pairs % len(self.ids)
        many = total > (first[d + 1] - first[d]) + (self.first[i + 1] - self.first[i])
        low, high = np.full(len(pairs), 1 << 62), np.full(len(pairs), -(1 << 62))
        found, at = [], 0
        for mine, theirs, left, right, _, size in met:
            own = place[at : at + len(left)]
            at += len(left)
            np.minimum.at(low, own, mine.least[left] - theirs.most[right])
            np.maximum.at(high, own, mine.most[left] - theirs.least[right])
            few = np.flatnonzero(~many[own])
            # A bounded number of pairs at a time.
            for some in np.split(few, np.searchsorted(np.cumsum(size[few]), np.arange(PAIRS, int(size[few].sum()), PAIRS))):
                n = size[some]
                rep = np.repeat(np.arange(len(some)), n)
                off = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                wide = theirs.size[right[some]][rep]
                shift = mine.at[mine.start[left[some]][rep] + off // wide] - theirs.at[theirs.start[right[some]][rep] + off % wide]
                found.append(np.unique(np.column_stack([own[some][rep], shift]), axis=0))
        whole = np.flatnonzero(many)
        n = high[whole] - low[whole] + 1
        found.append(np.column_stack([np.repeat(whole, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[whole], n)]))
        every = np.unique(np.concatenate(found), axis=0)
        return np.column_stack([d[every[:, 0]], i[every[:, 0]], every[:, 1]])


class Groups:
    """Positions of equal hashes inside one text: key, text, and where in `at` their positions are."""

    def __init__(self, h: np.ndarray, text: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, text, h))
        h, text, self.at = h[order], text[order], at[order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(h)))
        self.key, self.text = h[self.start], text[self.start].astype(np.int64)
        self.least, self.most = self.at[self.start], self.at[self.start + self.size - 1]


def longest_overlap(equal: np.ndarray, share: float = SHARE) -> tuple[int, int]:
    """Longest run that starts and ends with an equal word and has at least `share` equal words.

    Of runs of one length the first is taken; (0, 0) if no word is equal.
    """
    same = np.flatnonzero(equal)
    if not len(same):
        return 0, 0
    # In whole numbers, so that a share met exactly counts.
    up, down = round(1000 * (1 - share)), round(1000 * share)
    sums = np.append(0, np.cumsum(np.where(equal, up, -down)))
    # The farthest end whose sum is not below that of the start, among ends after an equal word.
    tops = np.maximum.accumulate(sums[same + 1][::-1])[::-1]
    end = np.searchsorted(-tops, -sums[same], "right") - 1
    size = same[end] - same
    best = int(np.argmax(size))
    return int(same[best]), int(same[end[best]]) + 1


def extended_overlap(equal: np.ndarray, least: int, share: float = SHARE) -> tuple[int, int]:
    """Longest run from an equal word to an equal word that is part of `least` or more words of which `share` are equal.

    The words around the run may differ, but must lie in `equal`. (0, 0) if there is none; of runs of
    one length the first is taken.
    """
    a, b = longest_overlap(equal, share)
    if b - a >= least or len(equal) < least:
        return (a, b) if b - a >= least else (0, 0)
    # All runs are shorter, so exactly `least` words around one decide.
    sums = np.append(0, np.cumsum(equal))
    at = np.flatnonzero(1000 * (sums[least:] - sums[:-least]) >= round(1000 * share) * least)
    if not len(at):
        return 0, 0
    same = np.flatnonzero(equal)
    start, end = same[sums[at]], same[sums[at + least] - 1] + 1
    best = int(np.argmax(end - start))
    return int(start[best]), int(end[best])


def overlaps(block: TestBlock, values: np.ndarray, first: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, word in document, word in item, words, equal words) of verified overlaps."""
    # One comparison for each document, item and diagonal, however many hits it has.
    found = []
    for d, i, shift in block.diagonals(values, first, doc).tolist():
        lo = max(int(block.first[i]), int(first[d]) - shift)
        hi = min(int(block.first[i + 1]), int(first[d + 1]) - shift)
        equal = block.values[lo:hi] == values[lo + shift : hi + shift]
        least = min(OVERLAP, int(block.first[i + 1] - block.first[i]))
        a, b = (0, len(equal)) if len(equal) >= least and equal.all() else extended_overlap(equal, least)
        if b > a:
            found.append((d, i, lo + a + shift - int(first[d]), lo + a - int(block.first[i]), b - a, int(equal[a:b].sum())))
    return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[TestBlock]:
    ids, texts, held = [], [], 0
    for row in take_columns(benchmark, item_id=item_id, text=text).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        held += len(row.text) // 2 + 1
        if held >= block_words:
            yield TestBlock(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield TestBlock(ids, texts)


def find_overlaps(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`(doc_id, item_id, doc_word, item_word, n_words, n_equal)`: verified overlaps of whole texts.

    Words are runs of letters and digits in lower case. An overlap pairs words one to one, has at
    least 13 words (all of a shorter item) and 80 % equal ones, the first and last of which may be
    unequal; each diagonal of a document and an item gives its longest. It is reported from its first
    to its last equal word, so `n_words` may be less than 13. Items go to the tasks in blocks of at most `block_words` words, each a
    pass over the documents, and the results of several blocks are written to the shared folder one
    after another, so neither table is ever held whole.

    Null and empty texts, items without words and items with a null id overlap with nothing.
    Equal items with different ids are all reported; repeated rows of the benchmark count once, those
    of the documents each. A null doc_id is reported as null. Empty tables give an empty one.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = take_columns(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def one_block(block: TestBlock) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part, _, _ in chunks(batch, "text"):
                    words, values = words_of(part.column(1))
                    rows = overlaps(block, values, words.first, words.doc)
                    if rows:
                        d, i, *rest = (np.array(c, np.int64) for c in zip(*rows))
                        yield pa.record_batch([part.column(0).take(pa.array(d)), pa.array(block.ids[i]), *map(pa.array, rest)], names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"])

        return docs.mapInArrow(search, RESULT), shared

    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], RESULT)
    if after is None:
        return one_block(block)[0]
    # Of several blocks, each one's result is written and it is let go before the next goes to the tasks.
    written = []
    while block is not None:
        found, shared = one_block(block)
        written.append(cut_lineage(found))
        shared.destroy()
        block, after = after, next(blocks, None)
    return reduce(DataFrame.unionByName, written)


def rows_without_overlaps(
    documents: DataFrame, benchmark: DataFrame, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows whose own text overlaps with no benchmark item, by the rule of `find_overlaps`; all columns stay.

    Ids don't matter: a row with a null id goes like any other, and rows that share an id stay or go
    alone. With a benchmark of one block rows aren't shuffled; for several, rows are numbered and
    written to the shared folder first, and the numbers of leaked rows are found block by block.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return documents
    if after is not None:
        block = after = None
        rows = cut_lineage(documents.withColumn("_row", F.monotonically_increasing_id()))
        leaked = find_overlaps(rows, benchmark, "_row", text, item_id, item_text, block_words).select(F.col("doc_id").alias("_row")).distinct()
        return rows.join(leaked, "_row", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
    shared = spark.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in chunks(batch, text):
                words, values = words_of(part.column(part.schema.get_field_index(text)))
                stays = np.ones(part.num_rows, bool)
                stays[[row[0] for row in overlaps(shared.value, values, words.first, words.doc)]] = False
                yield part.filter(pa.array(stays))

    return documents.mapInArrow(search, documents.schema)
