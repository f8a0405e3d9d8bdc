"""Removal of repeated passages across documents: fixed-block anchors extended to maximal repeats.

A window of `WINDOW` words always covers one whole block of `BLOCK` words on the block grid of its
document. So blocks on the grid are indexed, every rolling run of `BLOCK` words probes the index,
and windows around hits are settled exactly by two 64-bit hashes: of all documents with a window,
the one with the smallest id owns it. Overlapping windows that a document doesn't own add up to
maximal repeats, and their words go.

Hashes travel packed, one row for many, dealt by slices of the hash space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, cut_lineage, deal, input_bytes, take_columns
from earmark.llm.words import Words, binary_runs, chunks, rolling, whole

WINDOW = 50
# Any WINDOW words hold a whole grid block when WINDOW >= 2 * BLOCK - 1.
BLOCK = 25
# Probes of one slice of the hash space are shared among so many tasks; each gets the slice's blocks.
SALTS = 4
SLICE_BYTES = 100 << 20
# Words whose hashes a task packs at once.
PACK_WORDS = 1 << 21
LOW40 = np.uint64((1 << 40) - 1)


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _slices(documents: DataFrame) -> int:
    return 16 + input_bytes(documents) // SLICE_BYTES


def _split(h: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice of each hash, and the 40 other bits that tell hashes of a slice apart."""
    return ((h >> np.uint64(40)) % np.uint64(slices)).astype(np.int64), h & LOW40


def _pack40(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.int64)


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths: each value once, and how often it stands there."""
    at = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)) if len(doc) else np.zeros(0, np.int64)
    return doc[at], np.diff(np.append(at, len(doc))).astype(np.uint32)


PACKED = "slice int, salt int, kind int, h binary, doc binary, n binary"
_PACKED = ["slice", "salt", "kind", "h", "doc", "n"]


def _packed(slice_of: np.ndarray, salt: int, kind: int, h: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each slice: its hashes, and the documents they are from as runs."""
    order = np.argsort(slice_of, kind="stable")
    slice_of, h, doc = slice_of[order], h[order], doc[order]
    at = np.flatnonzero(np.diff(slice_of, prepend=-1))
    ends = np.append(at[1:], len(slice_of))
    ids, counts = zip(*[_runs(doc[a:b]) for a, b in zip(at, ends)]) if len(at) else ((), ())
    yield pa.record_batch(
        [
            pa.array(slice_of[at].astype(np.int32)),
            pa.array(np.full(len(at), salt, np.int32)),
            pa.array(np.full(len(at), kind, np.int32)),
            binary_runs(h, ends) if len(at) else pa.array([], pa.binary()),
            pa.array([i.tobytes() for i in ids], pa.binary()),
            pa.array([c.tobytes() for c in counts], pa.binary()),
        ],
        names=_PACKED,
    )


def _lowest(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, sorted, with the smallest document that has it."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], doc[first]


def _index_and_probe(slices: int):
    """Packed grid blocks (kind 0, copied to all salts) and rolling runs (kind 1) of whole texts."""

    def flush(h: list, doc: list, grid: list, salt: int) -> Iterator[pa.RecordBatch]:
        h, doc, grid = np.concatenate(h), np.concatenate(doc), np.concatenate(grid)
        block, low = _lowest(h[grid], doc[grid])
        cell, rest = _split(block, slices)
        for s in range(SALTS):
            yield from _packed(cell, s, 0, _pack40(rest), low)
        cell, rest = _split(h, slices)
        yield from _packed(cell, salt, 1, _pack40(rest), doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, grid, held, salt = [], [], [], 0, 0
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                words = Words(data, offsets)
                head = whole(words.doc, BLOCK)
                # Texts below a window can't hold one.
                head = head[np.diff(words.first)[words.doc[head]] >= WINDOW]
                if not len(head):
                    continue
                h.append(rolling(words.hashes(), BLOCK)[head])
                doc.append(part.column(0).to_numpy()[words.doc[head]])
                grid.append((head - words.first[words.doc[head]]) % BLOCK == 0)
                held += len(head)
                if held >= PACK_WORDS:
                    yield from flush(h, doc, grid, salt)
                    h, doc, grid, held, salt = [], [], [], 0, (salt + 1) % SALTS
        if held:
            yield from flush(h, doc, grid, salt)

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and hashes of runs that are a grid block of a document with a smaller id.

    A slice's blocks come first and are kept; its probes stream. The document with the smallest id
    is marked too, as the possible owner.
    """
    now, blocks, low, parts = None, None, None, []
    for batch in batches:
        cols = batch.to_pydict()
        out_doc, out_h = [], []
        for cell, salt, kind, h, doc, n in zip(*(cols[c] for c in _PACKED)):
            if now != (cell, salt):
                now, blocks, parts = (cell, salt), None, []
            h = _unpack40(h)
            doc = np.repeat(np.frombuffer(doc, np.int64), np.frombuffer(n, np.uint32))
            if kind == 0:
                parts.append((h, doc))
                continue
            if blocks is None:
                blocks, low = _lowest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (h[:0], doc[:0])
                parts = []
            if not len(blocks):
                continue
            at = np.minimum(np.searchsorted(blocks, h), len(blocks) - 1)
            hit = np.flatnonzero((blocks[at] == h) & (low[at] < doc))
            if len(hit):
                own = np.unique(at[hit])
                for d, x in ((doc[hit], h[hit]), (low[own], blocks[own])):
                    order = np.argsort(d, kind="stable")
                    d, x = d[order], x[order]
                    ids, counts = _runs(d)
                    out_doc.append(ids)
                    out_h += np.split(_pack40(x), np.cumsum(counts)[:-1])
        if out_doc:
            yield pa.record_batch(
                [pa.array(np.concatenate(out_doc)), pa.array([x.tobytes() for x in out_h], pa.binary())], names=["doc", "h"]
            )


def _window_hashes(values: np.ndarray) -> np.ndarray:
    """Two independent hashes of each window, as rows of 16 bytes."""
    return np.column_stack([rolling(values, WINDOW), rolling(values, WINDOW, 0x5DEECE66D)])


def _candidates(values: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """First words of the windows of one text that cover a marked run."""
    run = (rolling(values, BLOCK) & LOW40).astype(np.int64)
    marked = np.isin(run, _unpack40(b"".join(marks)))
    seen = np.append(0, np.cumsum(marked))
    at = np.arange(len(values) - WINDOW + 1)
    return at[seen[at + WINDOW - BLOCK + 1] > seen[at]]


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, Words, np.ndarray]]:
    """Row number, words and word hashes of each text of a batch."""
    row = 0
    for part, data, offsets in chunks(batch, text):
        words = Words(data, offsets)
        values = words.hashes()
        for i in range(part.num_rows):
            yield row, words, i, values[words.first[i] : words.first[i + 1]]
            row += 1


def _claim(slices: int):
    """Packed windows around marks, each once for a pack, with the smallest id that claims it."""

    def flush(h: list, doc: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(h)
        doc = np.repeat(*map(np.array, zip(*doc)))
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        h, doc = h[order], doc[order]
        first = np.append(True, (h[1:] != h[:-1]).any(axis=1))
        h, doc = h[first], doc[first]
        by_doc = np.argsort(doc, kind="stable")
        h, doc = h[by_doc], doc[by_doc]
        yield from _packed((h[:, 0] % np.uint64(slices)).astype(np.int64), 0, 0, h, doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, held = [], [], 0
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2)
            for row, _, _, values in _texts(batch, "text"):
                at = _candidates(values, marks[row].as_py())
                if len(at):
                    h.append(_window_hashes(values)[at])
                    doc.append((ids[row], len(at)))
                    held += len(at)
                if held >= PACK_WORDS // 4:
                    yield from flush(h, doc)
                    h, doc, held = [], [], 0
        if held:
            yield from flush(h, doc)

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id for each window of a slice: `(doc, h)` with the windows it owns."""

    def settle(h: list, doc: list) -> pa.RecordBatch:
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        h, doc = h[order], doc[order]
        first = np.append(True, (h[1:] != h[:-1]).any(axis=1))
        h, doc = h[first], doc[first]
        order = np.argsort(doc, kind="stable")
        ids, counts = _runs(doc[order])
        return pa.record_batch([pa.array(ids), binary_runs(h[order], np.cumsum(counts))], names=["doc", "h"])

    now, h, doc = None, [], []
    for batch in batches:
        cols = batch.to_pydict()
        for cell, x, d, n in zip(*(cols[c] for c in ("slice", "h", "doc", "n"))):
            if now != cell and h:
                yield settle(h, doc)
                h, doc = [], []
            now = cell
            h.append(np.frombuffer(x, np.uint64).reshape(-1, 2))
            doc.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint32)))
    if h:
        yield settle(h, doc)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _result(keep_text: bool):
    """Texts as they are: word counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                words = Words(data, offsets)
                joined, start, end = words.spaced()
                texts = [joined[start[a] : end[b - 1]] if b > a else b"" for a, b in zip(words.first, words.first[1:])]
                yield _rows(part.column(0), np.diff(words.first), np.zeros(part.num_rows, np.int64), texts, keep_text)

    return run


def _rows(ids, n_words, n_removed, texts: list[bytes], keep_text: bool) -> pa.RecordBatch:
    kept = pa.array([t.decode() for t in texts] if keep_text else [None] * len(texts), pa.string())
    return pa.record_batch(
        [ids, pa.array(np.asarray(n_words, np.int64)), pa.array(np.asarray(n_removed, np.int64)), pa.array([_sha(t) for t in texts], pa.string()), kept],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
    )


def _cut(keep_text: bool):
    """Marked texts without the words of windows they don't own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, owned = batch.column(2), batch.column(3)
            n_words, n_removed, texts = [], [], []
            for row, words, i, values in _texts(batch, "text"):
                at = _candidates(values, marks[row].as_py())
                mine = owned[row].as_py() or []
                if len(at) and mine:
                    h = _window_hashes(values)[at]
                    have = np.frombuffer(b"".join(mine), np.dtype([("a", "u8"), ("b", "u8")]))
                    at = at[~np.isin(np.ascontiguousarray(h).view(have.dtype).ravel(), have)]
                edge = np.zeros(len(values) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                stays = np.flatnonzero(np.cumsum(edge)[:-1] == 0) + words.first[i]
                text = words.data.tobytes() if row == 0 or i == 0 else text
                texts.append(b" ".join([text[a:b] for a, b in zip(words.start[stays].tolist(), words.end[stays].tolist())]))
                n_words.append(len(values))
                n_removed.append(len(values) - len(stays))
            yield _rows(batch.column(0), n_words, n_removed, texts, keep_text)

    return run


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept_sha256, kept)`: one row for each row of documents.

    Words are runs of anything but blank and the characters 9 to 13. A word is removed when a window
    of 50 words that covers it also stands in a document with a smaller id; windows are judged on
    the input. `kept` is the rest, joined by single blanks (null unless `keep_text`).

    Null and empty texts have no words. Repeated rows of one id don't count against each other.
    Documents with a null id have no order: they are returned whole, and nothing is removed for
    them. Extra columns are ignored, an empty table gives an empty one. Memory of a task is bounded
    by the larger of half a megabyte and its longest text, and by the blocks of a slice.
    """
    bound_batches(documents.sparkSession)
    docs = take_columns(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    slices = _slices(docs)
    known = docs.where("doc_id IS NOT NULL")
    runs = known.mapInArrow(_index_and_probe(slices), PACKED)
    marks = deal(runs, "slice", "salt").sortWithinPartitions("slice", "salt", "kind").mapInArrow(_mark, "doc long, h binary")
    marked = marks.groupBy("doc").agg(F.collect_list("h").alias("marks"))
    near = cut_lineage(known.join(marked, known.doc_id == marked.doc).select("doc_id", "text", "marks"))
    claims = near.mapInArrow(_claim(slices * SALTS), PACKED)
    owned = deal(claims, "slice").sortWithinPartitions("slice").mapInArrow(_own, "doc long, h binary")
    mine = owned.groupBy("doc").agg(F.collect_list("h").alias("owned"))
    judged = near.join(mine, near.doc_id == mine.doc, "left").select("doc_id", "text", "marks", "owned").mapInArrow(_cut(keep_text), RESULT)
    touched = near.select(F.col("doc_id").alias("_touched")).distinct()
    rest = docs.mapInArrow(_result(keep_text), RESULT).join(touched, F.col("doc_id") == F.col("_touched"), "left_anti")
    return judged.unionByName(rest)
