"""Token ids of a corpus in binary files: one id array a file, document boundaries in Elias-Fano form.

Layout of a file, little-endian; all counts are 64-bit unsigned:

    magic "EMTOKEF1", bytes an id takes (2 or 4), part, sequence number in the part,
    documents, tokens, documents with a null id, smallest id (signed),
    lengths of the four following blocks in bytes,
    ids | boundaries | document ids | one byte 0x0A

`boundaries` holds the end of each document in the id array, `document ids` the ids (less the
smallest) in ascending order, both as Elias-Fano sequences. Files in order of (part, sequence) hold
the documents in ascending order of their ids, nulls first.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, cut_lineage, input_bytes, shared_folder, take_columns
from earmark.llm.words import Words, chunks

MAGIC = b"EMTOKEF1"
HEADER = struct.Struct("<8sQQQQQQqQQ")
SAMPLE = 64
FILE_TOKENS = 1 << 22
FILE_DOCUMENTS = 1 << 16
PARTITION_BYTES = 32 << 20
# Above so many words or ids a worker forgets its words and begins anew.
CACHE_WORDS = 1 << 21
CACHE_IDS = 1 << 24
# New words are tokenized so many at a time; the mark parts those that are not of letters alone.
JOINED = 1 << 10
MARK = "\x1f"


class EliasFano:
    """A non-decreasing sequence of n values below u in n * (2 + log2(u / n)) bits, with random access.

    The low bits of each value stand side by side; the high bits are in unary: value i sets bit
    (high + i). The position of every 64th set bit is kept for `select`.
    """

    HEAD = struct.Struct("<QQQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        bits[place] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), place[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data: memoryview) -> "EliasFano":
        n, low_bits, n_low, n_high = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        at += samples.nbytes
        return cls(n, low_bits, np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low), samples)

    def select(self, i: int) -> int:
        """Position of set bit i of the high part: jump to the sample, then count bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        high = self.select(i) - i
        at = i * self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + self.low_bits) // 8 + 1].tobytes(), "little")
        return high << self.low_bits | chunk >> at % 8 & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        """All values at once."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        for b in range(self.low_bits):
            out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out


_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_STOPS = np.array([chr(b) in ".,;:!?" for b in range(256)])


def pieces(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Stretches of a text that the tokenizer never joins: words, parted before stops that follow an ASCII letter or digit."""
    cut = np.zeros(len(data), bool)
    cut[1:] = _STOPS[data[1:]] & _ALNUM[data[:-1]]
    return Words(data, offsets, cut=cut)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `np.unique` gives with index and inverse; only the distinct values are sorted."""
    coded = pa.array(values).dictionary_encode()
    code, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Of equal places the last one written stays, so the first value of each.
    first[code[::-1]] = np.arange(len(code))[::-1]
    return found[order], first[order], rank[code]


class WordCache:
    """Token ids of words already seen, so each is tokenized once for a worker.

    The tokenizer never joins characters across ASCII white space, nor letters or digits with stops,
    so the ids of a text are those of its pieces one after another. Pieces are told apart by a 64-bit
    hash. New ones are joined by blanks and tokenized many at a time.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary, suffix = tokenizer.get_vocab(), getattr(tokenizer.model, "end_of_word_suffix", None)
        single = [c for c in vocabulary if len(c) == 1]
        # Ids that end a word, where every word has one; and the id of a mark that stands alone.
        self.closing = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        if suffix and single and all(c + suffix in vocabulary for c in single):
            self.closing[[i for c, i in vocabulary.items() if c.endswith(suffix)]] = True
        self.mark = np.zeros_like(self.closing)
        alone = self._ids(MARK)
        if len(alone) == 1:
            self.mark[alone] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        # The first n_ids of `ids` are in use.
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def tokenize(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, where those of each piece begin and how many it has.

        Pieces of letters are one word each: a piece ends where an id ends a word. Others have a mark
        behind them. As each piece has one end at least, as many ends as pieces mean that all were
        found. Else, as a piece holds the mark or letters that part when normalized, the pieces
        are tokenized one by one.
        """
        plain = np.array([t.isalpha() and (t.isascii() or t.lower().isalpha()) for t in texts], bool)
        made, size = [], np.zeros(len(texts), np.int64)
        order = np.argsort(~plain, kind="stable")
        n_plain = int(plain.sum())
        bounds = [*range(0, n_plain, JOINED), *range(n_plain, len(texts), JOINED), len(texts)]
        for a, b in zip(bounds, bounds[1:]):
            part = [texts[i] for i in order[a:b].tolist()]
            between, closing = (" ", self.closing) if a < n_plain else (f" {MARK} ", self.mark)
            ids = self._ids(between.join([*part, ""]))
            ends = np.flatnonzero(closing[ids]) + 1
            if len(ends) != len(part):
                found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids, counts = np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
            else:
                counts = np.diff(ends, prepend=0)
                if a >= n_plain:
                    ids, counts = np.delete(ids, ends - 1), counts - 1
            made.append(ids)
            size[order[a:b]] = counts
        at = np.empty_like(size)
        at[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([np.zeros(0, np.uint32), *made]), at, size

    def add(self, place: np.ndarray, keys: np.ndarray, texts: list[bytes]) -> None:
        """Take in new words: `keys` ascend and belong before the words numbered `place`."""
        ids, at, size = self.tokenize([t.decode() for t in texts])
        total = self.n_ids + len(ids)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(total, 2 * len(self.ids)) - self.n_ids, np.uint32)])
        self.ids[self.n_ids : total] = ids
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, (self.n_ids + at).astype(np.uint32))
        self.size = np.insert(self.size, place, size.astype(np.uint32))
        self.n_ids = total

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some whole texts, each with the end id, and where each text ends."""
        words = pieces(data, offsets)
        h, first, where = distinct(words.hashes())
        k, new = self._find(h)
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHE_WORDS and len(self.keys):
                self.clear()
                k, new = self._find(h)
            text = data.tobytes()
            self.add(k[new], h[new], [text[a:b] for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())])
            # New words before a word move it up.
            k += np.cumsum(new) - new
        at, size = self.at[k][where].astype(np.int64), self.size[k][where].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(at - (ends - size), size)]
        last = np.append(0, ends)[words.first[1:]]
        if self.n_ids > CACHE_IDS:
            self.clear()
        return np.insert(ids, last, end_id), last + np.arange(1, len(offsets))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ascending keys stand among those known, or belong, and which of them are new."""
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        return place, new


@lru_cache(maxsize=1)
def _cache(vocabulary: str) -> WordCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordCache(Tokenizer.from_str(vocabulary))


def pack_file(part: int, number: int, ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, n_null: int, width: int) -> bytes:
    """One file of the layout above; `docs` are the ascending ids of the documents that have one."""
    low = int(docs[0]) if len(docs) else 0
    bounds = EliasFano.encode(ends).tobytes()
    named = EliasFano.encode(docs.astype(np.int64).view(np.uint64) - np.uint64(low % (1 << 64))).tobytes()
    body = ids.astype(f"<u{width}").tobytes()
    head = HEADER.pack(MAGIC, width, part, number, len(ends), len(ids), n_null, low, len(bounds), len(named))
    return head + body + bounds + named + b"\n"


class TokenFile:
    """A file read back: `document(i)` by two selects, or everything at once."""

    def __init__(self, data: bytes):
        magic, self.width, self.part, self.number, self.n_docs, self.n_tokens, self.n_null, self.low, n_bounds, n_named = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(data)
        at = HEADER.size + self.n_tokens * self.width
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_tokens, HEADER.size)
        self.bounds = EliasFano.frombytes(view[at : at + n_bounds])
        self.named = EliasFano.frombytes(view[at + n_bounds : at + n_bounds + n_named])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i - 1] if i else 0 : self.bounds[i]]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.named.values() + np.uint64(self.low % (1 << 64))).view(np.int64).tolist()


def _write_parts(vocabulary, end_id: int, width: int, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, ends, docs, held, n_docs = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            known = [d for d in docs if d is not None]
            data = pack_file(part, number, np.concatenate(ids), np.concatenate(ends), np.array(known, np.int64), len(docs) - len(known), width)
            return pa.record_batch([pa.array([data], pa.binary())], names=["data"])

        for batch in batches:
            for piece, data, offsets in chunks(batch, "text"):
                got, end = _cache(vocabulary.value).encode(data, offsets, end_id)
                ids.append(got.astype(f"<u{width}"))
                ends.append(end + held)
                docs += piece.column(0).to_pylist()
                held += len(got)
                if held >= file_tokens or len(docs) >= FILE_DOCUMENTS:
                    yield flush()
                    ids, ends, docs, held, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return run


def write_files(documents: DataFrame, vocabulary: str, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> None:
    """Tokenize whole texts and write them to `path` in the layout above.

    `vocabulary` is a file of the tokenizers library on the driver; its content (a few MB) is sent
    to the tasks. Rows are dealt by ranges of doc_id and sorted, so ids ascend through the files;
    ties are in order of a hash of the text, then of the input. A null text is empty and gets the end id only. An empty table
    writes no file with documents.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(content).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = take_columns(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // PARTITION_BYTES)
    # Rows of one id, or without one, are parted by their texts, and equal texts by their place in the input.
    docs = docs.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    ranged = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = ranged.drop("tie", "row").mapInArrow(_write_parts(spark.sparkContext.broadcast(content), end_id, width, file_tokens), "data binary")
    # A text file of one row is its bytes and a line end, which the layout counts in: byte 0x0A.
    whole = files.select(F.expr("cast(substring(data, 1, length(data) - 1) as string)").alias("value"))
    whole.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Files are read when all are written; a worker that is used again lets its tokenizer go.
    _cache.cache_clear()
    for batch in batches:
        for content in batch.column(0):
            file = TokenFile(content.as_py())
            ends = file.bounds.values().astype(np.int64)
            starts = np.append(0, ends[:-1])
            wide = file.ids.astype("<u4").tobytes()
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.record_batch(
                [pa.array(np.full(n, file.part)), pa.array(np.full(n, file.number)), pa.array(file.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                schema=pa.schema([(c, pa.int64()) for c in ("part", "number", "doc_id", "local_start", "n_tokens", "ids_crc32")]),
            )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` of all documents in the files below `path`.

    `start` counts the ids of all documents before, over all files. Offsets of files come from their
    headers: sums over parts first, then over the files of a part.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    # Only headers go to Python, once for both sums.
    heads = cut_lineage(files.select(F.substring("content", 1, HEADER.size)).mapInArrow(_heads, "part long, number long, tokens long"))
    sums = heads.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    before_part = sums.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("number")
    placed = heads.withColumn("file_start", F.sum("tokens").over(in_part) - F.col("tokens")).join(before_part, "part")
    placed = placed.select("part", "number", (F.col("part_start") + F.col("file_start")).alias("offset"))
    docs = files.mapInArrow(_documents, "part long, number long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return docs.join(placed, ["part", "number"]).select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [HEADER.unpack_from(memoryview(c.as_buffer())) for c in batch.column(0)]
        columns = [pa.array([h[i] for h in heads], pa.int64()) for i in (2, 3, 5)]
        yield pa.record_batch(columns, names=["part", "number", "tokens"])


def token_table(documents: DataFrame, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to a new place in the shared folder and read them back."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_files(documents, vocabulary, path, end_id, doc_id, text)
    return read_files(spark, path)
