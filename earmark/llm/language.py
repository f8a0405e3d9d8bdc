"""Language identification by n-gram filters that hold one bit for each language.

The filter is a Bloom filter whose slots hold a bit mask of languages instead of one bit. The slots of
an n-gram, taken together by AND, name all languages that contain it. Masks are cut into planes of
eight languages, so a text is judged by one histogram of bytes for each plane.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, cut_lineage, take_columns
from earmark.llm.words import chunks, mix

# Letters of an n-gram; a blank stands for either end of a word.
SIZES = (3, 4)
# An n-gram belongs to a language if it has this share of the n-grams of its training texts, and this
# part of its highest share in any language. So a language has at most 1 / LEAST_RATE of them.
LEAST_RATE = 1e-5
LEAST_PART = 0.2
# Slots of a plane and slots of an n-gram. With 100,000 n-grams a language, a quarter of the slots is set.
SLOTS = 1 << 20
PROBES = 3
# Bytes of all planes; with more than 512 languages planes get fewer slots.
FILTER_BYTES = 64 << 20
UNKNOWN = "und"
CHUNK = 1 << 20
BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point in lower case for letters, a blank for all else."""
    table = np.full(0x110000, 0x20, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some texts in UTF-8 and the offset of each text; broken bytes become U+FFFD."""
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        parts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        size = np.array([len(p) for p in parts], np.int64)
        text, offsets = "".join(parts), np.append(0, np.cumsum(size))
    else:
        offsets = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of some texts, the number of the text of each, and the letters of each text."""
    points, first = points_of(data, offsets)
    n_docs = len(first) - 1
    # A blank before each text and one behind the last keep words of neighbours apart.
    x = np.append(np.insert(letters()[points], first[:-1], 0x20), 0x20).astype(np.uint64)
    doc = np.repeat(np.arange(n_docs), np.diff(first) + 1)
    doc = np.append(doc, max(n_docs - 1, 0))
    blank = x == 0x20
    stays = ~blank
    stays[0] = True
    stays[1:] |= ~blank[:-1]
    x, doc, blank = x[stays], doc[stays], blank[stays]
    found, of = [], []
    for size in SIZES:
        n = len(x) - size + 1
        if n <= 0:
            continue
        inside = np.ones(n, bool)
        for i in range(1, size - 1):
            inside &= ~blank[i : n + i]
        at = np.flatnonzero(inside)
        h = np.full(len(at), np.uint64(size))
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[at + i]
        found.append(mix(mix(h)))
        of.append(doc[at + 1])
    letter = np.bincount(doc[~blank], minlength=n_docs)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letter
    return np.concatenate(found), np.concatenate(of), letter


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def count_grams(documents: DataFrame) -> DataFrame:
    """`(lang, h, n)`: how often each n-gram occurs in the texts of each language, from `(lang, text)`."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", CHUNK):
                h, doc, _ = grams(data, offsets)
                coded = part.column(0).dictionary_encode()
                code = np.asarray(coded.indices)[doc]
                for i, lang in enumerate(coded.dictionary.to_pylist()):
                    seen, n = np.unique(h[code == i], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    counted = documents.mapInArrow(run, "lang string, h long, n long")
    return counted.groupBy("lang", "h").agg(F.sum("n").alias("n"))


class Filter:
    """Planes of masks, the languages of their bits, and the share of set bits of each language."""

    def __init__(self, langs: list[str], planes: np.ndarray, usual: int):
        self.langs, self.planes, self.usual = langs, planes, usual
        set_bits = [np.bincount(p, minlength=256) @ BITS for p in planes]
        share = np.concatenate(set_bits)[: len(langs)] / planes.shape[1] if langs else np.zeros(0)
        self.wrong = share**PROBES

    def hits(self, h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """For each text and language, how many of the n-grams the filter says the language contains."""
        size = self.planes.shape[1]
        width = size.bit_length() - 1
        out = []
        for plane in self.planes:
            mask = np.full(len(h), 255, np.uint8)
            for i in range(PROBES):
                mask &= plane[(h >> np.uint64(i * width) & np.uint64(size - 1)).astype(np.int64)]
            seen = np.bincount(doc * 256 + mask, minlength=n_docs * 256).reshape(n_docs, 256)
            out.append(seen @ BITS)
        return np.concatenate(out, axis=1)[:, : len(self.langs)]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        h, doc, letter = grams(data, offsets)
        n_docs = len(offsets) - 1
        if not self.langs:
            return [UNKNOWN] * n_docs, np.zeros(n_docs)
        n = np.bincount(doc, minlength=n_docs)[:, None]
        # Of n n-grams that a language lacks, the filter reports n * wrong; take these out.
        own = np.maximum(self.hits(h, doc, n_docs) - n * self.wrong, 0) / (1 - np.minimum(self.wrong, 0.999))
        best = np.where(own.max(axis=1) > 0, own.argmax(axis=1), self.usual)
        score = np.clip(own[np.arange(n_docs), best] / np.maximum(n[:, 0], 1), 0, 1)
        return [self.langs[b] if some else UNKNOWN for b, some in zip(best.tolist(), letter.tolist())], np.where(letter > 0, score, 0.0)


def learn(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filter:
    """The filter of all training rows: a language, an id whose `remainder` isn't 2, and a text."""
    spark = documents.sparkSession
    rows = take_columns(documents, doc_id=doc_id, text=text, lang=lang).where(remainder() != 2)
    counts = cut_lineage(count_grams(rows.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")))
    total = cut_lineage(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    # One row for each language.
    totals = total.orderBy("lang").collect()
    langs = [r.lang for r in totals]
    size = SLOTS
    n_planes = max(1, -(-len(langs) // 8))
    while n_planes * size > FILTER_BYTES and size > 8:
        size //= 2
    planes = np.zeros((n_planes, size), np.uint8)
    if not langs:
        return Filter([], planes, 0)
    number = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, i int")
    rated = counts.join(total, "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= LEAST_RATE)
    own = rated.withColumn("top", F.max("rate").over(Window.partitionBy("h"))).where(F.col("rate") >= LEAST_PART * F.col("top")).join(number, "lang")
    width = size.bit_length() - 1
    slots = F.array(*[F.shiftrightunsigned("h", i * width).bitwiseAND(F.lit(size - 1).cast("long")) for i in range(PROBES)])
    bit = F.expr("shiftleft(1, i % 8)")
    packed = own.select((F.col("i") / 8).cast("int").alias("plane"), bit.alias("bit"), F.explode(slots).alias("slot"))
    packed = packed.groupBy("plane", "slot").agg(F.bit_or("bit").alias("mask"))
    # At most one row for each slot: the filter itself.
    found = packed.toArrow()
    planes[np.asarray(found["plane"]), np.asarray(found["slot"])] = np.asarray(found["mask"]).astype(np.uint8)
    usual = min(range(len(langs)), key=lambda i: (-totals[i].total, langs[i]))
    return Filter(langs, planes, usual)


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)`: one row for each row of documents, from its whole text.

    The filter learns n-grams of three and four letters from all rows with a language whose crc32 of
    the id, modulo 4, isn't 2; these are the rows with `held_out` false. The language with most n-grams of
    the text wins, after the hits that the filter is expected to report wrongly are taken out; `score` is the
    share of the text's n-grams that it has. Ties go to the smaller name. A text whose n-grams no
    language has is given the one with most training text, with score 0.

    Null and empty texts and texts without a letter are `und` with score 0, as is everything where
    no row can be learned from. A null id is not held out and not learned from. Repeated rows count
    each. An empty table gives an empty one; extra columns are ignored.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(learn(documents, doc_id, text, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", CHUNK):
                names, score = shared.value.judge(data, offsets)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = take_columns(documents, doc_id=doc_id, text=text)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
