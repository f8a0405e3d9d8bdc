"""Quality rules whose limits adapt to each language and source.

Each metric of all documents goes into mergeable quantile sketches, one for each pair of language
and source. A sketch counts values in buckets of equal ratio (DDSketch), so sketches merge by adding
counts, hold quantiles to 1 %, and don't depend on the order of rows. All limits come from the sketches: quartiles
for what every text has, and for what most texts lack the share of texts that have some and the median of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, cut_lineage, take_columns, with_measures
from earmark.llm.words import SPACES, Words, chunks, mix, rolling, whole

SYMBOLS = b"#*$%&|<>"
REPEAT = 5
# Base rules: too few words, or too many of them in repeated windows (per cent).
MIN_WORDS, MAX_REPEATED = 10, 20
# Metrics, and for rates the count that they are a share of.
METRICS = {"symbol_rate": "n_words", "dup_line_share": "n_lines", "word_length": None}
# A limit is the upper quartile plus so many spreads between the quartiles; for a rate it is the usual rate plus
# so many standard errors of a rate measured on the text's own count.
SPREADS, ERRORS = 4.0, 3.0
RATIO = 1.02
SMALLEST = 1e-6
# A pair of language and source is weighed by its rows, and its language stands in with so many rows; so
# does the whole table for the language. Small groups come close to their language, large ones stand alone.
SMOOTHING = 200

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated(words: Words) -> np.ndarray:
    """Words of each text that lie in a window of `REPEAT` words that the text holds twice or more."""
    n_docs = len(words.first) - 1
    head = whole(words.doc, REPEAT)
    if not len(head):
        return np.zeros(n_docs, np.int64)
    key = rolling(words.hashes(), REPEAT)[head] ^ mix(words.doc[head].astype(np.uint64) + np.uint64(1))
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(n_docs, np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = head[twice[at] == key]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[hit] += 1
    edge[hit + REPEAT] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    if b"\n" not in text:
        return (1, 0) if text.strip(b" \t\n\v\f\r") else (0, 0)
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of `COUNTS` for each text."""
    words = Words(data, offsets)
    points = (data & 0xC0) != 0x80
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[offsets[1:]] - total[offsets[:-1]]

    text = data.tobytes()
    lines = [_line_counts(text[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    n_lines, n_dup = (np.array(x, np.int64) for x in zip(*lines))
    return {
        "n_words": np.diff(words.first), "word_chars": inside(points & ~SPACES[data]), "n_symbols": inside(table[data]),
        "n_lines": n_lines, "n_dup_lines": n_dup, "n_repeat_words": _repeated(words),
    }


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    counts = count_texts(data, offsets)
    return [counts[c] for c in COUNTS]


def count(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`(doc_id, lang, source)` and the counts of each whole text; a null text has no words."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                counts = count_texts(data, offsets)
                yield pa.record_batch(
                    [part.column(i) for i in range(3)] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                    names=["doc_id", "lang", "source", *COUNTS],
                )

    docs = take_columns(documents, doc_id=doc_id, lang=lang, source=source, text=text)
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    return docs.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def metric_columns(prefix: str = "") -> dict[str, Column]:
    """The metrics from the counts; a text without words has none."""
    share = lambda a, b: F.when(F.col(prefix + b) > 0, F.col(prefix + a) / F.col(prefix + b))
    return {
        "symbol_rate": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"),
    }


def sketch_bucket(value: Column) -> Column:
    """Bucket of a value: its logarithm to the base `RATIO`; a bucket of their own for values near 0."""
    low = math.floor(math.log(SMALLEST) / math.log(RATIO))
    return F.when(value <= SMALLEST, F.lit(low)).otherwise(F.ceil(F.log(value) / math.log(RATIO))).cast("int")


def bucket_value(bucket: Column) -> Column:
    """A value within 1 % of all values of the bucket; 0 for the lowest."""
    low = math.floor(math.log(SMALLEST) / math.log(RATIO))
    return F.when(bucket <= low, 0.0).otherwise(2 * F.pow(F.lit(RATIO), bucket) / (RATIO + 1))


def sketches(counts: DataFrame) -> DataFrame:
    """`(lang, source, metric, bucket, n)`: the sketch of each metric for each pair of language and source."""
    named = metric_columns()
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), named[m].alias("value")) for m in METRICS])
    long = counts.where("n_words > 0").select("lang", "source", F.explode(pairs).alias("m"))
    bucket = sketch_bucket(F.col("m.value")).alias("bucket")
    return long.select("lang", "source", "m.metric", bucket).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def _level(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """`(by, metric, name)`: rows, place and spread of each metric, from merged sketches.

    Place and spread are the upper quartile and its distance from the lower one, but at least what one
    bucket can tell. For a rate the place is the usual rate: the share of texts that have some, times the median of these.
    """
    low = math.floor(math.log(SMALLEST) / math.log(RATIO))
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    ranked = merged.withColumns({
        "upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group),
        "none": F.sum(F.when(F.col("bucket") <= low, F.col("n")).otherwise(0)).over(group),
    })
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), F.col("bucket")))
    some = F.min(F.when((F.col("bucket") > low) & (F.col("upto") - F.col("none") >= F.ceil((F.col("rows") - F.col("none")) * 0.5)), F.col("bucket")))
    found = ranked.groupBy(*by, "metric").agg(F.max("rows").alias("rows"), F.max("none").alias("none"), at(0.25).alias("q1"), at(0.75).alias("q3"), some.alias("some"))
    q1, q3 = bucket_value(F.col("q1")), bucket_value(F.col("q3"))
    usual = F.coalesce((F.col("rows") - F.col("none")) / F.col("rows") * bucket_value(F.col("some")), F.lit(0.0))
    rate = F.col("metric").isin([m for m, n in METRICS.items() if n])
    shape = F.struct("rows", F.when(rate, usual).otherwise(q3).alias("place"), F.greatest(q3 - q1, q3 * (RATIO - 1)).alias("spread"))
    return found.select(*[F.col(c).alias(f"{name}_{c}") for c in by], F.col("metric").alias(f"{name}_metric"), shape.alias(name))


def limits(counts: DataFrame) -> DataFrame:
    """`(lang, source, symbol_rate_usual, dup_line_share_usual, word_length_limit)`: one row for each pair with words."""
    sketch = cut_lineage(sketches(counts))
    own, lang, every = _level(sketch, ["lang", "source"], "o"), _level(sketch, ["lang"], "l"), _level(sketch, [], "a")
    joined = own.join(lang, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_metric") == F.col("l_metric")))
    joined = joined.join(every, F.col("o_metric") == F.col("a_metric"))

    def smooth(inner: str, value: Column, c: str) -> Column:
        return (F.col(f"{inner}.rows") * F.col(f"{inner}.{c}") + SMOOTHING * value) / (F.col(f"{inner}.rows") + SMOOTHING)

    place, spread = (smooth("o", smooth("l", F.col(f"a.{c}"), c), c) for c in ("place", "spread"))
    chosen = joined.select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), F.col("o_metric").alias("metric"), place.alias("place"), spread.alias("spread"))
    at = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    limit = F.col("place") + SPREADS * F.col("spread")
    return chosen.groupBy("lang", "source").agg(*[at(m, F.col("place")).alias(f"{m}_usual") if n else at(m, limit).alias(f"{m}_limit") for m, n in METRICS.items()])


def limit_columns(prefix: str = "") -> dict[str, Column]:
    """The limit of each metric for a text, from its counts and the row of `limits` beside them.

    A rate may pass the usual one by chance: the fewer words or lines, the more.
    """
    at = lambda c: F.col(prefix + c)
    error = lambda m, n: at(f"{m}_usual") + ERRORS * F.sqrt(at(f"{m}_usual") / at(n)) + ERRORS * ERRORS / at(n)
    return {m: F.when(at(n) > 0, error(m, n)) if n else at(f"{m}_limit") for m, n in METRICS.items()}


RULES = [f"{m}_usual" if n else f"{m}_limit" for m, n in METRICS.items()]


def _verdicts(prefix: str = "") -> tuple[Column, Column]:
    """Whether the base rules fail and whether a text stays, from the counts and limits beside each other."""
    at = lambda c: F.col(prefix + c)
    base = (at("n_words") < MIN_WORDS) | (100 * at("n_repeat_words") > MAX_REPEATED * at("n_words"))
    kept, limit = ~base, limit_columns(prefix)
    for m, value in metric_columns(prefix).items():
        kept = kept & F.coalesce(value <= limit[m], F.lit(True))
    return base, kept


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of documents: `doc_id`, the counts, `base_failed`, `kept`, and the limits met with.

    `base_failed`: fewer than 10 words, or more than 20 % of them in repeated windows of five.
    `kept` is false for these and for texts above a limit of their language and source: symbols a
    word, share of repeated lines, characters a word. Limits follow each group's own sketch, smoothed
    towards its language by `SMOOTHING` rows; none is fixed. Null and empty texts have no words and fail.
    Null languages and sources are groups like any other. Repeated rows are judged each; their ids
    don't matter. An empty table gives an empty one; extra columns are ignored.
    """
    counts = cut_lineage(count(documents, doc_id, text, lang, source))
    found = limits(counts).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *RULES)
    joined = counts.join(found, counts.lang.eqNullSafe(F.col("_lang")) & counts.source.eqNullSafe(F.col("_source")), "left")
    base, kept = _verdicts()
    shown = {f"{m}_limit": c for m, c in limit_columns().items()}
    return joined.withColumns({"base_failed": base, "kept": kept, **shown}).drop("_lang", "_source", *[r for r in RULES if r.endswith("_usual")])


def passing(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents that `judge` keeps, with all columns.

    Each row is judged by its own text, whatever its id: rows with a null id go like any other, and a
    row of an id that others share stays or goes alone. Texts are counted twice, first for the limits.
    """
    found = limits(count(documents, doc_id, text, lang, source))
    # A stored table, so that its size is known and documents needn't be shuffled.
    found = cut_lineage(found.select([F.col(c).alias(f"_rule_{c}") for c in found.columns]))
    measured = with_measures(documents, text, [f"_rule_{c}" for c in COUNTS], _measure)
    same = [F.col(f"`{c}`").cast("string").eqNullSafe(F.col(f"_rule_{name}")) for c, name in ((lang, "lang"), (source, "source"))]
    return measured.join(found, same[0] & same[1], "left").where(_verdicts("_rule_")[1]).select(*[F.col(f"`{c}`") for c in documents.columns])
