"""Mixing of sources to target weights by entropy balancing, in DataFrame functions only.

Documents get rates that stay closest to 1 in relative entropy under one token constraint for each
source: rate = exp(tilt * x), cut at the most a document may be repeated, where x is the document's
size over the mean of its source. The dual is convex in one tilt for each source; all tilts are found
together by safeguarded Newton steps. Rates are then rounded into whole copies so that the sums hold.

Documents of one source and size share a rate, so the steps work on counts of sizes. Sums are in whole
numbers of fixed point and so don't depend on the order of rows: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.jobs import cut_lineage, take_columns

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3.0
# Fixed point of rates and token sums.
POINT = 1 << 20
# Newton steps end when each source is within this share of its target.
CLOSE = 1e-7
STEPS = 60
# Classes of sizes that round together, in steps of the binary logarithm, and their parts by hash.
CLASSES, PARTS = 16, 64
# Offsets that the rounding of a source is tried with.
OFFSETS = 64
# exp() of a larger exponent is beyond any limit on repeats.
FAR = 40.0


def _exact(value: Column) -> Column:
    """A double as a whole number of 1 / POINT, wide enough for any sum."""
    return F.round(value * POINT).cast("decimal(38,0)")


def sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`(doc_id, source, size)`: words of each whole text; a null text has none."""
    docs = take_columns(documents, doc_id=doc_id, source=source, text=text)
    n = F.expr(f"cast(regexp_count(coalesce(text, ''), '{WORD}') as bigint)")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"))


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """`(source, source_size, target)` from `cells(source, size, n)`.

    Sources in order of their code points, nulls last, take the weights in turn. All words are shared
    by weight; a target stops at `most` times its source's words and the excess is shared again. The
    shares are found at once: sources stop in order of words by weight, so a running sum over that
    order tells which do. The table has one row for each source.
    """
    total = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    # Strings compare by bytes here, which is the order of code points.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    named = total.withColumn("place", place).withColumn("weight", weight)
    # With the first k sources of this order stopped, the rest share what they leave.
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    stopped = named.withColumns({
        "words": F.sum("source_size").over(every).cast("double"),
        "taken": F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)),
        "heavy": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # Source k stops when the common rate with those before it stopped would pass its limit.
    rate = F.when(F.col("heavy") > 0, (F.col("words") - F.col("taken")) / F.col("heavy")).otherwise(0.0)
    judged = stopped.withColumn("rate", rate).withColumn("stops", F.col("rate") * F.col("weight") >= F.col("source_size") * most)
    # The first source that doesn't stop sets the rate of all after it.
    common = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") * most / F.col("weight"), "place", "rate"))).over(every)
    target = F.when(F.col("stops"), F.col("source_size") * most).otherwise(F.col("weight") * common["rate"])
    return judged.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, x: Column, most: float) -> Column:
    return F.least(F.exp(F.least(tilt * x, F.lit(FAR))), F.lit(most))


def tilts(cells: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """`(source, mean, tilt)`: the solution of the dual for each source.

    Each step is one aggregation over the counts of sizes. A step that leaves the bracket of the
    solution is replaced by halving it. Sources at their limit have no finite tilt; they take the end
    of the bracket, where every document with words is at the limit.
    """
    n_docs = cells.where("size > 0").groupBy("source").agg(F.sum("n").alias("rows"))
    start = targets.where("source_size > 0").join(n_docs, targets.source.eqNullSafe(n_docs.source)).select(
        targets.source, (F.col("source_size") / F.col("rows")).alias("mean"), "target", "source_size"
    )
    full = F.col("target") >= F.col("source_size") * most
    # The smallest document, one word, is at the limit from this tilt on; the other end takes nothing.
    end = F.col("mean") * (F.log(F.lit(most)) + 1)
    state = cut_lineage(start.select(
        "source", "mean", "target",
        F.when(full, end).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("tilt"),
        (-F.col("mean") * FAR).alias("low"), end.alias("high"), full.alias("done"),
    ))
    spread = cells.where("size > 0").select(F.col("source").alias("c_source"), "size", "n")
    for _ in range(STEPS):
        if state.where("NOT done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        weight = F.col("size") * F.col("n")
        rate = _rate(F.col("tilt"), x, most)
        met = spread.join(state.where("NOT done"), F.col("c_source").eqNullSafe(F.col("source")))
        sums = met.groupBy("c_source").agg(
            (F.sum(_exact(weight * rate)) / POINT).cast("double").alias("got"),
            (F.sum(_exact(F.when(rate < most, weight * rate * x).otherwise(0.0))) / POINT).cast("double").alias("slope"),
        )
        off = F.log(F.col("target") / F.col("got"))
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("c_source")), "left").withColumns({
            "low": F.when(F.col("got") < F.col("target"), F.greatest("low", "tilt")).otherwise(F.col("low")),
            "high": F.when(F.col("got") > F.col("target"), F.least("high", "tilt")).otherwise(F.col("high")),
        })
        # Newton on the logarithm of the constraint, which is nearly straight in the tilt.
        newton = F.col("tilt") + off * F.col("got") / F.greatest(F.col("slope"), F.lit(1e-9))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        close = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= F.col("target") * CLOSE)
        state = cut_lineage(joined.select(
            "source", "mean", "target", F.when(close, F.col("tilt")).otherwise(step).alias("tilt"), "low", "high", close.alias("done")
        ))
    return state.select("source", "mean", "tilt")


def mix(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: float = MOST,
) -> DataFrame:
    """`(doc_id, source, size, source_size, target, rate, copies, taken)`: one row for each row of documents.

    `rate` is the balanced rate, `copies` its rounding and `taken = copies * size`. Copies are whole,
    at most `most`, and differ from the rate by less than 1. Documents of a source are put in order
    of size classes, parts by hash and hash, and copies are the steps of the rounded running sum of
    rates. The rounding is tried with 64 offsets and the nearest to the target is taken, so a source's
    words differ from its target by a small part of a document, or, where it has but a few documents,
    by what whole copies allow.

    Texts without words have rate and copies 0. Null sources are one source, the last. Null ids and
    repeated rows are rows like any other. An empty table gives an empty one.
    """
    docs = cut_lineage(sizes(documents, doc_id, text, source))
    cells = cut_lineage(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = cut_lineage(source_targets(cells, weights, most))
    tilt = tilts(cells, targets, most)
    key = lambda t: (t.select(F.col("source").alias("k"), *[c for c in t.columns if c != "source"]))
    named = key(targets.join(tilt.select(F.col("source").alias("t_source"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source"))
    rated = docs.join(named, docs.source.eqNullSafe(named.k)).drop("k")
    rate = F.when(F.col("size") > 0, F.coalesce(_rate(F.col("tilt"), F.col("size") / F.col("mean"), most), F.lit(0.0))).otherwise(0.0)
    h = F.xxhash64("doc_id", "size")
    steps = cut_lineage(rated.select(
        "doc_id", "source", "size", "source_size", "target", h.alias("h"),
        F.round(rate * POINT).cast("long").alias("rate"),
        F.floor(F.log2(F.col("size") + 1.0) * CLASSES).cast("int").alias("class"),
        F.pmod(h, F.lit(PARTS)).cast("int").alias("part"),
    ))
    # Running sums in three levels, so that no window holds a whole source.
    by_part = steps.groupBy("source", "class", "part").agg(F.sum(F.col("rate").cast("decimal(38,0)")).alias("sum"))
    by_class = by_part.groupBy("source", "class").agg(F.sum("sum").alias("sum"))
    over = lambda by, order, col: F.sum(col).over(Window.partitionBy(*by).orderBy(*order)) - F.col(col)
    classes = by_class.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), over(["source"], ["class"], "sum").alias("class_start"))
    parts = by_part.select("source", "class", "part", over(["source", "class"], ["part"], "sum").alias("part_start"))
    starts = parts.join(classes, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class"))).select(
        F.col("source").alias("s_source"), F.col("class").alias("s_class"), F.col("part").alias("s_part"), (F.col("class_start") + F.col("part_start")).alias("start")
    )
    inner = steps.withColumn("upto", F.sum("rate").over(Window.partitionBy("source", "class", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    placed = inner.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("class") == F.col("s_class")) & (F.col("part") == F.col("s_part")))
    # A row takes floor(rate) copies and one more where the running sum, shifted by the source's
    # offset, passes a whole number. Of all offsets the one whose words come nearest is taken.
    end = F.pmod(F.col("start") + F.col("upto"), F.lit(POINT)).cast("long")
    rounded = placed.select(
        "doc_id", "source", "size", "source_size", "target", "rate", end.alias("end"),
        F.floor(F.col("rate") / POINT).cast("long").alias("base"), F.pmod("rate", F.lit(POINT)).alias("more"),
    )
    copies = lambda offset: F.col("base") + (F.pmod(F.col("end") + offset, F.lit(POINT)) < F.col("more")).cast("long")
    offsets = [POINT * i // OFFSETS for i in range(OFFSETS)]
    tried = rounded.groupBy("source", "target").agg(*[F.sum(F.col("size") * copies(F.lit(o))).alias(f"t{i}") for i, o in enumerate(offsets)])
    miss = [F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("miss"), F.lit(o).cast("long").alias("offset")) for i, o in enumerate(offsets)]
    best = tried.select(F.col("source").alias("b_source"), F.least(*miss)["offset"].alias("offset"))
    final = rounded.join(best, F.col("source").eqNullSafe(F.col("b_source"))).withColumn("copies", copies(F.col("offset")))
    return final.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("rate") / POINT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents as often as `mix` takes them, with all columns; those it takes 0 times go.

    Rows are matched by id, source and size; rows equal in these share out their copies in any order.
    """
    order = Window.partitionBy("_id", "_source", "_size").orderBy("_size")
    mixed = mix(documents, doc_id, text, source).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")
    ).withColumn("_row", F.row_number().over(order.orderBy("_copies")))
    n = F.expr(f"cast(regexp_count(coalesce(`{text}`, ''), '{WORD}') as bigint)")
    keyed = documents.withColumns({"_id": F.col(f"`{doc_id}`").cast("long"), "_source": F.col(f"`{source}`").cast("string"), "_size": n})
    keyed = keyed.withColumn("_row", F.row_number().over(order))
    same = [keyed[c].eqNullSafe(mixed[c]) for c in ("_id", "_source")] + [keyed[c] == mixed[c] for c in ("_size", "_row")]
    joined = keyed.join(mixed.where("_copies > 0"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return joined.select(*[F.col(f"`{c}`") for c in documents.columns])
