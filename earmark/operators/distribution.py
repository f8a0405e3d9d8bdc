"""Ranks, positions, runs and quantiles of groups of any size.

A plain window over a group puts the whole group into one task, and the exact percentile
aggregate keeps every distinct value of a group in memory. One query, track or severity may hold a
large part of all rows, so the helpers here first cut a group into bins whose order is known, count
the bins, and only then sort inside a bin. Results are exact; only small per-bin counts are ever
ordered over a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earmark.functions.columns import value_bin
from earmark.session import cut_lineage

ROWS_PER_BLOCK = 65536


def _before() -> tuple[int, int]:
    return W.unboundedPreceding, -1


def _offsets(df: DataFrame, keys: Sequence[str], bins: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows per bin, rows in all earlier bins, and rows of the whole group."""
    counts = df.groupBy(*keys, *bins).agg(F.count(F.lit(1)).alias("_in_bin"))
    group = W.partitionBy(*keys)
    before = group.orderBy(*order).rowsBetween(*_before())
    return counts.select(
        *keys,
        *bins,
        F.coalesce(F.sum("_in_bin").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_bin").over(group).alias("_group_rows"),
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    then_by: Sequence[Column],
    out: str = "rank",
    total: str | None = None,
    tie_bins: Sequence[Column] = (),
) -> DataFrame:
    """Exact `row_number` by `value` descending, then `then_by`, inside each group of `keys`.

    `value` must not be NULL. With `total` the group size is added as well. Where many rows of a
    group may have one and the same value, `tie_bins` are coarse columns that agree with `then_by`;
    a bin that holds a single value is cut further by them. The input is counted and then ordered,
    so it is written once first.
    """
    ties = [f"_tie{i}" for i in range(len(tie_bins))]
    binned = cut_lineage(df).withColumns({"_bin": value_bin(F.col(value)), **dict(zip(ties, tie_bins))})
    in_bin, group = W.partitionBy(*keys, "_bin"), W.partitionBy(*keys)
    in_order = group.orderBy(F.col("_bin").desc(), *ties).rowsBetween(*_before())
    counts = (
        binned.groupBy(*keys, "_bin", *ties)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_rows").over(in_order), F.lit(0)),
                "_group_rows": F.sum("_rows").over(group),
                "_uniform": F.min("_low").over(in_bin) == F.max("_high").over(in_bin),
            }
        )
        .withColumn("_before", F.when(F.col("_uniform"), F.col("_before")).otherwise(F.min("_before").over(in_bin)))
        .drop("_rows", "_low", "_high")
    )
    cuts = [F.when(F.col("_uniform"), F.col(t)) for t in ties]
    inside = W.partitionBy(*keys, "_bin", *cuts).orderBy(F.col(value).desc(), *then_by)
    ranked = binned.join(counts, [*keys, "_bin", *ties]).withColumn(
        out, (F.col("_before") + F.row_number().over(inside)).cast("int")
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_group_rows"))
    return ranked.drop("_bin", "_before", "_group_rows", "_uniform", *ties)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bins: Mapping[str, Column],
    order: Sequence[Column],
    out: str,
    start: int = 0,
) -> DataFrame:
    """Number the rows of each group from `start` in `order`.

    `bins` are coarse columns that agree with `order`: ordering by the bins first must not change
    the order of any two rows.
    """
    binned = df.withColumns({f"_b_{name}": col for name, col in bins.items()})
    names = [f"_b_{name}" for name in bins]
    offsets = _offsets(binned, keys, names, [F.col(n) for n in names])
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    return (
        binned.join(offsets, [*keys, *names])
        .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1 + start)
        .drop(*names, "_before", "_group_rows")
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    label: str,
    block: int = ROWS_PER_BLOCK,
    gaps_end_runs: bool = False,
) -> DataFrame:
    """Maximal runs of one label among neighbouring rows: `(keys, label, length)`.

    The last column of `order` is a whole number, unique in a group for equal leading columns. With
    `gaps_end_runs` a missing number ends a run. Runs are found inside blocks of that number. Only
    the first and the last run of each block are compared over the whole group.
    """
    *outer, pos = order
    block_key = [*keys, *outer, "_blk"]
    inside = W.partitionBy(*block_key).orderBy(pos)
    breaks = F.lag(label).over(inside) != F.col(label)
    if gaps_end_runs:
        breaks = breaks | (F.lag(pos).over(inside) != F.col(pos) - 1)
    pieces = (
        df.select(*keys, *order, label)
        .withColumn("_blk", F.expr(f"{pos} div {block}"))
        .withColumns({"_new": F.coalesce(breaks, F.lit(True)).cast("int"), "_end": F.lead(pos).over(inside).isNull()})
        .withColumn("_run", F.sum("_new").over(inside))
        .groupBy(*block_key, "_run", label)
        .agg(
            F.min(pos).alias("_first"),
            F.max(pos).alias("_last"),
            F.count(F.lit(1)).alias("length"),
            F.max("_end").alias("_end"),
        )
    )
    at_edge = (F.col("_run") == 1) | F.col("_end")
    across = W.partitionBy(*keys).orderBy(*outer, "_first")
    joins_previous = (F.lag(label).over(across) == F.col(label)) & (F.col("_run") == 1)
    if gaps_end_runs:
        joins_previous = joins_previous & (F.lag("_last").over(across) == F.col("_first") - 1)
    merged = (
        pieces.where(at_edge)
        .withColumn("_new", F.when(joins_previous, 0).otherwise(1))
        .withColumn("_merged", F.sum("_new").over(across))
        .groupBy(*keys, "_merged", label)
        .agg(F.sum("length").alias("length"))
    )
    columns = [*keys, label, "length"]
    return pieces.where(~at_edge).select(*columns).unionByName(merged.select(*columns))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    interpolate: bool = True,
) -> DataFrame:
    """Exact quantiles, one row for each group that has a value.

    They lie at `(n - 1) * p` with linear interpolation. Without, the element at `n * p`, counted
    from 0 and rounded down, is taken: the upper median for 0.5.

    Equal values are counted before anything is shuffled on. A histogram of bins then says which
    bin holds each wanted position, and only those bins are sorted.
    """
    values = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bin", value_bin(F.col("_v")))
    )
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    histogram = (
        values.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_end", F.sum("_c").over(group.orderBy("_bin")))
        .withColumn("_n", F.sum("_c").over(group))
    )
    def place(p: float) -> Column:
        if interpolate:
            return (F.col("_n") - 1) * F.lit(float(p))
        return F.least(F.floor(F.col("_n") * F.lit(float(p))), F.col("_n") - 1).cast("double")

    wanted = F.array(*[F.struct(F.lit(name).alias("_q"), place(p).alias("_at")) for name, p in probabilities.items()])
    positions = (
        histogram.select(*keys, "_bin", "_end", (F.col("_end") - F.col("_c")).alias("_start"), F.explode(wanted).alias("_w"))
        .select(
            *keys, "_bin", "_start", "_end", "_w._q", "_w._at",
            F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"),
        )
        .withColumn("_pos", F.when(F.col("_side") == 0, F.floor("_at")).otherwise(F.ceil("_at")))
        .where((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_end")))
    )
    in_bin = W.partitionBy(*keys, "_bin").orderBy("_v")
    needed = positions.select(*keys, "_bin").distinct()
    ordered = (
        values.join(needed, [*keys, "_bin"], "left_semi")
        .withColumn("_upto", F.sum("_c").over(in_bin))
        .withColumn("_from", F.col("_upto") - F.col("_c"))
    )
    found = positions.join(ordered, [*keys, "_bin"]).where(
        (F.col("_pos") - F.col("_start") >= F.col("_from")) & (F.col("_pos") - F.col("_start") < F.col("_upto"))
    )
    columns = []
    for name in probabilities:
        here = F.col("_q") == name
        low = F.max(F.when(here & (F.col("_side") == 0), F.col("_v")))
        high = F.max(F.when(here & (F.col("_side") == 1), F.col("_v")))
        share = F.max(F.when(here, F.col("_at") - F.floor("_at")))
        columns.append((low + (high - low) * share).alias(name))
    return found.groupBy(*keys).agg(*columns) if keys else found.agg(*columns)


def number_all(df: DataFrame, order: Sequence[Column], out: str, start: int = 0) -> DataFrame:
    """Number all rows in `order` without a gap and without one task that sees them all.

    The rows are sorted across partitions and written once. Only the partition sizes are added up
    over the whole table.
    """
    sorted_rows = cut_lineage(
        df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    )
    sizes = sorted_rows.groupBy("_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row for each partition.
    earlier = F.sum("_rows").over(W.orderBy("_part").rowsBetween(*_before()))
    offsets = sizes.select("_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_id") - F.col("_first") + start)
        .drop("_part", "_id", "_first", "_before")
    )


def join_hot(rows: DataFrame, stats: DataFrame, keys: Sequence[str], spread_by: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join one row of `stats` for each group to `rows`, where single groups may be very large.

    Rows of a group go to `salts` tasks by the hash of `spread_by`; the row of statistics goes to all. They meet in
    a shuffle: Spark's estimate knows neither the copies nor how far a file was compressed, and would broadcast
    millions of rows through the driver.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = stats.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def join_one_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Put the columns of a table of one row next to every row."""
    one = F.lit(0).alias("_one")
    return df.select("*", one).join(F.broadcast(single.select("*", one)), "_one").drop("_one")
