"""Shards by a weighted hash tree: regions, racks and shards, in DataFrame functions only.

A row descends the tree. At each level every child draws a number from the hash of the row's id and
the child's name, and the child with the smallest -ln(draw) / weight takes the row; the weight of an
inner node is the sum of its shards. So each shard gets its share of rows, and when weights change,
rows move only within or into the subtrees whose weights grow.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.jobs import cut_lineage, deal, take_columns

SHARDS = 16
RACK, REGION = 4, 2
# Slots are numbered in parts of a shard, by the leading bits of a hash.
PART_BITS = 12
# Equal rows that one piece stands for.
PIECE = 1 << 16


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = SHARDS, grown: int = 0) -> list[Leaf]:
    """Shards 0 to `shards - 1` in racks of 4, regions of 2 racks; each of `grown` more shards is a region.

    A shard that is a region of its own changes no other subtree's weight, so it takes rows only into
    itself.
    """
    leaves = [Leaf(s // (RACK * REGION), s // RACK, s) for s in range(shards)]
    regions = len({leaf.region for leaf in leaves})
    return leaves + [Leaf(regions + i, shards + i, shards + i) for i in range(grown)]


def draw(key: Column, name: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _choose(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child that takes the row; ties go to the smaller number."""
    if len(children) == 1:
        return F.lit(next(iter(children))).cast("int")
    drawn = [F.struct((-F.log(draw(key, f"{level}{c}")) / F.lit(w)).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items())]
    return F.least(*drawn)["c"]


def _children(leaves: Sequence[Leaf], of: int, below: int) -> dict[int, dict[int, float]]:
    """Weights of the nodes of level `below` under each node of level `of` (-1: the root)."""
    out: dict[int, dict[int, float]] = {}
    for leaf in leaves:
        under = out.setdefault(leaf[of] if of >= 0 else 0, {})
        under[leaf[below]] = under.get(leaf[below], 0.0) + leaf.weight
    return out


def descend(df: DataFrame, key: Column, leaves: Sequence[Leaf], out: str) -> DataFrame:
    """Add the shard of each row; one level of the tree is one column, then dropped."""
    leaves = [leaf for leaf in leaves if leaf.weight > 0]
    df = df.withColumn("_region", _choose(key, "region", _children(leaves, -1, 0)[0]))
    for level, of, name, col in (("rack", 0, "_region", "_rack"), ("shard", 1, "_rack", out)):
        chosen = None
        for node, children in sorted(_children(leaves, of, of + 1).items()):
            here = F.col(name) == node
            pick = _choose(key, level, children)
            chosen = F.when(here, pick) if chosen is None else chosen.when(here, pick)
        df = df.withColumn(col, chosen.cast("int"))
    return df.drop("_region", "_rack")


def assign(documents: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", leaves: Sequence[Leaf] | None = None) -> DataFrame:
    """`(doc_id, size, text_crc32, law, shard, slot, grown_shard)`: one row for each row of documents.

    The law is `key`: id and tree decide, so rows of one id share a shard, and all rows with a null
    id do. `size` is the bytes of the text plus 1, `text_crc32` its checksum; a null text is empty.
    `slot` counts from 0 without gaps in each shard, by a hash of id, size and checksum, then these;
    rows that are equal in all of them are alike. `grown_shard` is the shard with one shard more, a
    region of its own. `leaves` gives another tree or weights; shards of weight 0 take nothing. An
    empty table gives an empty one.

    Rows are counted before they are shuffled, and different ones numbered in 4096 parts of a shard, offset by the
    counts of earlier parts. Repeated rows come out of their count in pieces that are dealt to all tasks, so neither a
    null or repeated id nor a group of equal rows is sorted or made by one task.
    """
    leaves = list(leaves) if leaves is not None else tree(shards)
    more = leaves + [Leaf(max(x.region for x in leaves) + 1, max(x.rack for x in leaves) + 1, max(x.shard for x in leaves) + 1)]
    docs = take_columns(documents, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    counted = docs.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = descend(descend(counted, key, leaves, "shard"), key, more, "grown_shard").withColumn("h", F.xxhash64("doc_id", "size", "text_crc32"))
    placed = cut_lineage(placed.withColumn("part", F.shiftrightunsigned("h", 64 - PART_BITS).cast("int")))
    counts = placed.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    offsets = counts.select("shard", "part", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("shard", "part").orderBy("h", "doc_id", "size", "text_crc32")) - F.col("n")
    first = placed.withColumn("inner", inner).join(offsets, ["shard", "part"]).withColumn("first", F.col("before") + F.col("inner"))
    shown = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    alone = first.where("n = 1").select(*shown, F.col("first").cast("long").alias("slot"), "grown_shard")
    pieces = first.where("n > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    dealt = deal(pieces, "h", "piece").withColumn("i", F.explode(F.sequence("piece", F.least(F.col("piece") + PIECE, "n") - 1)))
    return alone.unionByName(dealt.select(*shown, (F.col("first") + F.col("i")).cast("long").alias("slot"), "grown_shard"))
