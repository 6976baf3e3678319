"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At each node every child makes a draw from a hash of
its own name and the row's key: -ln(u) / weight, where a rack weighs what its
shards do and a region what its racks do. The least draw wins, so a child is
chosen with a probability in proportion to its weight, and a row makes as many
draws as the nodes on its way have children.

A child's draw depends on nothing but its name, its weight and the key. So if
weights change, a row leaves a child only where the child became lighter against
its siblings, and below a node whose children kept their weights all rows that
stay keep their places: moves are confined to the subtrees whose weights change.
A shard in a region and rack of its own takes rows only into itself. The law is
``key``: doc_id and the tree alone decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, stored, text_or_empty, without

#: Rows that one task numbers at most, about: a shard is numbered in blocks of this size.
ROWS_A_BLOCK = 50_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def even_tree(shards: int, *, racks: int = 8, regions: int = 2) -> list[Shard]:
    """``shards`` of weight 1 in turn over the racks, racks in turn over the regions."""
    return [Shard(i, (i % racks) % regions, i % racks) for i in range(shards)]


def with_new_shard(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard, in a region and rack of its own: rows move into it and nowhere else."""
    return [*tree, Shard(max(s.number for s in tree) + 1, max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, weight)]


def node_name(seed: str, *path: int) -> int:
    """The long that stands for a node in its draws: ``path`` is region, rack and shard, as far as it goes."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, (seed, *path))).encode()).digest()[:8], "little", signed=True)


def place(key: Column, tree: Sequence[Shard], seed: str = "shard") -> Column:
    """The number of the shard in ``tree`` for ``key``, by descent."""
    live = sorted((s for s in tree if s.weight > 0), key=lambda s: (s.region, s.rack, s.number))
    if not live or any(s.weight < 0 for s in tree):
        raise ValueError("a tree needs a shard of positive weight and none of a negative one")
    if len({s.number for s in tree}) != len(tree):
        raise ValueError("shards need numbers of their own")

    def child(weight: float, at: int, *path: int) -> Column:
        return F.struct(F.lit(node_name(seed, *path)).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(at).alias("at"))

    def chosen(children: Column) -> Column:
        """``at`` of the child with the least draw."""
        unit = lambda c: (F.shiftrightunsigned(F.xxhash64(c["name"], key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.array_min(F.transform(children, lambda c: F.struct((-F.log(unit(c)) / c["weight"]).alias("draw"), c["name"].alias("name"), c["at"].alias("at"))))["at"]

    # Children of each node, as constants: a row looks up those of the nodes on its way only.
    regions, racks, shards = [], [], []
    for region in dict.fromkeys(s.region for s in live):
        inside, below = [s for s in live if s.region == region], []
        for rack in dict.fromkeys(s.rack for s in inside):
            leaves = [s for s in inside if s.rack == rack]
            below.append(child(sum(s.weight for s in leaves), len(shards), region, rack))
            shards.append(F.array(*[child(s.weight, s.number, region, rack, s.number) for s in leaves]))
        regions.append(child(sum(s.weight for s in inside), len(racks), region))
        racks.append(F.array(*below))
    return chosen(F.get(F.array(*shards), chosen(F.get(F.array(*racks), chosen(F.array(*regions))))))


def assign_shards(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None, *, seed: str = "shard", rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Adds ``size, text_crc32, law, shard, slot, grown_shard`` to ``docs``.

    ``slot`` numbers the rows of a shard from 0 without gaps, ordered by block,
    doc_id, checksum and size. The block is a hash of these three into one of
    ``ceil(rows / (shards * rows_a_block))``, so that rows of one doc_id are
    numbered by several tasks; block sizes are summed up before. A null doc_id
    is a key like any other; rows with equal doc_ids share a shard and have slots
    of their own, equal rows in any order. A null text has the size 16; a text of
    any length is read once; an empty table gives an empty one. Input columns
    named like a new one, without regard to case, are left out.
    """
    held = without(docs, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    text = text_or_empty().cast("binary")
    key = quoted("doc_id")
    placed = held.withColumns({
        "size": (F.length(text) + 16).cast("long"),
        "text_crc32": F.crc32(text).cast("long"),
        "law": F.lit("key"),
        "shard": place(key, tree, seed),
        "grown_shard": place(key, grown, seed) if grown else F.lit(None).cast("int"),
    })
    blocks = max(1, -(-held.count() // (len(tree) * rows_a_block)))
    placed = placed.withColumn("__lp_block", F.pmod(F.xxhash64(F.lit(seed + ":block"), key, "text_crc32", "size"), F.lit(blocks)).cast("int"))
    # A few rows for each shard and block; their running sums are where each block starts.
    counts = stored(placed.groupBy("shard", "__lp_block").agg(F.count(F.lit(1)).alias("__lp_n")), "blocks", 2)
    starts = counts.select(F.col("shard").alias("__lp_shard"), F.col("__lp_block").alias("__lp_b"), (F.sum("__lp_n").over(W.partitionBy("shard").orderBy("__lp_block")) - F.col("__lp_n")).alias("__lp_start"))
    ranked = placed.withColumn("__lp_rank", F.row_number().over(W.partitionBy("shard", "__lp_block").orderBy(key, "text_crc32", "size")))
    out = ranked.join(starts, (F.col("shard") == F.col("__lp_shard")) & (F.col("__lp_block") == F.col("__lp_b")))
    out = out.withColumn("slot", (F.col("__lp_start") + F.col("__lp_rank") - 1).cast("long"))
    return out.select(*[quoted(c) for c in held.columns], "size", "text_crc32", "law", "shard", "slot", "grown_shard")
