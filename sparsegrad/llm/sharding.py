"""Hierarchical weighted hash tree: region, rack and shard are drawn level by
level.

Every child of a node draws ``-ln(u) / weight`` with ``u`` hashed from the
document id and the child's name, and the smallest draw wins. A child's draw
depends on that child alone, so a changed weight moves documents only into or
out of the subtree that changed; siblings keep their relative order.

Defined cases: a null id is one key and lands in one shard; rows with equal
ids share a shard; slots number the rows of a shard from 0 without gaps, in an
order that depends only on the rows (equal rows take neighbouring slots); an
empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unit_draw

#: Rows of one slot-numbering window, on average.
SLOT_ROWS = 8192


@dataclass(frozen=True)
class Node:
    """A tree node: an inner node has children, a leaf has a shard number."""
    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int = -1

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` equal shards, filled in order."""
    leaves = [Node(f"shard{i}", shard=i) for i in range(shards)]
    rack_nodes = [Node(f"rack{i // per_rack}", children=tuple(leaves[i:i + per_rack]))
                  for i in range(0, shards, per_rack)]
    regions = [Node(f"region{i // racks}", children=tuple(rack_nodes[i:i + racks]))
               for i in range(0, len(rack_nodes), racks)]
    return Node("root", children=tuple(regions))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, alone in a rack of a region of its own:
    the only subtree whose weight changed, so rows move only into it."""
    n = 1 + max(x.shard for x in tree.leaves())
    leaf = Node(f"shard{n}", weight, shard=n)
    rack = Node(f"rack-of-{n}", children=(leaf,))
    return Node(tree.name, children=(*tree.children, Node(f"region-of-{n}", children=(rack,))))


def assign(key: Column, node: Node) -> Column:
    """Shard number of ``key``: one weighted draw for each child on the way."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.total > 0]
    if len(live) == 1:
        return assign(key, live[0])
    draws = [F.struct((-F.log(unit_draw(key, F.lit(c.name))) / F.lit(c.total)).alias("d"),
                      F.lit(i).alias("i")) for i, c in enumerate(live)]
    winner = F.array_min(F.array(*draws))["i"]
    if all(not c.children for c in live):
        return F.element_at(F.array(*[F.lit(c.shard) for c in live]), winner + 1)
    out = F.when(winner == 0, assign(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(winner == i, assign(key, c))
    return out


def shard_rows(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots: rows are cut into (shard, bin) cells of about ``SLOT_ROWS`` rows by
    a hash; cells are numbered inside and offset by the counts of the cells
    before them, so no shard is ever sorted in one task."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        assign(F.col(key), tree).cast("int").alias("shard"),
        assign(F.col(key), grown(tree)).cast("int").alias("grown_shard"))
    rows = stored(named, "shard-rows")
    shards = len(tree.leaves())
    bins = max(1, math.ceil(rows.count() / (shards * SLOT_ROWS)))
    rows = rows.withColumn("_bin", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(bins)))
    cells = rows.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("shard", "_bin").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "_bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_from") + F.col("_k")).cast("long").alias("slot"), "grown_shard")
