"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` from a hash of the document's id and the child's name,
and the smallest draw wins, so a child is taken in proportion to its weight
and a change of weights moves documents only into (or out of) the subtrees
whose weights changed. A new shard opened as a region of its own therefore
takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_string, text_or_empty

#: Slot buckets over all shards; bounds the table of bucket sizes.
SLOT_BUCKETS = 98_304


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def grid(n_shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """The tree for a shard count: full racks up to ``base`` shards, every later shard a region of its own."""
    out = []
    for s in range(n_shards):
        rack = s // per_rack
        region = f"r{rack // racks}" if s < base else f"x{s}"
        out.append(Shard(s, region, f"{region}/k{rack % racks}" if s < base else f"{region}/k0"))
    return out


def _children(shards: list[Shard]) -> dict[str, list[tuple[str, float]]]:
    """Children and their weights by node; a node weighs what its shards weigh."""
    weight: dict[tuple[str, str], float] = {}
    for s in shards:
        for parent, child in (("", s.region), (s.region, s.rack), (s.rack, f"{s.rack}/s{s.shard}")):
            weight[parent, child] = weight.get((parent, child), 0.0) + s.weight
    out: dict[str, list[tuple[str, float]]] = {}
    for (parent, child), w in weight.items():
        if w > 0:
            out.setdefault(parent, []).append((child, w))
    return out


def place(key: Column, shards: list[Shard], seed: str = "tree") -> Column:
    """Shard number of a key, by three levels of weighted draws over the chosen node's children only."""
    children = _children(shards)

    def table(nodes: list[str]) -> Column:
        entries: list[Column] = []
        for n in nodes:
            entries += [F.lit(n), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in sorted(children[n])])]
        return F.create_map(*entries)

    def draw(kids: Column) -> Column:
        scored = F.transform(kids, lambda c: F.struct(
            (-F.ln((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key, c["name"])), 1, 13), 16, 10).cast("double") + 0.5)
                   / float(2**52)) / c["weight"]).alias("score"), c["name"].alias("name")))
        return F.array_min(scored)["name"]

    regions = sorted({c for c, _ in children[""]})
    racks = sorted({c for r in regions for c, _ in children[r]})
    region = draw(F.element_at(table([""]), F.lit("")))
    rack = draw(F.element_at(table(regions), region))
    leaf = draw(F.element_at(table(racks), rack))
    return F.regexp_extract(leaf, r"/s(\d+)$", 1).cast("int")


def assign(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, doc_id: str = "doc_id", text: str = "text",
           seed: str = "tree") -> DataFrame:
    """``docs`` with ``shard``, ``slot`` and, given a grown tree, ``grown_shard``.

    Only the id decides the shard: equal ids share one, and null ids share
    one. Slots are gapless from 0 in a shard, ordered by a hash bucket of id
    and text, then id and text; equal rows get different slots in any order.
    Slots are numbered inside buckets and shifted by the sizes of the buckets
    before, so no shard is ever sorted as a whole. Columns of these names in
    ``docs`` are replaced.
    """
    key = id_string(doc_id)
    n_buckets = max(16, SLOT_BUCKETS // max(1, len(shards)))
    body = text_or_empty(text)
    placed = docs.drop("shard", "slot", "grown_shard").withColumn("shard", place(key, shards, seed))
    if grown is not None:
        placed = placed.withColumn("grown_shard", place(key, grown, seed))
    placed = placed.withColumn("__digest", F.md5(F.concat_ws("|", key, body)))
    placed = placed.withColumn("__bucket", F.pmod(F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long"), F.lit(n_buckets)).cast("int"))
    sizes = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(F.col(doc_id), "__digest")
    rows = placed.withColumn("__at", F.row_number().over(inside))
    # broadcast: at most SLOT_BUCKETS rows, or 16 for each shard of the given tree
    joined = rows.join(F.broadcast(offsets), ["shard", "__bucket"])
    out = joined.withColumn("slot", (F.col("__before") + F.col("__at") - 1).cast("long"))
    return out.drop("__bucket", "__digest", "__before", "__at")
