"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At every node
each child draws ``-ln(u) / weight`` with ``u`` uniform in (0, 1) from the
XXH64 of (key, child); the smallest draw wins, so a child is chosen with
probability proportional to its weight. A draw depends only on the key, the
child and the child's weight: changing one weight moves rows only into or
out of that subtree (and the subtrees above it).

``grow`` adds a shard as a region of its own, with one rack: no other draw
changes, so rows move only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regstat.llm.common import gapless_rank


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(n_shards: int, regions: int = 3, racks: int = 2) -> list[Leaf]:
    """``n_shards`` equal shards dealt over ``regions`` x ``racks`` racks."""
    cells = regions * racks
    out = []
    for s in range(n_shards):
        cell = s * cells // n_shards
        out.append(Leaf(f"r{cell // racks}", f"r{cell // racks}k{cell % racks}", s))
    return out


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a new region and rack."""
    shard = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"n{shard}", f"n{shard}k0", shard, weight)]


def _weights(tree: list[Leaf], parent, child) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for leaf in tree:
        kids = out.setdefault(parent(leaf), {})
        kids[child(leaf)] = kids.get(child(leaf), 0.0) + leaf.weight
    return out


def _draw(key: Column, child: str, weight: float) -> Column:
    h = F.xxhash64(F.concat(key, F.lit("|" + child)))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 53))
    return -F.log(u) / F.lit(weight)


def _descend(key: Column, at: Column | None, children: dict[str, dict[str, float]]) -> Column:
    """The winning child of the node ``at`` (None: the only node)."""
    def winner(kids: dict[str, float]) -> Column:
        if len(kids) == 1:
            return F.lit(next(iter(kids)))
        return F.array_min(F.array(*[
            F.struct(_draw(key, c, w).alias("draw"), F.lit(c).alias("child"))
            for c, w in kids.items()]))["child"]

    if at is None:
        return winner(next(iter(children.values())))
    chosen = None
    for node, kids in children.items():
        chosen = (F.when(at == node, winner(kids)) if chosen is None
                  else chosen.when(at == node, winner(kids)))
    return chosen


def with_shard(df: DataFrame, key: Column, tree: list[Leaf], out: str) -> DataFrame:
    """Add column ``out`` (int): the shard of each row by its string ``key``."""
    live = [leaf for leaf in tree if leaf.weight > 0]
    regions = _weights(live, lambda x: "", lambda x: x.region)
    racks = _weights(live, lambda x: x.region, lambda x: x.rack)
    shards = _weights(live, lambda x: x.rack, lambda x: f"s{x.shard}")
    t = f"_{out}"
    return (df.withColumn(f"{t}_region", _descend(key, None, regions))
            .withColumn(f"{t}_rack", _descend(key, F.col(f"{t}_region"), racks))
            .withColumn(out, F.substring(_descend(key, F.col(f"{t}_rack"), shards), 2, 9).cast("int"))
            .drop(f"{t}_region", f"{t}_rack"))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, ...) into one of ``n_shards``.

    Law ``key``: doc_id and the shard count decide the shard; with one more
    shard (``grown_shard``) rows only move into it. ``slot`` numbers the rows
    of a shard from 0 without gaps, by hash bucket, then doc_id.

    Returns doc_id, size (UTF-8 bytes of the text + 8), text_crc32, law,
    shard, slot, grown_shard. A null text counts as empty; a null doc_id is
    the key ""; repeated rows each get a row and a slot of their own; an
    empty table gives an empty result; other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    tree = balanced_tree(n_shards)
    rows = with_shard(rows, key, tree, "shard")
    ranked = gapless_rank(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", docs.count())
    return (with_shard(ranked, key, grow(tree), "grown_shard")
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    "slot", "grown_shard"))
