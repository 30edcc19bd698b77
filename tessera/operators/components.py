"""Connected components of an undirected edge table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

def _jump(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("id").alias("_up"), F.col("root").alias("_root"))
    return parents.join(up, parents["root"] == up["_up"], "left").select("id", F.coalesce("_root", "root").alias("root"))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges(a, b), root being the smallest id of its component.

    Each round hooks a node to its smallest smaller neighbour, jumps pointers until all trees are stars, and contracts
    the edges to the roots; each round takes at least one node out, so rounds stop when no edge is left (about log of the diameter). Null ends are ignored and a
    self-edge only names its node. No edge, label or component reaches the driver, only counts.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    labels = nodes.select("id", F.col("id").alias("root"))
    owned: list[DataFrame] = [pairs]
    live = pairs.where("a <> b")
    while True:
        parents = scratch.save(live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "parents")
        if parents.isEmpty():
            scratch.drop(parents)
            break
        while True:
            up = parents.select(F.col("id").alias("_up"))
            open_ends = parents.join(up, parents["root"] == up["_up"], "left_semi").isEmpty()
            if open_ends:
                break
            before, parents = parents, scratch.save(_jump(parents), "jump")
            scratch.drop(before)
        p = parents.select(F.col("id").alias("_id"), F.col("root").alias("_to"))
        new = labels.join(p, labels["root"] == p["_id"], "left").select("id", F.coalesce("_to", "root").alias("root"))
        labels = scratch.save(new, "labels")
        pa = p.select(F.col("_id").alias("_ia"), F.col("_to").alias("_ta"))
        moved = live.join(p, live["b"] == p["_id"]).select("a", F.col("_to").alias("b"))
        moved = moved.join(pa, moved["a"] == pa["_ia"], "left").select(F.coalesce("_ta", "a").alias("a"), "b")
        live = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = scratch.save(live, "contracted")
        # What this round read is read no more; the first round's edges also name the nodes until labels are a table.
        scratch.drop(*owned, parents)
        owned = [labels, live]
    return labels
