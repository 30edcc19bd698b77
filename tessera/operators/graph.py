"""Strongly connected components, condensation and longest-path levels by elimination of nodes, a share of them each round.

A node with few ways through it is taken out: every edge into it is joined to every edge out of it. What reaches what among the
other nodes stays the same, and so does the longest path if weights add up. Nodes taken out in one round are no neighbours
of each other. A chain, a ladder or a tree loses a share of its nodes each round, whatever its depth, so rounds grow with
the logarithm of the nodes, not with the layers. Later the rounds are gone back: a node's component or level
follows from its neighbours at the time it went. All steps are joins and groupings of edge tables, which shrink as rounds go.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

#: A node goes if the edges through it are at most so many times its edges: tables grow little, and no hub is multiplied out.
FILL = 2
#: Where a round would take out fewer nodes than this share of the edges, components are looked for by colours.
FEW = 0.03


def shuffled(table: DataFrame) -> DataFrame:
    """The right side of a join that takes no detour: a broadcast would pass through the driver, in every step of every round."""
    return table.hint("merge")


def _clean(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, and distinct edges between them without loops."""
    live = scratch.save(nodes.select("id").where("id IS NOT NULL").distinct(), "nodes")
    inside = edges.where("src <> dst").select("src", "dst").distinct()
    return live, scratch.save(inside.join(shuffled(live.toDF("src")), "src", "left_semi").join(shuffled(live.toDF("dst")), "dst", "left_semi"), "edges")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def _picked(edges: DataFrame, turn: int) -> DataFrame:
    """Nodes (id) that can go together: cheap ones, of which no two are neighbours. Leaves come first, then roots, then by hash."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    first = F.when(F.col("o") == 0, 2).when(F.col("i") == 0, 1).otherwise(0).cast("long")
    rank = F.shiftleft(first, 61).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 3))
    may = sums.where(F.col("i") * F.col("o") <= FILL * (F.col("i") + F.col("o"))).select("id", rank.alias("rank"))
    met = edges.join(shuffled(may.toDF("src", "a")), "src").join(shuffled(may.toDF("dst", "b")), "dst")
    return may.select("id").join(shuffled(met.select(F.when(F.col("a") <= F.col("b"), F.col("src")).otherwise(F.col("dst")).alias("id"))), "id", "left_anti")


def _ends(edges: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges into and out of the picked nodes: (src, id, w) and (id, dst, w)."""
    return edges.join(shuffled(picked.toDF("dst")), "dst").select("src", F.col("dst").alias("id"), "w"), edges.join(shuffled(picked.toDF("src")), "src").select(F.col("src").alias("id"), "dst", "w")


def _take_out(scratch: Scratch, edges: DataFrame, picked: DataFrame) -> DataFrame:
    """The edges (src, dst, w) that are left without the picked nodes, of parallel ones the heaviest."""
    into, out = _ends(edges, picked)
    through = into.withColumnRenamed("w", "before").join(shuffled(out), "id").where("dst IS NULL OR src <> dst").select("src", "dst", (F.col("before") + F.col("w")).alias("w"))
    rest = edges.join(shuffled(picked.toDF("src")), "src", "left_anti").join(shuffled(picked.toDF("dst")), "dst", "left_anti").select("src", "dst", "w")
    return scratch.save(rest.union(through).groupBy("src", "dst").agg(F.max("w").alias("w")), "left")


def scc(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): the smallest id of each node's strongly connected component; edges to what is no node are left out.

    A node that went is in a component with others just if one component has both an edge into it and one out of it. What
    has no cheap nodes left is dense, hence of small depth, and is coloured: as many steps as its paths are long.
    """
    live, first = _clean(scratch, nodes, edges)
    e, gone, found = first.withColumn("w", F.lit(0)), [], []
    e = scratch.save(e, "weighted")
    for turn in count():
        here = e.count()
        if not here:
            break
        picked = scratch.save(_picked(e, turn), "picked")
        if picked.count() >= FEW * here:
            gone.append((picked, e))
            e = _take_out(scratch, e, picked)
        else:
            found.append(_coloured(scratch, e, turn))
            open_ = found[-1].select("id")
            e = scratch.save(e.join(shuffled(open_.toDF("src")), "src", "left_anti").join(shuffled(open_.toDF("dst")), "dst", "left_anti"), "open")
    known = live.select("id", F.col("id").alias("name")).limit(0)
    for f in found:
        known = known.union(f)
    known = scratch.save(known, "known")
    for picked, edges_then in reversed(gone):
        # A neighbour without a name has lost all its edges: it is a component of its own.
        name = lambda rows, end: rows.join(shuffled(known.toDF(end, "name")), end, "left").select("id", F.coalesce("name", end).alias("name"))  # noqa: E731, B023
        into, out = _ends(edges_then, picked)
        both = name(into, "src").join(shuffled(name(out, "dst")), ["id", "name"]).groupBy("id").agg(F.min("name").alias("in"))
        new = picked.join(shuffled(both), "id", "left").select("id", F.coalesce("in", "id").alias("name"))
        before, known = known, scratch.save(known.union(new), "known")
        scratch.drop(before, picked, edges_then)
    # Names are some member's id; the neighbours that were never named are their own.
    every = live.join(shuffled(known), "id", "left").select("id", F.coalesce("name", "id").alias("name"))
    least = every.groupBy("name").agg(F.min("id").alias("scc"))
    return scratch.save(every.join(shuffled(least), "name").select("id", "scc"), "scc")


def _coloured(scratch: Scratch, e: DataFrame, turn: int) -> DataFrame:
    """(id, name) of some components of a graph that is all edges: every node takes the least label that reaches it, and what
    reaches a label's own node within its colour is that node's component. Labels are hashes, so a large one is met soon."""
    own = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"))
    last = scratch.save(_nodes(e).select("id", own.alias("c")), "colour")
    while True:
        colour = last.select("id", "c")
        come = e.join(shuffled(colour.toDF("src", "c2")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c2").alias("c2"))
        new = colour.join(shuffled(come), "id", "left").select("id", F.least("c", "c2").alias("c"), (F.col("c2") < F.col("c")).alias("moved"))
        before, last = last, scratch.save(new, "colour")
        scratch.drop(before)
        if last.where("moved").isEmpty():
            break
    colour = last.select("id", "c")
    back = e.join(shuffled(colour.toDF("src", "a")), "src").join(shuffled(colour.toDF("dst", "b")), "dst").where("a = b").select(F.col("dst").alias("id"), F.col("src").alias("to"))
    back = scratch.save(back, "back")
    seen = front = scratch.save(colour.where("id = c.id").select("id", F.col("id").alias("name")), "reach")
    while not front.isEmpty():
        step = back.join(shuffled(front), "id").select(F.col("to").alias("id"), "name").distinct()
        front = scratch.save(step.join(shuffled(seen.select("id")), "id", "left_anti"), "front")
        seen = scratch.save(seen.union(front), "reach")
    return seen


def condensation(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between components."""
    e = edges.join(shuffled(comp.toDF("src", "cs")), "src").join(shuffled(comp.toDF("dst", "cd")), "dst")
    return e.where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def levels(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc, level): longest path to a leaf over the condensation; 0 at leaves."""
    live, e = _clean(scratch, nodes, edges)
    comp = scc(scratch, live, e)
    rank = longest_paths(scratch, comp.select(F.col("scc").alias("id")).distinct(), condensation(e, comp))
    return comp.join(shuffled(rank.toDF("scc", "level")), "scc").select("id", "scc", "level")


def longest_paths(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): edges of the longest path from each node of an acyclic graph(src, dst).

    Elimination in max-plus algebra: weights through a node add up, of parallel edges the heaviest stays. An edge to null of weight
    0 is a path that ends here. In a graph without cycles there are leaves to take out in every round; more
    rounds than the logarithm are needed only where all nodes are dense over many layers.
    """
    kind = edges.schema["dst"].dataType
    ends = nodes.select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(0).cast("long").alias("w"))
    e = scratch.save(edges.select("src", "dst", F.lit(1).cast("long").alias("w")).union(ends), "weighted")
    gone = []
    for turn in count():
        inner = e.where("dst IS NOT NULL")
        if inner.isEmpty():
            break
        picked = scratch.save(_picked(inner, turn), "picked")
        gone.append((picked, e))
        e = _take_out(scratch, e, picked)
    known = scratch.save(e.select(F.col("src").alias("id"), F.col("w").alias("level")), "levels")
    for picked, edges_then in reversed(gone):
        way = _ends(edges_then, picked)[1].join(shuffled(known.toDF("dst", "level")), "dst", "left")
        new = way.groupBy("id").agg(F.max(F.col("w") + F.coalesce("level", F.lit(0))).alias("level"))
        before, known = known, scratch.save(known.union(new), "levels")
        scratch.drop(before, picked, edges_then)
    return known


def propagate(scratch: Scratch, seeds: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(id, hops): what becomes dirty from seeds(id) along caller edges(src calls dst); rows of stop(id) do not pass it on."""
    seen = scratch.save(seeds.select("id", F.lit(0).cast("long").alias("hops")).distinct(), "dirty")
    front = seen
    e = scratch.save(edges.select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct(), "callers")
    for hop in count(1):
        pass_on = front if stop is None else front.join(shuffled(stop.select("id")), "id", "left_anti")
        step = pass_on.join(shuffled(e), "id").select(F.col("caller").alias("id")).distinct().join(shuffled(seen.select("id")), "id", "left_anti")
        front = scratch.save(step.select("id", F.lit(hop).cast("long").alias("hops")), "front")
        if front.isEmpty():
            return seen
        seen = scratch.save(seen.union(front), "dirty")
