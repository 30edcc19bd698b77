"""Links of members that share a block, without emitting all pairs of a block, and without leaving one out.

A member's blocks are the first ``need`` of its grams in an order that is the same for all members; linked members share one of
these, whatever the order is. Keys below 0 are no grams: any two members of such a block are linked.

1. Every member of a block is compared with the block's centre, its smallest id. Verified links are joined to components.
2. Within a block only members of *different* components are still to be compared (equal components cannot change the
   result), and for keys below 0 none.
3. A gram of more than SPLIT_ABOVE members (a phrase that many of them quote) tells little, so it goes to the end of the order.
   Its members take their next grams instead and meet all members that have these; the order is still one for all, so no link
   is lost. Members that have too few other grams keep common ones, and meet there.
4. Members of a block meet in pieces of at most PIECE rows, each two pieces as a group of their own: a block of any size is
   compared whole, in bounded memory and by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.plans.scratch import Scratch

#: Members of a gram from which on their next grams take its place.
SPLIT_ABOVE = 1000
#: Rows of a block that meet as one group.
PIECE = 256
#: Blocks are grouped in so many turns, by their keys, so that only one turn's shuffle stands on disk.
TURNS = 6
#: Their members of different components meet in so many turns.
APART = 3


def _shared(blocks: DataFrame) -> DataFrame:
    """blocks(key, id, signs), repeats gone, with the block's rows ``n`` and centre ``c``, where another id shares it: (key, id, n, c)
    and the signs of the centre (l_) and of the id (r_). One shuffle by key."""
    signs = [x for x in blocks.columns if x not in ("key", "id")]
    by_id = Window.partitionBy("key").orderBy("id")
    whole = by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Most rows are alone with their key and go by the count, before the others' centres are looked up in the same order.
    sized = blocks.withColumn("rows", F.count("*").over(whole)).where("rows > 1")
    met = sized.select(
        "key", "id", F.col("rows").alias("n"), *[F.col(x).alias(f"r_{x}") for x in signs],
        F.lag("id").over(by_id).alias("before"), F.first(F.struct("id", *signs)).over(whole).alias("first"), F.last("id").over(whole).alias("last"),
    )
    met = met.where((F.col("first.id") != F.col("last")) & (F.col("before").isNull() | (F.col("before") != F.col("id"))))
    return met.select("key", "id", "n", F.col("first.id").alias("c"), *[F.col(f"first.{x}").alias(f"l_{x}") for x in signs], *[f"r_{x}" for x in signs])


def _tried(shared: DataFrame, cheap: Callable[[str, str], Column]) -> DataFrame:
    """(key, id, n, c, near): whether ``cheap`` lets the id and the centre pass. Two ids that it rejects need not be kept."""
    tried = shared.select("key", "id", "n", "c", ((F.col("id") != F.col("c")) & cheap("l_", "r_")).alias("near"))
    return tried.where("near OR n > 2")


def _star(shared: DataFrame) -> DataFrame:
    return shared.where("near").select(F.col("c").alias("a"), F.col("id").alias("b"))


def _turn(rows: DataFrame, turn: int) -> DataFrame:
    return rows.where(F.pmod("key", F.lit(TURNS)) == turn)


def _later(scratch: Scratch, blocks: DataFrame, shared: DataFrame, signs: DataFrame, cheap: Callable[[str, str], Column], grams: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """(key, id, n, c, near), a table a turn, of the blocks that take the place of the large ones; what has these grams anyway meets in them too."""
    large = shared.where((F.col("key") >= 0) & (F.col("n") > SPLIT_ABOVE))
    common = scratch.save(large.select("key").distinct(), "common")
    every = grams(scratch.save(large.select("id").distinct(), "in-large"))
    marked = every.join(common.select("key", F.lit(True).alias("last")), "key", "left").withColumn("last", F.coalesce("last", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("id").orderBy("last", "rank"))
    first = scratch.save(marked.withColumn("place", place).where("place <= need").select("key", "id", "last", (F.col("rank") > F.col("need")).alias("new")), "first")
    new = scratch.save(first.where("new AND NOT last").select("key").distinct(), "new")
    tables = []
    for turn in range(TURNS):
        scratch.sweep()
        own = _turn(first.where("new OR last").select("key", "id"), turn).join(signs, "id").select(*blocks.columns)
        there = _turn(blocks, turn).join(_turn(new, turn), "key", "left_semi").select(*blocks.columns)
        tables.append(scratch.save(_tried(_shared(own.union(there)), cheap), "later"))
    scratch.drop(first, new)
    return tables


def _apart(scratch: Scratch, shared: DataFrame, labels: DataFrame, signs: DataFrame, cheap: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a, b) of one block and different components that ``cheap`` does not reject."""
    root = labels.select(F.col("id").alias("_id"), "root")
    placed = shared.where("n > 2 AND key >= 0").select("key", "id").join(root, F.col("id") == F.col("_id"), "left")
    placed = placed.select("key", "id", F.coalesce("root", "id").alias("comp"))
    w = Window.partitionBy("key")
    mixed = placed.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)}).where("lo < hi")
    at = F.floor((F.row_number().over(w.orderBy("id")) - 1) / PIECE)
    pieces = mixed.withColumn("piece", at).withColumn("last", F.floor((F.count("*").over(w) - 1) / PIECE))
    pieces = scratch.save(pieces.select("key", "id", "comp", "piece", "last"), "mixed")
    scratch.sweep()
    known = pieces.join(signs, "id")
    cols = [c for c in known.columns if c not in ("key", "piece", "last")]
    x = known.select("key", F.col("piece").alias("i"), F.explode(F.sequence("piece", "last")).alias("j"), *[F.col(c).alias(f"l_{c}") for c in cols])
    y = known.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "piece")).alias("i"), F.col("piece").alias("j"), *[F.col(c).alias(f"r_{c}") for c in cols])
    y = y.select(F.col("key").alias("_key"), F.col("i").alias("_i"), F.col("j").alias("_j"), *[f"r_{c}" for c in cols])
    met = (F.col("key") == F.col("_key")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("l_id") < F.col("r_id")) & (F.col("l_comp") != F.col("r_comp"))
    pairs = x.join(y, met & cheap("l_", "r_")).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    pairs = scratch.save(pairs.distinct(), "apart")
    scratch.drop(pieces)
    scratch.sweep()
    return pairs


def link_blocks(
    scratch: Scratch,
    blocks: DataFrame,
    signs: DataFrame,
    cheap: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    grams: Callable[[DataFrame], DataFrame],
    spent: DataFrame,
) -> DataFrame:
    """(id, root) of linked ids. blocks(key, id, signs) may repeat rows; signs(id, signs) has each id once, with the columns by whose
    prefixed names ``cheap`` tests a pair; it rejects no link. verify(pairs(a, b)) keeps the true links; grams(wanted(id)) gives (id,
    key, rank, need) of all grams of the ids in their order, the first ``need`` being the blocks. ``spent`` is a scratch table
    that nothing but ``blocks`` reads; it goes once these are grouped.

    Signs travel with the blocks, so that most pairs are rejected where a block is grouped: neither they nor their texts are shuffled.
    """
    turns = []
    for turn in range(TURNS):
        turns.append(scratch.save(_tried(_shared(_turn(blocks, turn)), cheap), "shared"))
        scratch.sweep()
    shared = reduce(DataFrame.union, turns)
    large = (F.col("n") > SPLIT_ABOVE) & (F.col("key") >= 0)
    star, meet, later = _star(shared), turns, []
    if not shared.where(large).isEmpty():
        later = _later(scratch, blocks, shared, signs, cheap, grams)
        star, meet = star.unionByName(reduce(DataFrame.union, map(_star, later))), [t.where(~large) for t in turns] + later
    scratch.drop(spent)
    scratch.sweep()
    star = scratch.save(star.distinct(), "star")
    scratch.sweep()
    labels = components(scratch, verify(star))
    apart = [_apart(scratch, reduce(DataFrame.union, meet[k::APART]), labels, signs, cheap) for k in range(min(APART, len(meet)))]
    cross = scratch.save(reduce(DataFrame.union, apart).distinct().join(star, ["a", "b"], "left_anti"), "cross")
    scratch.drop(*turns, *later, *apart, star)
    scratch.sweep()
    if cross.isEmpty():
        return labels
    known = labels.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    return components(scratch, known.union(verify(cross).select("a", "b")))
