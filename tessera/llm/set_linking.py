"""Links between sets from hash buckets, complete over every bucket and without comparing its members pairwise.

1. A bucket of two gives its pair. Of a larger bucket every member is compared with the bucket's centre alone, the member
   that shares most buckets with others. Verified links are joined to components.
2. What is left are pairs x, y around one centre c in different components. With d(x) the symmetric difference of x and
   c, the difference of x and y is |d(x)| + |d(y)| - 2 * |d(x) & d(y)|; so with u = 100 + pct, v = 100 - pct and
   s(x) = u * |d(x)| - v * |x|,

       100 * |x & y| >= pct * |x | y|   if and only if   2 * u * |d(x) & d(y)| >= s(x) + s(y).

   x is linked to c itself if and only if s(x) <= v * |c|, and two members linked to c are in one component already.
   So one of the two has s > v * |c|, the right side is positive, and the pair shares differences: prefix filtering over
   the differences, rarest first, finds every such pair. Near copies of one text that were edited in different places
   share the text but not the edits, and never meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.plans.scratch import Scratch


def link_sets(
    scratch: Scratch,
    buckets: DataFrame,
    passing: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame], DataFrame],
    differences: Callable[[DataFrame], DataFrame],
    threshold_pct: int,
) -> DataFrame:
    """(id, root) of linked ids. buckets(key, id) has each id once a key at most; passing(pairs(a, b)) drops pairs whose
    estimate is too low, confirm(pairs(a, b)) keeps the true links, differences(pairs(c, id)) gives (c, id, n_c, n, d)
    with the sizes of both sets and their symmetric difference."""
    several = buckets.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(buckets.join(several, buckets["key"] == several["_key"]).select("key", "id", "n"), "buckets")
    hot = shared.where("n > 2")
    twos = shared.where("n = 2").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    degree = hot.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = hot.select("key", "id").join(degree, "id")
    centre = ranked.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"), "id")).alias("best"))
    centre = centre.select("_key", F.col("best.id").alias("c"))
    star = hot.join(centre, hot["key"] == centre["_key"]).where("id <> c").select("c", "id").distinct()
    star = scratch.save(star, "star")
    direct = twos.select("a", "b").union(star.select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")))
    labels = components(scratch, scratch.save(confirm(passing(direct.distinct())), "links"))

    # Groups whose members are not all in one component.
    label = labels.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    placed = star.join(label, star["id"] == label["_id"], "left").select("c", "id", F.coalesce("_root", "id").alias("comp"))
    placed = scratch.save(placed, "placed")
    mixed = placed.groupBy(F.col("c").alias("_c")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    around = placed.join(mixed.select("_c"), placed["c"] == mixed["_c"], "left_semi")
    apart = scratch.save(differences(around.select("c", "id")), "differences")
    cross = passing(_sharing(scratch, apart, around, threshold_pct).select("a", "b"))
    more = scratch.save(confirm(cross), "more-links")
    if more.isEmpty():
        return labels
    known = labels.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    return components(scratch, known.union(more))


def _sharing(scratch: Scratch, apart: DataFrame, around: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (a, b) of one centre and different components that share enough of their differences."""
    u, v = 100 + threshold_pct, 100 - threshold_pct
    size = F.size("d")
    s = u * size - v * F.col("n")
    members = apart.withColumns(
        {
            "far": s > v * F.col("n_c"),  # not linked to the centre
            "n_d": size,
            "s": s,
            # Shared differences at least: with any partner that is far; of a far one, with any partner of fitting size.
            "with_far": F.ceil((s + v * F.col("n_c") + 1) / (2.0 * u) - 1e-9),
            "with_any": F.greatest(F.lit(1), F.ceil((s - v * 100 / threshold_pct * F.col("n")) / u - 1e-9)),
        }
    )
    groups = members.groupBy(F.col("c").alias("_c")).agg(F.max("far").alias("some"), F.count("*").alias("k")).where("some and k > 1")
    members = members.join(groups.select("_c"), members["c"] == groups["_c"], "left_semi")
    members = members.withColumn("reach", F.col("n_d") + 1 - F.when(F.col("far"), F.least("with_far", "with_any")).otherwise(F.col("with_far")))
    rows = members.select("c", "id", "far", "n_d", "s", "reach", F.explode("d").alias("e"))
    often = rows.groupBy("c", "e").agg(F.count("*").alias("often")).where("often > 1")
    shared = rows.join(often, ["c", "e"])
    by_member = Window.partitionBy("c", "id")
    shared = shared.withColumn("rank", F.row_number().over(by_member.orderBy("often", "e")) + F.col("n_d") - F.count("*").over(by_member))
    where = around.select("c", "id", "comp")
    kept = scratch.save(shared.where("rank <= reach").join(where, ["c", "id"]).select("c", "id", "e", "comp", "far", "n_d", "s", "rank"), "shared")
    x = kept.select(*[F.col(n).alias(f"x_{n}") for n in kept.columns])
    y = kept.where("far").select(*[F.col(n).alias(f"y_{n}") for n in kept.columns])
    least = F.ceil((F.col("x_s") + F.col("y_s")) / (2.0 * u) - 1e-9)
    pairs = x.join(
        y,
        (F.col("x_c") == F.col("y_c"))
        & (F.col("x_e") == F.col("y_e"))
        & (F.col("x_comp") != F.col("y_comp"))
        & (~F.col("x_far") | (F.col("x_id") < F.col("y_id")))
        & (F.col("x_rank") + least <= F.col("x_n_d") + 1)
        & (F.col("y_rank") + least <= F.col("y_n_d") + 1),
    )
    return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
