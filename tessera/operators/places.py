"""Places in a sorted order without a window over all rows: range partitions, their sizes, and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

#: monotonically_increasing_id() is the partition's number times 2 ** 33 plus the row's number.
_PART = 33
#: Rows that a task of ``counted_within`` sorts: its memory is the same for tables of any size.
ROWS_A_TASK = 500_000


def numbered(scratch: Scratch, rows: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "place", each: str | None = None) -> DataFrame:
    """rows plus ``name``: the place (from 0) of each row of its group ``by`` in the given order, ties in the order read; with
    ``each`` the sum of that whole number over the rows before it.

    Rows are sorted into ranges of (by, order), so that one group, or one value, may fill many tasks. A range adds the rows that
    its first group has in earlier ranges: at most one group goes on in a range, so at most a row a range is broadcast.
    Null keys are a group. The result is a table of the scratch folder with no order of rows.
    """
    keys = [*by, *order, "__tie"]
    laid = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    laid = scratch.save(laid.withColumn("__at", F.monotonically_increasing_id()), "laid")
    placed = laid.withColumn("__range", F.shiftright("__at", _PART))
    if each:
        before_it = Window.partitionBy(*by, "__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        local = F.coalesce(F.sum(each).over(before_it), F.lit(0))
    elif by:
        local = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__at")) - 1
    else:
        local = F.col("__at").bitwiseAND(F.lit((1 << _PART) - 1))
    sizes = placed.groupBy(*by, "__range").agg((F.sum(each) if each else F.count("*")).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.withColumn("__before", F.sum("__n").over(before)).where("__before > 0")
    carried = carried.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__from"), "__before")
    same = F.col("__range") == F.col("__from")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = placed.withColumn("__local", local).join(F.broadcast(carried), same, "left")
    return out.select(*rows.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def counted_within(rows: DataFrame, by: str, at: str, reach: int) -> DataFrame:
    """(by, at, n): for each ``at`` of a group ``by`` the pairs of a row there and a row at ``at`` to ``at`` + reach of the group.

    Rows of one place are counted before places meet, and these by a moving sum, so that nothing is multiplied out.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(by, at).repartition(max(least, -(-rows.count() // ROWS_A_TASK)), by)
    here = dealt.groupBy(by, at).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(by).orderBy(at).rangeBetween(0, reach))
    return here.select(by, at, (F.col("n") * ahead).alias("n"))
