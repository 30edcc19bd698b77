"""Ordered folds into capped chunks, by blocks of a group: where a chunk that starts at an item ends does not depend on
what came before, so blocks are worked on at once and only their ways in and out are put together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.places import numbered
from tessera.plans.scratch import Scratch

#: Items of a block at least; blocks that are put together at once.
BLOCK, FAN = 4096, 64


def boundary(text: Column, max_items: int) -> Column:
    """Whether a stable chunk ends after this item: its SHA-1's first 32 bits divide by max(2, max_items // 2)."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long") % max(2, max_items // 2) == 0


def next_starts(sizes: np.ndarray, cuts: np.ndarray, max_items: int, max_chars: int) -> np.ndarray:
    """For each item, where the next chunk starts if one starts here: by a search in the running sums."""
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    here = np.arange(n)
    full = np.searchsorted(sums, sums[:-1] + max_chars, side="right") - 1
    marks = np.flatnonzero(cuts) + 1  # a chunk ends after a mark
    marked = np.append(marks, n + max_items)[np.searchsorted(marks, here, side="right")]
    return np.minimum(np.minimum(np.maximum(full, here + 1), here + max_items), marked)


def _null_safe(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def capped_chunks(
    scratch: Scratch, items: DataFrame, group: str, order: str, text: str, max_items: int = 15, max_chars: int = 3500, stable: bool = False
) -> DataFrame:
    """(group, order, chunk) of an ordered fold: a chunk closes before an item that would pass a cap, and, if stable,
    after an item with a boundary hash. An item above max_chars stands alone.

    1. Items get their places in the group, and groups are cut into blocks. 2. A block with the first items of the next one says, for
    each place at which a chunk may come in, where the next block's first chunk starts and how many chunks start here: a chunk
    has at most max_items items, so there are as many ways in. 3. These maps are put together, FAN blocks at a time, and gone down
    again, which gives every block its way in and the chunks before it. 4. Blocks mark their chunks. A task holds a block.
    """
    block = max(BLOCK, 8 * max_items)
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    cut = F.coalesce(boundary(F.col(text), max_items), F.lit(False)) if stable else F.lit(False)
    rows = items.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), size.alias("n"), cut.alias("cut"))
    placed = numbered(scratch, rows, ["o"], by=["g"], name="p").withColumns({"b": F.floor(F.col("p") / block), "at": (F.col("p") % block).cast("int")})
    placed = scratch.save(placed.drop("p"), "items")
    again = placed.where((F.col("b") > 0) & (F.col("at") < max_items)).withColumns({"b": F.col("b") - 1, "at": F.col("at") + block})
    whole = placed.unionByName(again)
    kind = items.schema[group].dataType.simpleString()

    def ways(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        jump = next_starts(table["n"].to_numpy(), table["cut"].to_numpy(), max_items, max_chars)
        own = min(block, len(jump))
        out, starts = np.zeros(block + max_items, np.int32), np.zeros(block + max_items, np.int64)
        out[block:] = np.arange(max_items)
        for i in range(own - 1, -1, -1):
            out[i], starts[i] = out[jump[i]], starts[jump[i]] + 1
        return pa.table({"g": table["g"][:1], "b": table["b"][:1], "out": pa.array([out[:max_items].tolist()], pa.list_(pa.int32())), "starts": pa.array([starts[:max_items].tolist()], pa.list_(pa.int64()))})

    maps = whole.groupBy("g", "b").applyInArrow(ways, f"g {kind}, b long, out array<int>, starts array<long>")
    entries = _entries(scratch, scratch.save(maps.select("g", "b", F.arrays_zip("out", "starts").alias("f")), "maps"), max_items)
    inner = whole.join(entries.select(F.col("g").alias("_g"), F.col("b").alias("_b"), "enter", "before"), _null_safe([("g", "_g"), ("b", "_b")]))

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        jump = next_starts(table["n"].to_numpy(), table["cut"].to_numpy(), max_items, max_chars)
        own = int((table["at"].to_numpy() < block).sum())
        start = np.zeros(own, np.int64)
        i = table["enter"][0].as_py()
        while i < own:
            start[i] = 1
            i = jump[i]
        chunk = table["before"][0].as_py() + np.cumsum(start) - 1
        return pa.table({"g": table["g"][:own], "o": table["o"][:own], "chunk": pa.array(chunk, pa.int64())})

    marked = inner.select("g", "b", "o", "n", "cut", "at", "enter", "before").groupBy("g", "b").applyInArrow(mark, f"g {kind}, o long, chunk long")
    return marked.select(F.col("g").alias(group), F.col("o").alias(order), "chunk")


def _entries(scratch: Scratch, maps: DataFrame, ways: int) -> DataFrame:
    """(g, b, enter, before): where each block's first chunk starts and how many start before it. ``f`` maps a way in to the
    next block's and the chunks between; maps of FAN blocks are put together level by level, then entries go down the levels."""
    levels = [maps]
    start = F.struct(F.lit(0).alias("out"), F.lit(0).cast("long").alias("starts"))
    through = lambda x, m: F.struct(m["f"][x["out"]]["out"].alias("out"), (x["starts"] + m["f"][x["out"]]["starts"]).alias("starts"))
    while (levels[-1].agg(F.max("b")).first()[0] or 0) > 0:
        parts = levels[-1].groupBy("g", F.floor(F.col("b") / FAN).alias("b2")).agg(F.sort_array(F.collect_list(F.struct("b", "f"))).alias("ms"))
        every = F.transform(F.sequence(F.lit(0), F.lit(ways - 1)), lambda i: F.struct(i.alias("out"), F.lit(0).cast("long").alias("starts")))
        f = F.aggregate("ms", every, lambda xs, m: F.transform(xs, lambda x: through(x, m)))
        levels.append(scratch.save(parts.select("g", F.col("b2").alias("b"), f.alias("f")), "maps"))
    entries = levels[-1].select("g", "b", start["out"].alias("enter"), start["starts"].alias("before"))
    for level in reversed(levels[:-1]):
        parts = level.groupBy("g", F.floor(F.col("b") / FAN).alias("b2")).agg(F.sort_array(F.collect_list(F.struct("b", "f"))).alias("ms"))
        above = entries.select(F.col("g").alias("_g"), F.col("b").alias("_b"), F.struct(F.col("enter").alias("out"), F.col("before").alias("starts")).alias("x"))
        met = parts.join(above, _null_safe([("g", "_g"), ("b2", "_b")]))
        none = F.array().cast("array<struct<b:bigint,out:int,starts:bigint>>")
        state = F.struct(F.col("x").alias("x"), none.alias("seen"))
        step = lambda s, m: F.struct(through(s["x"], m).alias("x"), F.concat(s["seen"], F.array(F.struct(m["b"].alias("b"), s["x"]["out"].alias("out"), s["x"]["starts"].alias("starts")))).alias("seen"))
        seen = met.select("g", F.explode(F.aggregate("ms", state, step)["seen"]).alias("e"))
        entries = scratch.save(seen.select("g", F.col("e.b").alias("b"), F.col("e.out").alias("enter"), F.col("e.starts").alias("before")), "entries")
    return entries


def hash_chunks(scratch: Scratch, items: DataFrame, group: str, order: str, text: str, max_items: int = 15) -> DataFrame:
    """(group, order, chunk): the number of boundaries before each item of its group, a running sum over sorted ranges."""
    cut = F.coalesce(boundary(F.col(text), max_items), F.lit(False)).cast("long")
    rows = items.select(group, order, cut.alias("_cut"))
    return numbered(scratch, rows, [order], by=[group], name="chunk", each="_cut").drop("_cut")
