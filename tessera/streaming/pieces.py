"""Streamed answers piece by piece: where one goes on with nothing but white space and should be stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White-space characters in a row after which an answer is stopped.
MOST_BLANKS = 50


def _counts(text: Column) -> tuple[Column, Column]:
    """(whether a piece is blank, white space at its end)."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+\z", "")
    return rest == "", F.length(F.coalesce(text, F.lit(""))) - F.length(rest)


def stopped(pieces: DataFrame, key: str, order: str, text: str, most: int = MOST_BLANKS) -> DataFrame:
    """(key, order) of the blank piece with which each answer has ``most`` white-space characters in a row; none for others.

    Running sums: white space since the last piece that is not blank, with the end of that one. Null texts are empty.
    """
    blank, end = _counts(F.col(text))
    rows = pieces.select(key, order, blank.alias("_blank"), end.alias("_n"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_sum": F.sum("_n").over(w), "_part": F.sum(F.when(F.col("_blank"), 0).otherwise(1)).over(w)})
    first = Window.partitionBy(key, "_part")
    run = F.col("_sum") - F.min(F.col("_sum") - F.col("_n")).over(first)
    hit = rows.withColumn("_run", run).where(F.col("_blank") & (F.col("_run") >= most))
    return hit.groupBy(key).agg(F.min(order).alias(order))


def stop_stream(pieces: DataFrame, key: str, order: str, text: str, most: int = MOST_BLANKS) -> DataFrame:
    """The same of a stream, as soon as it is known: a stateful fold that holds two numbers an answer, and tells each once.

    The pieces of one micro-batch are put in order; those of a later one are taken to follow.
    """
    kinds = {c: pieces.schema[c].dataType.simpleString() for c in (key, order)}
    blank, end = _counts(F.col(text))
    rows = pieces.select(key, order, blank.alias("blank"), end.alias("n"))

    def fold(keys, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, told = state.get if state.exists else (0, False)
        part = pd.concat(list(parts)).sort_values(order, kind="stable")
        for at, is_blank, n in zip(part[order], part["blank"], part["n"], strict=True):
            run = run + int(n) if is_blank else int(n)
            if is_blank and run >= most and not told:
                told = True
                yield pd.DataFrame({key: [keys[0]], order: [at]})
        state.update((run, told))

    out = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return rows.groupBy(key).applyInPandasWithState(fold, out, "run long, told boolean", "append", "NoTimeout")
