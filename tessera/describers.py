"""Describers: what gives symbols their texts. The default needs no service; others run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.markdown import static_description

FIELDS = ("purpose", "inputs", "outputs", "overview")


class Describer(Protocol):
    """Texts of symbols(unique_id, name, kind, fqdn, signature, code, callees, callee_context); made once a task by a factory."""

    def describe(self, symbols: pd.DataFrame) -> pd.DataFrame:
        """unique_id and FIELDS, a row a symbol."""
        ...

    def refine(self, symbols: pd.DataFrame) -> pd.DataFrame:
        """unique_id and ``context`` of variables(unique_id, name, kind, signature, code, parent, holder_kind, holder_purpose,
        functions); may be missing, then variables have no context."""
        ...

    def summarise(self, chunks: pd.DataFrame) -> pd.DataFrame:
        """key and ``summary`` of chunks(key, category, text); may be missing, then modules are told by their first items."""
        ...


def from_names(symbols: DataFrame) -> DataFrame:
    """(unique_id, purpose, inputs, outputs, overview) from kinds and names alone."""
    told = static_description(*[F.col(c) for c in ("name", "kind", "signature", "fqdn")])
    return symbols.select("unique_id", *[c.alias(n) for n, c in told.items()])


def by_plugin(symbols: DataFrame, make: Callable[[], Describer], on_chunk: Callable[[int], None] | None = None) -> DataFrame:
    """The same columns from a describer. ``make`` is called once a task; ``on_chunk`` with the rows of each batch, on the
    executor. A batch whose describer fails fails the task, which Spark then repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describer = make()
        for batch in batches:
            out = describer.describe(batch)
            if on_chunk:
                on_chunk(len(out))
            yield out[["unique_id", *FIELDS]]

    return symbols.mapInPandas(run, "unique_id string, " + ", ".join(f"{f} string" for f in FIELDS))


def summaries(chunks: DataFrame, make: Callable[[], Describer]) -> DataFrame:
    """(key, summary) of every chunk; one that the describer leaves out fails the run, as upper levels would lack it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describer = make()
        for batch in batches:
            out = describer.summarise(batch)[["key", "summary"]]
            if set(out["key"]) != set(batch["key"]):
                raise ValueError("a chunk has no summary")
            yield out

    return chunks.mapInPandas(run, "key string, summary string")


def refine(variables: DataFrame, make: Callable[[], Describer]) -> DataFrame:
    """(unique_id, context) of the variables that the describer has a context for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describer = make()
        for batch in batches:
            if hasattr(describer, "refine"):
                yield describer.refine(batch)[["unique_id", "context"]]

    return variables.mapInPandas(run, "unique_id string, context string")


def describe(symbols: DataFrame, static, make: Callable[[], Describer] | None = None) -> DataFrame:
    """Symbols for which the column ``static`` holds, or all without a describer, from names; the others by the describer."""
    if make is None:
        return from_names(symbols)
    return from_names(symbols.where(static)).unionByName(by_plugin(symbols.where(~static), make))
