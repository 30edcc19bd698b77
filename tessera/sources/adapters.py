"""Parsers by file extension: the built-in ones and those that callers register."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.sources.braces import LANGUAGES, brace_symbols
from tessera.sources.symbols import python_symbols, shell_symbols, with_unique_ids


@dataclass(frozen=True)
class Adapter:
    """Rows of the symbol schema from files(rel_path, language, content) with one of the extensions (lower case, no dot)."""

    name: str
    extensions: tuple[str, ...]
    code_language: str
    parse: Callable[[DataFrame], DataFrame]


class Registry:
    """Adapters in the order of registration; the first that has a file's extension gets the file."""

    def __init__(self, *adapters: Adapter):
        self.adapters = list(adapters)

    def register(self, adapter: Adapter) -> None:
        self.adapters.append(adapter)

    def adapter_of(self, path: Column) -> Column:
        """The name of the adapter that a path goes to; null without one."""
        ext, out = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), F.lit(None).cast("string")
        for a in reversed(self.adapters):
            out = F.when(ext.isin(*a.extensions), a.name).otherwise(out)
        return out

    def code_language(self, path: Column) -> Column:
        """What a code block of the file is marked with; empty without an adapter."""
        name, out = self.adapter_of(path), F.lit("")
        for a in self.adapters:
            out = F.when(name == a.name, a.code_language).otherwise(out)
        return out

    def parse(self, files: DataFrame) -> DataFrame:
        """Symbols of all files that have an adapter, with unique ids."""
        dealt = files.withColumn("_adapter", self.adapter_of(F.col("rel_path")))
        each = [a.parse(dealt.where(F.col("_adapter") == a.name).drop("_adapter")) for a in self.adapters]
        return with_unique_ids(reduce(DataFrame.unionByName, each))


def default_registry() -> Registry:
    """Python by syntax tree, shell by line, brace languages by their heads."""
    braces = [Adapter(name, files.LANGUAGES[name], name, brace_symbols) for name in LANGUAGES]
    return Registry(Adapter("python", ("py",), "python", python_symbols), Adapter("shell", ("sh", "bash"), "bash", shell_symbols), *braces)
