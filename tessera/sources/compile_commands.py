"""Compiler flags of C and C++ files from a compilation database."""

from __future__ import annotations

import json
import posixpath
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a database is looked for below a root, the flags that are kept, and those that are not.
PLACES = ("compile_commands.json", "build/compile_commands.json", "builddir/compile_commands.json")
KEPT, DROPPED, INCLUDES = ("-I", "-D", "-U", "-isystem", "-std=", "-m", "-f"), ("-c", "-o"), ("-I", "-isystem")
DEFAULT_C, DEFAULT_CPP, DEFAULTS = "-std=c11", "-std=c++17", ("-D_GNU_SOURCE",)


def kept_flags(arguments: list[str], directory: str) -> list[str]:
    """The kept flags of a command (its first word is the compiler), include folders made absolute."""
    below = lambda p: posixpath.normpath(posixpath.join(directory, p)) if directory and not p.startswith("/") else p
    out, rest = [], iter(arguments[1:])
    for a in rest:
        if a in DROPPED:
            next(rest, None)
        elif a in INCLUDES:
            folder = next(rest, None)
            out.append(a if folder is None else a + below(folder))
        elif a.startswith("-o"):
            continue
        elif a.startswith("-I"):
            out.append("-I" + below(a[2:]))
        elif a.startswith(KEPT):
            out.append(a)
    return out


def first_database(spark: SparkSession, root: str, explicit: str | None = None) -> str | None:
    """The first of the explicit path and the usual places below the root, then below the working folder, that exists."""
    for path in [explicit, *[f"{root.rstrip('/')}/{p}" for p in PLACES], *PLACES]:
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                return path
    return None


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """(file, base, flags) of each entry of a database: the absolute path, the file's name, and its kept flags."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.value:
                try:
                    entries = json.loads(text)
                except ValueError:
                    continue
                for e in entries if isinstance(entries, list) else []:
                    if not isinstance(e, dict) or not e.get("file"):
                        continue
                    folder = e.get("directory") or ""
                    words = e["arguments"] if "arguments" in e else shlex.split(e.get("command") or "")
                    full = posixpath.normpath(posixpath.join(folder, e["file"]))
                    rows.append((full, posixpath.basename(e["file"]), kept_flags(words, folder), len(rows)))
            yield pd.DataFrame(rows, columns=["file", "base", "flags", "nth"])

    texts = spark.read.option("wholetext", "true").text(path)
    return texts.mapInPandas(parse, "file string, base string, flags array<string>, nth long")


def flags_of(files: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """files(path) plus ``flags``: by absolute path, else by name (the last entry of each counts), else the defaults."""
    last = lambda key: known.groupBy(F.col(key).alias("_k")).agg(F.max_by("flags", "nth").alias("_f"))
    by_path, by_name = last("file").toDF("_path", "_by_path"), last("base").toDF("_base", "_by_name")
    out = files.join(by_path, F.col("path") == F.col("_path"), "left")
    out = out.join(by_name, F.element_at(F.split("path", "/"), -1) == F.col("_base"), "left")
    return out.select(*files.columns, F.coalesce("_by_path", "_by_name", defaults(F.col("path"), root)).alias("flags"))


def defaults(path: Column, root: str) -> Column:
    std = F.when(path.rlike(r"\.(c|h)$"), DEFAULT_C).otherwise(DEFAULT_CPP)
    return F.array(std, *[F.lit(x) for x in (*DEFAULTS, f"-I{root}", f"-I{root}/include", f"-I{root}/src")])
