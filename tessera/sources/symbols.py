"""Symbols of source files: line patterns for shell scripts as expressions, syntax trees for Python in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import kind_prefix

SCHEMA = (
    "rel_path string, ordinal int, scope string, name string, kind string, line_start int, line_end int, fqdn string, "
    "signature string, doc string, return_type string, callees array<string>, params array<string>"
)
#: Fixed value: a shell function's head at the start of a trimmed line.
SHELL_FUNCTION = r"^(?:function\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(\)\s*\{?"


def shell_symbols(files: DataFrame) -> DataFrame:
    """Functions of files(rel_path, content) by line; comments and blank lines are skipped, an extent is one line."""
    lines = files.select("rel_path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "raw"))
    trimmed = F.regexp_replace("raw", r"^\s+|\s+$", "")
    lines = lines.select("rel_path", (F.col("at") + 1).alias("line"), trimmed.alias("text")).where("text rlike '^[^#]'")
    heads = lines.select("rel_path", "line", F.regexp_extract("text", SHELL_FUNCTION, 1).alias("name")).where("name <> ''")
    file_name = F.element_at(F.split("rel_path", "/"), -1)
    nothing = F.array().cast("array<string>")
    return heads.select(
        "rel_path", F.col("line").alias("ordinal"), F.lit("").alias("scope"), "name", F.lit("function").alias("kind"), F.col("line").alias("line_start"),
        F.col("line").alias("line_end"), F.concat(file_name, F.lit("::"), "name").alias("fqdn"), F.concat("name", F.lit("()")).alias("signature"),
        F.lit("Shell script function definition.").alias("doc"), F.lit("").alias("return_type"), nothing.alias("callees"), nothing.alias("params"),
    )


def python_rows(rel_path: str, content: str | None) -> list[dict]:
    """Functions and classes of one Python file in pre-order; none where it has no valid syntax.

    Functions inside functions are part of them; those in classes, conditions and other blocks are found.
    """
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[dict] = []
    module = (rel_path.rpartition(".")[0] or rel_path).replace("/", ".")
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, scope = todo.pop()
        inner = scope
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            row = {"rel_path": rel_path, "ordinal": len(rows), "scope": scope, "name": node.name, "fqdn": f"{module}.{scope}{node.name}"}
            row |= {"line_start": node.lineno, "line_end": node.end_lineno, "doc": ast.get_docstring(node) or ""}
            rows.append(row | (_class(node) if isinstance(node, ast.ClassDef) else _function(node)))
            if not isinstance(node, ast.ClassDef):
                continue
            inner = f"{scope}{node.name}."
            below = node.body
        else:
            below = list(ast.iter_child_nodes(node))
        todo += [(x, inner) for x in reversed(below)]
    return rows


def _class(node: ast.ClassDef) -> dict:
    return {"kind": "class", "signature": f"class {node.name}", "return_type": "", "callees": [], "params": []}


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    params = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args]
    returns = ast.unparse(node.returns) if node.returns else ""
    called = [x.func for x in ast.walk(node) if isinstance(x, ast.Call)]
    names = {f.id for f in called if isinstance(f, ast.Name)} | {f.attr for f in called if isinstance(f, ast.Attribute)}
    kind, word = ("async_function", "async def") if isinstance(node, ast.AsyncFunctionDef) else ("function", "def")
    head = f"{word} {node.name}({', '.join(params)})" + (f" -> {returns}" if returns else "")
    return {"kind": kind, "signature": head, "return_type": returns, "callees": sorted(names), "params": params}


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files(rel_path, content), parsed file by file on the executors."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in zip(batch.rel_path, batch.content, strict=True) for r in python_rows(path, content)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("rel_path", "content").mapInPandas(parse, SCHEMA)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of all files(rel_path, language, content) that have a parser here, with unique ids."""
    found = python_symbols(files.where("language = 'python'")).unionByName(shell_symbols(files.where("language = 'shell'")))
    return with_unique_ids(found)


def with_unique_ids(found: DataFrame) -> DataFrame:
    """``unique_id`` = path::prefix.scoped name; repeats within a file, in pre-order, get #2, #3 and so on."""
    base = F.concat("rel_path", F.lit("::"), kind_prefix(F.col("kind")), F.lit("."), "scope", "name")
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("ordinal"))
    again = F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")
    return found.withColumn("_base", base).withColumn("unique_id", F.concat("_base", again)).drop("_base")
