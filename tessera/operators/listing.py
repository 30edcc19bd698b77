"""Listing and describing an index: files, functions, variables, types, descriptions, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.naming import doc_names
from tessera.functions.text import KINDS, first_filled, kind_prefix, location
from tessera.operators.places import numbered
from tessera.operators.search import find_tiered
from tessera.plans.scratch import Scratch

#: Kinds listed beside those of the prefix.
FUNCTION_PARTS = ("func", "method", "constructor", "destructor")
VARIABLES = ("variable", "var", "const", "constant", "enum_constant", "field", "member", "macro")
TYPES = ("struct", "class", "enum", "interface", "typedef", "union", "type", "data class", "object", "companion object", "annotation")
#: File-name infixes and kinds of the three parts of a document set.
PARTS = {"type": ("struct", "class", "enum"), "var": ("variable", "field"), "fn": ("function", "method")}
#: Kinds that a second pass describes from what is around them.
REFINED_KINDS = ("field", "member", "variable", "var", "const", "constant", "enum_constant")
#: Kinds whose description needs no describer, beside all that contain "enum".
STATIC_KINDS = ("enum_constant", "typedef", "field", "member", "variable", "const")


def all_symbols(symbols: DataFrame) -> DataFrame:
    """Every row by path, line and id."""
    return symbols.orderBy(F.asc_nulls_first("rel_path"), F.asc_nulls_first("line_start"), "unique_id")


def symbol_places(scratch: Scratch, symbols: DataFrame) -> DataFrame:
    """symbols plus ``place``, from 0, in the order of all_symbols."""
    return numbered(scratch, symbols, [F.asc_nulls_first("rel_path"), F.asc_nulls_first("line_start"), "unique_id"])


def indexed_files(listed: DataFrame, index: DataFrame, docs: DataFrame) -> DataFrame:
    """(file): distinct and in order, of the first source that has any: the list's lines, the index, or the names of file
    documents (those of symbols, ``*.fn.md`` and the like, do not count)."""
    symbols = r"\.(fn|var|type|const|sym)\.md$"
    from_docs = docs.where(F.col("file").endswith(".md") & ~F.col("file").rlike(symbols)).select(F.regexp_replace("file", r"\.md$", "").alias("file"))
    sources = [listed.select(F.btrim("file").alias("file")).where("file <> ''"), index.select("file"), from_docs]
    ranked = reduce(DataFrame.unionByName, [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    first = ranked.agg(F.min("_source").alias("_first"))  # one row
    return ranked.join(F.broadcast(first), F.col("_source") == F.col("_first")).select("file").distinct().orderBy("file")


def is_function(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return reduce(Column.__or__, [F.contains(k, F.lit(p)) for p in FUNCTION_PARTS], kind_prefix(kind) == "fn")


def is_variable(kind: Column) -> Column:
    return kind_prefix(kind).isin("var", "const") | F.lower(F.coalesce(kind, F.lit(""))).isin(*VARIABLES)


def is_type(kind: Column) -> Column:
    return (kind_prefix(kind) == "type") | F.lower(F.coalesce(kind, F.lit(""))).isin(*TYPES)


def _list(symbols: DataFrame, wanted: Column) -> DataFrame:
    """(unique_id, location) of the wanted symbols, by path, line and id."""
    name = first_filled(F.col("fqdn"), F.col("name"))
    shown = location(name, F.col("rel_path"), F.col("line_start"), F.col("line_end"))
    return all_symbols(symbols.where(wanted)).select("unique_id", shown.alias("location"))


def list_functions(symbols: DataFrame) -> DataFrame:
    return _list(symbols, is_function(F.col("kind")))


def list_variables(symbols: DataFrame) -> DataFrame:
    return _list(symbols, is_variable(F.col("kind")))


def list_types(symbols: DataFrame) -> DataFrame:
    return _list(symbols, is_type(F.col("kind")))


def doc_parts(docs: DataFrame, name: str = "file_name", kind: str = "kind") -> DataFrame:
    """docs(file_name, kind, ...) once for each ``part`` it belongs to: by file-name infix or kind; parts may overlap."""
    parts = [F.when(F.contains(F.col(name), F.lit(f".{p}.")) | F.coalesce(F.col(kind).isin(*kinds), F.lit(False)), F.lit(p)) for p, kinds in PARTS.items()]
    return docs.withColumn("part", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())))


def needs_no_describer(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.contains(k, F.lit("enum")) | k.isin(*STATIC_KINDS)


def describe(symbols: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """What ``find_tiered`` gives, with source, purpose (else the top-down context) and overview."""
    found = find_tiered(symbols, text).join(cache, "unique_id", "left")
    lines = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.format_string(" (Lines: %d-%d)", "line_start", "line_end"))
    lines = lines.when(F.col("line_start").isNotNull(), F.format_string(" (Line: %d)", "line_start")).otherwise("")
    source = F.concat(first_filled(F.col("rel_path"), F.lit("Unknown")), lines)
    out = found.select(
        "unique_id", first_filled(F.col("fqdn"), F.col("name")).alias("symbol"), source.alias("source"), "kind",
        F.coalesce("signature", F.lit("")).alias("signature"), first_filled(F.col("purpose"), F.col("top_down_context")).alias("purpose"),
        F.coalesce("overview", F.lit("")).alias("overview"), "rel_path", "line_start",
    )
    return all_symbols(out).drop("rel_path", "line_start")


def find_docs(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """(unique_id, file) of each symbol's document(file): by exact name, with the FQDN, with its tail; else by a name of
    its kind that ends in the symbol's, or any that ends in it; the first in order of these, then by file name.

    The exact names are an equi-join; a file name's tails behind each dot are exploded, so the others are one too.
    """
    kind = kind_prefix(F.col("kind"))
    tail = F.regexp_extract("fqdn", r"^[^.]*\.(.+)$", 1)
    named = lambda n: F.concat(F.col("rel_path"), F.lit("."), kind, F.lit("."), n, F.lit(".md"))
    exact = [named(F.col("name")), named(F.col("fqdn")), F.when(tail != "", named(tail))]
    wanted = symbols.select("unique_id", kind.alias("_kind"), "name", F.posexplode(F.array(*exact)).alias("rank", "file"))
    by_name = wanted.join(docs.select("file").distinct(), "file").select("unique_id", "file", "rank")
    parts = F.split(F.regexp_replace("file", r"\.md$", ""), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tails = docs.where(F.col("file").endswith(".md")).select("file", F.explode(ends).alias("name"))
    kinds = F.array(*[F.lit(f".{k}.") for k in (*KINDS, "sym")])
    tails = tails.withColumn("_in", F.filter(kinds, lambda k: F.contains(F.col("file"), k)))
    loose = symbols.select("unique_id", kind.alias("_kind"), "name").join(tails, "name")
    rank = F.when(F.array_contains("_in", F.concat(F.lit("."), F.col("_kind"), F.lit("."))), 3).otherwise(4)
    every = by_name.unionByName(loose.select("unique_id", "file", rank.alias("rank")))
    best = every.groupBy("unique_id").agg(F.min(F.struct("rank", "file")).alias("b"))
    return best.select("unique_id", F.col("b.file").alias("file"), F.col("b.rank").cast("long").alias("rank"))


def candidate_docs(symbols: DataFrame) -> DataFrame:
    """symbols plus ``candidates``: up to five document names, in order and distinct."""
    return symbols.withColumn("candidates", doc_names(F.col("rel_path"), F.col("kind"), F.col("name"), F.col("unique_id"), F.col("fqdn")))


def levels_in_order(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """nodes(id, kind) with ``level``, in order: what is no function is level 0, and functions, by ranks(id, rank), begin
    above it if there is any. Ranks without members leave no gap."""
    fn = kind_prefix(F.col("kind")) == "fn"
    base = nodes.where(~fn).select("id", F.lit(0).cast("long").alias("raw"))
    ranked = nodes.where(fn).select("id").join(ranks.select("id", "rank"), "id", "left")
    raw = base.unionByName(ranked.select("id", (F.coalesce("rank", F.lit(0)) + 1).cast("long").alias("raw")))
    steps = raw.select("raw").distinct().withColumn("level", F.dense_rank().over(Window.orderBy("raw")).cast("long") - 1)  # one row a level
    return raw.join(F.broadcast(steps), "raw").select("id", "level").orderBy("level", "id")


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """nodes(path, parent, ordinal, id, kind, name) of one tree a path, in pre-order with unique ids and names.

    ``parent`` is the id of the enclosing symbol or null, ``ordinal`` the place among siblings. The result has ``raw_name``
    (enclosing names and own, by dots), ``base`` (path::prefix.raw_name), ``unique_id`` (a repeated base gets #n in
    pre-order) and ``fqdn``. One round a depth; rows whose parents make a ring belong to no tree and do not show.
    """
    place = F.lpad(F.col("ordinal").cast("string"), 9, "0")
    level = nodes.where("parent IS NULL").withColumns({"raw_name": F.col("name"), "at": place})
    out = level
    while True:
        up = level.select(F.col("path").alias("_path"), F.col("id").alias("_id"), F.col("raw_name").alias("_raw"), F.col("at").alias("_at"))
        level = nodes.join(up, (F.col("path") == F.col("_path")) & (F.col("parent") == F.col("_id")))
        level = level.withColumns({"raw_name": F.concat_ws(".", "_raw", "name"), "at": F.concat_ws("/", F.col("_at"), place)}).drop("_path", "_id", "_raw", "_at")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    base = F.concat(F.col("path"), F.lit("::"), kind_prefix(F.col("kind")), F.lit("."), F.col("raw_name"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("at"))
    out = out.withColumn("base", base).withColumn("_nth", nth)
    unique = F.when(F.col("_nth") == 1, F.col("base")).otherwise(F.concat_ws("#", "base", F.col("_nth").cast("string")))
    module = F.replace(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    return out.withColumns({"unique_id": unique, "fqdn": F.concat_ws(".", module, "raw_name")}).drop("_nth").orderBy("path", "at")
