"""Documents of an index: modules, the functions that matter, summaries level by level, look-up of sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.incremental import group_key
from tessera.operators.chunks import capped_chunks
from tessera.operators.places import numbered
from tessera.plans.scratch import Scratch

#: Files that do not name a module, folders that do not, and files of the main module.
COMMON_FILES = ("client.py", "service.py", "math.c", "math.h", "types.h", "run.sh")
PLAIN_FOLDERS, MAIN_FILES = ("src", "include", "scripts"), ("main", "app")
#: Words in names of functions that matter, and the points for each sign.
KEY_WORDS = ("main", "cli", "run", "start", "handler", "app", "serve", "pipeline", "engine", "orchestrat")
KEY_POINTS, ROLE_POINTS, CALLEE_POINTS, ROOT_POINTS, MOST_FUNCTIONS = 20, 15, 2, 5, 60
#: Summaries without a describer take so many items of a group and characters of an item; levels at most.
SHOWN_ITEMS, SHOWN_CHARS, DEEPEST = 5, 60, 5
#: Sections by their names, beside the modules.
SECTIONS = {
    "README.md": ("readme", "summary", "project"), "design/overview.md": ("overview", "arch", "architecture", "overview.md"),
    "design/data_models.md": ("data_models", "data", "models", "schema"), "design/execution_model.md": ("execution_model", "exec", "runtime", "flow"),
}
SOURCE_ENDS = (".py", ".kt", ".java", ".c", ".cpp", ".h")


def module_of(file_name: Column) -> Column:
    """The module of a document: the first folder, or for common files the last; below a plain folder the next name; of a
    bare file its name, main for main and app."""
    clean = F.regexp_replace(F.regexp_replace(file_name, r"\.(fn|var|type|const)\..*$", ""), r"\.md$", "")
    parts = F.split(clean, "/")
    n, last = F.size(parts), F.element_at(parts, -1)
    stem = lambda c: F.regexp_extract(c, r"^[^.]*", 0)
    first = F.when(last.isin(*COMMON_FILES), F.get(parts, n - 2)).otherwise(F.get(parts, F.lit(0)))
    below = F.when(n > 2, F.get(parts, F.lit(1))).otherwise(stem(last))
    bare = F.when(stem(last).isin(*MAIN_FILES), "main").otherwise(stem(last))
    return F.when(n > 1, F.when(first.isin(*PLAIN_FOLDERS), below).otherwise(first)).otherwise(bare)


def importance(name: Column, role: Column, callees: Column, callers: Column) -> Column:
    """Points of a function for the overview; callees and callers are counts."""
    key = F.greatest(F.lit(False), F.lit(False), *[F.contains(F.lower(name), F.lit(w)) for w in KEY_WORDS])
    return (
        F.when(key, KEY_POINTS).otherwise(0)
        + F.when(F.coalesce(role, F.lit("")) != "", ROLE_POINTS).otherwise(0)
        + CALLEE_POINTS * F.coalesce(callees, F.lit(0))
        + F.when(F.coalesce(callers, F.lit(0)) == 0, ROOT_POINTS).otherwise(0)
    )


def top_functions(functions: DataFrame, ordinal: str, most: int = MOST_FUNCTIONS) -> DataFrame:
    """functions(file_name, ui_role, n_callees, n_callers, ordinal) with ``place``: the ``most`` with the most points, ties
    in input order; all of them in input order if there are no more than that. Two top-k steps, no sort of all rows."""
    points = importance(F.col("file_name"), F.col("ui_role"), F.col("n_callees"), F.col("n_callers"))
    ranked = functions.withColumn("points", points.cast("long"))
    few = functions.limit(most + 1).agg((F.count("*") <= most).alias("_few"))  # one row
    ranked = ranked.crossJoin(F.broadcast(few)).withColumn("_order", F.when(F.col("_few"), 0).otherwise(-F.col("points")))
    best = ranked.orderBy("_order", ordinal).limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy("_order", ordinal)).cast("long")).drop("_order", "_few")


def reduce_summaries(
    scratch: Scratch, items: DataFrame, group: str, order: str, text: str, max_items: int = 15, max_chars: int = 3500, stable: bool = False, line_of: Callable[[DataFrame, int], DataFrame] | None = None
) -> DataFrame:
    """(group, level, order, text): the summaries that stand for each group of items.

    Level by level, a group of more than ``max_items`` items or ``max_chars`` characters is cut into chunks and each chunk
    becomes one line; it stops when it fits, when it no longer shrinks, or after DEEPEST levels. The line is made of the first
    characters of the chunk's first items, or by line_of(chunk rows (group, chunk, order, text), level), which gives (group, chunk,
    line). With ``stable`` the items are sorted by text first and cut where their hashes say. What is done stays as it is; one
    job a level, and only counts reach the driver. Null groups are a group.
    """
    live = items.select(group, F.col(order).cast("long").alias("order"), F.coalesce(text, F.lit("")).alias("text"))
    done = None
    for level in range(DEEPEST + 1):
        was = F.max("_was") if level else F.lit(None).cast("long")
        sizes = live.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_size"), F.sum(F.length("text")).alias("_chars"), was.alias("_was"))
        fits = (F.col("_size") <= max_items) & (F.col("_chars") <= max_chars)
        if level:
            fits = fits | (F.col("_size") == 1) | (F.col("_size") >= F.col("_was"))
        sizes = scratch.save(sizes.select("_g", "_size", fits.alias("_fits")), f"sizes-{level}")
        live = live.select(group, "order", "text")
        rows = live.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
        ended = rows.where("_fits").select(group, F.lit(level).cast("long").alias("level"), "order", "text")
        ended = scratch.save(ended, f"done-{level}")
        done = ended if done is None else done.union(ended)
        rest = rows.where("NOT _fits")
        if rest.isEmpty():
            return done
        rest = rest.select(group, "order", "text", F.col("_size").alias("_was"))
        if stable:
            rest = numbered(scratch, rest, ["text", "order"], by=[group], name="_at").drop("order").withColumnRenamed("_at", "order")
        rest = scratch.save(rest, f"rest-{level}")
        chunks = capped_chunks(scratch, rest, group, "order", "text", max_items, max_chars, stable).withColumnsRenamed({group: "_g", "order": "_o"})
        placed = rest.join(chunks, F.col(group).eqNullSafe(F.col("_g")) & (F.col("order") == F.col("_o"))).drop("_g", "_o")
        lines = (line_of or _shown)(scratch.save(placed, f"placed-{level}"), level).withColumnsRenamed({group: "_g", "chunk": "_c"})
        counted = rest.groupBy(F.col(group).alias("_g2")).agg(F.max("_was").alias("_was"))
        lines = lines.join(counted, F.col("_g").eqNullSafe(F.col("_g2")))
        live = scratch.save(lines.select(F.col("_g").alias(group), (F.col("_c") + 1).cast("long").alias("order"), F.col("line").alias("text"), "_was"), f"level-{level}")
    return done.union(live.select(group, F.lit(DEEPEST + 1).cast("long").alias("level"), "order", "text"))


def _shown(placed: DataFrame, level: int) -> DataFrame:
    """The first characters of a chunk's first items, with its number."""
    group = placed.columns[0]
    first = Window.partitionBy(group, "chunk").orderBy("order")
    shown = placed.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= SHOWN_ITEMS)
    shown = shown.groupBy(group, "chunk").agg(F.sort_array(F.collect_list(F.struct("order", F.substring("text", 1, SHOWN_CHARS).alias("t")))).alias("_t"))
    line = F.concat(F.lit("- [Group "), (F.col("chunk") + 1).cast("string"), F.lit("]: "), F.array_join(F.transform("_t", lambda t: t["t"]), " / "))
    return shown.select(group, "chunk", line.alias("line"))


def chunk_keys(chunks: DataFrame, group: str, chunk: str, order: str, text: str, language: str) -> DataFrame:
    """(group, chunk, key, text): each chunk's text, its items joined by lines, and its cache key; a chunk is bounded by its caps."""
    joined = chunks.groupBy(group, chunk).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_t"))
    whole = F.array_join(F.transform("_t", lambda t: t[text]), "\n")
    return joined.select(group, chunk, group_key(language, F.col(group), whole).alias("key"), whole.alias("text"))


def reduce_anew(
    scratch: Scratch, items: DataFrame, group: str, order: str, text: str, stored: DataFrame, summarise: Callable[[DataFrame], DataFrame], language: str = "English", max_items: int = 15, max_chars: int = 3500
) -> tuple[DataFrame, DataFrame]:
    """What reduce_summaries gives with summaries for lines, and the summaries (key, summary) that were not stored before.

    The tree of summaries is addressed by content: a chunk's key is a hash of its items, chunks are cut where the items' hashes say,
    and a line has no number in it. So an edit changes one or two chunks a level, and only these, the path to the root, go to
    summarise(chunks(key, category, text)), which gives (key, summary); all others come from stored(key, summary). A
    chunk that occurs several times is summarised once.
    """
    fresh: list[DataFrame] = []

    def line_of(placed: DataFrame, level: int) -> DataFrame:
        keyed = scratch.save(chunk_keys(placed, group, "chunk", "order", "text", language), f"keys-{level}")
        known = stored.select("key", "summary")
        for f in fresh:
            known = known.union(f)
        lacking = keyed.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
        fresh.append(scratch.save(summarise(lacking.select("key", F.col(group).alias("category"), "text")).select("key", "summary"), f"fresh-{level}"))
        line = F.concat(F.lit("#### Group Summary\n"), F.btrim("summary"))
        return keyed.join(known.union(fresh[-1]), "key").select(group, "chunk", line.alias("line"))

    out = reduce_summaries(scratch, items, group, order, text, max_items, max_chars, True, line_of)
    made = stored.select("key", "summary").limit(0)
    for f in fresh:
        made = made.union(f)
    return out, made


def first_snippets(docs: DataFrame, file: str, text: str, pattern: str, read: int = 15, shown: int = 8) -> DataFrame:
    """(file, snippet): of the first ``read`` documents by name, the first ``shown`` in which the pattern's group is found."""
    some = docs.orderBy(file).limit(read).select(file, F.btrim(F.regexp_extract(text, pattern, 1)).alias("snippet"))
    return some.where("snippet <> ''").orderBy(file).limit(shown)


def find_section(docs: DataFrame, section: str) -> DataFrame:
    """docs(file, text): the document a section name stands for: a standing section by any of its names, else a module,
    for a path by its stem, else a design document. At most one row."""
    low = section.lower().strip()
    path = "/" in low or "\\" in low or low.endswith(SOURCE_ENDS)
    name = low.replace("\\", "/").rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if path and "." in name.lstrip(".") else name if path else low
    files = [f for f, names in SECTIONS.items() if low in names]
    files = files or [f"design/modules/{n}.md" for n in (section, low, stem)] + [f"design/{n}.md" for n in (section, low)]
    rank = F.array_position(F.array(*map(F.lit, files)), F.col("file"))
    return docs.where(F.col("file").isin(*files)).withColumn("_rank", rank).orderBy("_rank").limit(1).drop("_rank")


def modules(docs: DataFrame) -> DataFrame:
    """(module) of the module documents, in order."""
    return docs.where(F.col("file").rlike(r"^design/modules/[^/]+\.md$")).select(F.regexp_extract("file", r"([^/]+)\.md$", 1).alias("module")).orderBy("module")


def overview(docs: DataFrame) -> DataFrame:
    """(text): README and overview, trimmed, joined by a rule; no row without either."""
    two = docs.where(F.col("file").isin("README.md", "design/overview.md")).select(F.when(F.col("file") == "README.md", 0).otherwise(1).alias("o"), F.btrim("text").alias("t"))
    joined = two.agg(F.sort_array(F.collect_list(F.struct("o", "t"))).alias("_t")).where(F.size("_t") > 0)
    return joined.select(F.array_join(F.transform("_t", lambda t: t["t"]), "\n\n---\n\n").alias("text"))


def project_type(name: Column, overview_text: Column, snippets: Column, has_modules: Column) -> Column:
    """cli, gui, library or default, from the project's name, overview and interface notes."""
    has = lambda c, *words: F.greatest(F.lit(False), F.lit(False), *[F.contains(F.coalesce(c, F.lit("")), F.lit(w)) for w in words])
    cli = has(F.lower(name), "cli") | has(overview_text, "CLI", "main(") | has(snippets, "`CLI`")
    gui = has(snippets, "Activity", "QMainWindow", "Tkinter", "PyQt", "PySide", "GtkWindow", "wxWidgets", "Jetpack Compose", "GUI")
    return F.when(cli, "cli").when(gui, "gui").when(has_modules, "library").otherwise("default")
