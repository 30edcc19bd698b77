"""The engine over one source tree: bring its index up to date, and ask it."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import describers
from tessera.config import Options
from tessera.functions import interfaces, markdown
from tessera.functions import text as T
from tessera.operators import documents, graph, incremental, links, listing, search
from tessera.plans.scratch import Scratch
from tessera.sinks import Warehouse
from tessera.sources.adapters import Registry, default_registry
from tessera.sources.files import scan_tree


class Engine:
    """Tables of the index: files, symbols (with their texts), edges, documents, modules."""

    def __init__(self, spark: SparkSession, tree: str, warehouse: str, registry: Registry | None = None, make: Callable[[], describers.Describer] | None = None):
        self.spark, self.tree, self.make = spark, tree, make
        self.store, self.registry = Warehouse(spark, warehouse), registry or default_registry()

    # -- bringing up to date ------------------------------------------------------------------------------------------

    def sync(self, options: Options = Options()) -> dict[str, int]:
        """Scans, parses, links, tells what changed, describes that anew and what calls it, and writes documents.

        Symbols that did not change keep their texts. All tables are one commit. Returns counts: files, symbols, made anew.
        """
        scratch = Scratch(self.spark)
        files = scratch.save(scan_tree(self.spark, self.tree), "files")
        found = scratch.save(self._hashed(files, self.registry.parse(files)), "symbols")
        edges = scratch.save(self._edges(found), "edges")
        old = self.store.read("symbols") if self.store.exists("symbols") else None
        dirty = scratch.save(self._dirty(found, old, options.force), "dirty")
        made = scratch.save(self._described(found, dirty, edges, old, scratch), "described")
        made = scratch.save(self._refined(made, dirty, edges, old, options.force), "refined")
        counts = {"files": files.count(), "symbols": made.count(), "made": made.where("made").count()}
        steps, tables = options.steps(), {}
        if 1 in steps:
            tables["files"] = (files.select("rel_path", "file_hash"), "rel_path")
            tables["symbols"] = (made.drop("made", "promises"), "unique_id")
            tables["edges"] = (edges.select(F.concat_ws(" ", "src", "dst").alias("edge"), "src", "dst"), "edge")
            tables["documents"] = (self._documents(files, made, edges), "file")
        if 3 in steps:
            modules, summaries = self._modules(made, scratch)
            tables["modules"] = (modules, "module")
            if summaries is not None:
                tables["summaries"] = (summaries, "key")
        now = F.lit(datetime.now(timezone.utc))
        old = {t: self.store.read(t) if self.store.exists(t) else None for t in tables}
        self.store.commit({t: (incremental.stamped(old[t], rows, key, now), key) for t, (rows, key) in tables.items()})
        return counts

    def watch(self, checkpoint: str, options: Options = Options(), quiet: float = 2.0):
        """(watch, query): syncs now and whenever the tree has changed and been quiet, until the query is stopped."""
        from tessera.streaming.tree import TreeWatch

        seen = TreeWatch(self.spark, self.tree, lambda: self.sync(options), quiet, options.interval_s)
        return seen, seen.start(checkpoint)

    def _hashed(self, files: DataFrame, found: DataFrame) -> DataFrame:
        from tessera.functions.snippets import snippet

        rows = found.join(files.select("rel_path", "language", "content"), "rel_path")
        rows = rows.withColumn("code", snippet(F.col("content"), F.col("line_start"), F.col("line_end"))).drop("content")
        bare = F.when(F.col("language") == "shell", T.strip_hash_comments(F.col("code"))).otherwise(T.strip_c_comments(F.col("code")))
        bare = F.when(F.col("language") == "python", T.strip_python_comments(T.dedent(F.col("code")))).otherwise(bare)
        return rows.withColumns({
            "full_hash": T.symbol_hash(F.col("signature"), F.col("doc"), F.col("code")),
            "logic_hash": T.logic_hash(F.col("signature"), bare),
            "complexity": T.complexity(F.col("code"), F.size("callees"), F.size("params")),
        })

    def _edges(self, found: DataFrame) -> DataFrame:
        fn = found.where(T.kind_prefix(F.col("kind")) == "fn")
        targets = fn.select(F.col("unique_id").alias("id"), "fqdn", "name", F.element_at(F.split("unique_id", r"\."), -1).alias("tail"))
        return search.resolve_two_tier(fn.select(F.col("unique_id").alias("src"), F.explode("callees").alias("callee")), targets)

    def _dirty(self, found: DataFrame, old: DataFrame | None, force: bool) -> DataFrame:
        """(id) of the symbols whose texts are made anew for what they are themselves."""
        if old is None or force:
            return found.select(F.col("unique_id").alias("id"))
        names = ("full_hash", "logic_hash", "kind", "signature", "callees", "purpose")
        o = old.select(F.col("unique_id").alias("_id"), *[F.col(n).alias(f"old_{n}") for n in names])
        both = found.join(o, F.col("unique_id") == F.col("_id"), "left")
        pair = lambda n: (F.col(f"old_{n}"), F.col(n))
        _, logic = incremental.hash_changes(F.col("old_full_hash"), F.col("old_logic_hash"), F.col("full_hash"), F.col("logic_hash"))
        has = F.col("_id").isNotNull()
        trivial = incremental.trivial_change(F.col("old_purpose"), has, pair("kind"), pair("signature"), pair("callees"))
        flags = incremental.flags(F.lit(False), has & (F.coalesce("old_purpose", F.lit("")) != ""), logic, trivial, incremental.signature_changed(*pair("signature")), F.lit(True))
        return both.where(flags["dirty"]).select(F.col("unique_id").alias("id"))

    def _described(self, found: DataFrame, dirty: DataFrame, edges: DataFrame, old: DataFrame | None, scratch: Scratch) -> DataFrame:
        """found with texts, ``made`` and ``promises`` (the contract is another one): new texts for the dirty and, with a describer,
        for the callers of whatever changed its contract, callees first; the others keep theirs.

        Texts from names depend on nothing else, so without a describer one round makes all.
        """
        static = listing.needs_no_describer(F.col("kind"))
        parts = ("kind", "signature", "callees", *describers.FIELDS)
        nodes = found.select("unique_id", F.col("unique_id").alias("id"), "name", "fqdn", "rel_path")
        before = found.limit(0).select("unique_id", *parts[:3], *[F.lit("").alias(f) for f in describers.FIELDS]) if old is None else old.select("unique_id", *parts)
        before = before.toDF("_id", *[f"old_{c}" for c in parts])

        def make(now: DataFrame, made: DataFrame | None) -> DataFrame:
            wanted = found.join(now.select(F.col("id").alias("unique_id")), "unique_id", "left_semi")
            if self.make is not None:
                own = edges.join(now.select(F.col("id").alias("src")), "src", "left_semi")
                context = links.callee_summaries(own, self._with_texts(nodes, before, made)).select(F.col("id").alias("unique_id"), F.col("summary").alias("callee_context"))
                wanted = wanted.join(context, "unique_id", "left")
            new = describers.describe(wanted, static, self.make).join(found.select("unique_id", *parts[:3]), "unique_id")
            new = new.join(before, F.col("unique_id") == F.col("_id"), "left")
            pair = lambda c: (F.col(f"old_{c}"), F.col(c))
            has, cached = F.col("_id").isNotNull(), F.coalesce("old_purpose", F.lit("")) != ""
            promises = incremental.contract_changed(has & cached, has, *[pair(c) for c in ("kind", "signature", "callees", "inputs", "outputs", "purpose")])
            return new.select(F.col("unique_id").alias("id"), promises.alias("changed"), *describers.FIELDS)

        if self.make is None:
            made = make(dirty, None)
        else:
            above = graph.propagate(scratch, dirty, edges).select("id")  # nothing else can be made anew
            inside = edges.join(above.toDF("src"), "src", "left_semi").join(above.toDF("dst"), "dst", "left_semi")
            made = incremental.make_anew(scratch, dirty, graph.levels(scratch, above, inside), edges, make)
        new = made.select(F.col("id").alias("unique_id"), *describers.FIELDS, F.lit(True).alias("made"), F.col("changed").alias("promises"))
        kept = before.select(F.col("_id").alias("unique_id"), *[F.col(f"old_{f}").alias(f) for f in describers.FIELDS]).join(new.select("unique_id"), "unique_id", "left_anti")
        new = new.unionByName(kept.withColumns({"made": F.lit(False), "promises": F.lit(False)}))
        return found.join(new, "unique_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("made", "promises")})

    def _with_texts(self, nodes: DataFrame, before: DataFrame, made: DataFrame | None) -> DataFrame:
        """nodes with the texts made so far, else those of before."""
        old = before.select(F.col("_id").alias("unique_id"), *[F.col(f"old_{f}").alias(f) for f in describers.FIELDS])
        if made is None:
            return nodes.join(old, "unique_id", "left")
        new = made.select(F.col("id").alias("unique_id"), *describers.FIELDS)
        return nodes.join(new.unionByName(old.join(new.select("unique_id"), "unique_id", "left_anti")), "unique_id", "left")

    def _refined(self, made: DataFrame, dirty: DataFrame, edges: DataFrame, old: DataFrame | None, force: bool) -> DataFrame:
        """made with ``context``: the second pass of a describer over variables, from what holds them and who uses them. It sees
        those without a context and those downstream of a changed contract; others keep theirs."""
        kept = F.lit(None).cast("string")
        known = made.limit(0).select(F.col("unique_id").alias("_id"), kept.alias("context"))
        if old is not None and "context" in old.columns:
            known = old.select(F.col("unique_id").alias("_id"), "context")
        rows = made.join(known, F.col("unique_id") == F.col("_id"), "left").drop("_id")
        if self.make is None:
            return rows
        is_fn = T.kind_prefix(F.col("kind")) == "fn"
        v = rows.where(F.lower("kind").isin(*listing.REFINED_KINDS)).select(F.col("unique_id").alias("id"), "rel_path", "fqdn", "name", "context")
        types = rows.where((T.kind_prefix(F.col("kind")) == "type") & ~F.lower("kind").isin(*listing.REFINED_KINDS)).select(F.col("unique_id").alias("id"), "rel_path", "name", "kind", "line_start", "purpose", "overview")
        functions = rows.where(is_fn).select(F.col("unique_id").alias("id"), "name", "rel_path", "callees", "signature", "purpose")
        holders = links.containers(v, types)
        used = links.related_functions(v, functions)
        shown = functions.select(F.col("id").alias("fn"), F.struct("name", F.coalesce("purpose", F.lit(links.UNKNOWN_PURPOSE)).alias("purpose")).alias("f"))
        users = used.join(shown, "fn").groupBy("id").agg(F.sort_array(F.collect_set("f")).alias("functions"))
        interface = rows.where("promises").select(F.col("unique_id").alias("id"))
        changed = interface.union(dirty.select("id")).distinct()
        by_type = holders.where("parent IS NOT NULL").select("id", F.col("parent").alias("name")).join(v.select("id", "rel_path"), "id")
        by_type = by_type.join(types.select("rel_path", "name", F.col("id").alias("type_id")), ["rel_path", "name"]).select("id", "type_id")
        callers = edges.select(F.col("dst").alias("id"), F.col("src").alias("caller"))
        there = F.lit(True) if old is not None else F.lit(False)
        down = incremental.is_downstream(v.withColumn("doc_there", there), changed, interface, by_type, callers, functions)
        state = v.select("id", "context").join(down, "id").join(holders.withColumnsRenamed({"kind": "holder_kind", "purpose": "holder_purpose"}).drop("overview"), "id", "left").join(users, "id", "left")
        related = F.col("parent").isNotNull() | F.col("functions").isNotNull()
        wanted = state.where(incremental.needs_refinement(F.lit(True), related, F.lit(force), F.lit(not changed.isEmpty()), F.col("downstream"), F.col("context")))
        asked = wanted.select(F.col("id").alias("unique_id"), "parent", "holder_kind", "holder_purpose", "functions").join(rows.select("unique_id", "name", "kind", "signature", "code"), "unique_id")
        new = describers.refine(asked, self.make).toDF("_id", "new")
        return rows.join(new, F.col("unique_id") == F.col("_id"), "left").withColumn("context", F.coalesce("new", "context")).drop("_id", "new")

    def _documents(self, files: DataFrame, made: DataFrame, edges: DataFrame) -> DataFrame:
        callers = links.callers_shown(edges, made.select(F.col("unique_id").alias("id"), "name", "rel_path", "purpose"))
        rows = made.join(callers.select(F.col("id").alias("unique_id"), "callers"), "unique_id", "left")
        cols = {c: F.col(c) for c in ("name", "kind", "fqdn", "signature", "line_start", "line_end", "purpose", "context", "overview", "inputs", "outputs", "return_type", "params", "callees", "callers")}
        section = markdown.symbol_section(cols | {"snippet": F.col("code")}, 2, self.registry.code_language(F.col("rel_path")))
        rows = rows.withColumn("section", section).withColumn("depth", F.size(F.split("scope", r"\.")) - 1)
        whole = markdown.file_documents(rows, files.select("rel_path", "file_hash")).select(F.concat("rel_path", F.lit(".md")).alias("file"), "text")
        own = listing.candidate_docs(rows).select(F.get("candidates", F.lit(0)).alias("file"), F.concat(F.regexp_replace("section", "^## ", "# "), F.lit("\n")).alias("text"))
        return whole.unionByName(own).dropDuplicates(["file"])

    def _modules(self, made: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
        """(module, text), and all summaries (key, summary) if a describer makes them."""
        docs = made.select(documents.module_of(F.col("rel_path")).alias("module"), "unique_id", F.concat_ws(": ", "name", "purpose").alias("line"))
        from pyspark.sql import Window

        items = docs.withColumn("nth", F.row_number().over(Window.partitionBy("module").orderBy("unique_id")))
        if self.make is not None and hasattr(self.make(), "summarise"):
            kind = "key string, summary string"
            stored = self.store.read("summaries") if self.store.exists("summaries") else self.spark.createDataFrame([], kind)
            lines, fresh = documents.reduce_anew(scratch, items, "module", "nth", "line", stored, lambda chunks: describers.summaries(chunks, self.make))
            summaries = scratch.save(incremental.upsert(stored, fresh, ["key"]), "summaries")
        else:
            summaries = None
            lines = documents.reduce_summaries(scratch, items, "module", "nth", "line")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n")
        return lines.groupBy("module").agg(text.alias("text")), summaries

    # -- asking -------------------------------------------------------------------------------------------------------

    def _symbols(self) -> DataFrame:
        return self.store.read("symbols")

    def list(self) -> DataFrame:
        none = self.store.read("files").limit(0).select(F.col("rel_path").alias("file"))
        return listing.indexed_files(none, self.store.read("files").select(F.col("rel_path").alias("file")), none)

    def functions(self) -> DataFrame:
        return listing.list_functions(self._symbols())

    def variables(self) -> DataFrame:
        return listing.list_variables(self._symbols())

    def types(self) -> DataFrame:
        return listing.list_types(self._symbols())

    def description(self, text: str) -> DataFrame:
        s = self._symbols()
        cache = s.select("unique_id", "purpose", "overview", F.col("context").alias("top_down_context"))
        return listing.describe(s.drop("purpose", "overview"), cache, text)

    def locate(self, text: str, limit: int = 10) -> DataFrame:
        s = self._symbols()
        return search.locate(s.drop("purpose", "overview"), s.select("unique_id", "purpose", "overview"), text, limit)

    def search(self, text: str, kind: str | None = None, limit: int = 30) -> DataFrame:
        s = self._symbols()
        return search.keyword_search(s.drop("purpose", "overview"), s.select("unique_id", "purpose", "overview"), text, kind, limit)

    def impact(self, text: str) -> DataFrame:
        return search.impact_of(self._symbols(), self.store.read("edges"), text)

    def design(self, section: str) -> DataFrame:
        """The document of a section; if there is none, the modules that there are."""
        m = self.store.read("modules").select(F.concat(F.lit("design/modules/"), "module", F.lit(".md")).alias("file"), "text")
        found = documents.find_section(m, section)
        return documents.modules(m) if found.isEmpty() else found

    def program_type(self) -> DataFrame:
        return interfaces.detect(self._symbols().select(F.col("code").alias("text"), F.col("rel_path").alias("file")))


#: Names and aliases of the commands.
COMMANDS = {
    "sync": ("sync", "update"), "list": ("list", "files", "ls"), "functions": ("functions", "fn", "func"), "variables": ("variables", "var", "vars"),
    "types": ("types", "type"), "description": ("description", "desc", "show"), "locate": ("locate", "find"), "impact": ("impact",), "search": ("search",), "design": ("design",),
}


def main(arguments: list[str] | None = None) -> int:
    """python -m tessera.engine COMMAND TREE WAREHOUSE [TEXT]"""
    from tessera.session import get_session

    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("command", choices=[a for names in COMMANDS.values() for a in names])
    parser.add_argument("tree")
    parser.add_argument("warehouse")
    parser.add_argument("text", nargs="?")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--watch", metavar="CHECKPOINT", help="go on syncing whenever the tree has changed")
    parser.add_argument("--fast", action="store_true")
    parser.add_argument("--step", type=int, choices=(1, 2, 3, 4))
    parser.add_argument("--from-step", type=int, choices=(1, 2, 3, 4), default=1)
    got = parser.parse_args(arguments)
    command = next(c for c, names in COMMANDS.items() if got.command in names)
    engine = Engine(get_session(), got.tree, got.warehouse)
    if command == "sync" and got.watch:
        engine.watch(got.watch, Options(force=got.force, fast=got.fast, only_step=got.step, from_step=got.from_step))[1].awaitTermination()
        return 0
    if command == "sync":
        print(engine.sync(Options(force=got.force, fast=got.fast, only_step=got.step, from_step=got.from_step)))
        return 0
    answer = getattr(engine, command)
    out = answer() if command in ("list", "functions", "variables", "types") else answer(got.text or "")
    rows = out.limit(10_000).collect()
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r))
    return 0 if rows else 1


if __name__ == "__main__":
    raise SystemExit(main())
