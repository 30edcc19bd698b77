"""Change detection between two snapshots of an index, what must be made anew, and the snapshots' upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SAME, SAME_CONTRACT, alike, normal_spec, says_the_same
from tessera.operators.graph import propagate, shuffled
from tessera.operators.substrings import contained
from tessera.plans.scratch import Scratch


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or modified rows; equal rows do not show."""
    o, n = old.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_o")), new.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after new rows take the place of old ones with the same keys; keys of new must not repeat."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_hashes(old: DataFrame, new: DataFrame, key: str = "rel_path", value: str = "file_hash") -> DataFrame:
    """new plus ``changed``: whether its hash is not the stored one, or none is stored."""
    o = old.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return new.join(o, F.col(key) == F.col("_key"), "left").withColumn("changed", ~F.col(value).eqNullSafe(F.col("_value"))).drop("_key", "_value")


def stamped(old: DataFrame | None, new: DataFrame, key: str, now: Column) -> DataFrame:
    """new plus ``updated_at``: as stored where a row is what it was, else ``now``. Columns are compared by a hash; keys of old
    must not repeat. Without old, or where it has no such column, all rows are new."""
    if old is None or "updated_at" not in old.columns or sorted(old.columns) != sorted([*new.columns, "updated_at"]):
        return new.withColumn("updated_at", now)
    digest = F.sha2(F.to_json(F.struct(*sorted(new.columns))), 256)
    o = old.select(F.col(key).alias("_key"), digest.alias("_sha"), F.col("updated_at").alias("_at"))
    rows = new.withColumn("_now", digest).join(o, F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.select(*new.columns, F.when(F.col("_now") == F.col("_sha"), F.col("_at")).otherwise(now).alias("updated_at"))


def hash_changes(old_full: Column, old_logic: Column, full: Column, logic: Column) -> tuple[Column, Column]:
    """(full changed, logic changed): a new symbol changed both; without a new logic hash its change is the full one's,
    without an old one it changed."""
    full_changed = ~old_full.eqNullSafe(full)
    logic_changed = F.when(old_full.isNull(), True).when(logic.isNull(), full_changed).otherwise(~old_logic.eqNullSafe(logic))
    return full_changed, logic_changed


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values, whatever their order and repeats; null is empty."""
    return _set(a) == _set(b)


def signature_changed(old: Column, new: Column) -> Column:
    """Whether both are there and differ but for spaces around them."""
    a, b = F.btrim(F.coalesce(old, F.lit(""))), F.btrim(F.coalesce(new, F.lit("")))
    return (a != "") & (b != "") & (a != b)


def trivial_change(purpose: Column, has_meta: Column, kinds: tuple[Column, Column], signatures: tuple[Column, Column], callees: tuple[Column, Column]) -> Column:
    """A change inside a symbol: a cached purpose, and, where old metadata exist, the same kind, signature and callees."""
    same = kinds[0].eqNullSafe(kinds[1]) & ~signature_changed(*signatures) & same_set(*callees)
    return (F.coalesce(purpose, F.lit("")) != "") & (~has_meta | same)


def contract_changed(
    has_cache: Column,
    has_meta: Column,
    kinds: tuple[Column, Column],
    signatures: tuple[Column, Column],
    callees: tuple[Column, Column],
    inputs: tuple[Column, Column],
    outputs: tuple[Column, Column],
    purposes: tuple[Column, Column],
) -> Column:
    """Whether what a symbol promises changed: (old, new) of each. Without a cache it did; with old metadata by kind,
    signature or callees; by notes that appear, vanish or are less than half alike once normalised texts differ; by a
    purpose that differs and is less than half alike or on one side only."""
    meta = has_meta & (~kinds[0].eqNullSafe(kinds[1]) | signature_changed(*signatures) | ~same_set(*callees))
    old_in, new_in, old_out, new_out, old_p, new_p = (normal_spec(c) for c in (*inputs, *outputs, *purposes))
    far = lambda pair: alike(*pair) < SAME_CONTRACT
    lone = ((old_in == "") != (new_in == "")) | ((old_out == "") != (new_out == ""))
    apart = ((old_in != "") & (new_in != "") & far(inputs)) | ((old_out != "") & (new_out != "") & far(outputs))
    notes = ((old_in != new_in) | (old_out != new_out)) & (lone | apart)
    purpose = (old_p != new_p) & ~((old_p != "") & (new_p != "") & ~far(purposes))
    return F.coalesce(~has_cache | meta | notes | purpose, F.lit(True))


def flags(force: Column, has_cache: Column, logic: Column, trivial: Column, signature: Column, doc_there: Column) -> dict[str, Column]:
    """``dirty`` (made anew), ``trivial`` (logic changed, nothing outside did) and ``code_changed`` (document written anew)."""
    dirty = force | ~has_cache | (logic & ~trivial) | signature
    return {"dirty": dirty, "trivial": ~dirty & logic & trivial, "code_changed": force | ~doc_there | logic | signature}


def files_with_changes(symbols: DataFrame, *changed: DataFrame) -> DataFrame:
    """(rel_path, dirty): whether any symbol of a file is in one of the change sets changed(id)."""
    every = changed[0].select("id")
    for c in changed[1:]:
        every = every.union(c.select("id"))
    every = every.distinct().withColumn("_hit", F.lit(True))
    return symbols.join(every, "id", "left").groupBy("rel_path").agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("dirty"))


def make_anew(scratch: Scratch, dirty: DataFrame, levels: DataFrame, edges: DataFrame, make: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """Rows of ``make`` for dirty(id) and for the direct callers, again and again, of whatever changes its contract.

    The pending symbol with the lowest level(id, level) comes first, so that a caller is made once, after all its callees.
    make(now(id), made so far) gives (id, changed, ...), changed being whether the contract is another one; only those pass
    on to edges(src calls dst). There are as many rounds as levels with anything to make: a change that stops at
    an unchanged contract costs its own round alone. What is no node of levels is on level 0.
    """
    level = scratch.save(levels.select(F.col("id").alias("_id"), "level"), "level")
    edges = scratch.save(edges.select("src", "dst").distinct(), "edges")
    at = lambda ids: ids.join(shuffled(level), F.col("id") == F.col("_id"), "left").select("id", F.coalesce("level", F.lit(0)).cast("long").alias("level"))
    pending, made = scratch.save(at(dirty.select("id").distinct()), "pending"), None
    while (low := pending.agg(F.min("level")).first()[0]) is not None:
        new = scratch.save(make(pending.where(F.col("level") == low).select("id"), made), "round")
        made = new if made is None else scratch.save(made.unionByName(new), "made")
        callers = edges.join(shuffled(new.where("changed").select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        rest = pending.where(F.col("level") != low).unionByName(at(callers)).distinct()
        pending = scratch.save(rest.join(shuffled(made.select("id")), "id", "left_anti"), "pending")
    return make(pending.select("id"), None) if made is None else made


def needs_refinement(describer: Column, related: Column, force: Column, any_change: Column, downstream: Column, context: Column) -> Column:
    """Whether the second pass sees a variable: with a describer and anything related, if forced, without a context so
    far, or downstream of a change."""
    bare = F.coalesce(context, F.lit("")) == ""
    return describer & related & (force | bare | (any_change & (downstream | bare)))


def is_downstream(variables: DataFrame, changed: DataFrame, interface: DataFrame, containers: DataFrame, callers: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, downstream) of variables(id, rel_path, name, doc_there, context): itself changed(id); its container's, its
    caller's or a mentioning function's contract changed (interface(id)); no document or no context yet.

    containers(id, type_id), callers(id, caller), functions(id, rel_path, callees, signature).
    """
    own = variables.select("id").join(changed.select("id"), "id", "left_semi")
    by_type = containers.join(interface.select(F.col("id").alias("type_id")), "type_id", "left_semi").select("id")
    by_caller = callers.join(interface.select(F.col("id").alias("caller")), "caller", "left_semi").select("id")
    f = functions.join(interface.select("id"), "id", "left_semi").select(F.col("id").alias("fn"), "rel_path", "callees", "signature")
    called = f.select("rel_path", F.explode("callees").alias("name"))
    signed = contained(Scratch(functions.sparkSession), f.select(F.col("fn").alias("id"), F.col("signature").alias("text")), variables.select("name"))
    shown = signed.join(f.select(F.col("fn").alias("id"), "rel_path"), "id").select("rel_path", "name")
    by_mention = variables.select("id", "rel_path", "name").join(called.union(shown).distinct(), ["rel_path", "name"], "left_semi").select("id")
    every = own.union(by_type).union(by_caller).union(by_mention).distinct().withColumn("_hit", F.lit(True))
    plain = ~F.col("doc_there") | (F.coalesce("context", F.lit("")) == "")
    return variables.join(every, "id", "left").select("id", (F.coalesce("_hit", F.lit(False)) | plain).alias("downstream"))


def cached_designs(wanted: DataFrame, stored: DataFrame, least: float = SAME) -> DataFrame:
    """wanted(target_key, input_hash, input_text) with ``content``: the stored one of the key if its input has the same hash
    or, both texts there, says the same; else null. Texts are compared only where the hashes differ."""
    s = stored.select(F.col("target_key").alias("_key"), F.col("input_hash").alias("_hash"), F.col("input_text").alias("_text"), F.col("content").alias("_content"))
    same = F.col("_text").isNotNull() & (F.col("_text") != "") & F.col("input_text").isNotNull() & says_the_same(F.col("_text"), F.col("input_text"), least)
    hit = F.when(F.col("_hash") == F.col("input_hash"), F.col("_content")).when(same, F.col("_content"))
    return wanted.join(s, F.col("target_key") == F.col("_key"), "left").withColumn("content", hit).drop("_key", "_hash", "_text", "_content")


def group_key(language: str, category: Column | str, text: Column) -> Column:
    """The cache key of a group: SHA-256 of language, category and text; a null category is empty."""
    category = F.lit(category) if isinstance(category, str) else F.coalesce(category.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.lit(f"{language}\n"), category, F.lit("\n"), text), 256)


def localised(symbols: DataFrame, cache: DataFrame, language: str) -> DataFrame:
    """symbols(unique_id, ...) with the cache row of ``id::language``, else of ``id``: one aggregated look-up, then a left join."""
    suffix = f"::{language}"
    own = F.col("unique_id").endswith(suffix)
    plain = F.when(own, F.expr(f"left(unique_id, char_length(unique_id) - {len(suffix)})")).otherwise(F.col("unique_id"))
    fields = [c for c in cache.columns if c != "unique_id"]
    keyed = cache.select(plain.alias("_id"), F.when(own, 0).otherwise(1).alias("_order"), *fields)
    best = keyed.groupBy("_id").agg(F.min_by(F.struct(*fields), "_order").alias("_c"))
    return symbols.join(best, F.col("unique_id") == F.col("_id"), "left").select(*symbols.columns, *[F.col(f"_c.{c}").alias(c) for c in fields])
