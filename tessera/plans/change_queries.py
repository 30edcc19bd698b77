"""Change, cache and cost-model queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import costs
from tessera.functions import text as T
from tessera.operators import incremental as I
from tessera.operators import listing
from tessera.plans.catalog import query
from tessera.session import table


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, doc_id % 5 = 0 OR doc_id % 3 = 0 AS full_changed, CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 7 = 0 THEN doc_id % 3 = 0 WHEN doc_id % 11 = 0 THEN true ELSE doc_id % 2 = 0 END AS logic_changed FROM documents""")
def symbol_changes(spark, d):
    i = F.col("doc_id")
    old_full, full = F.when(i % 5 != 0, "a"), F.when(i % 3 == 0, "b").otherwise("a")
    old_logic, logic = F.when((i % 5 != 0) & (i % 11 != 0), "x"), F.when(i % 7 != 0, F.when(i % 2 == 0, "y").otherwise("x"))
    changed = I.hash_changes(old_full, old_logic, full, logic)
    return table(spark, d, "documents").select("doc_id", changed[0].alias("full_changed"), changed[1].alias("logic_changed"))


@query("""WITH n AS (SELECT DISTINCT doc_id, sha256(coalesce(text, '')) AS h FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE h END AS h FROM n WHERE doc_id % 13 <> 0)
 SELECT CAST(n.doc_id AS BIGINT) AS doc_id, n.h IS DISTINCT FROM o.h AS changed FROM n LEFT JOIN o ON n.doc_id = o.doc_id""")
def file_upsert(spark, d):
    new = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash")).distinct()
    old = new.where("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("file_hash")).alias("file_hash"))
    return I.upsert_hashes(old, new, "doc_id").select("doc_id", "changed")


@query("""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def snapshot_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return I.upsert(c.where("c_custkey % 2 = 0").withColumn("state", F.lit("old")), c.where("c_custkey % 3 = 0").withColumn("state", F.lit("new")), ["c_custkey"])


#: A symbol's old and new state dealt over orders: force, cache, purpose, kind, signature, callees, hashes, document.
_STATES = """SELECT o_orderkey, o_orderkey % 29 = 0 AS force, o_orderkey % 3 <> 0 AS has_cache, CASE WHEN o_orderkey % 5 <> 0 THEN 'p' ELSE '' END AS purpose, o_orderkey % 2 = 0 AS logic, o_orderkey % 7 = 0 AS other_kind,
 CASE o_orderkey % 4 WHEN 0 THEN 'f()' WHEN 1 THEN ' f() ' WHEN 2 THEN 'g()' ELSE '' END AS sig, o_orderkey % 13 = 0 AS other_callees, o_orderkey % 6 <> 0 AS doc FROM orders"""


@query(f"""WITH s AS ({_STATES}), t AS (SELECT *, sig = 'g()' AS sig_changed, purpose <> '' AND NOT (other_kind OR sig = 'g()' OR other_callees) AS is_trivial FROM s),
 u AS (SELECT *, force OR NOT has_cache OR (logic AND NOT is_trivial) OR sig_changed AS d FROM t)
 SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, d AS dirty, NOT d AND logic AND is_trivial AS trivial, force OR NOT doc OR logic OR sig_changed AS code_changed FROM u""")
def dirty_flags(spark, d):
    k = F.col("o_orderkey")
    sig = F.element_at(F.array(*map(F.lit, ("f()", " f() ", "g()", ""))), (k % 4 + 1).cast("int"))
    kinds = (F.lit("function"), F.when(k % 7 == 0, "method").otherwise("function"))
    signatures = (F.lit("f()"), sig)
    callees = (F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.when(k % 13 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))))
    trivial = I.trivial_change(F.when(k % 5 != 0, "p").otherwise(""), F.lit(True), kinds, signatures, callees)
    flags = I.flags(k % 29 == 0, k % 3 != 0, k % 2 == 0, trivial, I.signature_changed(*signatures), k % 6 != 0)
    return table(spark, d, "orders").select(k, *[c.alias(n) for n, c in flags.items()])


#: (old, new, whether they are less than half alike): worked by hand.
_PAIRS = (("ab cd", "ab cd", False), ("ab", "abc", False), ("ab", "cd", True), ("reads the file", "writes a socket", True), ("Reads a file.", "reads a FILE", False), ("", "ab", True), ("", "", False))
_N = len(_PAIRS)


def _pair_sql(n: str, i: int) -> str:
    return f"list_extract([{', '.join(repr(p[i]) if i < 2 else str(p[i]).lower() for p in _PAIRS)}], CAST({n} % {_N} AS INT) + 1)"


@query(f"""WITH s AS (SELECT o_orderkey AS k, {_pair_sql('o_orderkey', 2)} AS far, {_pair_sql('o_orderkey // 7', 2)} AS far_in, o_orderkey % 5 = 0 AS no_cache, o_orderkey % 3 = 0 AS meta, o_orderkey % 17 = 0 AS kind, o_orderkey % 11 = 0 AS sig, o_orderkey % 13 = 0 AS callees FROM orders)
 SELECT CAST(k AS BIGINT) AS o_orderkey, no_cache OR (meta AND (kind OR sig OR callees)) OR far_in OR far AS changed FROM s""")
def contract_change(spark, d):
    k = F.col("o_orderkey")
    pick = lambda n, i: F.element_at(F.array(*[F.lit(p[i]) for p in _PAIRS]), (n % _N + 1).cast("int"))
    at = F.floor(k / 7)
    changed = I.contract_changed(
        k % 5 != 0, k % 3 == 0, (F.lit("fn"), F.when(k % 17 == 0, "type").otherwise("fn")), (F.lit("f()"), F.when(k % 11 == 0, "g()").when(k % 2 == 0, "").otherwise("f() ")),
        (F.array(F.lit("a")), F.when(k % 13 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))), (pick(at, 0), pick(at, 1)), (F.lit("int"), F.lit("Int.")), (pick(k, 0), pick(k, 1)),
    )
    return table(spark, d, "orders").select(k, changed.alias("changed"))


@query(f"""SELECT CAST(o_orderkey AS BIGINT) AS target_key, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'c' || o_orderkey WHEN o_orderkey % 4 = 1 AND o_orderkey % {_N} IN (0, 4) THEN 'c' || o_orderkey END AS content FROM orders""")
def semantic_cache_hit(spark, d):
    """Equal hash, else text that says the same (of the pairs only the first and the fifth), else nothing stored."""
    k = F.col("o_orderkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in _PAIRS]), (k % _N + 1).cast("int"))
    o = table(spark, d, "orders")
    stored = o.where(k % 4 != 3).select(k.alias("target_key"), F.lit("h").alias("input_hash"), F.when(k % 4 == 1, pick(0)).alias("input_text"), F.concat(F.lit("c"), k.cast("string")).alias("content"))
    wanted = o.select(k.alias("target_key"), F.when(k % 4 == 0, "h").otherwise("i").alias("input_hash"), pick(1).alias("input_text"))
    return I.cached_designs(wanted, stored).select("target_key", "content")


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'own' WHEN p_partkey % 2 = 0 THEN 'plain' END AS purpose FROM part""")
def localized_cache(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("unique_id"))
    own = p.where("p_partkey % 3 = 0").select(F.concat("unique_id", F.lit("::Japanese")).alias("unique_id"), F.lit("own").alias("purpose"))
    plain = p.where("p_partkey % 2 = 0").select("unique_id", F.lit("plain").alias("purpose"))
    return I.localised(p, own.union(plain), "Japanese").select("p_partkey", "purpose")


@query("""SELECT 'n' || c_nationkey AS rel_path, bool_or(c_custkey % 40 = 0 OR c_custkey % 77 = 0) AS dirty FROM customer GROUP BY 1""")
def dirty_files(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("rel_path"))
    return I.files_with_changes(c, c.where("id % 40 = 0"), c.where("id % 77 = 0"), c.where("id < 0"))


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS describer, o_orderkey % 5 <> 0 AS related, o_orderkey % 13 = 0 AS force, o_orderkey % 2 = 0 AS anything, o_orderkey % 3 = 0 AS down, o_orderkey % 7 = 0 AS bare FROM orders)
 SELECT CAST(k AS BIGINT) AS o_orderkey, describer AND related AND (force OR (anything AND (down OR bare)) OR bare) AS refine FROM s""")
def refine_flags(spark, d):
    k = F.col("o_orderkey")
    refine = I.needs_refinement(k % 11 != 0, k % 5 != 0, k % 13 == 0, k % 2 == 0, k % 3 == 0, F.when(k % 7 != 0, "ctx"))
    return table(spark, d, "orders").select(k, refine.alias("refine"))


@query("""WITH v AS (SELECT p_partkey AS id, 'f' || (p_partkey % 30) AS f, 'r' || (p_partkey % 12) AS name, p_partkey % 19 <> 0 AS doc, p_partkey % 23 <> 0 AS ctx FROM part), g AS (SELECT s_suppkey AS id, 'f' || (s_suppkey % 30) AS f, 'r' || (s_suppkey % 10) AS callee, CASE WHEN s_suppkey % 5 = 0 THEN 'call(r11)' ELSE '' END AS sig FROM supplier WHERE s_suppkey % 2 = 0)
 SELECT CAST(id AS BIGINT) AS id, NOT doc OR NOT ctx OR id % 10 = 0 OR (id % 4 = 0 AND id % 3 = 0) OR (id % 7 = 0 AND (id // 7) % 2 = 0 AND (id // 7) IN (SELECT s_suppkey FROM supplier)) OR EXISTS (SELECT 1 FROM g WHERE g.f = v.f AND (callee = name OR contains(sig, name))) AS downstream FROM v""")
def downstream_variables(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    p, f = table(spark, d, "part"), table(spark, d, "supplier")
    v = p.select(k.alias("id"), text("f", k % 30).alias("rel_path"), text("r", k % 12).alias("name"), (k % 19 != 0).alias("doc_there"), F.when(k % 23 != 0, "c").alias("context"))
    interface = f.where(s % 2 == 0).select(s.cast("string").alias("id")).union(p.where(k % 3 == 0).select(text("t", k)))
    containers = p.where(k % 4 == 0).select(k.alias("id"), text("t", k).alias("type_id"))
    callers = p.where(k % 7 == 0).select(k.alias("id"), F.floor(k / 7).cast("string").alias("caller"))
    functions = f.select(s.cast("string").alias("id"), text("f", s % 30).alias("rel_path"), F.array(text("r", s % 10)).alias("callees"), F.when(s % 5 == 0, "call(r11)").otherwise("").alias("signature"))
    return I.is_downstream(v, p.where(k % 10 == 0).select(k.alias("id")), interface, containers, callers, functions)


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 + CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END END AS BIGINT) AS level FROM part""")
def assembled_levels(spark, d):
    """Ranks 0, 3 and 7 with a gap between; what is no function goes below."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part")
    nodes = p.select(k.alias("id"), F.when(k % 4 == 0, "class").otherwise("method").alias("kind"))
    ranks = p.where(size > 25).select(k.alias("id"), F.when(size > 40, 7).otherwise(3).cast("long").alias("rank"))
    return listing.levels_in_order(nodes, ranks)


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, CAST(floor(sum(greatest(event_id % 1000, 1) + event_id % 77) / sum(round_even(greatest(value, 0.01), 2))) AS BIGINT) AS rate FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 60000000, true) AS cold FROM events) WHERE event_id % 2 = 0 GROUP BY user_id""")
def server_rate(spark, d):
    """Even events are the warm requests."""
    i = F.col("event_id")
    r = table(spark, d, "events").select("user_id", (i % 1000).alias("in_chars"), (i % 77).alias("out_chars"), F.col("value").alias("seconds"), (i % 2 == 1).alias("is_cold"))
    return costs.server_rates(r, "user_id", digits=None).select("user_id", F.floor("rate").cast("long").alias("rate"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(round_even(greatest(120.0, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_orderkey % 100 + 60.5 ELSE 0 END, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey + 500) / CAST(o_orderkey % 5 AS DOUBLE) * 2.5 ELSE 0 END), 0) AS BIGINT) AS timeout FROM orders""")
def adaptive_timeout(spark, d):
    k = F.col("o_orderkey")
    cold = F.when(k % 3 != 0, k % 100 + 0.5)
    return table(spark, d, "orders").select(k, costs.adaptive_timeout(F.col("o_custkey"), k % 2 == 0, cold, (k % 5).cast("double")).alias("timeout"))


def _chars_sql() -> str:
    own = ((400, 5, 15), (550, 7, 20), (320, 3, 10), (850, 8, 25), (1200, 12, 35), (1600, 15, 40), (1100, 10, 30), (450, 6, 18))
    cases = " ".join(f"WHEN {i} THEN {base} + round_even({a} * l_quantity + {b} * (1 + l_linenumber), 0)" for i, (base, a, b) in enumerate(own))
    return f"greatest(150, CASE l_orderkey % 8 {cases} END)"


@query(f"""SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST({_chars_sql()} AS BIGINT) AS chars, round(l_quantity * sqrt(1 + l_linenumber), 4) AS work,
 round(greatest(0.05, 0.8 + 0.02 * (l_quantity * sqrt(1 + l_linenumber))), 4) AS seconds FROM lineitem""")
def predicted_costs(spark, d):
    n, c = F.col("l_quantity"), 1 + F.col("l_linenumber")
    kind = F.element_at(F.array(*[F.lit(k[0][-1]) for k in costs.CHARS], F.lit("thing")), (F.col("l_orderkey") % 8 + 1).cast("int"))
    coeffs = F.array(F.lit(0.8), F.lit(0.02), F.lit(0.0))
    w = costs.work(n, c)
    return table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), costs.predict_chars(kind, n, c).alias("chars"), F.round(w, 4).alias("work"), F.round(costs.polynomial(coeffs, w), 4).alias("seconds")
    )


@query("""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, round(CASE WHEN c_nationkey % 5 = 0 THEN CAST(0.8 AS DOUBLE) + CAST(0.03 AS DOUBLE) * z WHEN c_nationkey % 2 = 0 AND c_mktsegment = 'BUILDING' THEN 2 + z ELSE CAST(5 AS DOUBLE) END, 4) AS seconds
 FROM (SELECT *, greatest(1, c_custkey % 90) * CAST(2 AS DOUBLE) AS z FROM customer)""")
def predicted_durations(spark, d):
    """Hosts are nations; those divisible by five have no fit, the even ones one for BUILDING, all others one for ANY."""
    n = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("key"))
    fits = n.select("key", F.lit("ANY").alias("category"), F.array(F.lit(5.0)).alias("coeffs"))
    fits = fits.union(n.where("key % 2 = 0").select("key", F.lit("BUILDING"), F.array(F.lit(2.0), F.lit(1.0))))
    fits = fits.union(n.select("key", F.lit("A"), F.array().cast("array<double>")))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 90).alias("lines"), F.lit(4.0).alias("complexity"))
    return costs.predict_durations(c, fits).select("c_custkey", F.round("seconds", 4).alias("seconds"))


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS symbols, CAST(count(*) FILTER (o_orderstatus <> 'F') AS BIGINT) AS cached, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS to_generate,
 round(sum(CASE WHEN o_orderstatus <> 'F' THEN 0 WHEN o_orderkey % 3 = 0 THEN 0.001 ELSE o_totalprice END) / 4 / 1e6, 3) AS eta FROM orders GROUP BY 1""")
def eta_by_group(spark, d):
    dirty = F.col("o_orderstatus") == "F"
    o = table(spark, d, "orders").select("o_orderpriority", dirty.alias("dirty"), costs.estimate(dirty, F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("double")).alias("seconds"))
    return costs.totals(o, 4, "o_orderpriority").withColumn("eta", F.round(F.col("eta") / 1e6, 3))


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id, CAST(5 + 17 * (event_id % 9) AS BIGINT) AS seed, round(CAST(least(0.7, 0.2 + 0.1 * (event_id % 9)) AS DOUBLE), 3) AS temperature, CAST(event_id % 9 + 1 AS BIGINT) AS wait FROM events""")
def retry_schedule(spark, d):
    seed, temperature, wait = costs.retry(F.col("event_id") % 9 + 1, 5, 0.2)
    return table(spark, d, "events").select("user_id", "event_id", seed.cast("long").alias("seed"), F.round(temperature, 3).alias("temperature"), wait.cast("long").alias("wait"))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'a' || event_id || '|b' ELSE '' END AS items, CASE WHEN event_id % 3 = 1 THEN '["a' || event_id || '","b"]' ELSE '[]' END AS encoded FROM events""")
def json_list_decode(spark, d):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, "[broken").when(i % 3 == 1, F.concat(F.lit('["a'), i.cast("string"), F.lit('", "b"]')))
    e = table(spark, d, "events").select("event_id", T.list_from_json(text).alias("x"))
    return e.select("event_id", F.array_join("x", "|").alias("items"), T.list_to_json(F.col("x")).alias("encoded"))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CASE event_id % 3 WHEN 0 THEN 'p' || event_id WHEN 1 THEN 'm' ELSE '' END AS purpose, CASE WHEN event_id % 3 = 1 THEN 'x, y' ELSE '' END AS inputs, CASE WHEN event_id % 3 = 2 THEN 's' ELSE '' END AS overview,
 CASE WHEN event_id % 3 = 2 THEN 's' ELSE '' END AS top_down_summary, CASE WHEN event_id % 3 = 0 THEN 'r' ELSE '' END AS significance FROM events""")
def json_key_alias(spark, d):
    from tessera.functions.snippets import standard_keys

    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit('{"purpose": "", "目的": " p'), i.cast("string"), F.lit(' ", "役割": "r"}')))
    text = text.when(i % 3 == 1, '{"target": "m", "パラメータ": "x, y", "purpose": null}').otherwise('{"summary": "s"}')
    e = table(spark, d, "events").select("event_id", standard_keys(text).alias("k"))
    names = ("purpose", "inputs", "overview", "top_down_summary", "significance")
    return e.select("event_id", *[F.coalesce(F.try_element_at("k", F.lit(n)), F.lit("")).alias(n) for n in names])
