"""Index, graph and change queries over the driver's tables; stand-ins for an index are built from part and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, incremental, places, search
from tessera.plans.catalog import query
from tessera.plans.scratch import Scratch
from tessera.session import table

# part as symbols; an aggregate of all line items as the cache, of the part one below, so that the left join misses too.
_SYMBOLS = """SELECT CAST(p_partkey AS VARCHAR) AS unique_id, p_name AS name, p_type AS kind, p_brand || '.' || p_name AS fqdn,
 p_brand AS rel_path, p_size AS line_start, CAST(NULL AS VARCHAR) AS signature FROM part"""
_CACHE = """SELECT CAST(l_partkey + 1 AS VARCHAR) AS unique_id, 'moves ' || max(l_returnflag) || ' ' || max(l_linestatus) AS purpose,
 'lines ' || CAST(count(*) AS VARCHAR) AS overview FROM lineitem GROUP BY l_partkey"""


def _symbols(spark, d):
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("unique_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"),
        F.concat("p_brand", F.lit("."), "p_name").alias("fqdn"), F.col("p_brand").alias("rel_path"), F.col("p_size").alias("line_start"),
        F.lit(None).cast("string").alias("signature"),
    )


def _cache(spark, d):
    li = table(spark, d, "lineitem").groupBy((F.col("l_partkey") + 1).cast("string").alias("unique_id"))
    purpose = F.concat(F.lit("moves "), F.max("l_returnflag"), F.lit(" "), F.max("l_linestatus"))
    return li.agg(purpose.alias("purpose"), F.concat(F.lit("lines "), F.count("*").cast("string")).alias("overview"))


def _score_sql(q: str) -> str:
    """Points for the whole text and for its words of two letters or more, in numbers of its own."""
    low = lambda c: f"coalesce(lower({c}), '')"
    parts = [f"CASE WHEN contains({low('name')}, '{q}') OR contains({low('fqdn')}, '{q}') THEN 50 ELSE 0 END"]
    parts += [f"CASE WHEN contains({low(c)}, '{q}') THEN {w} ELSE 0 END" for c, w in (("purpose", 35), ("overview", 20), ("signature", 25))]
    words = (("name", 15), ("fqdn", 10), ("purpose", 10), ("overview", 5), ("rel_path", 8), ("signature", 6))
    parts += [f"CASE WHEN contains({low(c)}, '{t}') THEN {w} ELSE 0 END" for t in sorted({t for t in q.lower().split() if len(t) > 1}) for c, w in words]
    return " + ".join(parts)


_LOCATE = "part moves 1"


@query(f"""SELECT unique_id, name, rel_path, CAST(score AS BIGINT) AS score FROM (SELECT *, {_score_sql(_LOCATE)} AS score
 FROM ({_SYMBOLS}) LEFT JOIN ({_CACHE}) USING (unique_id)) WHERE score > 0 ORDER BY score DESC, rel_path NULLS FIRST, line_start NULLS FIRST, unique_id LIMIT 10""")
def locate_ranked(spark, d):
    return search.locate(_symbols(spark, d), _cache(spark, d), _LOCATE).select("unique_id", "name", "rel_path", "score")


_LOCATE_UI = "debug view 1"


@query(f"""SELECT unique_id, name, CAST(score AS BIGINT) AS score FROM (SELECT *, {_score_sql(_LOCATE_UI)} + CASE WHEN regexp_matches(lower(name || ' ' || fqdn || ' ' || kind), 'button|view|compose|screen|dialog|activity|fragment|ui') THEN 15 ELSE 0 END
 + CASE WHEN regexp_matches(signature, '(?i)composable|button|onclick|modifier|setonclicklistener') THEN 20 ELSE 0 END AS score
 FROM (SELECT * REPLACE (CASE WHEN CAST(unique_id AS INT) % 3 = 0 THEN 'void onClick()' ELSE 'int f()' END AS signature, CASE WHEN CAST(unique_id AS INT) % 5 = 0 THEN 'View' ELSE kind END AS kind) FROM ({_SYMBOLS})) LEFT JOIN ({_CACHE}) USING (unique_id)) WHERE score > 0 ORDER BY score DESC, rel_path NULLS FIRST, line_start NULLS FIRST, unique_id LIMIT 10""")
def locate_ui(spark, d):
    i = F.col("unique_id").cast("int")
    s = _symbols(spark, d).withColumns({"signature": F.when(i % 3 == 0, "void onClick()").otherwise("int f()"), "kind": F.when(i % 5 == 0, "View").otherwise(F.col("kind"))})
    return search.locate(s, _cache(spark, d), _LOCATE_UI).select("unique_id", "name", "score")


@query(f"""SELECT unique_id, name, purpose FROM ({_SYMBOLS}) LEFT JOIN ({_CACHE}) USING (unique_id)
 WHERE (lower(name) LIKE '%1%' OR lower(fqdn) LIKE '%1%' OR coalesce(lower(purpose) LIKE '%1%', false))
 ORDER BY rel_path NULLS FIRST, line_start NULLS FIRST, unique_id LIMIT 30""")
def search_keyword(spark, d):
    return search.keyword_search(_symbols(spark, d), _cache(spark, d), "1").select("unique_id", "name", "purpose")


@query(f"""SELECT unique_id, name, purpose FROM (SELECT *, list_extract(['FN_x', 'my Method', 'constructor', 'class'], CAST(unique_id AS INT) % 4 + 1) AS k FROM ({_SYMBOLS})) LEFT JOIN ({_CACHE}) USING (unique_id)
 WHERE (contains(lower(name), '1') OR contains(lower(fqdn), '1') OR coalesce(contains(lower(purpose), '1'), false)) AND (contains(lower(k), 'func') OR contains(lower(k), 'method') OR contains(lower(k), 'fn'))
 ORDER BY rel_path NULLS FIRST, line_start NULLS FIRST, unique_id LIMIT 30""")
def search_kind_filter(spark, d):
    """Of the kinds dealt over the symbols, two are of the function family; a constructor is not."""
    kind = F.element_at(F.array(*map(F.lit, ("FN_x", "my Method", "constructor", "class"))), F.col("unique_id").cast("int") % 4 + 1)
    return search.keyword_search(_symbols(spark, d).withColumn("kind", kind), _cache(spark, d), "1", "Functions").select("unique_id", "name", "purpose")


#: A part by id, by name with blanks around, by the tail of a dotted name written with ``::``, by a substring that is only
#: there with the dot, by one with a wildcard, and what is nowhere (a slash is no dot).
_ASKED = ("7", "  7 ", "Brand#11", "BRAND#11::GREEN", "brand_11", "Brand#11/green", "no such thing")


@query(f"""WITH s AS ({_SYMBOLS}), q(n, q, dot) AS (VALUES {', '.join(f"({i}, '{a.strip()}', '{a.strip().replace('::', '.')}')" for i, a in enumerate(_ASKED))}),
 t AS (SELECT n, unique_id, rel_path, line_start, CASE WHEN unique_id = q OR fqdn = q OR fqdn = dot OR name = q THEN 1 WHEN fqdn ILIKE '%.' || dot OR fqdn ILIKE '%::' || q THEN 2
  WHEN lower(fqdn) LIKE '%' || lower(dot) || '%' OR lower(name) LIKE '%' || lower(q) || '%' THEN 3 END AS tier FROM s, q)
 SELECT CAST(n AS BIGINT) AS query, unique_id, CAST(tier AS BIGINT) AS tier FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.n = t.n)""")
def find_tiered(spark, d):
    s, out = _symbols(spark, d), None
    for i, q in enumerate(_ASKED):
        one = search.find_tiered(s, q).select(F.lit(i).cast("long").alias("query"), "unique_id", "tier")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH s AS ({_SYMBOLS}), one AS (SELECT unique_id FROM s WHERE lower(fqdn) LIKE '%brand#11%' ORDER BY rel_path, line_start NULLS FIRST, unique_id LIMIT 1), e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey)
 SELECT unique_id, coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM e WHERE CAST(dst AS VARCHAR) = unique_id), '') AS callers, coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM e WHERE CAST(src AS VARCHAR) = unique_id), '') AS callees FROM one""")
def impact_of_query(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    out = search.impact_of(_symbols(spark, d), edges, "brand#11")
    return out.select("unique_id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'fn' WHEN s_nationkey % 5 = 1 THEN 'type' WHEN s_nationkey % 5 = 2 THEN 'const' WHEN s_nationkey % 5 = 3 THEN 'var' ELSE 'sym' END AS prefix,
 s_name || ' (src/n' || s_nationkey || '.c:' || s_nationkey || ':' || CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey ELSE s_nationkey + 5 END || ')' AS location FROM supplier""")
def list_by_kind(spark, d):
    s, n = table(spark, d, "supplier"), F.col("s_nationkey")
    kind = F.element_at(F.array(*map(F.lit, ("Constructor", "property", "macro", "VAR", "namespace"))), n % 5 + 1)
    end = F.when(n % 2 == 1, n + 5)
    loc = T.location(F.col("s_name"), F.concat(F.lit("src/n"), n.cast("string"), F.lit(".c")), n, end)
    return s.select("s_suppkey", T.kind_prefix(kind).alias("prefix"), loc.alias("location"))


_GRAPH = """(SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0 AND p_partkey // 3 IN (SELECT p_partkey FROM part)
 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_size % 10 = 0 AND p_partkey % 2 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)
 UNION SELECT p_partkey + 1, p_partkey FROM part WHERE p_size % 10 = 0 AND p_partkey % 2 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part))"""


def _graph(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    up = p.select(F.col("id").alias("src"), F.floor(F.col("id") / 3).cast("long").alias("dst")).where("src > 0")
    pair = p.where("p_size % 10 = 0 AND id % 2 = 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    e = up.union(pair).union(pair.select("dst", "src")).distinct()
    n = p.select("id")
    e = e.join(graph.shuffled(n.toDF("dst")), "dst", "left_semi").join(graph.shuffled(n.toDF("src")), "src", "left_semi")
    return n, e.select("src", "dst")


_CLOSURE = f"""g AS (SELECT DISTINCT src, dst FROM {_GRAPH} WHERE src <> dst), reach(a, b) AS (SELECT src, dst FROM g UNION SELECT a, dst FROM reach JOIN g ON b = src),
 comp AS (SELECT p_partkey AS id, least(p_partkey, coalesce((SELECT min(r.b) FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a WHERE r.a = p_partkey), p_partkey)) AS scc FROM part)"""


@query(f"WITH RECURSIVE {_CLOSURE} SELECT CAST(id AS BIGINT) AS id, CAST(scc AS BIGINT) AS scc FROM comp")
def scc_members(spark, d):
    return graph.scc(Scratch(spark), *_graph(spark, d))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT CAST(a.scc AS BIGINT) AS src, CAST(b.scc AS BIGINT) AS dst FROM g JOIN comp a ON a.id = src JOIN comp b ON b.id = dst WHERE a.scc <> b.scc")
def scc_condensation(spark, d):
    n, e = _graph(spark, d)
    return graph.condensation(e, graph.scc(Scratch(spark), n, e))


@query(f"""WITH RECURSIVE {_CLOSURE}, dag AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM g JOIN comp a ON a.id = src JOIN comp b ON b.id = dst WHERE a.scc <> b.scc),
 path(c, n) AS (SELECT DISTINCT scc, 0 FROM comp WHERE scc NOT IN (SELECT src FROM dag) UNION SELECT src, n + 1 FROM path JOIN dag ON dst = c)
 SELECT CAST(id AS BIGINT) AS id, CAST(comp.scc AS BIGINT) AS scc, CAST(max(n) AS BIGINT) AS level FROM comp JOIN path ON c = comp.scc GROUP BY id, comp.scc""")
def topo_levels(spark, d):
    return graph.levels(Scratch(spark), *_graph(spark, d))


@query(f"""WITH RECURSIVE g AS (SELECT DISTINCT src, dst FROM {_GRAPH} WHERE src <> dst), w(id, n) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 97 = 5
 UNION SELECT src, n + 1 FROM w JOIN g ON dst = id WHERE n < 40) SELECT CAST(id AS BIGINT) AS id, CAST(min(n) AS BIGINT) AS hops FROM w GROUP BY id""")
def dirty_propagation(spark, d):
    n, e = _graph(spark, d)
    return graph.propagate(Scratch(spark), n.where("id % 97 = 5"), e)


@query(f"""WITH RECURSIVE g AS (SELECT DISTINCT src, dst FROM {_GRAPH} WHERE src <> dst), m(id) AS (SELECT p_partkey FROM part WHERE p_partkey % 97 = 5
 UNION SELECT src FROM m JOIN g ON dst = id WHERE id % 3 = 1) SELECT CAST(id AS BIGINT) AS id, id % 3 = 1 AS changed FROM m""")
def contract_gate(spark, d):
    """What is made anew from a 97th of the parts on: each gets the same purpose, another one, or the same in other words."""
    n, e = _graph(spark, d)
    scratch = Scratch(spark)
    k, old, one = F.col("id") % 3, F.lit("Reads the file."), F.lit("")
    same = (one, one)

    def make(now, made):
        new = F.when(k == 0, old).when(k == 1, "Opens a socket").otherwise("reads the FILE")
        callees = (F.array(one), F.array(one))
        return now.select("id", incremental.contract_changed(F.lit(True), F.lit(True), same, same, callees, same, same, (old, new)).alias("changed"))

    return incremental.make_anew(scratch, n.where("id % 97 = 5"), graph.levels(scratch, n, e), e, make)


@query(f"""WITH g AS (SELECT DISTINCT src, dst FROM {_GRAPH} WHERE src <> dst) SELECT CAST(p_partkey AS BIGINT) AS id,
 coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM g WHERE dst = p_partkey), '') AS callers,
 coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM g WHERE src = p_partkey), '') AS callees FROM part""")
def impact_neighbors(spark, d):
    out = search.impact(*_graph(spark, d))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("id", text("callers"), text("callees"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS fqdn, p_brand || '-' || p_size AS name, 't' || (p_partkey // 40) AS tail FROM part),
 c AS (SELECT p_partkey AS src, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Brand#' || (p_partkey % 60) || '-' || p_size WHEN 2 THEN 't' || (p_partkey // 90) ELSE 'nowhere' END AS callee FROM part),
 x AS (SELECT src, callee, id FROM c JOIN t ON fqdn = callee), r AS (SELECT * FROM c ANTI JOIN x USING (src, callee)), y AS (SELECT src, id FROM r JOIN t ON name = callee UNION SELECT src, id FROM r JOIN t ON tail = callee)
 SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(id AS BIGINT) AS dst FROM (SELECT src, id FROM x UNION SELECT src, id FROM y) WHERE src <> id""")
def resolve_two_tier(spark, d):
    """All parts call: by full name, by the short name, by the tail, or what is nowhere."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda c: c.cast("string")
    p = table(spark, d, "part")
    targets = p.select(k.alias("id"), F.col("p_name").alias("fqdn"), F.concat("p_brand", F.lit("-"), size).alias("name"), F.concat(F.lit("t"), text(F.floor(k / 40))).alias("tail"))
    callee = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.lit("Brand#"), text(k % 60), F.lit("-"), size)).when(k % 4 == 2, F.concat(F.lit("t"), text(F.floor(k / 90)))).otherwise("nowhere")
    return search.resolve_two_tier(p.select(k.alias("src"), callee.alias("callee")), targets)


@query(f"""WITH g AS (SELECT DISTINCT src, dst FROM {_GRAPH} WHERE src <> dst), w AS (SELECT p_partkey AS id, least(p_partkey, coalesce((SELECT min(h.dst) FROM g h JOIN g i ON i.src = h.dst AND i.dst = h.src WHERE h.src = p_partkey), p_partkey)) AS scc FROM part)
 SELECT CAST(a.id AS BIGINT) AS id, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) AS peers FROM w a JOIN w b ON a.scc = b.scc AND a.id <> b.id GROUP BY a.id""")
def scc_peers(spark, d):
    """Components of this graph's pairs alone (edges both ways), so that the SQL needs no closure."""
    from tessera.operators import links

    n, e = _graph(spark, d)
    both = e.join(e.toDF("dst", "src"), ["src", "dst"])
    out = links.peers(graph.scc(Scratch(spark), n, both))
    return out.select("id", F.array_join(F.col("peers").cast("array<string>"), ",").alias("peers"))


_WORDS = r"[\p{L}\p{N}\p{M}\p{Pc}]+"


@query(f"""WITH post AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_WORDS}')) AS target FROM documents),
 want AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORDS}')) AS target FROM benchmark)
 SELECT target, CAST(count(*) AS BIGINT) AS n_docs FROM post JOIN want USING (target) GROUP BY target""")
def word_links(spark, d):
    bodies = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    want = table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)))).alias("target"))
    return search.word_links(bodies, want).groupBy("target").agg(F.count("*").alias("n_docs"))


@query("""SELECT CAST(f.l_orderkey AS BIGINT) AS l_orderkey, CAST(f.l_linenumber AS BIGINT) AS container, CAST(count(*) AS BIGINT) AS n FROM lineitem f JOIN lineitem t
 ON f.l_orderkey = t.l_orderkey AND t.l_linenumber BETWEEN f.l_linenumber AND f.l_linenumber + 2 GROUP BY 1, 2""")
def scope_range_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("at")).where("l_orderkey IS NOT NULL AND at IS NOT NULL")
    return places.counted_within(li, "l_orderkey", "at", 2).withColumnRenamed("at", "container")


@query("SELECT sha256(text) AS content, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id) AS BIGINT) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""WITH n AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0), o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0)
 SELECT CAST(coalesce(n.doc_id, o.doc_id) AS BIGINT) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
 FROM n FULL JOIN o ON n.doc_id = o.doc_id WHERE n.text IS DISTINCT FROM o.text""")
def snapshot_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return incremental.snapshot_diff(old, new, "doc_id", "h")


_TOK = r"[.,。、:：;；!?！？\-_()（）「」『』`\"''\[\]{}*#>|/\\\s　]+"


@query(f"""WITH c AS (SELECT item_id, trim(regexp_replace(lower(text), '{_TOK}', ' ', 'g')) AS t FROM benchmark), k AS (SELECT item_id, list_distinct(list_concat(list_filter(string_split(t, ' '), lambda x: x <> ''),
 list_transform(generate_series(1, length(replace(t, ' ', '')) - 1), lambda i: substring(replace(t, ' ', ''), i, 2)))) AS k FROM c),
 p AS (SELECT a.item_id AS a, b.item_id AS b, CAST(len(list_intersect(a.k, b.k)) AS DOUBLE) AS i, CAST(len(a.k) AS DOUBLE) AS n, CAST(len(b.k) AS DOUBLE) AS m FROM k a JOIN k b ON b.item_id = a.item_id + 1)
 SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(greatest(i / (n + m - i), i / least(n, m) * (0.5 + 0.5 * least(n, m) / greatest(n, m))), 6) AS similarity FROM p""")
def similarity_pairs(spark, d):
    k = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("k"))
    a, b = k.toDF("a", "ka"), k.toDF("b", "kb")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.similarity(F.col("ka"), F.col("kb")), 6).alias("similarity"))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_decode(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.where("k IS NOT NULL")
