"""Listing, describing, linking and document queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import interfaces, naming
from tessera.functions import text as T
from tessera.operators import documents, links, listing, search
from tessera.plans.catalog import query
from tessera.plans.scratch import Scratch
from tessera.session import table

#: Kinds dealt over the rows of supplier and part.
_KINDS = ("function", "Method", "constructor", "destructor", "variable", "field", "enum_constant", "macro", "class", "union", "data class", "annotation", "namespace")


def _kind(n):
    return F.element_at(F.array(*map(F.lit, _KINDS)), (n % len(_KINDS) + 1).cast("int"))


def _kind_sql(n: str) -> str:
    return f"list_extract([{', '.join(repr(k) for k in _KINDS)}], CAST({n} % {len(_KINDS)} AS INT) + 1)"


_INDEX = f"""SELECT CAST(s_suppkey AS VARCHAR) AS unique_id, s_name AS name, {_kind_sql('s_suppkey')} AS kind, 'src/n' || s_nationkey || '.py' AS rel_path,
 CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'mod' || s_nationkey || '.' || s_name END AS fqdn, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 50 END AS line_start,
 CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 50 + 4 END AS line_end, 'f(' || s_name || ')' AS signature FROM supplier"""


def _index(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    return table(spark, d, "supplier").select(
        k.cast("string").alias("unique_id"), F.col("s_name").alias("name"), _kind(k).alias("kind"), F.concat(F.lit("src/n"), n, F.lit(".py")).alias("rel_path"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("mod"), n, F.lit("."), "s_name")).alias("fqdn"), F.when(k % 7 != 0, k % 50).alias("line_start"),
        F.when(k % 3 != 0, k % 50 + 4).alias("line_end"), F.concat(F.lit("f("), "s_name", F.lit(")")).alias("signature"),
    )


def _list_sql(wanted: str) -> str:
    return f"""SELECT unique_id, CASE WHEN fqdn = '' THEN name ELSE fqdn END || ' (' || rel_path || coalesce(':' || line_start || ':' || coalesce(line_end, line_start), '') || ')' AS location
 FROM ({_INDEX}) WHERE {wanted}"""


@query(_list_sql("lower(kind) IN ('function', 'method', 'constructor', 'destructor')"))
def list_functions(spark, d):
    return listing.list_functions(_index(spark, d))


@query(_list_sql("kind IN ('variable', 'field', 'enum_constant', 'macro')"))
def list_variables(spark, d):
    return listing.list_variables(_index(spark, d))


@query(_list_sql("kind IN ('field', 'class', 'union', 'data class', 'annotation')"))
def list_types(spark, d):
    return listing.list_types(_index(spark, d))


@query(f"SELECT unique_id, CAST(row_number() OVER (ORDER BY rel_path NULLS FIRST, line_start NULLS FIRST, unique_id) AS BIGINT) AS place FROM ({_INDEX})")
def all_symbols_ordered(spark, d):
    return listing.symbol_places(Scratch(spark), _index(spark, d)).select("unique_id", (F.col("place") + 1).alias("place"))


@query(f"SELECT DISTINCT rel_path AS file FROM ({_INDEX})")
def list_files(spark, d):
    """No list is there, so the index answers."""
    none = table(spark, d, "nation").select(F.lit("  ").alias("file"))
    docs = table(spark, d, "nation").select(F.concat("n_name", F.lit(".py.md")).alias("file"))
    return listing.indexed_files(none, _index(spark, d).select(F.col("rel_path").alias("file")), docs)


@query("SELECT n_name || '.py' AS file FROM nation")
def list_files_by_docs(spark, d):
    """Neither list nor index: names of file documents, those of symbols left out."""
    none = table(spark, d, "nation").where("n_nationkey < 0").select(F.col("n_name").alias("file"))
    n = table(spark, d, "nation")
    docs = n.select(F.concat("n_name", F.lit(".py.md")).alias("file")).union(n.select(F.concat("n_name", F.lit(".py.fn.x.fn.md")))).union(n.select(F.concat("n_name", F.lit(".txt"))))
    return listing.indexed_files(none, none, docs)


_DOC_KINDS = "list_extract(['struct', 'variable', 'method', 'module'], CAST(doc_id % 4 AS INT) + 1)"


@query(f"""WITH d AS (SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '.fn.' ELSE '.py.' END || doc_id || '.md' AS f, {_DOC_KINDS} AS k FROM documents WHERE source IS NOT NULL)
 SELECT CAST(doc_id AS BIGINT) AS doc_id, 'type' AS part FROM d WHERE k = 'struct' UNION ALL SELECT doc_id, 'var' FROM d WHERE k = 'variable' UNION ALL SELECT doc_id, 'fn' FROM d WHERE k = 'method' OR contains(f, '.fn.')""")
def doc_parts(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("source IS NOT NULL").select(
        "doc_id", F.concat(F.col("source"), F.when(i % 3 == 0, ".fn.").otherwise(".py."), i.cast("string"), F.lit(".md")).alias("file_name"),
        F.element_at(F.array(*map(F.lit, ("struct", "variable", "method", "module"))), (i % 4 + 1).cast("int")).alias("kind"),
    )
    return listing.doc_parts(docs).select("doc_id", "part")


@query(f"SELECT unique_id, contains(kind, 'enum') OR kind IN ('field', 'variable') AS static FROM ({_INDEX})")
def static_bypass(spark, d):
    return _index(spark, d).select("unique_id", listing.needs_no_describer(F.col("kind")).alias("static"))


_CACHE = """SELECT CAST(doc_id AS VARCHAR) AS unique_id, CASE WHEN quality = 1 THEN 'good ' || doc_id WHEN doc_id % 2 = 0 THEN '' END AS purpose, CASE WHEN toxic = 1 THEN 'bad' END AS overview,
 CASE WHEN doc_id % 3 <> 0 THEN 'ctx ' || doc_id END AS top_down_context FROM labels"""


@query(f"""WITH c AS (SELECT unique_id, any_value(purpose) AS purpose, any_value(overview) AS overview, any_value(top_down_context) AS top_down_context FROM ({_CACHE}) GROUP BY unique_id)
 SELECT i.unique_id, CASE WHEN fqdn = '' THEN name ELSE fqdn END AS symbol, rel_path || CASE WHEN line_start IS NULL THEN '' WHEN line_end IS NULL THEN ' (Line: ' || line_start || ')' ELSE ' (Lines: ' || line_start || '-' || line_end || ')' END AS source,
 kind, signature, coalesce(nullif(purpose, ''), nullif(top_down_context, ''), '') AS purpose, coalesce(overview, '') AS overview FROM ({_INDEX}) i LEFT JOIN c USING (unique_id) WHERE lower(fqdn) LIKE '%mod1%' OR lower(name) LIKE '%mod1%'""")
def describe_fallback(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "labels").select(
        i.cast("string").alias("unique_id"), F.when(F.col("quality") == 1, F.concat(F.lit("good "), i.cast("string"))).when(i % 2 == 0, "").alias("purpose"),
        F.when(F.col("toxic") == 1, "bad").alias("overview"), F.when(i % 3 != 0, F.concat(F.lit("ctx "), i.cast("string"))).alias("top_down_context"),
    ).dropDuplicates(["unique_id"])
    return listing.describe(_index(spark, d), c, " mod1 ")


@query(f"""WITH i AS (SELECT *, CASE WHEN lower(kind) IN ('function', 'method', 'constructor', 'destructor') THEN 'fn' WHEN kind = 'variable' THEN 'var' WHEN kind IN ('field', 'class', 'annotation') THEN 'type' WHEN kind IN ('enum_constant', 'macro') THEN 'const' ELSE 'sym' END AS p FROM ({_INDEX})),
 c AS (SELECT unique_id, rel_path || '.' || p || '.' || name || '.md' AS a, rel_path || '.' || p || '.x' || unique_id || '.y.' || name || '.md' AS b0, rel_path || '.' || p || '.x' || unique_id || '.y.md' AS b,
  CASE WHEN fqdn <> '' THEN rel_path || '.' || p || '.' || split_part(fqdn, '.', 1) || '.' || name || '.md' END AS e, rel_path || '.' || p || '.x' || unique_id || '.' || name || '.md' AS m FROM i)
 SELECT unique_id, CASE WHEN e IS NULL THEN a || '|' || b || '|' || m ELSE a || '|' || b || '|' || m || '|' || e END AS candidates FROM c""")
def doc_candidates(spark, d):
    s = _index(spark, d).withColumn("uid", F.concat(F.col("rel_path"), F.lit("::fn.x"), F.col("unique_id"), F.lit(".y")))
    names = naming.doc_names(F.col("rel_path"), F.col("kind"), F.col("name"), F.col("uid"), F.col("fqdn"))
    return s.select("unique_id", F.array_join(names, "|").alias("candidates"))


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT CAST(doc_id AS BIGINT) AS module FROM d WHERE contains(t, 'the river of') OR contains(t, 'the') OR contains(t, 'river')""")
def module_hint(spark, d):
    return search.module_hints(table(spark, d, "documents").select(F.col("doc_id").alias("module"), "text"), "The river of")


_TARGETS = "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 9 = 0 THEN 'l-' || p_size WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'w' || p_size END AS name, 'f' || (p_partkey % 20) || '.c' AS rel_path, p_partkey % 30 AS line_start FROM part"
_BODIES = """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'f' || (s_suppkey % 40) || '.c' AS rel_path, s_suppkey % 20 AS line_start, s_suppkey % 20 + 5 AS line_end,
 'use w' || (s_suppkey % 60) || ' and l-' || (s_suppkey % 50) || ' or xw1 Brand#' || (s_suppkey % 60) AS code FROM supplier"""


def _targets(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 9 == 0, F.concat(F.lit("l-"), size)).when(k % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("w"), size))
    return table(spark, d, "part").select(k.cast("string").alias("id"), name.alias("name"), F.concat(F.lit("f"), (k % 20).cast("string"), F.lit(".c")).alias("rel_path"), (k % 30).alias("line_start"))


def _bodies(spark, d):
    k = F.col("s_suppkey")
    num = lambda m: (k % m).cast("string")
    code = F.concat(F.lit("use w"), num(60), F.lit(" and l-"), num(50), F.lit(" or xw1 Brand#"), num(60))
    return table(spark, d, "supplier").select(
        k.cast("string").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("f"), num(40), F.lit(".c")).alias("rel_path"),
        (k % 20).alias("line_start"), (k % 20 + 5).alias("line_end"), code.alias("code"),
    )


@query(f"""WITH t AS ({_TARGETS}), f AS ({_BODIES}), h AS (SELECT t.id AS target, f.id AS fn FROM t JOIN f ON t.rel_path = f.rel_path AND t.line_start BETWEEN f.line_start AND f.line_end
 UNION SELECT t.id, f.id FROM t JOIN f ON regexp_matches(f.code, '(^|[^\\w])' || regexp_replace(t.name, '([#-])', '\\\\\\1', 'g') || '([^\\w]|$)'))
 SELECT target, string_agg(DISTINCT fn, ',' ORDER BY fn) AS callers, string_agg(DISTINCT '`' || name || '` (`' || rel_path || '`)', ', ' ORDER BY '`' || name || '` (`' || rel_path || '`)') AS shown FROM h JOIN f ON f.id = h.fn GROUP BY target""")
def reference_links(spark, d):
    return links.references(_bodies(spark, d), _targets(spark, d), (",", ", "))


@query("""WITH t AS (SELECT i.page_id, p.name FROM pages i JOIN (VALUES ('<li>'), ('article>'), ('--')) p(name) ON regexp_matches(i.html, CASE p.name WHEN '<li>' THEN '\\w<li>\\w' WHEN 'article>' THEN '(^|\\W)article>\\w' ELSE '\\w--\\w' END))
 SELECT CAST(page_id AS BIGINT) AS page_id, name FROM t""")
def regex_residual_join(spark, d):
    bodies = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code"))
    names = spark.createDataFrame([(n, n) for n in ("<li>", "article>", "--", "plain")], "id string, name string")
    return links.by_pattern(bodies, names).select(F.col("fn").alias("page_id"), F.col("target").alias("name"))


@query("""WITH v AS (SELECT c_custkey AS id, 'n' || c_nationkey AS f, CASE WHEN c_custkey % 4 = 0 THEN 'lone' ELSE 'm.' || c_mktsegment || '.v' END AS q, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS parent FROM customer),
 t AS (SELECT 'n' || c_nationkey AS f, c_mktsegment AS name, min(c_custkey) AS k FROM customer WHERE c_custkey % 6 = 0 GROUP BY ALL)
 SELECT CAST(id AS BIGINT) AS id, parent, CASE WHEN parent IS NULL THEN NULL WHEN k IS NULL THEN 'class/struct/data model' ELSE 'class' END AS kind, CASE WHEN parent IS NOT NULL THEN coalesce('p' || k, '') END AS purpose, CASE WHEN parent IS NOT NULL THEN '' END AS overview
 FROM v LEFT JOIN t ON v.f = t.f AND v.parent = t.name""")
def parent_containers(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    path = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("rel_path")
    v = c.select(k.alias("id"), path, F.when(k % 4 == 0, "lone").otherwise(F.concat(F.lit("m."), "c_mktsegment", F.lit(".v"))).alias("fqdn"))
    t = c.where(k % 6 == 0).select(k.alias("id"), path, F.col("c_mktsegment").alias("name"), k.alias("line_start"), F.lit("class").alias("kind"), F.concat(F.lit("p"), k.cast("string")).alias("purpose"), F.lit(None).cast("string").alias("overview"))
    return links.containers(v, t)


@query("""WITH v AS (SELECT p_partkey AS id, 'f' || (p_partkey % 30) AS f, 'r' || (p_partkey % 12) AS name FROM part), g AS (SELECT s_suppkey AS fn, 'f' || (s_suppkey % 9) AS f, 'r' || (s_suppkey % 10) AS callee, CASE WHEN s_suppkey % 5 = 0 THEN 'call(r11, int)' ELSE '' END AS sig FROM supplier)
 SELECT CAST(id AS BIGINT) AS id, CAST(fn AS BIGINT) AS fn FROM v JOIN g USING (f) UNION SELECT id, fn FROM v JOIN g ON callee = name OR contains(sig, name) WHERE v.f NOT IN (SELECT f FROM g)""")
def variable_functions(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    v = table(spark, d, "part").select(k.alias("id"), text("f", k % 30).alias("rel_path"), text("r", k % 12).alias("name"))
    f = table(spark, d, "supplier").select(s.alias("id"), text("f", s % 9).alias("rel_path"), F.array(text("r", s % 10)).alias("callees"), F.when(s % 5 == 0, "call(r11, int)").otherwise("").alias("signature"))
    return links.related_functions(v, f)


_EDGES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem"
_CALLER = "'`' || s_name || '` (`n' || s_nationkey || '.c`)' || CASE WHEN s_suppkey % 2 = 0 THEN ': p' || s_suppkey ELSE '' END"


@query(f"SELECT CAST(dst AS BIGINT) AS id, string_agg({_CALLER}, ' ; ' ORDER BY src) AS callers FROM ({_EDGES}) JOIN supplier ON s_suppkey = src GROUP BY dst")
def callers_with_purpose(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    k = F.col("s_suppkey")
    n = table(spark, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit(".c")).alias("rel_path"), F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("purpose"))
    return links.callers_shown(e, n).select("id", F.array_join("callers", " ; ").alias("callers"))


@query(f"""WITH b AS (SELECT s_suppkey, '- Function `' || s_name || '` (FQDN: `' || CASE WHEN s_suppkey % 2 = 0 THEN 'q.' || s_name ELSE s_name END || '`, File: `n' || s_nationkey || '.c`):' || chr(10) || '  - Purpose: ' || CASE WHEN s_suppkey % 3 = 0 THEN 'p' || s_suppkey ELSE 'Executes operation' END
 || chr(10) || '  - Inputs: None' || chr(10) || '  - Outputs: int' || CASE WHEN s_suppkey % 5 = 0 THEN chr(10) || '  - Summary: a / b' ELSE '' END AS block FROM supplier)
 SELECT CAST(src AS BIGINT) AS id, md5('[Direct Callees Summary]:' || chr(10) || string_agg(block, chr(10) ORDER BY dst)) AS summary FROM (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) JOIN b ON s_suppkey = dst GROUP BY src""")
def callee_summaries(spark, d):
    k, name = F.col("s_suppkey"), F.col("s_name")
    n = table(spark, d, "supplier").select(
        k.alias("id"), name.alias("name"), F.when(k % 2 == 0, F.concat(F.lit("q."), name)).alias("fqdn"), F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit(".c")).alias("rel_path"),
        F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("purpose"), F.lit("").alias("inputs"), F.lit("int").alias("outputs"), F.when(k % 5 == 0, "a \n b\nc").alias("overview"),
    )
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return links.callee_summaries(e, n).select("id", F.md5("summary").alias("summary"))


@query("""WITH p AS (SELECT page_id, 'src/' || regexp_extract(url, '://([^/?#]*)', 1) || '/' || CASE WHEN page_id % 4 = 0 THEN 'client.py' ELSE 'x' || page_id || '.c' END || '.fn.go.md' AS f FROM pages WHERE page_id % 3 = 0
 UNION ALL SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'main.py.type.T.md' ELSE 'tool' || page_id % 7 || '.py.md' END FROM pages WHERE page_id % 3 = 1
 UNION ALL SELECT page_id, 'lib/d' || page_id % 4 || '/' || CASE WHEN page_id % 2 = 0 THEN 'run.sh' ELSE 'b.c' END || '.md' FROM pages WHERE page_id % 3 = 2),
 m AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(f, '^src/(.*)/', 1) WHEN page_id % 3 = 1 THEN CASE WHEN page_id % 5 = 0 THEN 'main' ELSE 'tool' || page_id % 7 END WHEN page_id % 2 = 0 THEN 'd' || page_id % 4 ELSE 'lib' END AS module FROM p)
 SELECT module, CAST(count(*) AS BIGINT) AS n, CAST(min(page_id) AS BIGINT) AS first_id FROM m GROUP BY module""")
def module_groups(spark, d):
    i = F.col("page_id")
    s = lambda c: c.cast("string")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    a = F.concat(F.lit("src/"), host, F.lit("/"), F.when(i % 4 == 0, "client.py").otherwise(F.concat(F.lit("x"), s(i), F.lit(".c"))), F.lit(".fn.go.md"))
    b = F.when(i % 5 == 0, "main.py.type.T.md").otherwise(F.concat(F.lit("tool"), s(i % 7), F.lit(".py.md")))
    c = F.concat(F.lit("lib/d"), s(i % 4), F.lit("/"), F.when(i % 2 == 0, "run.sh").otherwise("b.c"), F.lit(".md"))
    docs = table(spark, d, "pages").select(i, F.when(i % 3 == 0, a).when(i % 3 == 1, b).otherwise(c).alias("file_name"))
    return docs.groupBy(documents.module_of(F.col("file_name")).alias("module")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


_ARCH = """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Main' || p_name WHEN p_partkey % 11 = 0 THEN 'orchestrate' ELSE 'q' || p_partkey END AS f, p_partkey % 4 = 0 AS role, p_size AS callees, p_partkey % 3 AS callers FROM part"""


@query(f"""WITH s AS (SELECT p_partkey, CASE WHEN regexp_matches(lower(f), 'main|cli|run|start|handler|app|serve|pipeline|engine|orchestrat') THEN 20 ELSE 0 END + CASE WHEN role THEN 15 ELSE 0 END + 2 * callees + CASE WHEN callers = 0 THEN 5 ELSE 0 END AS points FROM ({_ARCH}))
 SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(points AS BIGINT) AS points, CAST(row_number() OVER (ORDER BY points DESC, p_partkey) AS BIGINT) AS place FROM s ORDER BY points DESC, p_partkey LIMIT 60""")
def arch_topk(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("Main"), "p_name")).when(k % 11 == 0, "orchestrate").otherwise(F.concat(F.lit("q"), k.cast("string")))
    f = table(spark, d, "part").select(k, name.alias("file_name"), F.when(k % 4 == 0, "x").alias("ui_role"), F.col("p_size").alias("n_callees"), (k % 3).alias("n_callers"))
    return documents.top_functions(f, "p_partkey").select("p_partkey", "points", "place")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS place FROM nation")
def arch_topk_few(spark, d):
    """No more than 60 functions stay in input order, whatever their points."""
    f = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("file_name"), F.lit(None).cast("string").alias("ui_role"), F.col("n_regionkey").alias("n_callees"), F.lit(1).alias("n_callers"))
    return documents.top_functions(f, "n_nationkey").select("n_nationkey", "place")


@query()
def reduce_groups(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("line"))
    return documents.reduce_summaries(Scratch(spark), docs, "source", "doc_id", "line")


@query(r"""WITH RECURSIVE x AS (SELECT coalesce(source, '') AS g, t, length(t) AS n, CAST('0x' || substring(sha1(t), 1, 8) AS BIGINT) % 7 = 0 AS cut, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY t, doc_id) AS r FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
 f(g, r, k, items, chars, cut, t) AS (SELECT g, r, 0, 1, n, cut, t FROM x WHERE r = 1
 UNION ALL SELECT x.g, x.r, CASE WHEN f.cut OR f.items >= 15 OR f.chars + x.n > 3500 THEN k + 1 ELSE k END, CASE WHEN f.cut OR f.items >= 15 OR f.chars + x.n > 3500 THEN 1 ELSE f.items + 1 END,
 CASE WHEN f.cut OR f.items >= 15 OR f.chars + x.n > 3500 THEN x.n ELSE f.chars + x.n END, x.cut, x.t FROM f JOIN x ON x.g = f.g AND x.r = f.r + 1)
 SELECT g AS source, CAST(k AS BIGINT) AS chunk, sha256('English' || chr(10) || g || chr(10) || string_agg(t, chr(10) ORDER BY r)) AS key FROM f GROUP BY g, k""")
def reduce_level_keys(spark, d):
    """The keys by which the summaries of the lowest level are stored: whole texts, in the order of the texts."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("line"))
    scratch = Scratch(spark)
    placed = documents.numbered(scratch, docs, ["line", "doc_id"], by=["source"], name="order")
    chunks = documents.capped_chunks(scratch, placed, "source", "order", "line", stable=True)
    return documents.chunk_keys(placed.join(chunks, ["source", "order"]), "source", "chunk", "order", "line", "English").select("source", "chunk", "key")


def _pattern_sql(name: str) -> str:
    weight, patterns = interfaces.CLASSES[name]
    return " + ".join(f"{weight} * len(regexp_extract_all(t, '(?i){p.replace(chr(39), chr(39) * 2)}'))" for _, p in patterns)


_DECIDE = "CASE WHEN cli_score > 0 AND (cli_score >= gui_score OR gui_score = 0) THEN 'CLI' WHEN gui_score > 0 AND gui_score > cli_score THEN 'GUI' WHEN tui_score > 0 AND tui_score >= cli_score THEN 'TUI' WHEN cli_score > 0 THEN 'CLI' ELSE 'Library' END"
#: Texts with the patterns' subjects in them, dealt over the pages.
_CODE = ("import tkinter\nroot = tk.Tk()", "import curses\ncurses.initscr()", "parser = ArgumentParser()\nparser.add_argument('x')", "if __name__ == '__main__': pass", "gtk_window_new(); initscr(); new JFrame(", "class A : Activity { int argc }")
_PAGE = "page_id || '.' || CASE WHEN page_id % 5 = 0 THEN 'main.py' WHEN page_id % 7 = 0 THEN '_CLI.py' ELSE 'c' END"


def _code_sql() -> str:
    code = ", ".join("'" + c.replace("'", "''") + "'" for c in _CODE)
    return f"SELECT page_id, html || list_extract([{code}, ''], CAST(page_id % 7 AS INT) + 1) AS t, {_PAGE} AS f FROM pages".replace("\n", "' || chr(10) || '")


def _code(spark, d):
    i = F.col("page_id")
    f = F.concat(i.cast("string"), F.lit("."), F.when(i % 5 == 0, "main.py").when(i % 7 == 0, "_CLI.py").otherwise("c"))
    return table(spark, d, "pages").select("page_id", F.concat("html", F.element_at(F.array(*map(F.lit, (*_CODE, ""))), (i % 7 + 1).cast("int"))).alias("text"), f.alias("file"))


@query(f"""WITH s AS (SELECT page_id, CAST({_pattern_sql('gui')} AS BIGINT) AS gui_score, CAST({_pattern_sql('tui')} AS BIGINT) AS tui_score,
 CAST({_pattern_sql('cli')} + CASE WHEN contains(lower(f), '_cli.') THEN 15 WHEN contains(lower(f), 'main.py') THEN 5 ELSE 0 END AS BIGINT) AS cli_score FROM ({_code_sql()}))
 SELECT CAST(page_id AS BIGINT) AS page_id, gui_score, tui_score, cli_score, {_DECIDE} AS decision FROM s""")
def pattern_scores(spark, d):
    s = interfaces.scores(_code(spark, d), "text", "file")
    return s.select("page_id", "gui_score", "tui_score", "cli_score", interfaces.decide(F.col("gui_score"), F.col("tui_score"), F.col("cli_score")).alias("decision"))


@query(f"""WITH s AS (SELECT CAST(sum({_pattern_sql('gui')}) AS BIGINT) AS gui_score, CAST(sum({_pattern_sql('tui')}) AS BIGINT) AS tui_score, CAST(sum({_pattern_sql('cli')}) AS BIGINT) AS cli_score, sum(len(regexp_extract_all(t, '(?i)argparse|argumentparser|add_argument|parse_args'))) AS parsers FROM ({_code_sql()}))
 SELECT {_DECIDE} AS ui_type, CASE {_DECIDE} WHEN 'CLI' THEN CASE WHEN parsers > 0 THEN 'argparse' END WHEN 'GUI' THEN 'Android UI' END AS framework, gui_score, tui_score, cli_score, true AS has_ui FROM s""")
def ui_decision(spark, d):
    """Of all pages, no paths that count."""
    return interfaces.detect(_code(spark, d).withColumn("file", F.lit("x")))


@query(f"""WITH u AS (SELECT *, list_extract(['GUI', 'CLI', 'TUI', 'Library'], CAST(unique_id AS INT) % 4 + 1) AS u FROM ({_INDEX}))
 SELECT unique_id, CASE u WHEN 'GUI' THEN 'Supports GUI internal processing and data flow.' WHEN 'CLI' THEN CASE WHEN unique_id LIKE '%1' THEN 'Controls terminal standard output and error rendering.' ELSE 'Executes processing in CLI execution pipeline.' END
 WHEN 'TUI' THEN CASE WHEN unique_id LIKE '%2' THEN 'Handles keyboard navigation and terminal interaction events.' ELSE 'Manages TUI screen state and internal logic.' END ELSE 'Provides public API endpoints or internal library modules.' END AS role FROM u""")
def symbol_roles(spark, d):
    s, i = _index(spark, d), F.col("unique_id")
    kind = F.element_at(F.array(*map(F.lit, ("GUI", "CLI", "TUI", "Library"))), i.cast("int") % 4 + 1)
    name = F.when(i.endswith("1"), "PrintIt").when(i.endswith("2"), "OnKey").otherwise("zz")
    return s.select("unique_id", interfaces.role(kind, name, F.col("kind"), F.col("signature"), F.lit("")).alias("role"))


@query("""WITH t AS (SELECT r_regionkey AS r, n_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY n_nationkey, c_mktsegment ORDER BY c_custkey) AS k, c_mktsegment AS m, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
 SELECT 'world.py::type.' || r_name AS unique_id, 'world.' || r_name AS fqdn FROM region UNION ALL SELECT 'world.py::type.' || r_name || '.' || n_name, 'world.' || r_name || '.' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
 UNION ALL SELECT 'world.py::fn.' || r_name || '.' || n_name || '.' || m || CASE WHEN k = 1 THEN '' ELSE '#' || k END, 'world.' || r_name || '.' || n_name || '.' || m FROM t""")
def flatten_tree(spark, d):
    node = lambda parent, ordinal, key, kind, name: [F.lit("world.py").alias("path"), parent.alias("parent"), F.col(ordinal).alias("ordinal"), key.alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name")]
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, d, "region").select(*node(F.lit(None).cast("string"), "r_regionkey", of("r", "r_regionkey"), "class", "r_name"))
    n = table(spark, d, "nation").select(*node(of("r", "n_regionkey"), "n_nationkey", of("n", "n_nationkey"), "class", "n_name"))
    c = table(spark, d, "customer").select(*node(of("n", "c_nationkey"), "c_custkey", of("c", "c_custkey"), "method", "c_mktsegment"))
    return listing.flatten_tree(r.union(n).union(c)).select("unique_id", "fqdn")


@query("""SELECT n_name AS label, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN 'L' || n_nationkey WHEN n_nationkey % 3 = 1 THEN '' END, ''), n_comment_default) AS text FROM (SELECT n_name, n_nationkey, 'D' || n_regionkey AS n_comment_default FROM nation)""")
def label_overlay(spark, d):
    from tessera.functions import labels

    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    defaults = n.select(F.col("n_name").alias("key"), F.concat(F.lit("D"), F.col("n_regionkey").cast("string")).alias("text"))
    loaded = n.select(F.col("n_name").alias("key"), F.when(k % 3 == 0, F.concat(F.lit("L"), k.cast("string"))).when(k % 3 == 1, "").alias("text"))
    return labels.overlay(defaults, loaded).select(F.col("key").alias("label"), "text")


@query("""SELECT CAST(count(*) FILTER (n_nationkey % 3 <> 0) AS BIGINT) AS untranslated, count(*) FILTER (n_nationkey % 3 <> 0) * 2 > count(*) AS incomplete FROM nation WHERE n_nationkey <> 4""")
def untranslated_labels(spark, d):
    from tessera.functions import labels

    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    defaults = n.select(F.col("n_name").alias("key"), F.lit("D").alias("text"), (k == 4).alias("neutral"))
    loaded = n.where(k % 3 != 1).select(F.col("n_name").alias("key"), F.when(k % 3 == 0, "L").otherwise("D").alias("text"))
    return labels.untranslated(defaults, loaded)


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Japanese' WHEN 1 THEN 'German' WHEN 2 THEN 'English' WHEN 3 THEN 'Portuguese' WHEN 4 THEN 'Klingon' ELSE 'English' END AS language, CAST(CASE c_custkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 END AS INT) AS step,
 CASE c_custkey % 6 WHEN 0 THEN 'http://127.0.0.1:11434/v1' WHEN 1 THEN 'http://box:80/v1' WHEN 2 THEN 'https://a.b/v1' ELSE 'http://c/x/v1' END AS host,
 CASE WHEN c_custkey % 6 = 2 THEN 'plain' ELSE 'Does work.' END AS context, CASE c_custkey % 3 WHEN 0 THEN '--:--' WHEN 1 THEN '02:05' ELSE '01:00:01' END AS eta FROM customer""")
def name_forms(spark, d):
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return table(spark, d, "customer").select(
        k, naming.language(pick(" 日本語 ", "de_DE.UTF-8@euro", "C.UTF-8", "pt-BR:en", "klingon", None)).alias("language"),
        naming.step_number(pick("README ", "var", "3", "symbols", "7", None)).alias("step"),
        naming.host_url(pick("", "box:80/", " https://a.b/v1/ ", "c/x", "c/x/v1", "http://c/x")).alias("host"),
        naming.without_persona(pick(" Does work. ", "Does work.", "Software Architect ", "Does work.", "Does work.", "Does work. "), F.lit("plain")).alias("context"),
        naming.clock(pick(None, 125.4, 3600.6)).alias("eta"),
    )


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, regexp_replace(source, '[^A-Za-z0-9_.-]', '_', 'g') AS file, trim(regexp_replace('## 3. ' || source, '^#+\\s*(\\d+\\.\\s*)?', '')) AS heading
 FROM (SELECT doc_id, source || ' é/x' AS s0, coalesce(source, '') || '::a b' AS source, coalesce(text, '') || 'x' AS t FROM documents)""")
def text_forms(spark, d):
    s = F.concat(F.coalesce("source", F.lit("")), F.lit("::a b"))
    docs = table(spark, d, "documents").select("doc_id", s.alias("s"), F.concat(F.coalesce("text", F.lit("")), F.lit("x")).alias("t"))
    lines = F.size(F.split("t", "\n")).cast("long")
    return docs.select("doc_id", lines.alias("n_lines"), naming.cache_file(F.col("s")).alias("file"), naming.heading_text(F.concat(F.lit("## 3. "), "s")).alias("heading"))


_COMMENTED = "'int a; /* ' || p_name || ' */ int b = \"//' || p_brand || '\"; // end' || chr(10) || chr(10) || '  if (a && b) return x ? y : z;'"


@query(f"""WITH c AS (SELECT p_partkey, 'int a;   int b = "//' || p_brand || '";' || chr(10) || 'if (a && b) return x ? y : z;' AS s FROM part)
 SELECT CAST(p_partkey AS BIGINT) AS p_partkey, s AS stripped, sha256('f()' || chr(10) || s) AS logic, 3.05 + CAST(0.05 * 2 + 0.3 * 2 + 0.2 AS DOUBLE) AS complexity FROM c""")
def logic_hash(spark, d):
    code = F.concat(F.lit("int a; /* "), "p_name", F.lit(' */ int b = "//'), "p_brand", F.lit('"; // end\n\n  if (a && b) return x ? y : z;'))
    p = table(spark, d, "part").select("p_partkey", code.alias("code"))
    p = p.withColumn("stripped", T.strip_c_comments(F.col("code")))
    return p.select("p_partkey", "stripped", T.logic_hash(F.lit("f()"), F.col("stripped")).alias("logic"), F.round(T.complexity(F.col("code"), F.lit(2), F.lit(1)), 6).alias("complexity"))


@query(r"""SELECT CAST(page_id AS BIGINT) AS page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(h, '(?s)/\*.*?\*/', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10)) AS stripped
 FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(html, '<!--', '/*'), '-->', '*/'), chr(39), ''), '"', ''), '//', ''), chr(13), '') AS h FROM pages)""")
def logic_hash_pages(spark, d):
    h = F.replace(F.replace(F.col("html"), F.lit("<!--"), F.lit("/*")), F.lit("-->"), F.lit("*/"))
    for gone in ("'", '"', "//", "\r"):
        h = F.replace(h, F.lit(gone), F.lit(""))
    return table(spark, d, "pages").select("page_id", T.strip_c_comments(h).alias("stripped"))
