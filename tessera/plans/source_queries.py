"""Queries of the text functions for sources, over the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.snippets import json_object, snippet
from tessera.plans.catalog import query
from tessera.session import table


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents")
def snippet_lines(spark, sf_dir):
    """Lines 2 to 4 of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))


@query(
    r"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE substring(props, 1, length(props) - 1) || '}' END AS found
FROM events WHERE json_valid(props)"""
)
def json_from_text(spark, sf_dir):
    """The JSON object in a noisy text; every second one is cut off before its last brace."""
    e = table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull())
    whole = F.concat(F.lit("The answer is "), F.col("props"), F.lit(" as asked."))
    cut = F.concat(F.lit("The answer is "), F.expr("substring(props, 1, length(props) - 1)"))
    return e.select("event_id", json_object(F.when(F.col("event_id") % 2 == 0, whole).otherwise(cut)).alias("found"))


@query("""SELECT n_name, n_name || chr(10) || 'of ' || n_regionkey AS doc FROM nation""")
def clean_docstrings(spark, sf_dir):
    from tessera.sources.blocks import clean_comment

    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("/** "), "n_name", F.lit("\n * of "), F.col("n_regionkey").cast("string"), F.lit("\n */"))
    return n.select("n_name", clean_comment(text).alias("doc"))


@query("""SELECT n_name, CAST(n_nationkey % 3 + 2 AS INT) AS last FROM nation""")
def block_end_lines(spark, sf_dir):
    """Functions of as many lines as the nation says, with a brace in a string."""
    from tessera.sources.blocks import block_ends

    body = F.concat(F.lit('int f() { s = "}";\n'), F.repeat(F.lit("  x;\n"), (F.col("n_nationkey") % 3).cast("int")), F.lit("}\nint g;"))
    return table(spark, sf_dir, "nation").select("n_name", block_ends(body, F.lit(1)).alias("last"))


_BLOCK = """CASE doc_id % 4 WHEN 0 THEN 'int f() {' || chr(10) || x || chr(10) || '}' || chr(10) || 'int g;' WHEN 1 THEN 'int x' || chr(10) || ' = 1;' || chr(10) || x
 WHEN 2 THEN repeat('a' || chr(10), CAST(doc_id % 9 AS INT)) || '{ if (b) { /* } ' || chr(10) || '*/ c = "}"; }' || chr(10) || x || ' }' ELSE x END"""


@query(rf"""WITH t AS (SELECT doc_id, {_BLOCK} AS t FROM (SELECT doc_id, replace(coalesce(text, ''), chr(13), '') AS x FROM documents)),
 k AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)/\*.*?(?:\*/|\z)|//[^\n]*|"(?:[^"\\\n]+|\\[^\n]?)*"?|''(?:[^''\\\n]+|\\[^\n]?)*''?|[{{}};\n]') AS ks FROM t),
 m AS (SELECT doc_id, i, ks[i] AS m FROM k, range(1, len(ks) + 1) r(i)),
 r AS (SELECT doc_id, i, m, 1 + coalesce(sum(length(m) - length(replace(m, chr(10), ''))) OVER before, 0) AS line, coalesce(sum(CASE m WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS depth,
  coalesce(sum(CAST(m = '{{' AS INT)) OVER before, 0) AS opens FROM m WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT doc_id, min(line) FILTER (m = '{{') AS body, min(line) FILTER (depth = 0 AND (m = '}}' AND opens > 0 OR m = ';' AND opens = 0)) AS closed FROM r GROUP BY doc_id)
 SELECT CAST(k.doc_id AS BIGINT) AS doc_id, CAST(CASE WHEN least(body, closed) <= 7 THEN coalesce(closed, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END) ELSE 1 END AS INT) AS last FROM k LEFT JOIN e USING (doc_id)""")
def block_ends_documents(spark, sf_dir):
    """Blocks around all documents' texts, with the quotes, slashes and signs that these have."""
    from tessera.sources.blocks import block_ends

    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("x"))
    i, x = F.col("doc_id"), F.col("x")
    third = F.concat(F.repeat(F.lit("a\n"), (i % 9).cast("int")), F.lit('{ if (b) { /* } \n*/ c = "}"; }\n'), x, F.lit(" }"))
    text = F.when(i % 4 == 0, F.concat(F.lit("int f() {\n"), x, F.lit("\n}\nint g;"))).when(i % 4 == 1, F.concat(F.lit("int x\n = 1;\n"), x)).when(i % 4 == 2, third).otherwise(x)
    return docs.select("doc_id", block_ends(text, F.lit(1)).alias("last"))


@query(r"""SELECT file, snippet FROM (SELECT * FROM (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file, trim(regexp_extract(coalesce(text, ''), 'the (\w+)', 1)) AS snippet FROM documents ORDER BY file LIMIT 15) WHERE snippet <> '' ORDER BY file LIMIT 8)""")
def first_snippets(spark, sf_dir):
    """Of the first 15 documents by name the first 8 with a match: a top-k report."""
    from tessera.operators.documents import first_snippets as first

    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return first(docs, "file", "text", r"the (\w+)")


@query("""WITH p AS (SELECT 'src/n' || n_nationkey || '.c' AS path, n_nationkey AS k FROM nation) SELECT path, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 2 = 0 THEN 'c' ELSE 'kotlin' END AS adapter FROM (SELECT CASE WHEN k % 5 = 4 THEN path || 'x' WHEN k % 2 = 0 THEN path ELSE replace(path, '.c', '.KT') END AS path, k FROM p)""")
def adapter_dispatch(spark, sf_dir):
    from tessera.sources.adapters import default_registry

    k = F.col("n_nationkey")
    path = F.concat(F.lit("src/n"), k.cast("string"), F.when(k % 5 == 4, ".cx").when(k % 2 == 0, ".c").otherwise(".KT"))
    return table(spark, sf_dir, "nation").select(path.alias("path")).select("path", default_registry().adapter_of(F.col("path")).alias("adapter"))


@query("""WITH n AS (SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'enum' WHEN n_nationkey % 3 = 1 THEN 'method' ELSE 'object' END AS k, 'W.' || n_name AS q FROM nation)
 SELECT n_name, CASE k WHEN 'enum' THEN 'Defines status code, constant, or enumeration `' || n_name || '` in `W`.' WHEN 'method' THEN 'Executes `' || n_name || '` operations.' ELSE 'Defines `' || n_name || '` (object).' END AS purpose,
 CASE k WHEN 'enum' THEN 'Constant `' || n_name || '`.' ELSE 'Result `' || n_name || '`.' END AS outputs FROM n""")
def static_descriptions(spark, sf_dir):
    from tessera.functions.markdown import static_description

    k = F.col("n_nationkey")
    kind = F.when(k % 3 == 0, "enum").when(k % 3 == 1, "method").otherwise("object")
    told = static_description(F.col("n_name"), kind, F.lit(""), F.concat(F.lit("W."), "n_name"))
    return table(spark, sf_dir, "nation").select("n_name", told["purpose"].alias("purpose"), told["outputs"].alias("outputs"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'Function Documentation: `' || n_name || '`' AS title, 'Function' AS kind, n_name || '(int a)' AS signature, 'g' || n_regionkey || ',h' AS callees, '- **UI Type**: `CLI` (x)' || chr(10) || '- **Interaction Specification**: Runs ' || n_name || '.' AS ui_role FROM nation""")
def document_round_trip(spark, sf_dir):
    """A document of each nation as a function is rendered, given its role, and parsed."""
    from tessera.functions import markdown as M

    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    n = table(spark, sf_dir, "nation")
    s = {
        "name": F.col("n_name"), "kind": F.lit("function"), "fqdn": F.lit(""), "signature": F.concat("n_name", F.lit("(int a)")), "line_start": F.lit(1), "line_end": F.lit(2), "purpose": F.lit("Does."), "context": none, "overview": none,
        "inputs": none, "outputs": none, "return_type": none, "params": F.array(F.lit("a: int")), "callees": F.array(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")), F.lit("h")), "callers": empty, "snippet": F.lit("x"),
    }
    docs = n.select("n_nationkey", "n_name", M.symbol_section(s, 1, "c").alias("t"))
    docs = docs.withColumn("t", M.with_role(F.col("t"), F.lit("CLI"), F.lit("x"), F.concat(F.lit("Runs "), "n_name", F.lit("."))))
    parsed = M.parse_document(F.col("t"))
    return docs.select(
        F.col("n_nationkey").cast("long").alias("n_nationkey"), *[parsed[k].alias(k) for k in ("title", "kind", "signature")], F.array_join(parsed["callees"], ",").alias("callees"), parsed["ui_role"].alias("ui_role")
    )
