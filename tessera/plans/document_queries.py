"""Queries over documents, names and stamps of an index, over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import naming
from tessera.operators import documents, incremental, listing
from tessera.plans.catalog import query
from tessera.plans.listing_queries import _INDEX, _index
from tessera.session import table

#: The prefix of each of the index's kinds, worked by hand.
_PREFIX = """CASE lower(kind) WHEN 'function' THEN 'fn' WHEN 'method' THEN 'fn' WHEN 'constructor' THEN 'fn' WHEN 'destructor' THEN 'fn' WHEN 'variable' THEN 'var' WHEN 'field' THEN 'type'
 WHEN 'enum_constant' THEN 'const' WHEN 'macro' THEN 'const' WHEN 'class' THEN 'type' WHEN 'annotation' THEN 'type' ELSE 'sym' END"""


@query(f"""WITH s AS (SELECT *, CAST(unique_id AS BIGINT) AS k, {_PREFIX} AS p FROM ({_INDEX})),
 d AS (SELECT DISTINCT CASE k % 5 WHEN 0 THEN rel_path || '.' || p || '.' || name || '.md' WHEN 1 THEN rel_path || '.' || p || '.' || fqdn || '.md' WHEN 2 THEN 'lib.' || p || '.' || name || '.md' WHEN 3 THEN 'lib.x.' || name || '.md' END AS file FROM s WHERE k % 5 <> 4)
 SELECT unique_id, file, CAST(rank AS BIGINT) AS rank FROM (
  SELECT unique_id, file, CASE WHEN file = rel_path || '.' || p || '.' || name || '.md' THEN 0 WHEN file = rel_path || '.' || p || '.' || fqdn || '.md' THEN 1 WHEN contains(file, '.' || p || '.') THEN 3 ELSE 4 END AS rank
  FROM s JOIN d ON file = rel_path || '.' || p || '.' || fqdn || '.md' OR file LIKE '%.' || name || '.md')
 QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY rank, file) = 1""")
def symbol_documents(spark, d):
    """Documents named after symbols, after their FQDNs, or anywhere else by kind or by name alone; a fifth has none."""
    s = _index(spark, d)
    k, p = F.col("unique_id").cast("long"), listing.kind_prefix(F.col("kind"))
    own = lambda n: F.concat("rel_path", F.lit("."), p, F.lit("."), n, F.lit(".md"))
    other = F.when(k % 5 == 2, F.concat(F.lit("lib."), p, F.lit("."), "name", F.lit(".md"))).when(k % 5 == 3, F.concat(F.lit("lib.x."), "name", F.lit(".md")))
    docs = s.select(F.when(k % 5 == 0, own(F.col("name"))).when(k % 5 == 1, own(F.col("fqdn"))).otherwise(other).alias("file")).where("file IS NOT NULL")
    return listing.find_docs(s, docs)


#: What is asked, and the files that may answer, in order; worked by hand.
_ASKED = {
    "Arch": ["design/overview.md"], "runtime": ["design/execution_model.md"], " schema ": ["design/data_models.md"], "nowhere": [],
    "SRC1": ["design/modules/src1.md"], "lib/src2.py": ["design/modules/src2.md"], "notes": ["design/notes.md"],
}
_FILES = "list_extract(['design/modules/' || coalesce(source, 'none') || '.md', 'design/overview.md', 'design/execution_model.md', 'design/notes.md', 'README.md', 'design/data_models.md'], CAST(CASE WHEN doc_id < 5 THEN doc_id + 2 ELSE 1 END AS INT))"


@query("WITH f AS (SELECT " + _FILES + " AS file, max(doc_id) AS last FROM documents GROUP BY 1), a(section, file) AS (VALUES " + ", ".join(f"('{q}', '{f}')" for q, fs in _ASKED.items() for f in fs) + ") SELECT section, file, CAST(last AS BIGINT) AS last FROM a JOIN f USING (file)")
def section_documents(spark, d):
    i = F.col("doc_id")
    files = F.array(F.concat(F.lit("design/modules/"), F.coalesce("source", F.lit("none")), F.lit(".md")), *map(F.lit, ("design/overview.md", "design/execution_model.md", "design/notes.md", "README.md", "design/data_models.md")))
    docs = table(spark, d, "documents").select(F.get(files, F.when(i < 5, i + 1).otherwise(0).cast("int")).alias("file"), i).groupBy("file").agg(F.max("doc_id").alias("last"))
    found = [documents.find_section(docs, q).select(F.lit(q).alias("section"), "file", "last") for q in _ASKED]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("SELECT DISTINCT 'src' || s AS module FROM (SELECT regexp_extract(source, '^src(.+)$', 1) AS s FROM documents WHERE source LIKE 'src%') WHERE s <> ''")
def module_documents(spark, d):
    """Of all documents, each in a module's file, a design file or elsewhere, the names of the modules."""
    docs = table(spark, d, "documents").where("source LIKE 'src_%'")
    files = F.explode(F.array(F.concat(F.lit("design/modules/"), "source", F.lit(".md")), F.concat(F.lit("design/"), "source", F.lit(".md")), F.concat(F.lit("design/modules/x/"), "source", F.lit(".md"))))
    return documents.modules(docs.select(files.alias("file")).distinct())


@query("SELECT trim(string_agg(r_name, ' ' ORDER BY r_regionkey)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || (SELECT string_agg(n_name, ' ' ORDER BY n_nationkey) FROM nation) AS text FROM region")
def overview_text(spark, d):
    """README and overview, of names of regions and nations, with white space around them."""
    joined = lambda t, key, name: table(spark, d, t).agg(F.sort_array(F.collect_list(F.struct(key, name))).alias("x")).select(F.concat(F.lit("  "), F.array_join(F.transform("x", lambda r: r[name]), " "), F.lit("  ")).alias("text"))
    readme, other = joined("region", "r_regionkey", "r_name").withColumn("file", F.lit("README.md")), joined("nation", "n_nationkey", "n_name").withColumn("file", F.lit("design/overview.md"))
    return documents.overview(other.unionByName(readme).unionByName(readme.withColumn("file", F.lit("x.md"))))


@query("""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, CASE WHEN c_custkey % 4 <> 0 THEN 'n' || c_nationkey END, c_name], lambda x: x IS NOT NULL AND x <> ''), '::') AS fqdn FROM customer""")
def scoped_names(spark, d):
    k = F.col("c_custkey")
    scopes = F.array(F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.when(k % 4 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))
    return table(spark, d, "customer").select("c_custkey", naming.fqdn(scopes, F.col("c_name"), "::").alias("fqdn"))


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN doc_id % 7 = 0 OR contains(coalesce(text, ''), 'CLI') OR contains(coalesce(text, ''), 'main(') OR doc_id % 11 = 0 THEN 'cli'
 WHEN doc_id % 5 = 0 THEN 'gui' WHEN doc_id % 2 = 0 THEN 'library' ELSE 'default' END AS kind FROM documents""")
def project_types(spark, d):
    """Documents as overviews of projects with all kinds of names and notes."""
    i = F.col("doc_id")
    notes = F.when(i % 11 == 0, "is a `CLI` program").when(i % 5 == 0, F.when(i % 2 == 0, "QMainWindow").otherwise("a GUI")).otherwise("plain")
    name = F.when(i % 7 == 0, "My-CLI-tool").when(i % 3 != 0, "server")
    return table(spark, d, "documents").select("doc_id", documents.project_type(name, F.col("text"), notes, i % 2 == 0).alias("kind"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN TIMESTAMP '2024-05-06 07:08:09' ELSE TIMESTAMP '2020-01-01 00:00:00' END AS updated_at FROM orders""")
def stamped_rows(spark, d):
    """A third of the orders is not stored yet, a quarter is stored with another price; the others keep their stamps."""
    new = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k, at = F.col("o_orderkey"), lambda *x: F.lit(datetime(*x)).cast("timestamp_ntz")
    old = new.where(k % 3 != 0).withColumns({"o_totalprice": F.when(k % 4 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice").cast("double")).cast(new.schema["o_totalprice"].dataType), "updated_at": at(2020, 1, 1)})
    return incremental.stamped(old, new, "o_orderkey", at(2024, 5, 6, 7, 8, 9)).select("o_orderkey", "updated_at")
