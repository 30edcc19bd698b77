"""Chunking, classification, cost-model and timing queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import costs
from tessera.operators import chunks as C
from tessera.operators import reduce as R
from tessera.plans.catalog import query
from tessera.plans.scratch import Scratch
from tessera.session import table


@query("""WITH b AS (SELECT doc_id, source, CAST(CAST('0x' || substring(sha1(text), 1, 8) AS BIGINT) % 7 = 0 AS BIGINT) AS cut FROM documents)
 SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(sum(cut) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk FROM b""")
def hash_boundaries(spark, d):
    return C.hash_chunks(Scratch(spark), table(spark, d, "documents"), "source", "doc_id", "text").select("doc_id", "source", "chunk")


_FOLD = """WITH RECURSIVE x AS (SELECT source, doc_id, length(text) AS n, {cut} AS cut, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
 f(source, doc_id, r, k, items, chars, cut) AS (SELECT source, doc_id, r, 0, 1, n, cut FROM x WHERE r = 1
 UNION ALL SELECT x.source, x.doc_id, x.r, CASE WHEN f.cut OR f.items >= 15 OR f.chars + x.n > 3500 THEN k + 1 ELSE k END, CASE WHEN f.cut OR f.items >= 15 OR f.chars + x.n > 3500 THEN 1 ELSE f.items + 1 END,
 CASE WHEN f.cut OR f.items >= 15 OR f.chars + x.n > 3500 THEN x.n ELSE f.chars + x.n END, x.cut FROM f JOIN x ON x.source = f.source AND x.r = f.r + 1)
 SELECT source, CAST(doc_id AS BIGINT) AS doc_id, CAST(k AS BIGINT) AS chunk FROM f"""


@query(_FOLD.format(cut="false"))
def chunks_by_size(spark, d):
    return C.capped_chunks(Scratch(spark), table(spark, d, "documents"), "source", "doc_id", "text")


@query(_FOLD.format(cut="CAST('0x' || substring(sha1(text), 1, 8) AS BIGINT) % 7 = 0"))
def chunks_stable(spark, d):
    return C.capped_chunks(Scratch(spark), table(spark, d, "documents"), "source", "doc_id", "text", stable=True)


@query("SELECT " + ", ".join([f"round(sum(pow(x, {p})) / 1e6, 3) AS sx{p}" for p in range(5)] + [f"round(sum(y * pow(x, {p})) / 1e9, 3) AS sy{p}" for p in range(4)])
       + " FROM (SELECT greatest(l_quantity, 1.0) AS x, greatest(l_extendedprice, 0.01) AS y FROM lineitem)")
def poly_power_sums(spark, d):
    s = table(spark, d, "lineitem").agg(*R.power_sums(F.col("l_quantity"), F.col("l_extendedprice")))
    return s.select(*[F.round(F.col(f"sx{p}") / 1e6, 3).alias(f"sx{p}") for p in range(5)], *[F.round(F.col(f"sy{p}") / 1e9, 3).alias(f"sy{p}") for p in range(4)])


def _gauss(sums: str, by: str) -> str:
    """SQL of the 4 x 4 system with a ridge, one unknown eliminated at a time, and the values at 10 to 50."""
    cells = [(i, j) for i in range(4) for j in range(5)]
    start = ", ".join(f"sx{i + j}{' + 0.00001' if i == j else ''} AS a{i}{j}" if j < 4 else f"sy{i} AS a{i}4" for i, j in cells)
    steps, at = [f"g0 AS (SELECT {by}{start} FROM ({sums}))"], "g0"
    for k in range(3):
        row = ", ".join(f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" if i > k else f"a{i}{j}" for i, j in cells)
        steps.append(f"g{k + 1} AS (SELECT {by}{row} FROM {at})")
        at = f"g{k + 1}"
    back = "c3 AS (SELECT *, a34 / a33 AS c3 FROM g3), c2 AS (SELECT *, (a24 - a23 * c3) / a22 AS c2 FROM c3), c1 AS (SELECT *, (a14 - a12 * c2 - a13 * c3) / a11 AS c1 FROM c2), c0 AS (SELECT *, (a04 - a01 * c1 - a02 * c2 - a03 * c3) / a00 AS c0 FROM c1)"
    return f"{', '.join(steps)}, {back} SELECT {by}CAST(x AS BIGINT) AS x, round(greatest(0.05, c0 + c1 * x + c2 * x * x + c3 * x * x * x), 2) AS predicted FROM c0, (VALUES (10), (20), (30), (40), (50)) v(x)"


_SUMS = ", ".join([f"sum(pow(q, {p})) AS sx{p}" for p in range(7)] + [f"sum(t * pow(q, {p})) AS sy{p}" for p in range(4)])
_HUNDRED = """SELECT CAST(l_suppkey AS BIGINT) AS key, l_returnflag AS category, greatest(l_quantity, 1.0) AS q, greatest(floor(l_extendedprice / 100), 0.01) AS t FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) <= 100"""


@query("WITH " + _gauss(f"SELECT {_SUMS} FROM (SELECT greatest(l_quantity, 1.0) AS q, greatest(floor(l_extendedprice / 100), 0.01) AS t FROM lineitem)", ""))
def poly_fit(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", F.floor(F.col("l_extendedprice") / 100).alias("t"))
    at = R.fits(rows, "l_quantity", "t").select(F.explode(F.array(*[F.lit(x).cast("long") for x in (10, 20, 30, 40, 50)])).alias("x"), "coeffs")
    return at.select("x", F.round(costs.polynomial(F.col("coeffs"), F.col("x")), 2).alias("predicted"))


@query("WITH " + _gauss(f"SELECT key, category, {_SUMS} FROM ({_HUNDRED}) GROUP BY ALL", "key, category, "))
def category_fits(spark, d):
    """Each supplier is a server, each return flag a category; the last hundred lines are its measurements."""
    log = table(spark, d, "lineitem").withColumn("t", F.floor(F.col("l_extendedprice") / 100))
    found = R.category_fits(log, "l_suppkey", "l_returnflag", "l_quantity", "t", [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")])
    wanted = found.select("key", "category", F.explode(F.array(*[F.lit(x).cast("long") for x in (10, 20, 30, 40, 50)])).alias("lines"), F.lit(1.0).alias("complexity"))
    return costs.predict_durations(wanted, found).select("key", "category", F.col("lines").alias("x"), F.round("seconds", 2).alias("predicted"))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CAST(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 60000000, true) AS BIGINT) AS is_cold FROM events""")
def cold_start_flags(spark, d):
    return R.cold_flags(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", F.col("is_cold").cast("long").alias("is_cold"))


@query("""WITH RECURSIVE c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 60000000, true) AS cold FROM events) WHERE cold),
 v AS (SELECT user_id, r, CAST(round_even(greatest(value, 0.01) * 100, 0) AS BIGINT) AS x FROM c),
 f(user_id, r, e) AS (SELECT user_id, r, x FROM v WHERE r = 1 UNION ALL SELECT v.user_id, v.r, t // 10 + CASE WHEN t % 10 > 5 OR (t % 10 = 5 AND t // 10 % 2 = 1) THEN 1 ELSE 0 END FROM f JOIN v ON v.user_id = f.user_id AND v.r = f.r + 1, LATERAL (SELECT 7 * f.e + 3 * v.x AS t))
 SELECT CAST(f.user_id AS BIGINT) AS user_id, arg_max(e, f.r) / 100 AS cold, max(x) / 100 AS most_cold FROM f JOIN v ON v.user_id = f.user_id AND v.r = f.r GROUP BY f.user_id""")
def cold_ema(spark, d):
    events = R.cold_flags(table(spark, d, "events"), "user_id", "ts", "event_id")
    return R.cold_starts(events, "user_id", ["ts", "event_id"], "value")


@query("SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def last_n_samples(spark, d):
    return R.last_n(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id")


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
 WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) >= 1800000000 GROUP BY 1""")
def debounce_sessions(spark, d):
    from tessera.streaming.debounce import sessions

    return sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("""WITH RECURSIVE p AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, turn, CASE WHEN (turn + conv_id) % 4 = 0 THEN text || repeat(' ', 10) ELSE repeat(' ' || chr(10), CAST(5 + conv_id % 9 AS INT)) END AS x FROM conversations),
 f(k, r, turn, n, hit) AS (SELECT k, r, turn, length(x) - length(rtrim(x, ' ' || chr(10))), false FROM p WHERE r = 1
 UNION ALL SELECT p.k, p.r, p.turn, CASE WHEN trim(x, ' ' || chr(10)) = '' THEN n + length(x) ELSE length(x) - length(rtrim(x, ' ' || chr(10))) END, trim(x, ' ' || chr(10)) = '' AND n + length(x) >= 50 FROM f JOIN p ON p.k = f.k AND p.r = f.r + 1)
 SELECT CAST(k AS BIGINT) AS conv_id, CAST(min(turn) AS BIGINT) AS turn FROM f WHERE hit GROUP BY k""")
def stopped_answers(spark, d):
    """Each conversation is an answer in pieces, three of four of them blank."""
    from tessera.streaming.pieces import stopped

    k, t = F.col("conv_id"), F.col("turn")
    piece = F.when((t + k) % 4 == 0, F.concat("text", F.repeat(F.lit(" "), F.lit(10)))).otherwise(F.repeat(F.lit(" \n"), (5 + k % 9).cast("int")))
    return stopped(table(spark, d, "conversations").select(k, t, piece.alias("piece")), "conv_id", "turn", "piece")


@query("""SELECT c_custkey, c_mktsegment || CASE WHEN r = 1 THEN '' ELSE '#' || r END AS uid FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer)""")
def dup_ordinals(spark, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    uid = F.concat("c_mktsegment", F.when(r == 1, "").otherwise(F.concat(F.lit("#"), r.cast("string"))))
    return table(spark, d, "customer").select("c_custkey", uid.alias("uid"))


