"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_PASSES = 1.5, 2
BLOCK_WORDS = 16
#: Documents of a source that one shard has on average: a shard is ordered within one task.
SHARD_DOCS = 2000


def size_of(text_col: str):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: float = MOST_PASSES) -> DataFrame:
    """sizes(source, source_size, ...) plus ``target``: one row a source.

    Sources in code point order, null last, take the weights in turn. They share ``share`` of all words; a target stops
    at ``passes`` times its source and the excess is shared anew by weight. In order of passes * size / weight the
    sources that stop come first, so one running sum finds the common level: the first source whose own limit is above
    (words left) / (weights left) ends the stopped ones. The window runs over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(k == i, F.lit(w)).otherwise(weight)
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(passes)))
    every = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight_left)
    open_level = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("l")))).over(every)
    target = F.least("most", F.coalesce(F.col("weight") * open_level["l"], F.col("most")))
    return s.withColumn("target", target).drop("most", "total", "level", "weight")


#: Sources up to which their plan is broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sainte_lague(parties: DataFrame, by: str | None, party: str, votes: str, seats: str) -> DataFrame:
    """parties plus integer ``won``: the ``seats`` of a group go to the highest quotients votes / (2 k + 1), ties by name.

    With a lowest winning quotient t a party of v votes has floor(v / 2t + 1/2) seats, between v / 2t - 1/2 and v / 2t + 1/2.
    Summed over the m parties of a group, 1 / 2t lies between (seats - m / 2) / votes and (seats + m / 2) / votes of the
    group. So a party surely has the seats of the lower end and none beyond those of the upper end; only the quotients
    between, about 3 m a group, compete. Groups without votes get none.
    """
    whole = Window.partitionBy(F.lit(0) if by is None else F.col(by))
    v = F.col(votes).cast("double")
    p = parties.withColumns({"_all": F.sum(v).over(whole), "_m": F.count("*").over(whole)})
    least = lambda d: F.floor(F.coalesce(F.try_divide(v * F.greatest(F.lit(0.0), F.col(seats) + d * F.col("_m") / 2), F.col("_all")), F.lit(0.0)) + 0.5)
    p = p.withColumns({"_base": F.greatest(F.lit(0), least(-1.0) - 1).cast("long"), "_top": (least(1.0) + 1).cast("long")})
    p = p.withColumn("_free", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_base").over(whole)).otherwise(0))
    p = p.withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_top"))))
    p = p.withColumn("_rank", F.row_number().over(whole.orderBy((v / (2 * F.col("_k") + 1)).desc(), party, "_k")))
    mine = [party] if by is None else [by, party]
    won = p.groupBy(*mine).agg(F.when(F.first("_all") > 0, F.first("_base") + F.count_if(F.col("_rank") <= F.col("_free"))).otherwise(0).cast("long").alias("won"))
    return parties.join(won, mine)


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: row, doc_id, source, size, source_size, target, taken, passes, skip, run.

    Within a shard (by hash) documents stand in seeded order and their words form one stream of BLOCK_WORDS blocks. Every
    source's target is apportioned in blocks, then to its shards: whole passes over the shard, and for the rest a seeded
    circular run of blocks. A document gives ``passes`` whole copies and the words [skip, skip + run) (circular runs may
    give it two pieces; ``run`` counts both). Null texts have size 0; null sources are a source of their own. Reruns and
    other partitionings agree; repeated rows are rows of their own but tie, so they may swap places.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size_of(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col)).alias("row"),
    )
    # Texts are read once: all later steps read this narrow table.
    return _plan(Scratch(docs.sparkSession).save(rows, "sizes"), seed)


def _plan(rows: DataFrame, seed: int) -> DataFrame:
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = targets(per_source)
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SHARD_DOCS)).cast("long"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    goal = goal.withColumn("_key", key).drop("source")
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS).cast("long")
    goal = sainte_lague(goal.withColumn("seats", seats), None, "_key", "target", "seats").withColumnRenamed("won", "blocks").drop("seats")
    if goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    placed = rows.withColumn("_key", key).join(goal, "_key")
    placed = placed.withColumn("shard", F.pmod(F.col("row"), F.col("shards")))

    per_shard = placed.groupBy("_key", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    per_shard = sainte_lague(per_shard, "_key", "shard", "shard_size", "blocks")
    # A shard gives no word more than MOST_PASSES times.
    words = F.least(F.col("won") * BLOCK_WORDS, F.col("shard_size") * MOST_PASSES)
    per_shard = per_shard.withColumn("words", words).select("_key", "shard", "shard_size", "words")
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), F.col("_key"), F.col("shard")), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / BLOCK_WORDS)))
    per_shard = per_shard.withColumn("start", start * BLOCK_WORDS)

    stream = Window.partitionBy("_key", "shard").orderBy("row", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("begin", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    at = at.join(per_shard, ["_key", "shard"])
    passes = F.coalesce(F.try_divide(F.col("words"), F.col("shard_size")), F.lit(0)).cast("long")
    at = at.withColumn("passes", passes).withColumn("need", F.col("words") - F.col("passes") * F.col("shard_size"))
    end = F.col("begin") + F.col("size")
    stop = F.col("start") + F.col("need")
    # The run [start, start + need) of the circular stream, and its part past the end, [0, stop - shard_size).
    late_from, late_to = F.greatest("begin", "start"), F.least(end, stop)
    one = F.greatest(F.lit(0), late_to - late_from)
    two = F.greatest(F.lit(0), F.least(end, stop - F.col("shard_size")) - F.col("begin"))
    at = at.withColumn("_two", two.cast("long")).withColumn("_one", one.cast("long"))
    at = at.withColumn("skip", F.when(F.col("_one") > 0, late_from - F.col("begin")).otherwise(0).cast("long"))
    taken = F.col("passes") * F.col("size") + F.col("_one") + F.col("_two")
    return at.select(
        "row", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "passes", "skip",
        F.col("_one").alias("run"), F.col("_two").alias("head"),
    )


def materialise(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of docs: whole copies, and the word runs of documents at the edge of a run.

    A document may stand twice; a run keeps its words, joined by single spaces. Rows that give no word go.
    """
    plan = mix(docs, seed).select(F.col("row").alias("__row"), *[F.col(c).alias(f"__{c}") for c in ("size", "passes", "skip", "run", "head")])
    plan = plan.dropDuplicates(["__row"])
    own = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.col("source"))
    joined = docs.withColumn("__own", own).join(plan, F.col("__own") == F.col("__row"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    piece = lambda skip, run: F.when(run >= F.col("__size"), F.col("text")).otherwise(F.array_join(F.slice(words, (skip + 1).cast("int"), run.cast("int")), " "))
    parts = F.array(
        F.when(F.col("__passes") >= 1, F.col("text")),
        F.when(F.col("__passes") >= 2, F.col("text")),
        F.when(F.col("__run") > 0, piece(F.col("__skip"), F.col("__run"))),
        F.when(F.col("__head") > 0, piece(F.lit(0), F.col("__head"))),
    )
    parts = F.filter(F.when(F.col("__size") > 0, parts), lambda p: p.isNotNull())
    out = joined.withColumn("__text", F.explode(parts))
    cols = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
