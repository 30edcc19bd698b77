"""Conversation repair with Spark SQL's higher-order functions: the cheapest edits that give a legal order of roles.

Rows of a conversation get their place in it, windows mark their faults, and ``aggregate()`` folds the sorted turn structs over
the four states of the pattern ``(s?(ua)+)?`` (nothing yet, after s, after u, after a). A state is a struct (cost, audit), so
``least`` takes the cheapest edits and, among these, the ASCII-least audit. Equal costs never have an audit that begins with the other
one (an audit names its edits, so the longer one would cost more); so the order of two audits stays as more letters follow.

A conversation of any length: the fold is done per CHUNK turns, from all four states, which gives a matrix of (cost, audit);
matrices of one conversation are multiplied, FAN at a time. No task holds more turns than a chunk has. The audit and the hash
are single values of a conversation; the hash reads the repaired lines as a sorted stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.places import numbered
from tessera.plans.scratch import Scratch

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, LATE = 2, 3, 2, 1
#: Turns of one fold; matrices of one product.
CHUNK, FAN = 512, 64
#: Above any cost of possible edits.
NEVER = 1 << 40
SPACE = " \t\n\x0b\x0c\r"


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 takes its
    ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space, but turn stays null."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("__kind")).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__copy")).drop("__copy")


def _add(state: Column, cost: Column | int, letters: Column | str) -> Column:
    text = letters if isinstance(letters, Column) else F.lit(letters)
    return F.struct((state["c"] + (cost if isinstance(cost, Column) else F.lit(cost))).alias("c"), F.concat(state["t"], text).alias("t"))


def _four(*states: Column) -> Column:
    return F.struct(*[s.alias(f"a{i}") for i, s in enumerate(states)])


def _from(start: int | None) -> Column:
    """The states before any turn, ``start`` being the one possible."""
    return _four(*[F.struct(F.lit(0 if i == start else NEVER).cast("long").alias("c"), F.lit("").alias("t")) for i in range(4)])


def _inserted(a: Column) -> Column:
    """Up to two turns put in: to u from anywhere else, to a from u, or both."""
    u = F.least(a["a2"], *[_add(a[x], INSERT, "I") for x in ("a0", "a1", "a3")])
    end = F.least(a["a3"], _add(a["a2"], INSERT, "I"), *[_add(a[x], 2 * INSERT, "II") for x in ("a0", "a1")])
    return _four(a["a0"], a["a1"], u, end)


def _turned(a: Column, x: Column) -> Column:
    """The turn x is deleted, or stays as s, u or a."""
    gone = [_add(a[f"a{i}"], DELETE, "D") for i in range(4)]
    as_s = _add(a["a0"], x["s"], "K")
    as_u = _add(F.least(a["a0"], a["a1"], a["a3"]), x["u"], x["by_u"])
    as_a = _add(a["a2"], x["a"], x["by_a"])
    return _four(gone[0], F.least(gone[1], as_s), F.least(gone[2], as_u), F.least(gone[3], as_a))


def _fold(turns: Column, start: int) -> Column:
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (evaluates value once)
    return F.aggregate(turns, _from(start), lambda a, x: bound(_inserted(a), lambda b: _turned(b, x)))


def _product(matrices: Column, start: int) -> Column:
    def step(a: Column, x: Column) -> Column:
        end = lambda k: F.least(*[_add(a[f"a{j}"], x["m"][j][f"a{k}"]["c"], x["m"][j][f"a{k}"]["t"]) for j in range(4)])
        return _four(*[end(k) for k in range(4)])

    return F.aggregate(matrices, _from(start), step)


def _matrix(fold, values: Column, first: Column) -> Column:
    """Rows of the matrix: what each start gives; what comes first in a conversation has one start."""
    rest = [F.when(first, _from(None)).otherwise(fold(values, start)) for start in (1, 2, 3)]
    return F.array(fold(values, 0), *rest)


def _flagged(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """(conv_id, place, chunk, turn, initial, fault) of placed rows; the fault is blank, duplicate, truncated or null."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = placed.select(
        "conv_id", "place", F.floor(F.col("place") / CHUNK).alias("chunk"), "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("own"),
        F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("said"),
    )
    here = Window.partitionBy("conv_id", "chunk", "said").orderBy("place")
    rows = scratch.save(rows.withColumn("again", F.row_number().over(here) > 1), "turns")
    # A chunk says a text first at one place; only conversations of several chunks compare these places.
    long = rows.where("chunk > 0").select(F.col("conv_id").alias("_conv")).distinct()
    firsts = rows.where("NOT again").join(long, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("conv_id", "said").orderBy("place"))
    later = firsts.select("conv_id", "place", nth.alias("nth")).where("nth > 1").select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"))
    out = rows.join(later, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")), "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("again") | F.col("_place").isNotNull(), "duplicate").otherwise(F.col("own"))
    return out.select("conv_id", "place", "chunk", "turn", "initial", fault.alias("fault"))


def _chunks(flagged: DataFrame) -> DataFrame:
    """(conv_id, chunk, m, counts, first and last initial and turn), a row a chunk."""
    order = Window.partitionBy("conv_id", "chunk").orderBy("place")
    before, earlier = F.lag("initial").over(order), F.lag("turn").over(order)
    new_turn = F.col("turn").isNotNull() & (earlier.isNull() | (earlier != F.col("turn")))
    rows = flagged.withColumns({"odd": before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au"), "fresh": new_turn})
    gone, late = F.col("fault").isin("blank", "duplicate"), F.when(F.col("fault") == "truncated", LATE).otherwise(0)
    as_role = lambda i: F.when(gone, NEVER).when(F.col("initial") == i, late).otherwise(late + REROLE).cast("long")
    by = lambda i: F.when(F.col("initial") == i, "K").otherwise("R")
    gone = F.coalesce(gone, F.lit(False))
    stays = F.when(~gone & (F.col("initial") == "s"), late).otherwise(F.lit(NEVER)).cast("long")
    turn = F.struct("place", "turn", "initial", stays.alias("s"), as_role("u").alias("u"), by("u").alias("by_u"), as_role("a").alias("a"), by("a").alias("by_a"))
    count = lambda what: F.sum(F.coalesce(what, F.lit(False)).cast("long"))
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(turn)).alias("xs"), *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("odd")).alias("odd"), count(F.col("fresh")).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    first, last = F.get("xs", F.lit(0)), F.element_at("xs", -1)
    ends = [x[c].alias(f"{name}_{c}") for name, x in (("first", first), ("last", last)) for c in ("initial", "turn")]
    return chunks.select("*", _matrix(_fold, F.col("xs"), F.col("chunk") == 0).alias("m"), *ends).drop("xs")


def _counts(chunks: DataFrame) -> DataFrame:
    """(_conv, gaps, blank, duplicate, truncated, illegal): sums of the chunks, and what their borders add."""
    order = Window.partitionBy("conv_id").orderBy("chunk")
    before, earlier = F.lag("last_initial").over(order), F.lag("last_turn").over(order)
    rows = chunks.withColumns({"edge": before.isNotNull() & ~F.concat(before, "first_initial").isin("su", "ua", "au"), "same": F.coalesce(earlier == F.col("first_turn"), F.lit(False))})
    total = lambda *cs: sum((F.sum(F.col(c).cast("long")) for c in cs[1:]), F.sum(F.col(cs[0]).cast("long")))
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - (F.sum("turns") - total("same")), F.lit(0)).cast("long")
    faults = [total(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    return rows.groupBy(F.col("conv_id").alias("_conv")).agg(gaps.alias("gaps"), *faults, total("odd", "edge").alias("illegal"))


def _audits(scratch: Scratch, chunks: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) of the cheapest edits."""
    folds = chunks.select("conv_id", "chunk", "m")
    while folds.agg(F.max("chunk")).first()[0]:
        groups = folds.groupBy("conv_id", F.floor(F.col("chunk") / FAN).alias("group")).agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("ms"))
        folds = scratch.save(groups.select("conv_id", F.col("group").alias("chunk"), _matrix(_product, F.col("ms"), F.col("group") == 0).alias("m")), "product")
    a = F.col("m")[0]
    end = F.least(a["a0"], a["a3"], _add(a["a2"], INSERT, "I"), _add(a["a1"], 2 * INSERT, "II"))
    return folds.select("conv_id", end.alias("end")).select("conv_id", F.col("end.c").alias("cost"), F.col("end.t").alias("audit"))


def _lines(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, lines) of the repaired conversations, inserted turns before the row that they precede."""
    plan = F.regexp_extract_all("audit", F.lit("I*([DKR]|$)"), F.lit(0))
    parts = audits.select(F.col("conv_id").alias("_conv"), F.length(F.translate("audit", "D", "")).alias("n"), F.posexplode(plan).alias("_place", "edits")).where("edits <> ''")
    so_far = Window.partitionBy("_conv").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    put = F.length(F.regexp_replace("edits", "[DKR]", ""))
    parts = parts.withColumn("at", F.coalesce(F.sum(F.length(F.translate("edits", "D", ""))).over(so_far), F.lit(0)) - F.col("n") % 2).withColumn("put", put)
    role = lambda at: F.when(F.pmod(at, F.lit(2)) == 0, "user:").otherwise("assistant:")
    rows = parts.join(placed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")), "left")
    inserted = F.when(F.col("put") > 0, F.transform(F.sequence(F.lit(0), F.col("put") - 1), lambda i: role(F.col("at") + i))).otherwise(F.array().cast("array<string>"))
    head = F.when(F.endswith("edits", F.lit("K")), F.concat("role", F.lit(":"))).otherwise(role(F.col("at") + F.col("put")))
    own = F.when(F.col("edits").rlike("[KR]"), F.array(F.concat(head, "text"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("_conv").alias("conv_id"), F.col("_place").alias("place"), F.concat(inserted, own).alias("lines")).where(F.size("lines") > 0)


def _hashed(lines: DataFrame) -> DataFrame:
    """(conv_id, sha) of all lines of a conversation joined by newlines, read as a sorted stream, a line at a time."""
    kind = lines.schema["conv_id"].dataType.simpleString()

    def run(batches):
        last, sha, types = None, None, None
        for batch in batches:
            types, ids, hashes = batch.schema.field(0).type, [], []
            for conv, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sha is None or conv != last:
                    if sha is not None:
                        ids.append(last), hashes.append(sha.hexdigest())
                    last, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(block)
            yield pa.RecordBatch.from_arrays([pa.array(ids, types), pa.array(hashes, pa.string())], names=["_conv2", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], types), pa.array([sha.hexdigest()], pa.string())], names=["_conv2", "sha"])

    rows = lines.select("conv_id", "place", F.encode(F.array_join("lines", "\n"), "UTF-8").alias("block"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "block")
    return rows.mapInArrow(run, f"_conv2 {kind}, sha string")


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of turns(conv_id, turn, role, text),
    for every conv_id of ``ids`` (or of turns).

    Order: turn, nulls first, then role and text, so that the result does not depend on how rows lie. Null roles and
    texts are one space; rows whose conv_id is null are one conversation; a null or empty role has no legal initial. Columns more are
    passed over. Repeated rows are duplicates. A conversation without turns, and so every one of an empty table's ``ids``, has
    zeros, an empty audit and the hash of the empty text.
    """
    scratch = Scratch(turns.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    placed = scratch.save(numbered(scratch, rows, [F.asc_nulls_first("turn"), "role", "text"], by=["conv_id"]), "placed")
    chunks = scratch.save(_chunks(_flagged(scratch, placed)), "chunks")
    audits = scratch.save(_audits(scratch, chunks), "audits")
    hashes = scratch.save(_hashed(_lines(placed, audits)), "hashes")
    counts = scratch.save(_counts(chunks), "counts")
    scratch.keep(audits, hashes, counts)
    every = (turns if ids is None else ids).select(F.col("conv_id").alias("_id")).distinct()
    out = every.join(counts, F.col("_id").eqNullSafe(F.col("_conv")), "left").join(audits, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    out = out.join(hashes, F.col("_id").eqNullSafe(F.col("_conv2")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))
