"""Extents of blocks against a plain count of braces, on random texts and long ones."""

import random
import re

from pyspark.sql import functions as F


def _last(text, start):
    lines = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
    if not 1 <= start <= len(lines):
        return max(1, start)
    bare = re.sub(r"(?s)/\*.*?(\*/|\Z)|//[^\n]*|\"([^\"\\\n]|\\[^\n]?)*\"?|'([^'\\\n]|\\[^\n]?)*'?", lambda m: "\n" * m.group().count("\n"), "\n".join(lines[start - 1 :]))
    first = re.search(r"{|;", bare)
    while first and first.group() == ";" and bare[: first.start()].count("}"):
        first = re.compile("{").search(bare)
    if not first or bare[: first.start()].count("\n") > 6:
        return start
    if first.group() == ";":
        return start + bare[: first.start()].count("\n")
    for end in range(first.start() + 1, len(bare) + 1):
        if bare[end - 1] == "}" and bare[:end].count("{") == bare[:end].count("}"):
            return start + bare[:end].count("\n")
    return len(lines)


def test_block_ends_equal_a_count(spark):
    from tessera.sources.blocks import block_ends

    r = random.Random(1)
    rows = [("".join(r.choice(["{", "}", ";", "\n", "a", '"', "'", "/*", "*/", "//", "\\"] + ["\n", "a"] * 3) for _ in range(r.randrange(40))), r.randrange(8)) for _ in range(800)]
    rows += [("{/*" + "x\n" * 50_000 + "*/}", 1), ('{"' + "a\\" * 50_000 + '"}', 1), ("", 1), ("x", -3)]
    got = spark.createDataFrame(rows, "t string, s int").select("t", "s", block_ends(F.col("t"), F.col("s")).alias("e")).collect()
    assert [(x.t[:60], x.s, x.e) for x in got if x.e != _last(x.t, x.s)] == []
    nulls = spark.createDataFrame([(None, 1), ("x", None)], "t string, s int").select(block_ends(F.col("t"), F.col("s")).alias("e"))
    assert [x.e for x in nulls.collect()] == [None, None]
