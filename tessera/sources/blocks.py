"""Comments and extents of blocks in brace languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import LINE_ENDS, count_lines

#: Fixed value: without a brace for more than so many lines after the first, a block is its first line.
PATIENCE = 4


def clean_comment(text: Column) -> Column:
    """The words of a /* */ or // comment without its marks, line by line, blank lines dropped; other text is trimmed."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = trim(F.coalesce(text, F.lit("")))
    lines = F.split(bare, "\r\n|\r|\n")

    def block(line: Column) -> Column:
        x = trim(line)
        x = F.when(x.startswith("/**"), trim(F.substring(x, 4, 1_000_000))).when(x.startswith("/*"), trim(F.substring(x, 3, 1_000_000))).otherwise(x)
        x = trim(F.regexp_replace(x, r"\*/$", ""))
        return trim(F.regexp_replace(x, r"^\*", ""))

    plain = lambda line: trim(F.regexp_replace(trim(line), "^//", ""))
    joined = lambda each: F.array_join(F.filter(F.transform(lines, each), lambda x: x != ""), "\n")
    return F.when(bare.startswith("/*"), joined(block)).when(bare.startswith("//"), joined(plain)).otherwise(bare)


#: What a block's extent depends on: comments, literals (up to the end of their line), braces, semicolons and line ends.
MARKS = r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*|\"(?:[^\"\\\n]++|\\[^\n]?)*+\"?|'(?:[^'\\\n]++|\\[^\n]?)*+'?|[{};\n]"


def block_ends(content: Column, start: Column) -> Column:
    """Last line (1-based) of the block that begins at line ``start`` of each text: where its braces balance, or where a ``;``
    stands before any brace. Braces in literals and comments do not count.

    Where neither comes in the first lines, the block is its first line; braces that never balance reach to the last one. A
    start outside the text stands for itself, at least 1; null texts or starts give null. One pass of a pattern finds the marks, and
    a sum runs over them.
    """
    lines = F.split(content, LINE_ENDS)
    marks = F.regexp_extract_all(F.array_join(F.slice(lines, start, F.size(lines)), "\n"), F.lit(MARKS), F.lit(0))
    long = F.lit(PATIENCE + 2)  # lines after the first in which the block must show itself

    def add(s: Column, mark: Column) -> Column:
        depth = s["depth"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        body = F.coalesce(s["body"], F.when(mark == "{", s["line"]))
        ends = ((mark == "}") & s["body"].isNotNull() | (mark == ";") & s["body"].isNull()) & (depth == 0)
        down = F.length(mark) - F.length(F.replace(mark, F.lit("\n")))
        return F.struct((s["line"] + down).alias("line"), depth.alias("depth"), body.alias("body"), F.coalesce(s["end"], F.when(ends, s["line"])).alias("end"))

    nothing = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("line"), F.lit(0).alias("depth"), nothing.alias("body"), nothing.alias("end"))
    seen = F.aggregate(marks, zero, add)
    shown = F.least(seen["body"], seen["end"]) <= long
    last = F.when(~F.coalesce(shown, F.lit(False)), start).otherwise(F.coalesce(start + seen["end"], count_lines(content)))
    outside = (start < 1) | (start > count_lines(content))
    return F.when(content.isNotNull() & start.isNotNull(), F.when(outside, F.greatest(F.lit(1), start)).otherwise(last).cast("int"))
