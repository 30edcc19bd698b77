"""Line dedup with DataFrame functions alone: hashed normal lines, pigeonhole blocks, edit similarity, one kept.

A line is normalised to its lower-cased runs of letters, marks and digits (words). Equal normal lines are one line by a
64-bit hash. Two lines are linked if their edit similarity in words is MIN_SIMILARITY or more. Candidates share a block, and
no link is left out (but for hashes that are equal by chance):

- Pairs of up to NINE words may differ by one word. Each line gives what is left without one of its words, with that word's place,
  and itself with each place where a word may come in; lines are linked if and only if they share one of these keys.
- Else an edit touches two pairs of neighbouring words (grams) at most, so of 2 * edits + 1 grams of a line, the first ones in an
  order that is the same for all lines, one is in the other line's first ones too. The order begins with the longest words, which are
  rare, so blocks are small without any statistics. Parities of the hashed words reject candidates before texts are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.linking import link_blocks
from tessera.llm.prefilter import possible
from tessera.plans.scratch import Scratch

#: 1 - (word edits) / (words of the longer line).
MIN_SIMILARITY = 0.8
#: Words of the longer of two lines that at most one edit may part, and of the shortest line that another one is similar to.
NINE, SHORTEST = 9, 4
#: Words of a gram, and of the shortest line that is similar to one of more than NINE words.
GRAM, FROM = 2, 8
#: Edit distances are cut off by length class, as their cost is length times cut-off.
LENGTHS = (64, 256, 1024, 4096, 16384, 65536)
#: Lines that at least one in HOT of all lines equals are told by broadcast which document keeps them: HOT lines at most.
HOT = 4096


def normal_words(line: Column) -> Column:
    """The words of a line; a line without any gives one empty word."""
    return F.split(F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " ")), " ")


def word_letters(line: Column) -> Column:
    """One character a word (a hash to 50,000 characters below the surrogates), so levenshtein() counts word edits."""
    code = F.transform(normal_words(line), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(50_000)) + 256), 4, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def most_edits(longer: Column) -> Column:
    """Word edits that a pair may have whose longer line has so many words."""
    return F.floor(longer * (1 - MIN_SIMILARITY) + 1e-9).cast("int")


#: 64-bit hashes of the words of the array w, the last four bits being the word's length, 9 at most.
_HASHES = "transform(w, x -> (xxhash64(x) & -16L) | least(char_length(x), 9))"
#: Of two neighbours: a class, 0 for the longest pairs, then 59 bits of both hashes; so grams sort by class, then at random, and
#: are never below 0. (coalesce: neighbours are never null, and arrays without nulls are sorted as plain numbers.)
_GRAM = "coalesce(shiftleft(6 - ((a & 15) + (b & 15)) div 3, 59) | (xxhash64(a, b) & 576460752303423487L), 0L)"
_GRAMS = f"sort_array(zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (a, b) -> {_GRAM}))"
#: The keys of lines that one edit may part, all below 0: without the word at a place, and with room for one.
_BELOW = "| -9223372036854775808L"
_WITHOUT = f"transform(sequence(0, size(h) - 1), i -> xxhash64(slice(h, 1, i), slice(h, i + 2, size(h)), i) {_BELOW})"
_ROOM = f"transform(sequence(0, size(h)), i -> xxhash64(slice(h, 1, i), slice(h, i + 1, size(h)), i) {_BELOW})"


def n_blocks(n: Column) -> Column:
    """Grams of a line of n words that edits may touch, and one more.

    The partner may be a word longer and so allow one edit more, which then inserts a word and touches a gram less.
    """
    return F.greatest(*[GRAM * most_edits(n + more) - more for more in range(GRAM)]) + 1


#: 256 parities of the words' hashes, in four longs: strong for long lines too. With the number of words they are what a pair is tested by.
_PARITY = [f"aggregate(h, 0L, (s, x) -> s ^ if((x & 3072) = {k << 10}, shiftleft(1L, cast(shiftright(x, 4) & 63 as int)), 0L))" for k in range(4)]
SIGNS = ("n", "q0", "q1", "q2", "q3")


def may_link(a: str, b: str) -> Column:
    """Whether the lines of the columns n, q0.. of either prefix can be similar: the words that only one of them has are two an edit, or one for an inserted one."""
    odd = sum((F.bit_count(F.col(f"{a}q{i}").bitwiseXOR(F.col(f"{b}q{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}q0").bitwiseXOR(F.col(f"{b}q0"))))
    longer, shorter = F.greatest(f"{a}n", f"{b}n"), F.least(f"{a}n", f"{b}n")
    most = most_edits(longer)
    return (longer - shorter <= most) & (odd <= 2 * most - (longer - shorter))


def edit_similar(a: Column, b: Column, least: float = MIN_SIMILARITY) -> Column:
    """1 - distance / longer length >= least."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    most = F.floor(longer * (1 - least) + 1e-9)
    hit = F.levenshtein(a, b) <= most
    for upper in reversed(LENGTHS):
        d = F.levenshtein(a, b, int(upper * (1 - least)) + 1)
        hit = F.when(longer <= upper, (d >= 0) & (d <= most)).otherwise(hit)
    return F.when(longer - shorter > most, F.lit(False)).otherwise(hit)


def distinct_rows(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): rows that repeat both id and text stand once. Only hashes and repeated rows are shuffled."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    again = scratch.save(rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "repeated")
    if again.isEmpty():
        return rows
    return rows.join(again, "row", "left_anti").unionByName(rows.join(again, "row", "left_semi").dropDuplicates(["row"]))


def hashed_lines(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, line_no, id, blocks, n, q0..q3) of every line with words: its blocks, its number of words and their parities.
    Lines of fewer than four words are similar to equal ones alone and have no blocks. Equal ids are equal normal lines up to a chance of 2 ** -64 a pair."""
    rows = distinct_rows(docs, scratch, id_col, text_col)
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "row", "line_no", normal_words(F.col("line")).alias("w")).where("w[0] <> ''")
    lines = lines.select("doc_id", "row", "line_no", F.xxhash64("w").alias("id"), F.expr(_HASHES).alias("h"))
    n, none = F.size("h"), F.array().cast("array<bigint>")
    grams = F.when(n >= FROM, F.slice(F.expr(_GRAMS), F.lit(1), n_blocks(n))).otherwise(none)
    without = F.when((n > SHORTEST) & (n <= NINE), F.expr(_WITHOUT)).otherwise(none)
    room = F.when((n >= SHORTEST) & (n < NINE), F.expr(_ROOM)).otherwise(none)
    blocks = F.when(n <= NINE, F.concat(grams, without, room)).otherwise(grams).alias("blocks")
    return lines.select("doc_id", "row", "line_no", "id", blocks, n.alias("n"), *[F.expr(c).alias(q) for q, c in zip(SIGNS[1:], _PARITY, strict=True)])


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, line_no, id) of every line with words, and (id, n, at, group) of every normal line: its hash, how
    often and where first it stands (doc_id, row, line_no), and the name of its connected group."""
    hashed = scratch.save(hashed_lines(docs, scratch, id_col, text_col), "lines")
    found = scratch.save(hashed.select("doc_id", "row", "line_no", "id"), "found")
    distinct = found.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "line_no")).alias("at"))
    distinct = scratch.save(distinct, "distinct")
    total = found.count()

    def lines_of(wanted: DataFrame) -> DataFrame:
        """(id, line) of wanted(id): only their first occurrences, and few others by the bitmap, leave their documents."""
        at = distinct.join(wanted, "id", "left_semi").select(F.xxhash64("at.row", "at.line_no").alias("line_id"), "id")
        at = scratch.save(at, "wanted")
        row = F.xxhash64(F.col(id_col), F.col(text_col))
        own = docs.select(row.alias("row"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
        own = possible(own.select(F.xxhash64("row", "line_no").alias("line_id"), "line"), at.select("line_id"), "line_id")
        return own.join(at, "line_id").select("id", "line").dropDuplicates(["id"])

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        letters = scratch.save(lines_of(wanted).select("id", word_letters(F.col("line")).alias("t")), "letters")
        scratch.sweep()
        ta, tb = letters.toDF("a", "ta"), letters.toDF("b", "tb")
        links = scratch.save(pairs.join(ta, "a").join(tb, "b").where(edit_similar(F.col("ta"), F.col("tb"))).select("a", "b"), "links")
        scratch.drop(letters)
        scratch.sweep()
        return links

    def grams(wanted: DataFrame) -> DataFrame:
        words = lines_of(wanted).select("id", normal_words(F.col("line")).alias("w")).select("id", F.expr(_HASHES).alias("h"))
        ranked = scratch.save(words.select("id", n_blocks(F.size("h")).alias("need"), F.expr(_GRAMS).alias("k")), "grams")
        return ranked.select("id", "need", F.posexplode("k").alias("at", "key")).select("id", "key", (F.col("at") + 1).alias("rank"), "need")

    # Blocks of every line but the repeats of common ones, so that no block is large for a line that many documents have.
    common = distinct.where(F.col("n") * HOT >= total).select(F.col("id").alias("_id"), "at")
    each = hashed.where(F.size("blocks") > 0).join(F.broadcast(common), F.col("id") == F.col("_id"), "left")
    first = F.col("at").isNull() | ((F.col("at.row") == F.col("row")) & (F.col("at.line_no") == F.col("line_no")))
    blocks = each.where(first).select(F.explode(F.col("blocks")).alias("key"), "id", *SIGNS)
    signs = scratch.save(hashed.where(F.size("blocks") > 0).select("id", *SIGNS).dropDuplicates(["id"]), "signs")
    scratch.sweep()
    labels = link_blocks(scratch, blocks, signs, may_link, verify, grams, hashed)
    scratch.drop(signs)
    root = labels.select(F.col("id").alias("_id"), "root")
    grouped = distinct.join(root, distinct["id"] == root["_id"], "left").select("id", "n", "at", F.coalesce("root", "id").alias("group"))
    return found, scratch.save(grouped, "grouped")


def line_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, line_no, key, group) of every line with words: ``group`` names its connected group."""
    found, grouped = _groups(docs, scratch, id_col, text_col)
    return found.join(grouped.select("id", "group"), "id").select("doc_id", "row", "line_no", F.col("id").alias("key"), "group")


def _repeated(found: DataFrame, grouped: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, line_no) of the lines that another one of their group stands for, the first of the group.

    Of a line that at least one in HOT of all lines equals, the rows meet their group by broadcast, at most HOT rows, so
    that no line, however common, is one task.
    """
    first = grouped.groupBy("group").agg(F.sum("n").alias("all"), F.min("at").alias("kept")).where("all > 1")
    ends = grouped.join(first, "group").select(F.col("id").alias("_id"), "n", "kept")
    ends = scratch.save(ends, "ends")
    total = found.count()
    common = F.col("n") * HOT >= total
    by_broadcast = found.join(F.broadcast(ends.where(common)), F.col("id") == F.col("_id"))
    by_shuffle = found.join(ends.where(~common), F.col("id") == F.col("_id"))
    here = (F.col("kept.row") == F.col("row")) & (F.col("kept.line_no") == F.col("line_no"))
    return by_broadcast.unionByName(by_shuffle).where(~here).select("row", "line_no")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns ``__kept`` (text of the kept lines) and ``__n_lines``, ``__n_dropped`` added.

    Of every group of lines the occurrence with the smallest (doc_id, row hash, line number) stays, null ids first. Lines
    without words stay always. Null texts stay null with no lines; an empty text is one line. Documents are never
    dropped, even if no line is left (their text is then empty). Rows that repeat both id and text are one document
    and get the same result.
    """
    scratch = Scratch(docs.sparkSession)
    again = _repeated(*_groups(docs, scratch, id_col, text_col), scratch)
    gone = again.groupBy(F.col("row").alias("__row")).agg(F.collect_set("line_no").alias("__gone"))
    gone = scratch.save(gone, "gone")
    scratch.keep(gone)
    out = docs.withColumn("__own", F.xxhash64(F.col(id_col), F.col(text_col)))
    out = out.join(gone, out["__own"] == gone["__row"], "left")
    text = F.col(text_col).cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    out = out.withColumn("__kept", F.when(F.col("__gone").isNull(), text).otherwise(kept))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    n_gone = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return out.withColumn("__n_lines", n_lines).withColumn("__n_dropped", n_gone).drop("__own", "__row", "__gone")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the kept lines as text (and n_chars to match, if there); all rows and columns stay."""
    out = dedup_lines(docs, id_col, text_col)
    new = {text_col: F.col("__kept")}
    if chars_col in docs.columns:
        new[chars_col] = F.coalesce(F.length("__kept"), F.lit(0)).cast(docs.schema[chars_col].dataType)
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
