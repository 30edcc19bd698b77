"""Functions that no table of the driver exercises, on worked values."""

import pytest
from pyspark.sql import functions as F


def _one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_comments(spark):
    from tessera.functions import text as T

    code = 'int/*x*/a; // "no"\n\n  s = "/* keep */";\t\nc = \'"\'; /* two\nlines */ d'
    assert _one(spark, T.strip_c_comments(F.lit(code)))[0] == 'int a;\ns = "/* keep */";\nc = \'"\';   d'
    sh = 'x="#no" # yes\n\'\'\'# in\nit\'\'\'\n#all'
    assert _one(spark, T.strip_hash_comments(F.lit(sh)), T.strip_c_comments(F.lit(None).cast("string"))) == ("x=\"#no\"\n'''# in\nit'''", "")
    assert _one(spark, T.strip_python_comments(F.lit("def f( a ):\n  # c\n  return  a")), T.strip_python_comments(F.lit("def (# c")))[0:2] == ("def f(a):\n    return a", "def (")


def test_complexity_and_lines(spark):
    from tessera.functions import text as T

    code = F.lit("return a && b ? c : await d")
    assert _one(spark, F.round(T.complexity(code, F.lit(0), F.lit(0)), 6), T.complexity(F.lit(""), F.lit(9), F.lit(9)), T.count_lines(F.lit("a\r\nb\n")), T.count_lines(F.lit(""))) == (3.05, 1.0, 2, 0)


@pytest.mark.parametrize("a,b,value", [("ab cd", "ab cd", 1.0), ("", "", 1.0), ("ab", "", 0.0), ("ab", "abc", 0.666667), ("ab", "cd", 0.0), ("a", "a", 1.0), ("日本語", "日本", 0.666667)])
def test_likeness(spark, a, b, value):
    from tessera.functions import text as T

    got = _one(spark, F.round(T.alike(F.lit(a), F.lit(b)), 6))[0]
    assert got == value or (a == "日本語" and 0 < got < 1)


def test_decisions(spark):
    from tessera.functions.interfaces import decide

    cases = {(4, 6, 0): "GUI", (4, 6, 4): "CLI", (0, 2, 0): "TUI", (6, 0, 3): "GUI", (0, 0, 3): "CLI", (0, 0, 0): "Library", (0, 9, 3): "CLI"}
    assert {c: _one(spark, decide(*map(F.lit, c)))[0] for c in cases} == cases


def test_names(spark):
    from tessera.functions import naming as N

    assert N.locale_language({"LANG": "ja_JP.UTF-8"}) == "Japanese" and N.locale_language({}) == "English" and N.locale_language({"LC_ALL": "C", "LANG": "de_DE"}) == "English"
    got = _one(spark, N.display_width(F.lit("a日b\n")), N.fit_width(F.lit("日本語日本語"), 8), N.fit_width(F.lit("abc"), 3), N.bar(F.lit(5), F.lit(10), 4), N.fqdn(F.array(F.lit("a"), F.lit(""), F.lit("b")), F.lit("c")))
    assert got == (4, "日本...", "abc", "[━━  ]", "a.b.c")


def test_block_ends(spark):
    from tessera.sources.blocks import block_ends, clean_comment

    java = 'void f() {\n  s = "}"; // }\n  if (x) { y(); }\n}\nint g;\nclass A\n{\n /* } */ }\n'
    rows = [(java, 1, 4), (java, 5, 5), (java, 6, 8), (java, 0, 1), (java, 99, 99), ("a\n" * 20, 1, 1), ("f {\nx", 1, 2), (None, 1, None), ("", 1, 1)]
    df = spark.createDataFrame(rows, "t string, s int, last int")
    assert [(r.e, r.last) for r in df.select(block_ends(F.col("t"), F.col("s")).alias("e"), "last").collect()] == [(x[2], x[2]) for x in rows]
    got = _one(spark, clean_comment(F.lit("/** One.\n   * two\n\n */")), clean_comment(F.lit("// a\n//b ")), clean_comment(F.lit(" x ")), clean_comment(F.lit(None).cast("string")))
    assert got == ("One.\ntwo", "a\nb", "x", "")


def _symbol(spark):
    row = dict(name="load", kind="function", fqdn="m.load", signature="def load(p: str)", line_start=3, line_end=9, purpose="Loads a file.", context=None, overview="Reads it whole.", inputs="a path", outputs="", return_type="str")
    df = spark.createDataFrame([row], "name string, kind string, fqdn string, signature string, line_start int, line_end int, purpose string, context string, overview string, inputs string, outputs string, return_type string")
    return df.withColumns({"params": F.array(F.lit("p: str"), F.lit("q")), "callees": F.array(F.lit("open"), F.lit("read")), "callers": F.array(F.lit("`main` (`a.py`)")), "snippet": F.lit("def load(p): ...")})


def test_documents_round_trip(spark):
    from tessera.functions import markdown as M

    df = _symbol(spark)
    s = {c: F.col(c) for c in df.columns}
    doc = df.select(M.symbol_section(s, 1, "python").alias("t"))
    text = doc.first()[0]
    assert text.startswith("# Function Documentation: `load`\n\nLoads a file. In the system architecture, it is referenced by `main` (`a.py`). It accepts parameters and returns computed results. Implementation overview: Reads it whole.\n\n## 1. Basic Information\n- **FQDN**: `m.load`\n")
    assert "- `p`: `str`\n- `q`\n\n## 3. Input / Return Specifications\n- Input Constraints: a path\n- Return Type: `str`\n\n## 4. Called Functions\n- `open`\n- `read`\n\n## Source Code Snippet\n```python\ndef load(p): ...\n```" in text
    parsed = doc.select(*[c.alias(k) for k, c in M.parse_document(F.col("t")).items()]).first()
    assert (parsed.title, parsed.kind, parsed.signature, parsed.callees, parsed.callers, parsed.ui_role) == ("Function Documentation: `load`", "Function (FQDN:", "def load(p: str)", ["open", "read"], [], "")
    assert parsed.purpose.startswith("Loads a file. In")
    put = lambda c, role, force=False: M.with_role(c, F.lit("CLI"), F.lit("argparse"), F.lit(role), force)
    once = doc.select(put(F.col("t"), "Runs.").alias("t"))
    again = once.select(put(F.col("t"), "Other.").alias("same"), put(F.col("t"), "Runs.", True).alias("forced"), put(F.col("t"), "New.", True).alias("new"), F.col("t"), M.parse_document(F.col("t"))["ui_role"].alias("role")).first()
    assert again.same == again.t == again.forced and "New." in again.new and "Runs." not in again.new and again.t.index("## UI & Interaction Role") < again.t.index("## Source Code Snippet")
    assert again.role == "- **UI Type**: `CLI` (argparse)\n- **Interaction Specification**: Runs."


def test_file_documents(spark):
    from tessera.functions import markdown as M

    rows = spark.createDataFrame([("a.py", 0, 0, "A", "class", 1, 9, "## A"), ("a.py", 1, 1, "f", "method", 2, 3, "### f"), ("a.py", 2, 0, "n", "namespace", 10, 11, "## n")], "rel_path string, ordinal int, depth int, name string, kind string, line_start int, line_end int, section string")
    hashes = spark.createDataFrame([("a.py", "h1"), ("b.py", "h2")], "rel_path string, file_hash string")
    got = {r.rel_path: r.text for r in M.file_documents(rows, hashes).collect()}
    assert got["a.py"] == "# File Documentation: `a.py`\n\n- **File SHA-256**: `h1`\n- **Detected Symbols**: 2\n\n## Symbol List\n- `A` (Class) [Lines: 1-9]\n- `n` (namespace) [Lines: 10-11]\n\n## A\n\n### f\n\n## n\n"
    assert got["b.py"] == "# File Documentation: `b.py`\n\n- **File SHA-256**: `h2`\n- **Detected Symbols**: 0\n\n## Symbol List\n"


def test_static_descriptions(spark):
    from tessera.functions.markdown import static_description

    say = lambda kind, fqdn="m.P.x", sig="": _one(spark, *[c for c in static_description(F.lit("x"), F.lit(kind), F.lit(sig), F.lit(fqdn)).values()])
    assert say("constructor")[0] == "Defines status code, constant, or enumeration `x` in `P`."  # "const" is in it
    assert say("field", sig="int x")[0] == "Defines field `x` (int x) in data model `P` for data storage and transfer."
    assert say("type_alias")[2] == "Type `x`." and say("destructor")[0] == "Defines data model or structure `x`."
    assert say("method")[3] == "Basic specification and role for `x`." and say("object")[0] == "Defines `x` (object)." and say("field", "x")[0].endswith("in data structure for data storage and transfer.")


def test_reduced_summaries(spark):
    from tessera.operators.documents import reduce_summaries
    from tessera.plans.scratch import Scratch

    rows = [("big", i, f"item {i} " + "x" * 100) for i in range(400)] + [("small", 0, "a"), ("small", 1, "b"), ("long", 0, "y" * 5000)]
    got = {}
    for x in reduce_summaries(Scratch(spark), spark.createDataFrame(rows, "g string, o int, t string"), "g", "o", "t").collect():
        got.setdefault(x.g, []).append((x.level, x.order, x.text))

    def reduced(items):
        for level in range(7):
            if len(items) <= 15 and sum(map(len, items)) <= 3500 or level == 6 or level and len(items) == 1 or level and len(items) >= was:
                return level, items
            chunks, size = [[]], 0
            for t in items:
                if chunks[-1] and (len(chunks[-1]) >= 15 or size + len(t) > 3500):
                    chunks.append([])
                    size = 0
                chunks[-1].append(t)
                size += len(t)
            was, items = len(items), [f"- [Group {i}]: " + " / ".join(t[:60] for t in c[:5]) for i, c in enumerate(chunks, 1)]

    for g in ("big", "small", "long"):
        level, items = reduced([t for k, _, t in rows if k == g])
        assert [(x[0], x[2]) for x in sorted(got[g])] == [(level, t) for t in items]


def test_only_the_path_to_the_root_is_summarised_anew(spark):
    from tessera.operators.documents import reduce_anew
    from tessera.plans.scratch import Scratch

    def reduced(changed, stored):
        rows = [("big", i, f"- Function `f{i:04d}`: purpose of item {i} " * 3 + ("EDITED" if i == changed else "")) for i in range(300)] + [(None, 0, "few")]
        items = spark.createDataFrame(rows, "g string, o int, t string")
        say = lambda chunks: chunks.select("key", F.concat(F.lit("about "), F.substring("key", 1, 8)).alias("summary"))
        out, fresh = reduce_anew(Scratch(spark), items, "g", "o", "t", stored, say)
        return {(x.g, x.level, x.order): x.text for x in out.collect()}, fresh

    first, made = reduced(None, spark.createDataFrame([], "key string, summary string"))
    assert made.count() > 5 and first[None, 0, 0] == "few"
    again, none = reduced(None, made)
    assert again == first and none.count() == 0
    edited, anew = reduced(150, made)
    assert 0 < anew.count() <= 4 and edited != first
    whole, every = reduced(150, made.limit(0))
    assert whole == edited and every.count() > 5


def test_fits_by_columns(spark):
    import numpy as np

    from tessera.functions import costs
    from tessera.operators import reduce as R

    x = np.arange(1, 40)
    y = 3 + 0.5 * x - 0.02 * x**2 + 0.001 * x**3
    rows = [("a", float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("b", 2.0, 0.05, 0), (None, 5.0, 7.0, 0), (None, 9.0, 3.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, i int")
    got = {r.g: r for r in R.fits(df, "x", "y", ("g",)).collect()}
    assert np.allclose(got["a"].coeffs, [3, 0.5, -0.02, 0.001], atol=1e-3) and got["a"].n == 39 and list(got["b"].coeffs) == [0.1, 0.0, 0.0, 0.0]
    line = R.fits(df.where("g IS NULL"), "x", "y", degree=1).first().coeffs
    assert np.allclose(line, [12, -1], atol=1e-3)
    assert list(R.fits(df.where("false"), "x", "y").first().coeffs) == R.NO_SAMPLES and R.fits(df.where("false"), "x", "y", ("g",)).count() == 0
    two = R.category_fits(df.withColumn("c", F.lit("k")), "g", "c", "x", "y", [F.desc("i")], last=2, degree=1).where("key = 'a'").first()
    assert two.n == 2 and abs(two.coeffs[0] + 39 * two.coeffs[1] - y[38]) < 0.05
    values = df.limit(1).select(costs.polynomial(F.array(F.lit(1.0), F.lit(2.0)), F.lit(-5)).alias("v"), costs.polynomial(F.array(F.lit(-9.0)), F.lit(2)).alias("w")).first()
    assert tuple(values) == (3.0, 0.05)


def test_anchors_miss_no_match(spark):
    from tessera.functions import interfaces

    for _, patterns in interfaces.CLASSES.values():
        for _, p in patterns:
            assert interfaces.anchors(p), p
    assert interfaces.anchors(r"a+|xyz") is None and interfaces.anchors(r"(?:from|import)\s+(?:kivy|flet)\b") == ["kivy", "flet"]
    texts = ["from PySide6 import x", "IMPORT  Flet", "tuiſ curſeſ", "Kivy import Kivy", "fınd", "class A : Activity {", "main( int argc", "if __name__ == '__main__'", "gi.repository import Gtk", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = [(k, i, F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("(?iU)" + p)))) for k, (_, ps) in interfaces.CLASSES.items() for i, (_, p) in enumerate(ps)]
    fast = [F.sum(interfaces._count(F.col("text"), p)) for _, ps in interfaces.CLASSES.values() for _, p in ps]
    assert tuple(df.agg(*fast).first()) == tuple(df.agg(*[c for _, _, c in plain]).first())


def test_server_rate_floors_the_rate_itself(spark, tmp_path):
    """21,250 characters in 400.96 seconds are 52.998 a second, which became 53 by rounding before the floor; 24 in 0.1
    and 0.2 are 80."""
    from tessera.plans.change_queries import server_rate

    rows = [(7, 998 + 1000 * i, 20.96 if i == 3 else 20.0) for i in range(20)] + [(8, 4, 0.1), (8, 8, 0.2), (9, 4, 0.1), (9, 8, float("nan"))]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["user_id"]: r["rate"] for r in server_rate(spark, str(tmp_path)).collect() if r["user_id"] < 9} == {7: 52, 8: 80}
