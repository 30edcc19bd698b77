"""Source scan, symbols, snippets and JSON objects on small files."""

from pyspark.sql import functions as F

PY = '''import os


class Counter(Base):
    """Counts."""

    def up(self, by: int) -> int:
        def inner():
            return 1
        return inner() + os.getpid(by)

    if True:
        async def later(self):
            await self.up(1)


def main(): return Counter().up(2)
def main(): return 1
'''
SH = "#!/bin/bash\n# old() {\nfunction start () {\n  helper\n}\n\n  helper() { :; }\nx=1\n"


def test_scan_and_symbols(spark, tmp_path):
    from tessera.sources.files import read_docs, scan_tree
    from tessera.sources.symbols import symbols

    for name, text in {"pkg/a.py": PY, "run me+1.SH": SH, "bad.py": "def (", "notes.md": "# x", ".hid/b.py": PY, "build/c.py": PY, "x/node_modules/d.py": PY, "buildx/e.c": "int x;", ".py": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = scan_tree(spark, str(tmp_path))
    assert {(r.rel_path, r.language) for r in files.collect()} == {("pkg/a.py", "python"), ("run me+1.SH", "shell"), ("bad.py", "python"), ("buildx/e.c", "c")}
    got = {r.unique_id: r for r in symbols(files).collect()}
    a = "pkg/a.py::"
    assert set(got) == {a + "type.Counter", a + "fn.Counter.up", a + "fn.Counter.later", a + "fn.main", a + "fn.main#2", "run me+1.SH::fn.start", "run me+1.SH::fn.helper"}
    up = got[a + "fn.Counter.up"]
    assert (up.signature, up.fqdn, up.callees, up.line_start, up.line_end) == ("def up(self, by: int) -> int", "pkg.a.Counter.up", ["getpid", "inner"], 7, 10)
    assert got[a + "fn.Counter.later"].kind == "async_function" and got[a + "type.Counter"].doc == "Counts."
    assert got["run me+1.SH::fn.start"].line_start == 3
    assert [r.text for r in read_docs(spark, str(tmp_path)).collect()] == ["# x"]


def test_snippets_and_json(spark):
    from tessera.functions.snippets import json_object, snippet

    row = spark.createDataFrame([("a\nb\nc",)], "t string").select(*[snippet(F.col("t"), F.lit(x), F.lit(y)) for x, y in ((2, 3), (0, 1), (2, 99), (5, 9))]).first()
    assert tuple(row) == ("b\nc", "a", "b\nc", "")
    cases = {
        'x ```json\n{"a": 1}\n``` y': '{"a": 1}',
        'so {"a": {"b": 2}} it is': '{"a": {"b": 2}}',
        '{"a": "cut of': '{"a": "cut of"}',
        '{"a": {"b": "c': '{"a": {"b": "c"}}',
        '{"a": 1': '{"a": 1}',
        "none": None,
        "": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", json_object(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in got} == cases
