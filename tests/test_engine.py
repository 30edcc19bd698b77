"""The engine over a small tree: first run, no change, a change, and questions."""

import os

import pandas as pd


def _write(root, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)) or root, exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write(text)


def test_sync_and_ask(spark, tmp_path):
    from tessera.config import Options
    from tessera.engine import Engine

    tree, store = str(tmp_path / "tree"), str(tmp_path / "store")
    _write(tree, {"src/app.py": "import argparse\ndef main():\n    argparse.ArgumentParser()\n    return load(1)\n", "src/io.py": "def load(x):\n    return x\n\nclass Box:\n    def get(self):\n        return load(2)\n", "run.sh": "start() {\n}\n"})
    engine = Engine(spark, tree, store)
    assert engine.sync() == {"files": 3, "symbols": 5, "made": 5}
    assert [r.file for r in engine.list().collect()] == ["run.sh", "src/app.py", "src/io.py"]
    assert [r.location for r in engine.functions().collect()] == ["run.sh::start (run.sh:1:1)", "src.app.main (src/app.py:2:4)", "src.io.load (src/io.py:1:2)", "src.io.Box.get (src/io.py:5:6)"]
    assert [r.unique_id for r in engine.types().collect()] == ["src/io.py::type.Box"] and engine.variables().count() == 0
    found = engine.impact("load").first()
    assert found.callers == ["src/app.py::fn.main", "src/io.py::fn.Box.get"] and found.callees == []
    assert engine.description("Box").first().purpose == "Defines data model or structure `Box`."
    assert engine.locate("load").first().unique_id == "src/io.py::fn.load" and engine.search("box", "class").count() == 1
    assert engine.program_type().first().ui_type == "CLI" and "main: Executes" in engine.design("app.py").first().text
    docs = {r.file: r.text for r in engine.store.read("documents").collect()}
    assert "- `main` (`app.py`)" not in docs["src/app.py.md"] and "`main` (`app.py`): Executes `main` operations." in docs["src/io.py.fn.load.md"]
    assert engine.sync()["made"] == 0
    version = engine.store._version("symbols")
    assert engine.sync()["made"] == 0 and engine.store._version("symbols") == version
    _write(tree, {"src/io.py": "def load(x, y):  # now two\n    return x\n\nclass Box:\n    def get(self):\n        return load(2)\n"})
    assert engine.sync()["made"] == 1 and engine.store._version("symbols") == version + 1
    assert engine.sync(Options(force=True))["made"] == 5


class Shout:
    def describe(self, symbols):
        return pd.DataFrame({"unique_id": symbols.unique_id, "purpose": symbols.name.str.upper(), "inputs": "", "outputs": "", "overview": ""})


def test_describers_registry_and_settings(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera import config, describers
    from tessera.sources.adapters import Adapter, default_registry

    rows = spark.createDataFrame([("a", "x", "field", "m.x", ""), ("b", "y", "function", "m.y", "")], "unique_id string, name string, kind string, fqdn string, signature string")
    got = {r.unique_id: r.purpose for r in describers.describe(rows, F.col("kind") == "field", Shout).collect()}
    assert got["b"] == "Y" and got["a"].startswith("Defines field")
    registry = default_registry()
    registry.register(Adapter("mine", ("py", "zz"), "zig", lambda files: files))
    paths = spark.createDataFrame([("a.py",), ("b.ZZ",), ("c.txt",), (".py",)], "p string")
    assert [tuple(r) for r in paths.select(registry.adapter_of(F.col("p")), registry.code_language(F.col("p"))).collect()] == [("python", "python"), ("mine", "zig"), (None, ""), (None, "")]
    user, project = tmp_path / "u.json", tmp_path / "p.json"
    user.write_text('{"concurrency": 2, "max_tokens": 5, "nonsense": 1}')
    project.write_text('{"concurrency": 3}')
    got = config.load(str(user), str(project), {"TESSERA_ALLOW_FALLBACK": "yes", "TESSERA_CONCURRENCY": "4"}, max_tokens=9, fast=None)
    assert (got.concurrency, got.max_tokens, got.allow_fallback, got.context_size, got.fast) == (4, 9, True, 16384, False)
    assert config.load(str(tmp_path / "none"), None, {}) == config.Options() and config.Options(fast=True).steps() == [1] and config.Options(from_step=2, skip=(3,)).steps() == [2, 4]


def test_compile_commands(spark, tmp_path):
    from tessera.sources import compile_commands as C

    (tmp_path / "build").mkdir()
    path = tmp_path / "build" / "compile_commands.json"
    path.write_text('[{"directory": "/w/b", "file": "../src/a.c", "command": "cc -I../inc -I /abs -DX=\\"1 2\\" -O2 -c ../src/a.c -o a.o -fPIC"}, {"file": "/z/b.cc", "arguments": ["c++", "-isystem", "s", "-std=c++20", "-ob"]}, {"x": 1}]')
    found = C.first_database(spark, str(tmp_path))
    assert found.endswith("build/compile_commands.json") and C.first_database(spark, str(tmp_path / "build" / "x")) is None
    known = C.read_flags(spark, found)
    files = spark.createDataFrame([("/w/src/a.c",), ("/q/b.cc",), ("/q/new.h",), ("/q/new.cpp",)], "path string")
    got = {r.path: r.flags for r in C.flags_of(files, known, "/q").collect()}
    assert got["/w/src/a.c"] == ["-I/w/inc", "-I/abs", "-DX=1 2", "-fPIC"] and got["/q/b.cc"] == ["-isystems", "-std=c++20"]
    assert got["/q/new.h"] == ["-std=c11", "-D_GNU_SOURCE", "-I/q", "-I/q/include", "-I/q/src"] and got["/q/new.cpp"][0] == "-std=c++17"


def test_sinks(spark, tmp_path):
    from tessera import sinks

    docs = spark.createDataFrame([("a/x.md", "one"), ("b.md", None)], "file string, text string")
    write = lambda df: {r.file: r.written for r in sinks.write_documents(df, str(tmp_path / "docs")).collect()}
    assert write(docs) == {"a/x.md": True, "b.md": True} and write(docs) == {"a/x.md": False, "b.md": False}
    assert (tmp_path / "docs" / "a" / "x.md").read_text() == "one" and sorted(os.listdir(tmp_path / "docs" / "a")) == ["x.md"]
    path = str(tmp_path / "labels.json")
    sinks.write_labels(spark, path, {"a": "ä"}, "German", True)
    assert sinks.read_labels(spark, path, "German") == {"language": "German", "a": "ä"} and sinks.read_labels(spark, path, "French") == {} == sinks.read_labels(spark, path + "x", "German")
    store = sinks.Warehouse(spark, str(tmp_path / "w"))
    store.append("perf", spark.range(2)), store.append("perf", spark.range(1))
    assert store.read_log("perf").count() == 3 and not store.exists("t")
    assert store.write_if_different("t", spark.range(3), "id") and not store.write_if_different("t", spark.range(3), "id") and store.write_if_different("t", spark.range(4), "id")
    sinks.write_file_list(spark.createDataFrame([("b",), ("a",)], "file string"), str(tmp_path / "list"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["a", "b"]


def test_watchers(spark, tmp_path):
    from tessera.streaming.debounce import Watchers

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path": "a"}\n{"path": "b"}\n')
    seen, watchers = [], Watchers()
    query = watchers.watch(spark, str(tmp_path / "in"), "path string", lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    (tmp_path / "in" / "2.json").write_text('{"path": "c"}\n')
    watchers.watch(spark, str(tmp_path / "in"), "path string", lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    watchers.stop(str(tmp_path / "in"))
    assert seen == [2, 1]


def test_streaming_sessions(spark, tmp_path):
    from tessera.streaming.debounce import sessions

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("".join(f'{{"k": 1, "ts": "2024-01-01T00:{m:02d}:00Z"}}\n' for m in (0, 1, 20, 55)))
    stream = spark.readStream.schema("k int, ts timestamp").json(str(tmp_path / "in"))
    query = sessions(stream, "k", "ts", "10 minutes", "1 minute").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("closed").collect()) == [1, 2]


class Counting:
    """Purposes from the first comment of the code, so that an edit may keep them; counts what it sees in a folder."""

    folder = ""

    def _seen(self, what, ids):
        for i in ids:
            with open(os.path.join(self.folder, f"{what}-{i.replace('/', '|')}"), "a") as f:
                f.write("x")

    def describe(self, symbols):
        self._seen("fn", symbols.unique_id)
        said = symbols.code.str.extract(r"#: (.*)", expand=False).fillna("Does its work.")
        return pd.DataFrame({"unique_id": symbols.unique_id, "purpose": said, "inputs": "", "outputs": "", "overview": symbols.callee_context.fillna("")})

    def refine(self, variables):
        self._seen("var", variables.unique_id)
        return pd.DataFrame({"unique_id": variables.unique_id, "context": variables.name.str.upper()})


def test_sync_stops_at_unchanged_contracts(spark, tmp_path):
    from tessera.engine import Engine

    tree, seen = str(tmp_path / "tree"), tmp_path / "seen"
    seen.mkdir()
    leaf = "def leaf(x):\n    #: {}\n    y = x + {}\n    return y\n"
    rest = "def middle(x):\n    return leaf(x)\n\ndef top():\n    return middle(1)\n\ndef alone():\n    return 0\n"
    make = type("Mine", (Counting,), {"folder": str(seen)})
    engine = Engine(spark, tree, str(tmp_path / "store"), make=make)

    def told():
        out = sorted(p.name.split(".")[-1] for p in seen.iterdir())
        for p in seen.iterdir():
            p.unlink()
        return out

    _write(tree, {"a.py": leaf.format("Adds one.", 1), "b.py": rest, "Box.java": "class Box {\n    int size;\n    int grab() {\n        return size;\n    }\n}\n"})
    assert engine.sync()["made"] == 7 and told() == ["Box", "alone", "grab", "leaf", "middle", "size", "top"]
    assert {r.name: r.context for r in engine.store.read("symbols").collect()} == {"Box": None, "grab": None, "size": "SIZE", "leaf": None, "middle": None, "top": None, "alone": None}
    texts = {r.name: r.overview for r in engine.store.read("symbols").collect()}
    assert "Adds one." in texts["middle"] and "`middle`" in texts["top"] and texts["leaf"] == ""
    _write(tree, {"a.py": leaf.format("Adds one.", 1).replace("y = x", "y  =  x")})
    assert engine.sync()["made"] == 0 and told() == []  # only the layout
    _write(tree, {"a.py": leaf.format("Counts whales at sea.", 1).replace("(x):", "(x, z):")})
    assert engine.sync()["made"] == 2 and told() == ["leaf", "middle"]  # middle promises what it did, so top stays, and size has its context


def test_commits_are_whole(spark, tmp_path, monkeypatch):
    import pytest

    from tessera import sinks

    store, range_ = sinks.Warehouse(spark, str(tmp_path / "w")), spark.range
    both = lambda n: {"a": (range_(n), "id"), "b": (range_(n + 1), "id")}
    seen = lambda: (store.read("a").count(), store.read("b").count())
    assert store.commit(both(1)) == {"a", "b"} and seen() == (1, 2) and store.commit(both(1)) == set()
    broken = range_(3).select(sinks.F.raise_error(sinks.F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": (range_(5), "id"), "b": (broken, "id")})  # a is written, b is not
    assert seen() == (1, 2)
    with monkeypatch.context() as m:
        m.setattr(sinks, "create_text", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            store.commit(both(7))  # all is written, the manifest is not
    assert seen() == (1, 2)
    other, manifests = sinks.Warehouse(spark, store.root), store._manifests()
    monkeypatch.setattr(store, "_manifests", lambda: manifests)  # what this writer saw before the other one was done
    assert other.commit(both(8)) == {"a", "b"}
    with pytest.raises(FileExistsError):
        store.commit(both(9))
    assert (other.read("a").count(), other.read("b").count()) == (8, 9)
    old = other.read("a")
    assert other.commit({"a": (range_(10), "id")}) == {"a"} and other.read("b").count() == 9 and old.count() == 8
    other.commit({"a": (range_(11), "id")})
    assert len(other._manifests()) == 2 and other._version("a") == 4 and other._version("b") == 2
