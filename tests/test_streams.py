"""Trees and answers as streams."""

import os
import time



def test_answers_are_stopped_in_batch_and_stream(spark, tmp_path):
    from tessera.streaming.pieces import stop_stream, stopped

    answers = {1: ["a", " " * 30, "\n" * 20, "b"], 2: ["a" + " " * 49, " "], 3: ["a", " " * 49, "b", " " * 49], 4: [" " * 50, " "], 5: ["", None, " " * 60], 6: []}
    rows = [(k, i, t) for k, ts in answers.items() for i, t in enumerate(ts)]
    want = {(1, 2), (2, 1), (4, 0), (5, 2)}
    schema = "k long, i long, t string"
    assert set(map(tuple, stopped(spark.createDataFrame(rows, schema), "k", "i", "t").collect())) == want
    (tmp_path / "in").mkdir()
    for part, half in enumerate((lambda i: i < 2, lambda i: i >= 2)):  # an answer may go on in the next batch
        spark.createDataFrame([r for r in rows if half(r[1])], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = stop_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), "k", "i", "t")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)


def test_a_tree_is_synced_after_it_is_quiet(spark, tmp_path):
    from tessera.streaming.tree import TreeWatch

    tree, clock, seen = tmp_path / "tree", [0.0], []
    tree.mkdir()
    put = lambda name, text: (tree / name).write_text(text)
    put("a.py", "1"), put("b.py", "2")

    def sync():
        seen.append({f: (tree / f).read_text() for f in sorted(os.listdir(tree)) if f.endswith(".py")})
        if len(seen) == 2:  # edits, deletes and adds while the second sync runs, after it has read the tree
            put("a.py", "while"), (tree / "b.py").unlink(), put("d.py", "new")

    watch = TreeWatch(spark, str(tree), sync, quiet=2, now=lambda: clock[0])
    assert watch.tick() and not watch.tick() and seen == [{"a.py": "1", "b.py": "2"}]
    clock[0] = 10
    put("c.py", "3")
    assert not watch.tick()
    clock[0] = 11.5
    put("c.py", "33")
    assert not watch.tick()
    clock[0] = 12.5  # two seconds after the first change, one after the last
    assert not watch.tick()
    clock[0] = 13.5
    assert watch.tick() and seen[-1] == {"a.py": "1", "b.py": "2", "c.py": "33"}
    clock[0] = 14
    assert not watch.tick() and watch.changes[-1] == {"modified": 1, "removed": 1, "added": 1}
    clock[0] = 16
    assert watch.tick() and seen[-1] == {"a.py": "while", "c.py": "33", "d.py": "new"} and not watch.tick()


def test_a_watch_is_a_streaming_query(spark, tmp_path):
    from tessera.streaming.tree import TreeWatch

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("1")
    watch = TreeWatch(spark, str(tmp_path / "tree"), lambda: None, quiet=0.1, every=0.2)
    query = watch.start(str(tmp_path / "cp"))
    end = time.time() + 90
    while watch.runs < 1 and time.time() < end:
        time.sleep(0.2)
    (tmp_path / "tree" / "a.py").write_text("two")
    while watch.runs < 2 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert watch.runs >= 2 and query.exception() is None
