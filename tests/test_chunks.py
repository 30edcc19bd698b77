"""Chunks and places against plain folds, over borders of blocks and ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks
from tessera.operators.places import numbered
from tessera.plans.scratch import Scratch


def _fold(texts, items, chars, stable):
    out, k, n, size, cut = [], 0, 0, 0, False
    for given in texts:
        t = given or ""
        if n and (cut or n >= items or size + len(t) > chars):
            k, n, size = k + 1, 0, 0
        out.append(k)
        n, size = n + 1, size + len(t)
        cut = stable and given is not None and int(hashlib.sha1(t.encode()).hexdigest()[:8], 16) % max(2, items // 2) == 0
    return out


@pytest.mark.parametrize("stable", [False, True])
def test_chunks_equal_a_fold(spark, monkeypatch, stable):
    monkeypatch.setattr(chunks, "BLOCK", 1)  # blocks of 8 * max_items, put together by threes
    monkeypatch.setattr(chunks, "FAN", 3)
    r = random.Random(3)
    groups = {g: [r.choice([None, "", "x" * r.randrange(1, 30), f"t{r.randrange(9)}"]) for _ in range(n)] for g, n in ((None, 50), ("a", 1), ("b", 500), ("c", 32), ("d", 33))}
    rows = [(g, i * 3, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    r.shuffle(rows)
    items = spark.createDataFrame(rows, "src string, nr int, body string").repartition(5)
    got = {(x.src, x.nr): x.chunk for x in chunks.capped_chunks(Scratch(spark), items, "src", "nr", "body", 4, 40, stable).collect()}
    assert got == {(g, i * 3): k for g, ts in groups.items() for i, k in enumerate(_fold(ts, 4, 40, stable))}
    assert chunks.capped_chunks(Scratch(spark), items.limit(0), "src", "nr", "body", 4, 40, stable).count() == 0


def test_places_of_one_group_in_many_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "hot", "hot", "hot", "x"]), r.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = numbered(Scratch(spark), df, [F.desc("v")], by=["g"]).collect()
    for g in (None, "hot", "x"):
        mine = sorted((x for x in got if x.g == g), key=lambda x: x.place)
        assert [x.place for x in mine] == list(range(len(mine))) and [x.v for x in mine] == sorted((x.v for x in mine), reverse=True)
    assert sorted(x.place for x in numbered(Scratch(spark), df, ["v", "i"]).collect()) == list(range(3000))
    sums = numbered(Scratch(spark), df, ["i"], by=["g"], name="before", each="v").collect()
    assert all(x.before == sum(v for g, v, i in rows if g == x.g and i < x.i) for x in sums if x.i % 50 == 0)
