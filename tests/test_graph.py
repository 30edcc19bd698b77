"""Components, levels and longest paths by elimination against plain closures, on deep and on dense graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.scratch import Scratch


def _truth(nodes, pairs):
    out = {v: {b for a, b in pairs if a == v and b != a and b in nodes} for v in nodes}
    reach = {}
    for v in nodes:
        seen, todo = {v}, [v]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reach[v] = seen
    comp = {v: min(u for u in reach[v] if v in reach[u]) for v in nodes}
    level = {}
    for c in sorted(set(comp.values()), key=lambda c: len(reach[c])):  # what is reached reaches less
        level[c] = max((level[comp[y]] + 1 for v in nodes if comp[v] == c for y in out[v] if comp[y] != c), default=0)
    return sorted((v, comp[v], level[comp[v]]) for v in nodes)


@pytest.mark.parametrize("n,m", [(14, 18), (40, 200)])
def test_levels_equal_a_closure(spark, n, m):
    r = random.Random(n)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(3, 99), (None, 2), (5, 5)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(n)] + [(3,), (None,)], "id long"), spark.createDataFrame(pairs, "src long, dst long")
    got = sorted(map(tuple, graph.levels(Scratch(spark), nodes, edges).collect()))
    assert got == _truth(set(range(n)), [p for p in pairs if p[0] is not None])
    assert graph.levels(Scratch(spark), nodes.limit(0), edges).count() == 0


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    rounds, take_out = [], graph._take_out
    monkeypatch.setattr(graph, "_take_out", lambda *a: rounds.append(1) or take_out(*a))
    n = 20_000
    chain = spark.range(n).select((F.col("id") * 7919 % n).alias("id"))
    down = chain.where("id > 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    few = chain.where("id < 1000")
    ladder = down.where("src < 1000").union(few.where("id > 1").select("id", F.col("id") - 2))
    assert graph.longest_paths(Scratch(spark), few, ladder).where("id <> level").isEmpty()
    assert len(rounds) < 40
    rounds.clear()
    rings = down.union(chain.where("id % 1000 = 0").select("id", F.col("id") + 5))
    found = graph.scc(Scratch(spark), chain, rings)
    assert found.where("scc <> CASE WHEN id % 1000 < 6 THEN id - id % 1000 ELSE id END").isEmpty() and found.count() == n
    assert len(rounds) < 40


def test_no_round_goes_through_the_driver(spark, monkeypatch):
    """F8, F9: the joins of each round, and the edges made anew in each, were broadcast by way of the driver."""
    from tessera.operators import incremental

    plans, save = [], Scratch.save

    def watched(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    nodes = spark.range(40)
    edges = nodes.where("id > 0").select(F.col("id").alias("src"), (F.col("id") - 1 - F.col("id") % 3).alias("dst")).where("dst >= 0")
    monkeypatch.setattr(Scratch, "save", watched)
    hops = {r["id"]: r["hops"] for r in graph.propagate(Scratch(spark), spark.range(1), edges).collect()}
    up = {0: 0}
    for i in range(1, 40):
        if (i - 1 - i % 3) in up:
            up[i] = up[i - 1 - i % 3] + 1
    assert hops == up
    made = incremental.make_anew(Scratch(spark), spark.range(1), graph.levels(Scratch(spark), nodes, edges), edges, lambda now, _: now.withColumn("changed", F.lit(True)))
    assert {r["id"] for r in made.collect()} == set(up)
    assert plans and not [p for p in plans if "BroadcastExchange" in p]
