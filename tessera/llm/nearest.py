"""Approximate nearest neighbours by cross-polytope hashing, with probes fitted to a measured recall and exact reranking.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform, and hashed to the signed axis nearest to it.
Several turns give a longer hash, so that cells stay small as rows grow. Every row is in one cell of each of TABLES tables;
a query looks into the cells that its own coordinates make likeliest. How many it takes is fitted: a bounded sample of the
queries is searched exactly, and the fewest probes are taken that find RECALL of their neighbours.

A cell's rows and the queries that look into it meet in pieces of bounded size (ROWS x QUERIES), whatever a cell holds, and only
the nearest of a piece leave it: no pairs are emitted, and a cell with a third of all rows is as many tasks as it has pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

NEIGHBOURS, TABLES, SEED = 10, 8, 12
#: Rows of a cell that the hash length aims at; rows and queries of a piece.
CELL, ROWS, QUERIES = 400, 4096, 1024
#: Queries that are searched exactly to fit the probes, and the share of their neighbours that must be found.
SAMPLE, RECALL = 128, 0.95


def _turned(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of x under a pseudo-rotation: random signs and a Hadamard transform, three times."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, size))
    for s in signs:
        y *= s
        h = 1
        while h < size:
            y = y.reshape(n, size // (2 * h), 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2)
            h *= 2
        y = y.reshape(n, size) / np.sqrt(size)
    return y


def _axes(x: np.ndarray, table: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each turn of a table the coordinates along the 2 * width signed axes, +1..+w then -1..-w."""
    out = []
    for k, w in enumerate(widths):
        y = _turned(x, SEED + 1000 * table + k)[:, :w]
        out.append(np.concatenate([y, -y], 1))
    return out


def cells(x: np.ndarray, table: int, widths: tuple[int, ...]) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for y in _axes(x, table, widths):
        code = code * y.shape[1] + y.argmax(1)
    return code


def likeliest(x: np.ndarray, table: int, widths: tuple[int, ...], probes: int) -> np.ndarray:
    """The cells of a table in the order of the sum over turns of how far the cell's axes lie behind the nearest: (rows, probes)."""
    code, behind = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for y in _axes(x, table, widths):
        far = (y.max(1, keepdims=True) - y) ** 2
        some = min(probes, y.shape[1])
        axis = np.argpartition(far, some - 1, 1)[:, :some]
        cost = (behind[:, :, None] + np.take_along_axis(far, axis, 1)[:, None, :]).reshape(len(x), -1)
        both = (code[:, :, None] * y.shape[1] + axis[:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, 1, kind="stable")[:, :probes]
        code, behind = np.take_along_axis(both, best, 1), np.take_along_axis(cost, best, 1)
    return code


def widths_for(rows: int, dimension: int) -> tuple[int, ...]:
    """Axes used in each turn, so that cells hold about CELL rows: whole turns, then a narrower one."""
    full_bits = max(1, (dimension - 1).bit_length()) + 1
    bits = max(1, int(np.log2(max(2.0, rows / CELL))))
    return (1 << (full_bits - 1),) * (bits // full_bits) + ((1 << (bits % full_bits - 1),) if bits % full_bits else ())


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    y = x / big
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def nearest_rows(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, distance) of each query's k nearest rows but the one with its own key; ties to smaller ids.

    A matrix product finds what can be among the nearest; distances are then taken from the differences, so that equal
    vectors are equally far.
    """
    out = ([], [], [])
    norms = (x**2).sum(1)
    scale = max(1e-300, float(norms.max(initial=0.0)), float((q**2).sum(1).max(initial=0.0)))
    for i in range(len(q)):
        rough = norms - 2 * (x @ q[i]) + q[i] @ q[i]
        rough[keys == own[i]] = np.inf
        can = np.flatnonzero(np.isfinite(rough))
        if len(can) > k:
            can = can[rough[can] <= np.partition(rough[can], k - 1)[k - 1] + 1e-12 * scale * x.shape[1]]
        far = np.sqrt(((x[can] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[can], far))[:k]
        out[0].append(np.full(len(best), i)), out[1].append(can[best]), out[2].append(far[best])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, key, vector) of the rows that take part, those that repeat both once. The key names a row: a hash of both."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    fine = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda e: e != 0)
    found = rows.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(F.col(id_col).cast("long"), v).alias("key"), v.alias("vector"))
    return found.dropDuplicates(["vec_id", "key"])


#: What leaves a piece: a query's key and id, and the row's key, id and distance.
_FOUND = "query_key long, query_id long, key long, vec_id long, score double"


def _met(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query in each piece; rows(t, cell, vec_id, key, vector) and queries(t, cell, vec_id, key,
    vector) of the same (t, cell) meet. Both sides of a large cell are dealt out to pieces, each of which gets a part of the rows
    and a part of the queries: the rows go once to every part of the queries, and the other way round."""
    parts = lambda df, size, name: df.groupBy("t", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    split = parts(rows, ROWS, "rp").join(parts(queries, QUERIES, "qp"), ["t", "cell"])
    dealt = lambda part, n: F.pmod(F.xxhash64("key", F.lit(part)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(split, ["t", "cell"]).select("t", "cell", dealt("r", "rp").alias("r"), every("qp").alias("q"), "vec_id", "key", "vector")
    right = queries.join(split, ["t", "cell"]).select("t", "cell", every("rp").alias("r"), dealt("q", "qp").alias("q"), "vec_id", "key", "vector")

    def piece(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _FOUND.split(", ")]
        if not len(a) or not len(b):
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        column = lambda t, c: t.column(c).to_numpy()
        xs, qs = (_matrix(t.column("vector").combine_chunks()) for t in (a, b))
        keys, ids, own, asked = column(a, "key"), column(a, "vec_id"), column(b, "key"), column(b, "vec_id")
        i, j, far = nearest_rows(qs, own, xs, ids, keys, k)
        i, j = i.astype(int), j.astype(int)
        return pa.table(dict(zip(names, (own[i], asked[i], keys[j], ids[j], far), strict=True)))

    pieces = ["t", "cell", "r", "q"]
    return left.groupBy(*pieces).cogroup(right.groupBy(*pieces)).applyInArrow(piece, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what all pieces found, each row once."""
    once = found.groupBy("query_key", "query_id", "key", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_key", "query_id").orderBy("score", "vec_id", "key")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _whole(rows: DataFrame) -> DataFrame:
    """Everything as one cell, which _met deals out."""
    return rows.withColumns({"t": F.lit(-1), "cell": F.lit(0).cast("long")})


def _hashed(rows: DataFrame, tables: int, widths: tuple[int, ...], probes: int | None) -> DataFrame:
    """rows(vec_id, key, vector) once a table with its cell, or with its ``probes`` likeliest cells."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(_matrix(batch.column(2)))
            for t in range(tables):
                code = cells(x, t, widths)[:, None] if probes is None else likeliest(x, t, widths, probes)
                take = pa.array(np.repeat(np.arange(len(x)), code.shape[1]))
                columns = [pa.array(np.full(code.size, t, np.int32)), pa.array(code.reshape(-1)), *[c.take(take) for c in batch.columns]]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "cell", "vec_id", "key", "vector"])

    return rows.select("vec_id", "key", "vector").mapInArrow(run, "t int, cell long, vec_id long, key long, vector array<double>")


def fit_probes(queries: DataFrame, rows: DataFrame, scratch: Scratch, widths: tuple[int, ...], k: int = NEIGHBOURS, tables: int = TABLES, recall: float = RECALL) -> tuple[int, float]:
    """(probes, recall): the fewest probes a table with which SAMPLE queries, taken by hash, find ``recall`` of their k nearest
    rows, and the share that they find. The sample is searched exactly, in pieces, over all rows; at most SAMPLE * (k + 1)
    vectors reach the driver."""
    picked = scratch.save(queries.orderBy(F.xxhash64("key", F.lit(SEED)), "key").limit(SAMPLE), "sample")
    near = scratch.save(_ranked(_met(_whole(rows), _whole(picked), k), k).select("query_key", "key"), "near")
    wanted = near.join(rows.select("key", "vector"), "key").join(picked.select(F.col("key").alias("query_key"), F.col("vector").alias("asked")), "query_key")
    pairs = wanted.select("vector", "asked").collect()
    if not pairs:
        return 1, 1.0
    x, q = (_unit(np.array([r[c] for r in pairs])) for c in ("vector", "asked"))
    cells_in_all = int(np.prod([2 * w for w in widths]))
    most = 1
    while True:
        rank = np.full(len(x), np.iinfo(np.int64).max)
        for t in range(tables):
            hit = likeliest(q, t, widths, most) == cells(x, t, widths)[:, None]
            rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1) + 1, np.iinfo(np.int64).max))
        found = [(rank <= p).mean() for p in range(1, most + 1)]
        good = next((p for p, share in enumerate(found, 1) if share >= recall), None)
        if good or most >= cells_in_all:
            return (good or most), float(found[(good or most) - 1])
        most = min(2 * most, cells_in_all)


def search(queries: DataFrame, rows: DataFrame, scratch: Scratch, k: int = NEIGHBOURS, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): of every query the k rows found nearest by Euclidean distance on the original vectors.

    queries and rows are (vec_id, key, vector) as ``usable`` gives them; a query's own row, the one with its id and vector,
    is no candidate. Queries that find fewer than k rows (or than there are) are searched exactly, in pieces over all
    rows. Vectors have one length, the commonest; others take no part. Ties go to smaller ids. Empty tables give no rows. Rows that
    repeat id and vector are one; of an id with several vectors each is a row and a query of its own.
    """
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return _ranked(queries.limit(0).selectExpr("key AS query_key", "vec_id AS query_id", "key", "vec_id", "0D AS score"), k).select("query_id", "rank", "vec_id", "score")
    fits = F.size("vector") == lengths["d"]
    rows, queries = scratch.save(rows.where(fits), "rows"), scratch.save(queries.where(fits), "queries")
    n = rows.count()
    widths = widths_for(n, lengths["d"])
    probes, _ = fit_probes(queries, rows, scratch, widths, k, tables, recall)
    found = scratch.save(_ranked(_met(_hashed(rows, tables, widths, None), _hashed(queries, tables, widths, probes), k), k), "found")
    # Whether all candidates there are have been found depends on the query's own row being one of the rows.
    enough = found.groupBy("query_key", "query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_key").alias("key"), F.col("query_id").alias("vec_id"))
    few = scratch.save(queries.join(enough, ["key", "vec_id"], "left_anti"), "few")
    if not few.isEmpty():
        exact = _ranked(_met(_whole(rows), _whole(few), k), k)
        done = few.select(F.col("key").alias("query_key"), F.col("vec_id").alias("query_id"))
        found = scratch.save(found.join(done, ["query_key", "query_id"], "left_anti").unionByName(exact.select(*found.columns)), "all")
    scratch.keep(found)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
