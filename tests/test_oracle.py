"""Every query with SQL against DuckDB on the smallest tables, as sorted rows."""

import math

import duckdb
import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    value = lambda v: ("nan" if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v)
    return sorted(cols), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0]
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.execute(ORACLE_SQL[name])
        assert got == _rows([c[0] for c in want.description], want.fetchall())
