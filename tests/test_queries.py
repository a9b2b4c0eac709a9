"""Every query runs; those with an SQL twin give its rows."""

import os

import duckdb
import pytest

import proofgrid.queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(show(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, name):
    df = q.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in q.ORACLE_SQL:
        assert got
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    res = db.execute(q.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, res.fetchall())


def test_the_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
