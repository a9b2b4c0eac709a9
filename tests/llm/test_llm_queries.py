"""Queries with SQL twins give their rows; all of them have the columns promised."""

import os

import duckdb
import pytest

from proofgrid.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    res = db.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(res.fetchall(), key=repr)


def test_columns(spark):
    wanted = {
        "op1": ["query_id bigint", "rank int", "vec_id bigint", "score double"], "op3": ["doc_id bigint", "size bigint", "source_size bigint", "target double", "taken bigint"],
        "op4": ["page_id bigint", "url string", "text string", "n_chars bigint"], "op5": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
        "op9": ["doc_id bigint", "n_bytes bigint", "n_tokens bigint", "over_limit boolean"], "op10": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
    }
    for name, f in queries.QUERIES.items():
        if (want := wanted.get(name.split("_")[0])) is not None:
            have = {f"{c} {t}" for c, t in f(spark, DATA).dtypes}
            assert set(want) <= have, name
