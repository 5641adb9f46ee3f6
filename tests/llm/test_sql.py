"""Queries of the operators that SQL can express, against DuckDB."""

import os

import pytest

from metaglean.llm import queries

from .test_operators import SF


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())
