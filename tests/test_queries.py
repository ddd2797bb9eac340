"""Each query over score tables against its SQL in DuckDB."""

import duckdb
import pytest

from scorelake import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, db, data, name):
    got, want = queries.QUERIES[name](spark, data), db.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
    assert rows


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.SQL])
def test_query_has_rows(spark, data, name):
    assert queries.QUERIES[name](spark, data).count()
