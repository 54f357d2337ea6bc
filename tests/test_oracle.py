"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

from inkmill.plans import registry

TABLES = "documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, data, db, name):
    df = registry.QUERIES[name](spark, data)
    sql = db.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
