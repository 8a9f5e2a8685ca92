"""Every registered query of the reference's operators against its SQL in DuckDB."""

import duckdb
import pytest

from veristrata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def check(spark, duck, query, sql):
    got = query(spark, SF).toArrow()
    if sql is None:
        assert got.num_rows
        return
    want = duck.sql(sql).to_arrow_table()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    rows = lambda t: sorted(map(str, zip(*[t[c].to_pylist() for c in columns], strict=True)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    check(spark, duck, registry.QUERIES[name], registry.SQL.get(name))


@pytest.mark.parametrize("name", sorted(registry.CASES))
def test_cases(spark, duck, name):
    check(spark, duck, registry.CASES[name], registry.CASES_SQL.get(name))
