"""Every query that has SQL gives the same rows as DuckDB on the same files."""

import __spark_entry__ as entry
import duckdb
import pytest
from millrace import testdata

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(testdata.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = got.columns
    mine = [tuple(r) for r in got.collect()]
    theirs = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    if " ORDER BY " in testdata.STATEMENTS.get(name, ("",))[0]:
        assert mine == theirs
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)
    if name not in ("is_null", "date_in"):
        assert mine


def test_every_query_has_sql_or_is_known_not_to():
    assert set(testdata.queries()) == set(testdata.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
