"""Every query that has SQL gives the same rows as DuckDB on the same documents."""

import duckdb
import pytest
from millrace.llm import queries


def compare(spark, sf, name, files=""):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet{files}'")
    got, want = queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.project(names).fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf, name):
    compare(spark, sf, name)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_of_odd_texts(spark, docs_of, tmp_path, name):
    texts = [None, "", "É日 " * 40 + "x", "a b\tc\x0bd", "mail me a.b+c@d-e.fg.h now, 10.0.0.256 10.0.0.255 +1 (212) 555-0100 4111 1111 1111 1111 1.2.3.4.5", "Same text " * 30, "same text " * 30, "z" * 2100, "y" + "z" * 2100]
    docs_of(list(enumerate(texts * 2, 1))).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), name, "/*.parquet")
