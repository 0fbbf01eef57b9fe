"""Every query of the core against its SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from palimpsest.queries import ORACLE_SQL, QUERIES
from palimpsest.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    def text(v):
        return "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)

    columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
    return sorted(tuple(map(text, r)) for r in zip(*columns, strict=True))


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    got, want = QUERIES[key](spark, SF).toArrow(), duck.sql(ORACLE_SQL[key]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
