"""COPY, cursors, policies and materialized views."""

import pytest
from pyspark.sql import functions as F

from palimpsest.model import ColumnDef, TableDef
from palimpsest.sources.files import MaterializedView, Policies, copy_from, copy_to, cursor

T = TableDef("t", (ColumnDef("id", "int"), ColumnDef("s", "string"), ColumnDef("twice", "int", generated="id * 2")), ("id",))


def test_copy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, s string")
    copy_to(df, f"file://{tmp_path}/out", delimiter="|", null="\\N")
    assert sorted(map(tuple, copy_from(spark, f"file://{tmp_path}/out", T, delimiter="|", null="\\N").collect())) == [(1, "a|b", 2), (2, None, 4)]
    (tmp_path / "bad.csv").write_text("x,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        copy_from(spark, f"file://{tmp_path}/bad.csv", T).collect()


def test_cursor(spark):
    assert [len(b) for b in cursor(spark.range(25).orderBy("id"), 10)] == [10, 10, 5]


def test_policies(spark):
    df = spark.range(10)
    assert Policies().view(df).count() == 0
    assert Policies().allow(F.col("id") < 3).allow(F.col("id") > 7).restrict(F.col("id") % 2 == 0).view(df).count() == 3


def test_materialized_view(spark, tmp_path):
    n = [3]
    v = MaterializedView(spark, f"file://{tmp_path}/v", lambda: spark.range(n[0]))
    with pytest.raises(ValueError):
        v.read()
    v.refresh()
    n[0] = 5
    assert v.read().count() == 3
    v.refresh()
    assert v.read().count() == 5
