"""Tables on disk, changes, constraints, ranges and streams."""

from functools import reduce

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ranges
from palimpsest.functions.types import enum_order
from palimpsest.model import ColumnDef, ForeignKey, IndexDef, KeyPart, TableDef
from palimpsest.operators import access, constraints, dml, introspect, versions
from palimpsest.operators.joins import asof_join, range_join
from palimpsest.plans.keyrange import all_array, any_array, row_compare
from palimpsest.queries import QUERIES
from palimpsest.sources.commitlog import ConflictError, RetentionError, VersionedTable
from palimpsest.streaming import cdc

ITEMS = TableDef("items", (ColumnDef("id", "bigint", nullable=False), ColumnDef("v", "int"), ColumnDef("s", "string")), ("id",))


def ids(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def items(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/items", ITEMS)
    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, None, None)], ITEMS.schema())
    assert t.commit(dml.insert(rows, rows), ts_us=1_000) == 1
    return t


def test_snapshots_and_time_travel(items):
    s = items.snapshot()
    items.commit(dml.update(s, {"v": F.col("v") + 1}, F.col("id") <= 2), ts_us=2_000)
    items.commit(dml.delete(items.snapshot(), F.col("id") == 1), ts_us=3_000)
    assert ids(items.snapshot(2)) == [(1, 10, "a"), (2, 20, "b"), (3, None, None)]
    assert ids(items.snapshot(3)) == [(1, 11, "a"), (2, 21, "b"), (3, None, None)]
    assert ids(items.snapshot()) == [(2, 21, "b"), (3, None, None)]
    assert ids(items.as_of(2_500)) == ids(items.snapshot(3))
    assert ids(items.as_of(10)) == []
    assert items.row_counts() == (2, 4) and items.log_size() > 0


def test_first_committer_wins(items):
    base = items.current_csn()
    mine = dml.update(items.snapshot(base), {"v": F.lit(1)}, F.col("id") == 2)
    items.commit(dml.update(items.snapshot(base), {"v": F.lit(2)}, F.col("id") == 2), base_csn=base)
    with pytest.raises(ConflictError):
        items.commit(mine, base_csn=base)
    other = dml.update(items.snapshot(base), {"v": F.lit(7)}, F.col("id") == 1)
    assert items.commit(other, base_csn=base) == 3
    assert ids(items.snapshot()) == [(1, 7, "a"), (2, 2, "b"), (3, None, None)]


def test_changed_key_and_statements_of_one_commit(items):
    a = dml.update(items.snapshot(), {"id": F.col("id") + 100}, F.col("id") == 1)
    b = dml.delete(items.snapshot(), F.col("id") == 2)
    items.commit([a, b])
    assert ids(items.snapshot().select("id")) == [(3,), (101,)]
    assert items.log(2).filter("_moved").count() == 2


def test_rewind_and_retention(items):
    items.commit(dml.update(items.snapshot(), {"v": F.lit(0)}))
    items.commit(dml.delete(items.snapshot(), F.col("id") == 3))
    items.rewind(2)
    assert ids(items.snapshot()) == [(1, 10, "a"), (2, 20, "b"), (3, None, None)]
    with pytest.raises(RetentionError):
        items.rewind(99)
    after = ids(items.snapshot())
    items.compact(4)
    assert ids(items.snapshot()) == after
    with pytest.raises(RetentionError):
        items.rewind(1)


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_rewind_of_a_log_that_is_a_union(spark, broadcast):
    """1 stays, 2 changed, 3 went, 4 came, 5 went before, 6 came back, 7 changed twice before; also where all joins are sort-merge joins."""
    columns = "k long, v int, _op string, _csn long, _cid int, _ts long"
    parts = [
        [(k, k, "I", 1, 0, 1) for k in (1, 2, 3, 5, 6, 7)], [(7, 71, "U", 2, 0, 2), (7, 72, "U", 2, 1, 2), (5, 5, "D", 2, 0, 2), (6, 6, "D", 2, 0, 2)],
        [(2, 20, "U", 3, 0, 3), (3, 3, "D", 3, 0, 3), (7, 73, "U", 3, 0, 3)], [(4, 4, "I", 4, 0, 4), (6, 60, "I", 4, 0, 4)],
    ]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        log = reduce(DataFrame.union, [spark.createDataFrame(p, columns) for p in parts])
        back = versions.rewind(log, ["k"], 3, 5)
        assert back.columns == ["k", "v", "_op", "_csn", "_cid"]
        assert ids(back) == [(2, 2, "U", 5, 0), (3, 3, "U", 5, 0), (4, None, "D", 5, 0), (6, None, "D", 5, 0), (7, 72, "U", 5, 0)]
        assert ids(versions.snapshot(log.unionByName(back.withColumn("_ts", F.lit(5))), ["k"], 6)) == ids(versions.snapshot(log, ["k"], 3)) == [(1, 1), (2, 2), (3, 3), (7, 72)]
        assert QUERIES["rewind_to_csn"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_added_column_reads_its_missing_value(spark, items):
    items.alter(lambda t: t.add_column(ColumnDef("n", "int", missing=5)))
    rows = spark.createDataFrame([(9, 1, "x", None)], items.table.schema())
    items.commit(dml.insert(items.snapshot(), rows))
    assert ids(items.snapshot()) == [(1, 10, "a", 5), (2, 20, "b", 5), (3, None, None, 5), (9, 1, "x", None)]


def follow(items, tmp_path, got):
    q = cdc.replicate(items, f"file://{tmp_path}/cp", lambda df, n: got.extend(tuple(r) for r in df.select("id", "v", "_op").collect())).start()
    q.awaitTermination(60)
    assert q.exception() is None


def test_stream_applies_changes(spark, items, tmp_path):
    items.commit(dml.update(items.snapshot(), {"v": F.lit(8)}, F.col("id") == 2))
    got = []
    follow(items, tmp_path, got)
    assert sorted(got, key=str) == sorted([(1, 10, "I"), (2, 8, "U"), (3, None, "I")], key=str)


def test_stream_sees_published_work_only_and_all_of_it(spark, items, tmp_path, monkeypatch):
    got = []
    # Files of a transaction that has not committed when the stream looks.
    late = items._write(items._stored(dml.log_rows(dml.delete(items.snapshot(), F.col("id") == 1), ["id"]).withColumn("_cid", F.lit(0))), 2)
    follow(items, tmp_path, got)
    assert sorted(x[0] for x in got) == [1, 2, 3] and items.snapshot().count() == 3
    got.clear()
    # A loser's files never count, even once another commit has taken the number it was after.
    items._write(items._stored(dml.log_rows(dml.delete(items.snapshot()), ["id"]).withColumn("_cid", F.lit(0))), 2)
    monkeypatch.setattr(items, "_write", lambda rows, csn: late)
    assert items.commit(dml.delete(items.snapshot(), F.col("id") == 1)) == 2
    follow(items, tmp_path, got)
    assert got == [(1, 10, "D")] and ids(items.snapshot().select("id")) == [(2,), (3,)]
    items.truncate()
    got.clear()
    follow(items, tmp_path, got)
    assert sorted(got, key=str) == sorted([(2, 20, "D"), (3, None, "D")], key=str)


def test_keys_that_shift_keep_their_rows(items):
    items.commit(dml.update(items.snapshot(), {"id": F.col("id") + 1}))
    assert ids(items.snapshot()) == [(2, 10, "a"), (3, 20, "b"), (4, None, None)]
    items.commit(dml.update(items.snapshot(), {"id": F.col("id") - 1}))
    assert ids(items.snapshot()) == [(1, 10, "a"), (2, 20, "b"), (3, None, None)]
    log = items.log().select("id", "v", "s", *versions.META)
    for rows in (log.orderBy("_op"), log.orderBy(F.desc("_op"))):
        assert ids(versions.snapshot(rows.coalesce(1), ["id"], 3)) == [(2, 10, "a"), (3, 20, "b"), (4, None, None)]
    net = {r.id: r._op for r in cdc.net_changes(log, ["id"], 2, 3).collect()}
    assert net == {1: "D", 2: "U", 3: "U", 4: "I"}


def test_a_key_has_one_row(spark, items):
    there = spark.createDataFrame([(2, 99, "x")], ITEMS.schema())
    twice = spark.createDataFrame([(7, 1, "x"), (7, 2, "y")], ITEMS.schema())
    before = ids(items.snapshot())
    for bad in (there, twice):
        with pytest.raises(dml.CardinalityError, match="duplicate key"):
            items.commit(dml.insert(items.snapshot(), bad))
        with pytest.raises(PySparkException, match="duplicate key"):
            dml.insert(items.snapshot(), bad, ["id"]).collect()
    with pytest.raises(dml.CardinalityError, match="duplicate key"):
        items.commit(dml.update(items.snapshot(), {"id": F.lit(3)}, F.col("id") == 1))
    with pytest.raises(PySparkException, match="second time"):
        dml.upsert_do_update(items.snapshot(), twice, ["id"], {"v": F.col("excluded.v")}).collect()
    one = dml.update(items.snapshot(), {"v": F.lit(1)}, F.col("id") == 1)
    with pytest.raises(dml.CardinalityError, match="second time"):
        items.commit(dml.together(one, one))
    assert ids(items.snapshot()) == before and items.last_csn() == 1
    # Gone in one statement, back in the next one.
    assert items.commit([dml.delete(items.snapshot(), F.col("id") == 2), dml.insert(items.snapshot(), there)]) == 2
    assert items.snapshot().filter("id = 2").first().v == 99


def test_renamed_and_retyped_columns_read_old_files(spark, items):
    items.alter(lambda t: t.rename_column("v", "amount").alter_type("amount", "bigint").rename_column("id", "key"))
    items.commit(dml.insert(items.snapshot(), spark.createDataFrame([(9, 5_000_000_000, "z")], items.table.schema())))
    assert items.snapshot().columns == ["key", "amount", "s"] and dict(items.snapshot().dtypes)["amount"] == "bigint"
    assert ids(items.snapshot().na.fill(-1, ["amount"])) == [(1, 10, "a"), (2, 20, "b"), (3, -1, None), (9, 5_000_000_000, "z")]
    items.alter(lambda t: t.drop_column("s").add_column(ColumnDef("s", "int", missing=4)))
    items.commit(dml.update(items.snapshot(), {"s": F.lit(6)}, F.col("key") == 1))
    assert ids(items.snapshot().select("key", "s")) == [(1, 6), (2, 4), (3, 4), (9, 4)]
    d = TableDef("t", (ColumnDef("a", "int", check="a > aa"), ColumnDef("aa", "int"), ColumnDef("g", "int", generated="a * 2")), ("a",), (IndexDef("i", (KeyPart("a + 1"),), include=("a",)),), ("a < 5",)).rename_column("a", "b")
    assert (d.pk, d.columns[0].check, d.columns[2].generated, d.indexes[0].key[0].expr, d.indexes[0].include, d.checks) == (("b",), "b > aa", "b * 2", "b + 1", ("b",), ("b < 5",))


def test_truncate_and_what_came_before(spark, items):
    assert items.truncate() == 2 and items.snapshot().count() == 0 and items.snapshot(2).count() == 3
    items.commit(dml.insert(items.snapshot(), spark.createDataFrame([(1, 0, "n")], ITEMS.schema())))
    assert ids(items.snapshot()) == [(1, 0, "n")]
    items.rewind(2)
    assert ids(items.snapshot()) == [(1, 10, "a"), (2, 20, "b"), (3, None, None)]
    items.compact(4)
    assert ids(items.snapshot(4)) == [(1, 0, "n")] and ids(items.snapshot().select("id")) == [(1,), (2,), (3,)]


def test_compaction_can_stop_anywhere(items, monkeypatch):
    for v in range(3):
        items.commit(dml.update(items.snapshot(), {"v": F.lit(v)}, F.col("id") == 1))
    want = ids(items.snapshot())
    real, left = items.files.delete, [0]

    def dying(path):
        if left[0] == 0:
            raise OSError("gone")
        left[0] -= 1
        real(path)

    monkeypatch.setattr(items.files, "delete", dying)
    for n in range(4):
        left[0] = n
        with pytest.raises(OSError):
            items.compact(4 + n)
        assert ids(items.snapshot()) == want
        items.commit(dml.update(items.snapshot(), {"s": F.lit(f"s{n}")}, F.col("id") == 2))
        want = [(1, 2, "a"), (2, 20, f"s{n}"), (3, None, None)]
        assert ids(items.snapshot()) == want


def test_manifests_hold_the_markers(items, monkeypatch):
    from palimpsest.sources import commitlog

    monkeypatch.setattr(commitlog, "MANIFEST_EVERY", 2)
    for v in range(4):
        items.commit(dml.update(items.snapshot(), {"v": F.lit(v)}, F.col("id") == 1), ts_us=v)
    opened, real = [], items.files.read
    monkeypatch.setattr(items.files, "read", lambda p: opened.append(p) or real(p))
    assert [c.csn for c in items.commits()] == [1, 2, 3, 4, 5] and [p.rpartition("/")[2] for p in opened] == ["4.manifest", "5.json"]
    assert items.snapshot(4).filter("id = 1").first().v == 1


def test_merge_refuses_a_second_time(spark):
    t = spark.createDataFrame([(1, 1)], "id int, v int")
    s = spark.createDataFrame([(1, 2), (1, 3)], "id int, v int")
    with pytest.raises(PySparkException, match="second time"):
        dml.merge(t, s, ["id"], {"v": F.col("s.v")}).collect()


def test_constraints(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (2, 5, 9, 1), (3, 8, 10, 1), (4, 3, 3, 1), (5, 0, 99, None), (6, 0, None, 2), (7, 50, 51, 2)], "id int, lo int, hi int, g int")
    assert ids(constraints.overlaps(df, ["id"], "lo", "hi", ["g"]).select("id")) == [(2,), (3,), (6,), (7,)]
    two = spark.createDataFrame([(None, 1), (None, 1), (2, 2), (2, 2)], "a int, b int")
    assert ids(constraints.unique(two, ["a", "b"])) == [(2, 2, 2)]
    assert constraints.unique(two, ["a", "b"], nulls_distinct=False).count() == 2
    child = spark.createDataFrame([(1,), (7,), (None,)], "p int")
    assert ids(constraints.foreign_key(child, df, ForeignKey(("p",), "t", ("id",)))) == []
    moved = spark.createDataFrame([(1, 70)], "old int, new int")
    assert (70,) in ids(constraints.cascade(child.na.drop(), moved, "p"))
    table = TableDef("t", (ColumnDef("a", "int", nullable=False), ColumnDef("b", "int")), indexes=(IndexDef("u", (KeyPart("b"),), "unique"),))
    assert ids(constraints.verify(two, table)) == [("not null a", 2), ("unique u", 2)]


def test_ranges(spark):
    df = spark.createDataFrame([("[1,5]",), ("(1,5)",), ("empty",), ("[,3)",)], "t string").select("t", ranges.parse(F.col("t")).alias("r"))
    got = {r[0]: tuple(r)[1:] for r in df.select("t", ranges.show(F.col("r")), ranges.contains(F.col("r"), F.lit(5)), ranges.overlap(F.col("r"), ranges.make(F.lit(0), F.lit(2)))).collect()}
    assert got == {"[1,5]": ("[1,6)", True, True), "(1,5)": ("[2,5)", False, False), "empty": ("empty", False, False), "[,3)": ("(,3)", False, True)} or got["[,3)"][1:] == (False, True)


def test_predicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 4), (1, 5), (0, None), (None, 1)], "a int, b int")
    assert ids(df.filter(row_compare(["a", "b"], "<", [1, 5])).na.fill(-1)) == [(0, -1), (1, 4)]
    assert df.filter(any_array(F.col("b"), "<", [2, 5])).count() == 2
    assert df.filter(all_array(F.col("b"), "<>", [4, 5])).count() == 1


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 4, "y"), (2, 10, "z")], "k int, t int, v string")
    assert sorted(map(tuple, asof_join(left, right, ["k"], "t", ["v"]).collect()), key=str) == [(1, 1, None), (1, 5, "y"), (2, 9, None)]
    points, spans = spark.range(30).withColumnRenamed("id", "p"), spark.createDataFrame([(3, 17), (16, 18), (5, 5)], "lo int, hi int")
    assert range_join(points, "p", spans, "lo", "hi", 4).count() == 16


def test_slices_change_nothing(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.randrange(3), r.choice([None, r.randrange(400)]) if i % 50 == 0 else r.randrange(400), r.randrange(1, 6)) for i in range(300)]
    rows = [(i, g, lo, None if i % 70 == 3 or lo is None else lo + n) for i, g, lo, n in rows]
    df = spark.createDataFrame(rows, "id int, g int, lo int, hi int")
    meet = lambda a, b: (a[2] is None or b[3] is None or a[2] < b[3]) and (b[2] is None or a[3] is None or b[2] < a[3])
    for equal in ([], ["g"]):
        want = sorted((a[0],) for a in rows if any(a is not b and (not equal or a[1] == b[1]) and meet(a, b) for b in rows))
        for slices in (1, 7, 32):
            assert ids(constraints.overlaps(df, ["id"], "lo", "hi", equal, slices).select("id")) == want
    left = spark.createDataFrame([(r.choice([None, 1, 2]), r.randrange(50), i) for i in range(200)], "k int, t int, l int")
    right = spark.createDataFrame([(r.choice([None, 1, 2]), r.randrange(50), i) for i in range(60)], "k int, t int, v int")
    wide = lambda n: sorted(map(str, asof_join(left, right, ["k"], "t", ["v"], ("l", "v"), n).collect()))
    assert wide(1) == wide(9) and len(wide(9)) == 200
    points = spark.range(3000).withColumnRenamed("id", "p")
    spans = spark.createDataFrame([(3, 2900), (16, 18), (5, 5), (2999, 3500), (None, 3), (100, 228)], "lo int, hi int")
    got = sorted(map(tuple, range_join(points, "p", spans, "lo", "hi", 4).collect()))
    assert got == sorted((p, lo, hi) for lo, hi in ((3, 2900), (16, 18), (2999, 3500), (100, 228)) for p in range(3000) if lo <= p < hi)


def test_index_copies(spark, tmp_path):
    from palimpsest.sources.indexes import IndexCopy

    t = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    copy = IndexCopy(spark, f"file://{tmp_path}/by_k", IndexDef("by_k", (KeyPart("k", desc=True),), where="id < 90"), ["id"])
    with pytest.raises(ValueError):
        copy.read()
    for table in (t, t.filter("k <> 3"), t):
        copy.build(table)
        assert copy.agrees(table)
    assert [r.id for r in copy.scan(F.col("key_0") >= 5).limit(2).collect()] == [6, 13] and copy.fetch(t, F.col("key_0") == 3).count() == 13
    copy.build(t.limit(0))
    assert copy.read().count() == 0
    copy.drop()
    assert not (tmp_path / "by_k").exists()


def test_triggers(spark):
    from palimpsest.operators import triggers

    t = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    double = triggers.Triggers().before("IU", lambda old, new: new.withField("v", new["v"] * 2), F.col("after.v") < 15).before("D", lambda old, new: F.when(old["v"] > 15, old)).after("U", lambda c: triggers.audit(c, ["id"], "v"))
    changes, (seen,) = double.fire(dml.together(dml.update(t, {"v": F.col("v") + 1}), dml.delete(t)))
    assert ids(changes.select("_op", "before.id", "after.v").na.fill(-1)) == [("D", 2, -1), ("U", 1, 22), ("U", 2, 21)]
    assert ids(seen) == [("U", 1, 10, 22), ("U", 2, 20, 21)]


def test_access(spark):
    t = spark.range(100).withColumn("k", F.col("id") % 7)
    a, b = access.KeySet(t, ["id"], F.col("k") == 3), access.KeySet(t, ["id"], F.col("id") < 20)
    assert ids((a & b).fetch().select("id")) == [(3,), (10,), (17,)]
    other = access.KeySet(t, ["id"], keys=spark.range(5))
    assert (a & other).fetch().count() == 1 and (a | other).fetch().count() == 18
    assert access.multi_lookup(t, "id", list(range(50, 2000))).count() == 50
    assert introspect.same_rows(t, t.orderBy("id")) and not introspect.same_rows(t, t.limit(3))
    order = enum_order(F.col("s"), ("low", "high"))
    e = spark.createDataFrame([("high",), ("low",), (None,)], "s string")
    assert [r.s for r in e.orderBy(order.asc_nulls_last()).collect()] == ["low", "high", None]


def test_definitions():
    d = ITEMS.create_index(IndexDef("by_v", (KeyPart("v"),)))
    with pytest.raises(ValueError):
        d.drop_column("v")
    with pytest.raises(ValueError):
        d.drop_column("id")
    with pytest.raises(ValueError):
        d.add_column(ColumnDef("s", "int"))
    assert [c.name for c in d.drop_index("by_v").drop_column("v").live] == ["id", "s"]
