"""A versioned table on a file system: change files per commit, a marker that publishes it, snapshots and changes read back.

    <path>/data/<id>/...parquet            rows of a commit, written before it is published
    <path>/commits/<n>.json                marker of commit n; its creation is the commit
    <path>/commits/<n>.manifest            the markers up to n together, so that readers open few files
    <path>/commits/<n>.base                what is left of the commits before n after a compaction

A commit takes the next number and creates its marker without overwriting; who finds it there lost, and checks whether
what the winner changed meets its own keys before another try.  Readers only look at commits with a marker, so an
aborted write is never seen.  All access goes through Hadoop's file systems; the commit needs one whose create without overwrite is
atomic (local disks, HDFS, object stores with conditional puts), else two writers at once may both believe they won.

Files hold columns by their number, not their name, and a marker says which types they had: renamed columns, changed types and
columns that came later are read by the schema they were written with, without looking into any footer.

A table without rows, or without any commit, reads as an empty one.  Keys are never null; null payload values stay as they are.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableDef
from ..operators import dml, versions

REFUSED = re.compile(rf"(?:(?:ON CONFLICT DO UPDATE|MERGE) )?{dml.SECOND_TIME}|{dml.DUPLICATE_KEY}")
#: Every so many commits, a manifest takes their markers together.
MANIFEST_EVERY = 16


class ConflictError(RuntimeError):
    """A row that a transaction changes was changed by a later commit than its snapshot."""


class RetentionError(ValueError):
    """A time or commit that is not in the past, or older than what is kept."""


@dataclass(frozen=True)
class Commit:
    """``columns``: (number, type) of the columns its files hold; ``truncates``: whether rows of earlier commits are gone."""

    csn: int
    ts_us: int
    origin: str | None
    version: int
    data: str | None
    columns: tuple[tuple[int, str], ...]
    truncates: bool = False

    @staticmethod
    def of(csn: int, x: dict) -> Commit:
        return Commit(csn, x["ts_us"], x.get("origin"), x.get("version", 1), x.get("data"), tuple((i, t) for i, t in x.get("columns", ())), x.get("truncates", False))

    def marker(self) -> dict:
        return {"ts_us": self.ts_us, "origin": self.origin, "version": self.version, "data": self.data, "columns": self.columns, "truncates": self.truncates}


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def create(self, path: str, text: str) -> bool:
        """False if the file is there already."""
        try:
            out = self.fs.create(self._path(path), False)
        except Exception as e:  # py4j wraps the file system's own exceptions
            if self.fs.exists(self._path(path)):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def json(self, path: str, patience: float = 30.0):
        """A file that was just created may be empty until its writer closes it."""
        end = time.time() + patience
        while True:
            try:
                return json.loads(self.read(path))
            except ValueError:
                if time.time() > end:
                    raise
                time.sleep(0.05)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def size(self, path: str) -> int:
        p = self._path(path)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def _numbered(names: Sequence[str], ending: str) -> list[int]:
    return sorted(int(n[: -len(ending)]) for n in names if n.endswith(ending))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, table: TableDef):
        self.spark, self.path, self.table = spark, path.rstrip("/"), table
        self.files = _Files(spark, self.path)
        self.pk = list(table.pk)
        if not self.pk:
            raise ValueError("a versioned table needs a primary key; give rows a surrogate one")

    # Commits.

    def commits(self) -> list[Commit]:
        """All commits that can be read, by number; a base stands for those that were compacted."""
        folder = f"{self.path}/commits"
        names = self.files.names(folder)
        known: dict[int, Commit] = {}
        low = 0
        if bases := _numbered(names, ".base"):
            low = bases[-1]
            x = self.files.json(f"{folder}/{low}.base")
            known[x["csn"]] = Commit.of(x["csn"], x)
        if manifests := _numbered(names, ".manifest"):
            for n, x in self.files.json(f"{folder}/{manifests[-1]}.manifest"):
                if n >= low:
                    known[n] = Commit.of(n, x)
        for n in _numbered(names, ".json"):
            if n >= low and n not in known:
                known[n] = Commit.of(n, self.files.json(f"{folder}/{n}.json"))
        return [known[n] for n in sorted(known)]

    def last_csn(self) -> int:
        names = self.files.names(f"{self.path}/commits")
        return max([*_numbered(names, ".json"), *(n - 1 for n in _numbered(names, ".base"))], default=0)

    def current_csn(self) -> int:
        """A snapshot that sees every commit so far."""
        return self.last_csn() + 1

    def commit(self, changes: DataFrame | Sequence[DataFrame], base_csn: int | None = None, origin: str | None = None, ts_us: int | None = None) -> int:
        """Publishes the changes of one transaction, statement by statement; returns its csn.

        ``base_csn``: the snapshot they were made from; rows changed since make it fail (first committer wins).  The changes are
        evaluated once, when they are written; what is written is then checked: a row that is inserted though its key is there, or that one statement
        changes twice, raises `dml.CardinalityError`, and nothing is published.
        """
        statements = [changes] if isinstance(changes, DataFrame) else list(changes)
        rows = reduce(DataFrame.unionByName, [dml.log_rows(c, self.pk).withColumn("_cid", F.lit(cid)) for cid, c in enumerate(statements)])
        base = base_csn if base_csn is not None else self.current_csn()
        csn = self.last_csn() + 1
        try:
            data = self._write(self._stored(rows), csn)
        except Exception as e:
            # A statement that finds a row twice says so while it runs.
            if said := REFUSED.search(str(e)):
                raise dml.CardinalityError(said[0]) from e
            raise
        try:
            self._check(self._read([Commit(csn, 0, None, self.table.version, data, self._columns())]), base)
            while True:
                if base < csn and self._touched(base, csn, data):
                    raise ConflictError(f"rows were changed after snapshot {base}")
                now = ts_us if ts_us is not None else time.time_ns() // 1000
                if self._publish(Commit(csn, now, origin, self.table.version, data, self._columns())):
                    return csn
                csn = self.last_csn() + 1
        except BaseException:
            self.files.delete(f"{self.path}/data/{data}")
            raise

    def truncate(self, origin: str | None = None, ts_us: int | None = None) -> int:
        """A commit after which the table is empty: a marker only, whatever the table's size.  Earlier snapshots stay."""
        while True:
            now = ts_us if ts_us is not None else time.time_ns() // 1000
            csn = self.last_csn() + 1
            if self._publish(Commit(csn, now, origin, self.table.version, None, (), True)):
                return csn

    def _publish(self, c: Commit) -> bool:
        if not self.files.create(f"{self.path}/commits/{c.csn}.json", json.dumps(c.marker())):
            return False
        if c.csn % MANIFEST_EVERY == 0:
            self.files.create(f"{self.path}/commits/{c.csn}.manifest", json.dumps([[x.csn, x.marker()] for x in self.commits() if x.csn <= c.csn]))
        return True

    def _columns(self) -> tuple[tuple[int, str], ...]:
        return tuple((c.number, c.type) for c in self.table.live)

    def _stored(self, rows: DataFrame) -> DataFrame:
        """Log rows with columns by number."""
        old = F.when(F.col("_old").isNotNull(), F.struct(*[F.col(f"_old.{c.name}").alias(f"c{c.number}") for c in self.table.live]))
        return rows.select(*[F.col(c.name).alias(f"c{c.number}") for c in self.table.live], "_op", old.alias("_old"), "_moved", F.col("_cid").cast("int").alias("_cid"))

    def _write(self, rows: DataFrame, csn: int) -> str:
        data, keys = f"{csn}-{uuid.uuid4().hex}", [f"c{c.number}" for c in self.table.live if c.name in self.pk]
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/data/{data}")
        return data

    def _touched(self, base: int, csn: int, data: str) -> bool:
        if any(c.truncates for c in self.commits() if base <= c.csn < csn):
            return True
        mine = self._read([Commit(csn, 0, None, self.table.version, data, self._columns())]).select(*self.pk)
        return self.log(base, csn).select(*self.pk).join(mine, self.pk, "left_semi").limit(1).count() > 0

    def _check(self, rows: DataFrame, base: int) -> None:
        """A key's changes in order: it can't come if it is there, and one statement can't touch a row twice."""
        w = Window.partitionBy(*self.pk).orderBy(*versions.order())
        seen = rows.select(*self.pk, "_op", "_cid", F.lag("_op").over(w).alias("_before"), F.lag("_cid").over(w).alias("_last"))
        again = (F.col("_op") == "I") & F.col("_before").isin("I", "U")
        twice = (F.col("_last") == F.col("_cid")) & ((F.col("_op") == "U") | ((F.col("_op") == "D") & (F.col("_before") == "D")))
        wrong = seen.select(F.when(again, dml.DUPLICATE_KEY).when(twice, dml.SECOND_TIME).alias("what")).filter("what IS NOT NULL").limit(1).collect()
        if wrong:
            raise dml.CardinalityError(wrong[0].what)
        first = seen.filter((F.col("_op") == "I") & F.col("_before").isNull()).select(*self.pk)
        there = self._current(self.log(self._since(base), base).join(first, self.pk, "left_semi"))
        if there.limit(1).count():
            raise dml.CardinalityError(dml.DUPLICATE_KEY)

    # Reading.

    def _since(self, csn: int) -> int:
        """The first commit whose rows a snapshot at ``csn`` can see."""
        return max((c.csn for c in self.commits() if c.truncates and c.csn < csn), default=1)

    def log(self, from_csn: int = 1, to_csn: int | None = None) -> DataFrame:
        """Changes of the commits in [from_csn, to_csn), only their files, as rows of the table's present version."""
        end = to_csn if to_csn is not None else self.current_csn()
        return self._read([c for c in self.commits() if from_csn <= c.csn < end])

    def _read(self, commits: Sequence[Commit]) -> DataFrame:
        by_schema: dict[tuple, list[Commit]] = {}
        for c in commits:
            if c.data:
                by_schema.setdefault((c.version, c.columns), []).append(c)
        parts = [self._as_present(version, columns, mine) for (version, columns), mine in by_schema.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self._empty()

    def _as_present(self, version: int, columns: tuple[tuple[int, str], ...], commits: Sequence[Commit]) -> DataFrame:
        row = T.StructType([T.StructField(f"c{i}", T._parse_datatype_string(t)) for i, t in columns])
        stored = T.StructType([*row.fields, T.StructField("_op", T.StringType()), T.StructField("_old", row), T.StructField("_moved", T.BooleanType()), T.StructField("_cid", T.IntegerType())])
        raw = self.spark.read.schema(stored).parquet(*[f"{self.path}/data/{c.data}" for c in commits])
        # Of many commits, the folder's name says which one a row is from; the map is as long as the list of commits.
        of = self.spark.createDataFrame([(c.data, c.csn, c.ts_us, c.origin) for c in commits], "_data string, _csn long, _ts_us long, _origin string")
        if len(commits) == 1:
            c = commits[0]
            raw = raw.withColumns({"_csn": F.lit(c.csn).cast("long"), "_ts_us": F.lit(c.ts_us).cast("long"), "_origin": F.lit(c.origin).cast("string")})
        else:
            raw = raw.withColumn("_data", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(of), "_data")
        have = {i for i, _ in columns}

        def value(c, prefix: str = "") -> Column:
            return (F.col(f"{prefix}c{c.number}") if c.number in have and version >= c.since else F.lit(c.missing)).cast(c.type).alias(c.name)

        old = F.when(F.col("_old").isNotNull(), F.struct(*[value(c, "_old.") for c in self.table.live])).alias("_old")
        return raw.select(*[value(c) for c in self.table.live], "_op", old, "_moved", "_cid", F.timestamp_micros("_ts_us").alias("_ts"), "_origin", F.lit(version).alias("_version"), "_csn")

    def _empty(self) -> DataFrame:
        row = T.StructType([T.StructField(f.name, f.dataType) for f in self.table.schema().fields])
        more = [("_op", T.StringType()), ("_old", row), ("_moved", T.BooleanType()), ("_cid", T.IntegerType()), ("_ts", T.TimestampType()), ("_origin", T.StringType()), ("_version", T.IntegerType()), ("_csn", T.LongType())]
        return self.spark.createDataFrame([], T.StructType([*row.fields, *(T.StructField(n, t) for n, t in more)]))

    def _names(self) -> list[str]:
        return [c.name for c in self.table.live]

    def _current(self, log: DataFrame) -> DataFrame:
        return versions.latest(log.select(*self._names(), *versions.META), self.pk).select(*self._names())

    def snapshot(self, csn: int | None = None) -> DataFrame:
        end = csn if csn is not None else self.current_csn()
        return self._current(self.log(self._since(end), end))

    def csn_at(self, ts_us: int) -> int:
        """The snapshot that sees the commits up to and with a time."""
        return max((c.csn for c in self.commits() if c.ts_us <= ts_us), default=0) + 1

    def as_of(self, ts_us: int) -> DataFrame:
        return self.snapshot(self.csn_at(ts_us))

    def history(self) -> DataFrame:
        return versions.history(self.log().select(*self._names(), *versions.META), self.pk)

    # The schema.

    def alter(self, change: Callable[[TableDef], TableDef]) -> None:
        """Takes another version of the definition; files stay as they are and are read as rows of it."""
        self.table = change(self.table)
        self.pk = list(self.table.pk)

    # Maintenance.

    def rewind(self, csn: int) -> int:
        """A commit that brings back the state before commit ``csn``; later commits stay in the log."""
        if csn > self.last_csn():
            raise RetentionError(f"commit {csn} is not in the past")
        if csn < self.horizon_csn():
            raise RetentionError(f"commit {csn} is older than what is kept")
        now, before = self.snapshot(), self.snapshot(csn)
        a, b = now.alias("a"), before.alias("b")
        joined = a.join(b, dml._same(self.pk, "a", "b"), "full")
        row = lambda x: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in now.columns])
        there, back = F.col(f"a.{self.pk[0]}").isNotNull(), F.col(f"b.{self.pk[0]}").isNotNull()
        op = F.when(there & ~back, "D").when(~there & back, "I").when(~row("a").eqNullSafe(row("b")), "U")
        changes = joined.select(op.alias("_op"), F.when(there, row("a")).alias("before"), F.when(back, row("b")).alias("after")).filter("_op IS NOT NULL")
        return self.commit(changes)

    def rewind_by_time(self, seconds: float) -> int:
        return self.rewind_to_timestamp(time.time_ns() // 1000 - int(seconds * 1e6))

    def rewind_to_timestamp(self, ts_us: int) -> int:
        return self.rewind(self.csn_at(ts_us))

    def horizon_csn(self) -> int:
        """The oldest snapshot that can still be read."""
        return max(_numbered(self.files.names(f"{self.path}/commits"), ".base"), default=1)

    def compact(self, keep_from: int) -> None:
        """Folds the commits before ``keep_from`` into one; snapshots from ``keep_from`` on are unchanged.

        The new base counts from the moment its one file is there; only then are markers and data that nothing refers to any more deleted, so a reader
        or a crash at any point finds either the old commits or the base.
        """
        old = [c for c in self.commits() if c.csn < keep_from]
        if len(old) < 2:
            return
        last = old[-1]
        rows = versions.latest(self.log(self._since(keep_from), keep_from), self.pk).select(*self._names(), "_op", "_old", "_moved", "_cid")
        base = Commit(last.csn, last.ts_us, last.origin, self.table.version, self._write(self._stored(rows), last.csn), self._columns())
        earlier = [n for n in self.files.names(f"{self.path}/commits") if n.endswith(".base")]
        if not self.files.create(f"{self.path}/commits/{keep_from}.base", json.dumps(base.marker() | {"csn": last.csn})):
            self.files.delete(f"{self.path}/data/{base.data}")
            return
        for name in earlier:
            self.files.delete(f"{self.path}/commits/{name}")
        for n in _numbered(self.files.names(f"{self.path}/commits"), ".json"):
            if n < keep_from:
                self.files.delete(f"{self.path}/commits/{n}.json")
        for c in old:
            if c.data:
                self.files.delete(f"{self.path}/data/{c.data}")

    def log_size(self) -> int:
        """Bytes of the log."""
        return self.files.size(f"{self.path}/data")

    def row_counts(self) -> tuple[int, int]:
        """(live rows, dead versions): what an index's row statistics give."""
        live, total = self.snapshot().count(), self.log().count()
        return live, total - live

    # The stream.

    def read_stream(self) -> DataFrame:
        """The markers of commits as a stream: a commit comes when it is published, and what is never published never comes."""
        return self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(f"{self.path}/commits").select(F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("long").alias("csn"))

    def changes_of(self, csns: Sequence[int]) -> DataFrame:
        """Log rows of some commits; of one that truncates, the rows that went with it."""
        wanted = [c for c in self.commits() if c.csn in set(csns)]
        out = self._read(wanted)
        for c in wanted:
            if c.truncates:
                gone = self.snapshot(c.csn)
                row = T.StructType([T.StructField(f.name, f.dataType) for f in gone.schema.fields])
                old = F.struct(*[F.col(n) for n in gone.columns]).cast(row)
                more = {"_op": F.lit("D"), "_old": old, "_moved": F.lit(False), "_cid": F.lit(0), "_ts": F.timestamp_micros(F.lit(c.ts_us)), "_origin": F.lit(c.origin).cast("string"), "_version": F.lit(c.version), "_csn": F.lit(c.csn).cast("long")}
                out = out.unionByName(gone.withColumns(more))
        return out
