"""Change feeds: changes in commit order, net changes, filters by origin, before and after, and their application."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import versions


def changes(log: DataFrame, from_csn: int, to_csn: int) -> DataFrame:
    """Changes of the commits in [from_csn, to_csn); order by `_csn`, `_cid` where order matters."""
    return log.filter((F.col("_csn") >= from_csn) & (F.col("_csn") < to_csn))


def without_origin(log: DataFrame, origin: str) -> DataFrame:
    """Changes that don't come from ``origin``; those without one stay."""
    return log.filter(F.col("_origin").isNull() | (F.col("_origin") != origin))


def before_after(log: DataFrame, pk: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(pk, _op, _csn, old_*, new_*): replica identity FULL, from the version before in the log."""
    w = Window.partitionBy(*pk).orderBy(*versions.order())
    gone = F.lag("_op").over(w) == "D"
    old = [F.when(~F.coalesce(gone, F.lit(True)), F.lag(c).over(w)).alias(f"old_{c}") for c in columns]
    new = [F.when(F.col("_op") != "D", F.col(c)).alias(f"new_{c}") for c in columns]
    return log.select(*pk, "_op", "_csn", *old, *new)


def net_changes(log: DataFrame, pk: Sequence[str], from_csn: int, to_csn: int) -> DataFrame:
    """One change a key over the commits in [from_csn, to_csn): first and last together; inserts that go again are none."""
    rest = [c for c in log.columns if c not in pk]
    at = versions.place()
    ends = changes(log, from_csn, to_csn).groupBy(*pk).agg(F.min_by("_op", at).alias("_first"), F.max_by(F.struct(*rest), at).alias("_v"))
    last = F.col("_v._op")
    op = F.when((F.col("_first") == "I") & (last == "D"), None).when(F.col("_first") == "I", "I").when(last == "D", "D").otherwise("U")
    return ends.select(*pk, *[F.col(f"_v.{c}").alias(c) for c in rest if c != "_op"], op.alias("_op")).filter("_op IS NOT NULL").select(*log.columns)


def apply_changes(target: DataFrame, log: DataFrame, pk: Sequence[str]) -> DataFrame:
    """A replica after the changes: the last one a key counts, so applying some of them twice changes nothing."""
    last = versions.latest(log, pk, deleted=True)
    return target.join(last.select(*pk), list(pk), "left_anti").unionByName(last.filter("_op <> 'D'").select(*target.columns))


def replicate(table, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Follows a `VersionedTable` commit by commit: ``apply`` gets the last change of each key in a batch of commits, and the batch's number.

    The stream is that of the commits' markers, and each batch reads the data they name: work that is not published is never
    seen, whenever its files came, and none that is published is lost.  Start it with ``.start()``; after a failure the batch comes
    again, which `apply_changes` stands.
    """

    def each(batch: DataFrame, number: int) -> None:
        csns = [r.csn for r in batch.collect()]  # one number a commit
        if csns:
            apply(versions.latest(table.changes_of(csns), table.pk, deleted=True), number)

    return table.read_stream().writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Grouped by windows of a fixed width; on a stream with a watermark, late rows are dropped and windows closed."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, width), *keys)


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str, watermark: str | None = None) -> DataFrame:
    if watermark:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, width, step), *keys)


def sessions(events: DataFrame, ts: str, gap: str | Column, *keys: str, watermark: str | None = None) -> DataFrame:
    """Grouped by sessions: stretches without a gap of that length."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.session_window(ts, gap), *keys)
