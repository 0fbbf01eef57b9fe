"""What a table looks like: statistics, sizes, equality of two access paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TableDef

VERSION = "0.1.0"


def column_stats(df: DataFrame, *columns: str) -> DataFrame:
    """(column, rows, nulls, distinct_values, least, greatest), exact, in one pass over the table.  An empty table has no least and greatest."""
    figures = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("distinct_values"),
            F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"),
        )
        for c in columns
    ]
    return df.agg(F.array(*figures).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def approx_stats(df: DataFrame, *columns: str) -> DataFrame:
    """One row, one pass, bounded memory: what a planner needs of very large tables."""
    return df.agg(F.count("*").alias("rows"), *[x for c in columns for x in (F.approx_count_distinct(c).alias(f"{c}_distinct"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables, or two ways to read one, give the same multiset of rows."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def file_sizes(df: DataFrame) -> DataFrame:
    """(file, bytes, rows) of the files a table is read from."""
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def pages(df: DataFrame, *key: str) -> DataFrame:
    """(file, start, bytes, rows, low_<key>, high_<key>): the splits a table is read in, with the range of its keys in each: what a scan by key can leave out."""
    ends = [f(c).alias(f"{name}_{c}") for c in key for name, f in (("low", F.min), ("high", F.max))]
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("bytes"))
    return df.groupBy(*place).agg(F.count("*").alias("rows"), *ends)


def tables(spark, definitions: Sequence[TableDef]) -> DataFrame:
    """(table_name, version, columns, primary_key, indexes): one row a declared table."""
    rows = [(t.name, t.version, len(t.live), ", ".join(t.pk), len(t.all_indexes())) for t in definitions]
    return spark.createDataFrame(rows, "table_name string, version int, columns int, primary_key string, indexes int")


def indexes(spark, definitions: Sequence[TableDef]) -> DataFrame:
    """(table_name, index_name, kind, key, include, predicate) of all declared tables."""
    rows = [(t.name, i.name, i.kind, ", ".join(k.expr + (" DESC" if k.desc else "") for k in i.key), ", ".join(i.include), i.where) for t in definitions for i in t.all_indexes()]
    return spark.createDataFrame(rows, "table_name string, index_name string, kind string, key string, include string, predicate string")


def plan(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """(line, text): what EXPLAIN says of a query."""
    explained = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return df.sparkSession.createDataFrame(list(enumerate(explained.split("\n"))), "line int, text string")
