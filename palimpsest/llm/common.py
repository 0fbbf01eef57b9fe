"""Helpers shared by the operators: exact column picking, durable tables, text expressions."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def narrow(df: DataFrame, **names: str) -> DataFrame:
    """Columns by exact name, renamed (``new=old``); the first one wins where a name repeats.

    Extra columns, also those that differ in case only or repeat a name, can't make a reference ambiguous.
    """
    have = df.columns
    missing = [old for old in names.values() if old not in have]
    if missing:
        raise ValueError(f"no column {missing} in {have}")
    numbered = df.toDF(*[f"__c{i}" for i in range(len(have))])
    return numbered.select(*[F.col(f"__c{have.index(old)}").alias(new) for new, old in names.items()])


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: the lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what `durable` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps, which else stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of a batch in what the pipeline's stages run: what executors and idle workers keep of buffers adds up from stage to stage.
STAGE_BATCH = 1 << 20


def byte_batches(spark: SparkSession, max_bytes: int = 8 << 20) -> None:
    """Arrow batches end at so many bytes, not at a number of rows: long texts make small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


#: Rows without texts that are worth a file.
FILE_ROWS = 100_000


def in_few_files(df: DataFrame, parts: int = 1) -> DataFrame:
    """``df`` in a partition for each core, or in ``parts`` if those are more, and so in no more files, however many partitions a shuffle has.

    For what comes out of a shuffle: of scans and Python functions, a task keeps the buffers of all its partitions until it ends.
    Where files are local and Hadoop has no native library, each file costs three processes (chmod of it, of its checksum file and of a folder).
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, parts))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
