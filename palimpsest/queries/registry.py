"""Queries by key, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NAMES = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def sql_query(key: str, text: str, oracle: str | None = None) -> None:
    """A query that Spark SQL expresses; tables are written ``{name}``.  ``oracle``: where another dialect needs other words."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: read(spark, sf_dir, t) for t in set(_NAMES.findall(text))})

    QUERIES[key] = run
    ORACLE_SQL[key] = _NAMES.sub(r"\1", oracle or text)


def query(key: str, oracle: str | None = None):
    """A query that the engine's functions express: called with ``t``, which reads a table by name."""

    def keep(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: read(spark, sf_dir, name))

        QUERIES[key] = run
        if oracle is not None:
            ORACLE_SQL[key] = _NAMES.sub(r"\1", oracle)
        return f

    return keep
