"""Registers queries under their names, together with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.tables import table


class Registry:
    """QUERIES and SQL of a module of plans."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def portable(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The rows of SQL that Spark and DuckDB both understand, over tables named in braces."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, folder, n) for n in names})


def plain(sql: str) -> str:
    """The same SQL for DuckDB, where the tables are views of their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
