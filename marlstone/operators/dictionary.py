"""Costly expressions over columns of few distinct values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def through_distinct(df: DataFrame, column: str, name: str, expression: Callable[[Column], Column]) -> DataFrame:
    """df with `name`: the expression of `column`, worked out once for each distinct value. Nulls are a value like others.

    The values are joined back as their number allows, which the planner sees when they have been counted: few are broadcast.
    """
    values = df.select(F.col(column).alias("_value")).distinct()
    mapped = values.select("_value", expression(F.col("_value")).alias(name))
    return df.join(mapped, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
