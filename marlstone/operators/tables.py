"""Transitions of catalog tables: each gives the new table from the old one and a change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: str, chosen) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # A map-side combined aggregate: a key with very many rows never fills one task.
    row = F.struct(F.col(order).alias("_order"), *(F.col(c) for c in rest))
    return df.groupBy(*keys).agg(chosen(row).alias("_row")).select(*(F.col(k) if k in keys else F.col(f"_row.{k}") for k in df.columns))


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key: that with the least `order`."""
    return _pick(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key: that with the greatest `order`."""
    return _pick(df, keys, order, F.max)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and the rows of new whose key it lacks; what is there stays as it is."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new, and the rows of old that it doesn't replace."""
    return without(old, new, keys).unionByName(new.select(*old.columns))


def without(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys of gone; keys that aren't there don't matter."""
    return old.join(gone.select(*keys), list(keys), "left_anti").select(*old.columns)


def patch(old: DataFrame, change: DataFrame, keys: Sequence[str], column: str, when: Column | None = None) -> DataFrame:
    """old with `column` from change where the key is in both and `when` holds (over old's columns and _old, the old value)."""
    changed = change.select(*keys, F.col(column).alias("_new"), *(F.col(c).alias(f"_{c}") for c in change.columns if c not in (*keys, column)), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False)) & (F.coalesce(when, F.lit(False)) if when is not None else F.lit(True))
    value = F.when(hit, F.col("_new")).otherwise(F.col(column))
    return old.join(changed, list(keys), "left").withColumn(column, value).select(*old.columns)


def store_format(meta: DataFrame, expected: str) -> DataFrame:
    """value, error: the marker of a store (value) as it is afterwards. An empty store gets the expected one; any other marker, or
    several, is `incompatible`, and stays.
    """
    found = meta.agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_least"), F.max("value").alias("_most"))
    good = (F.col("_n") == 0) | ((F.col("_n") == 1) & F.coalesce(F.col("_least") == expected, F.lit(False)))
    return found.select(F.when(F.col("_n") == 0, F.lit(expected)).otherwise(F.col("_most")).alias("value"), F.when(~good, "incompatible").alias("error"))


def verify_store_format(df: DataFrame, expected: str) -> str:
    """The marker to write for an empty store, or the one that is there; an incompatible one is an error."""
    found = store_format(df, expected).first()
    if found["error"]:
        raise ValueError(f"store format {found['value']!r}, not {expected!r}")
    return found["value"]


def encode_records(df: DataFrame, version: int, column: str = "schema_version") -> DataFrame:
    """df with the version of its layout in `column`, as decode_records reads it; a `column` that is there already is an error."""
    if column.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"records have a column {column!r} already")
    return df.withColumn(column, F.lit(version))


def decode_records(df: DataFrame, version: int, column: str = "schema_version") -> DataFrame:
    """df with `record_error`: null, `empty` or `version` for records that can't be read."""
    v = F.col(column)
    return df.withColumn("record_error", F.when(v.isNull(), "empty").when(v != version, "version"))
