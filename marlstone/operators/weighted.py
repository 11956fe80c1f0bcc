"""Per-key statistics where a few keys hold most rows.

Rows are compressed to (key, value, weight) before anything is brought together by key: a map-side
combined count, in which a key with a third of all rows weighs no more than its distinct values.
Ranks then come from prefix sums over slices of the order by key and value, which are cut so that each has about the
same number of distinct pairs; so no task holds a whole key, whatever its values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut_lineage, slots

#: What key_statistics can tell besides percentiles.
STATISTICS = ("n_rows", "n_valued", "n_distinct", "total", "smallest", "largest", "mode")
#: Percentiles in thousandths, by the suffix of their column.
PERCENTILES = {"p10": 100, "p25": 250, "p50": 500, "p75": 750, "p90": 900, "p95": 950, "p99": 990}


def value_frequencies(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """_key, _value, _weight: how often each value occurs with each key.

    A null or negative value keeps its row under the value null, so that rows can still be counted.
    """
    kept = F.when(value >= 0, value.cast("bigint"))
    return df.select(key.alias("_key"), kept.alias("_value")).groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_weight"))


def key_statistics(df: DataFrame, key: Column, value: Column, percentiles: dict[str, int] = PERCENTILES, wanted: Sequence[str] = STATISTICS) -> DataFrame:
    """key and for each one the `wanted` statistics (of STATISTICS) and exact percentiles.

    * Null keys form one key of their own (`key` null).
    * Null and negative values count in n_rows only; a key with no other values has null statistics.
    * Repeated rows count as often as they are stored.
    * A percentile p is the smallest value whose rank is at least p times n_valued; of several modes the
      smallest is given.
    * An empty table gives no rows. Other columns of df, whatever their names, play no part.
    * total is a decimal of 38 digits, so that it can't overflow.
    """
    freq = value_frequencies(df, key, value)
    if percentiles:
        freq = sliced(freq)
    valued = F.col("_value").isNotNull()
    known = {
        "n_rows": F.sum("_weight"),
        "n_valued": F.sum(F.when(valued, F.col("_weight")).otherwise(F.lit(0))),
        "n_distinct": F.count("_value"),
        "total": F.sum(F.col("_value").cast("decimal(20,0)") * F.col("_weight").cast("decimal(18,0)")).cast("decimal(38,0)"),
        "smallest": F.min("_value"),
        "largest": F.max("_value"),
        "mode": -F.max(F.when(valued, F.struct("_weight", (-F.col("_value")).alias("_minus"))))["_minus"],
    }
    totals = freq.groupBy(F.col("_key").alias("key")).agg(*(known[n].alias(n) for n in wanted))
    if not percentiles:
        return totals
    ranked = _ranks(freq.filter(valued), percentiles)
    picked = ranked.groupBy(F.col("_key").alias("_rank_key")).agg(*(F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in percentiles))
    return totals.join(picked, totals["key"].eqNullSafe(picked["_rank_key"]), "left").select("key", *wanted, *percentiles)


def sliced(freq: DataFrame, slices: int | None = None) -> DataFrame:
    """freq with `_slice`, a number that doesn't fall as (_key, _value) rises; slices have about as many rows each.

    The cuts come from a sample of the pairs, of which there are no two alike, so they can be anywhere. They are made
    once and written down: whatever reads the slices must see the same ones.
    """
    spark = freq.sparkSession
    n = slices or max(slots(spark), spark.sparkContext.defaultParallelism)
    return cut_lineage(freq.repartitionByRange(n, "_key", "_value").withColumn("_slice", F.spark_partition_id()))


def _ranks(freq: DataFrame, percentiles: dict[str, int]) -> DataFrame:
    """_key, _name, _value of each percentile: find its slice by sums over slices, then its value inside the slice."""
    sums = freq.groupBy("_key", "_slice").agg(F.sum("_weight").alias("_in_slice"))
    by_key = Window.partitionBy("_key")  # as many rows as slices at most, whatever the rows of the key
    upto = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select(
        F.col("_key").alias("_k"), F.col("_slice").alias("_s"), "_in_slice",
        F.coalesce(F.sum("_in_slice").over(upto), F.lit(0)).alias("_before"), F.sum("_in_slice").over(by_key).alias("_n"),
    )
    wanted = F.array(*(F.struct(F.lit(n).alias("_name"), F.lit(p).alias("_permille")) for n, p in percentiles.items()))
    asked = (
        placed.withColumn("_w", F.explode(wanted))
        .withColumn("_rank", F.expr("greatest((_w._permille * _n + 999) div 1000, 1)"))
        .filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_in_slice")))
        .select("_k", "_s", F.col("_w._name").alias("_name"), (F.col("_rank") - F.col("_before")).alias("_offset"))
    )
    # Only slices that hold an asked rank are looked into, a key's part of a slice at a time.
    hit = asked.groupBy("_k", "_s").agg(F.collect_list(F.struct("_name", "_offset")).alias("_asked"))
    inside = freq.join(hit, freq["_key"].eqNullSafe(hit["_k"]) & (freq["_slice"] == hit["_s"]))
    running = Window.partitionBy("_key", "_slice").orderBy("_value")
    cumulated = inside.withColumn("_upto", F.sum("_weight").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        cumulated.select("_key", "_value", "_weight", "_upto", F.explode("_asked").alias("_a"))
        .filter((F.col("_a._offset") <= F.col("_upto")) & (F.col("_a._offset") > F.col("_upto") - F.col("_weight")))
        .select("_key", F.col("_a._name").alias("_name"), "_value")
    )


def value_histogram(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """key, bucket, n: rows of each key by the power of two that bounds the value from below (-1: no valid value, 0: zero)."""
    freq = value_frequencies(df, key, value)
    bucket = F.when(F.col("_value").isNull(), -1).when(F.col("_value") == 0, 0).otherwise(F.length(F.bin("_value")))
    return freq.groupBy(F.col("_key").alias("key"), bucket.cast("int").alias("bucket")).agg(F.sum("_weight").alias("n"))


def keys_above_share(stats: DataFrame, rows: int, one_in: int) -> DataFrame:
    """The keys of key_statistics that hold at least one in `one_in` of all `rows`; the null key is no key here."""
    return stats.filter(F.col("key").isNotNull() & (F.col("n_rows") * one_in >= rows)).select("key", "n_rows")
