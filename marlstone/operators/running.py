"""Running aggregates along a key's order, without a task that holds a whole key.

A key's rows are cut into at most SLICES stretches of its order. Stretches are summed up on their own, their results are
carried forward over the few rows of stretches, and each row adds what its stretch had to start with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of a key's order, at most.
SLICES = 1_024


def _sliced(df: DataFrame, order: str, slices: int) -> DataFrame:
    """df with `_slice`: stretches of equal width between the ends that nearly all rows lie within, so that a few far rows
    don't push all others into one.
    """
    low, high = df.agg(F.percentile_approx(order, [0.001, 0.999], 10_000).alias("ends")).first()["ends"] or (None, None)
    if low is None:
        return df.withColumn("_slice", F.lit(-1).cast("bigint"))
    low, width = int(low), (int(high) - int(low)) // max(1, slices - 2) + 1
    number = F.expr(f"least(greatest((cast(`{order}` as bigint) - {low}) div {width} + if(cast(`{order}` as bigint) < {low}, 0, 1), 0), {slices - 1})")
    return df.withColumn("_slice", F.coalesce(number, F.lit(-1).cast("bigint")))  # rows without an order come first


def _carried(df: DataFrame, by: Sequence[str], order: str, columns: dict[str, Column], last: bool, slices: int) -> DataFrame:
    names = list(columns)
    staged = _sliced(df.withColumns({f"_v_{n}": c for n, c in columns.items()}), order, slices)
    keys = [*by, "_slice"]
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    if last:
        ends = staged.groupBy(*keys).agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in names))
        starts = ends.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_s_{n}") for n in names))
        local = staged.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(within) for n in names})
        whole = {n: F.coalesce(F.col(n), F.col(f"_s_{n}")) for n in names}
    else:
        ends = staged.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names))
        starts = ends.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.sum(f"_t_{n}").over(before).alias(f"_s_{n}") for n in names))
        local = staged.withColumns({n: F.sum(f"_v_{n}").over(within) for n in names})
        zero = F.lit(0).cast("bigint")
        whole = {n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_s_{n}"), zero) for n in names}
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = one if same is None else same & one
    kept = [c for c in df.columns if c not in names]
    return local.join(starts, same).select(*kept, *(c.alias(n) for n, c in whole.items()))


def running_sums(df: DataFrame, by: Sequence[str], order: str, columns: dict[str, Column], slices: int = SLICES) -> DataFrame:
    """df with each column's sum over the key's rows up to and including this one; nulls add nothing.

    order: a whole number that no two rows of a key share, else rows that do are taken in any order.
    """
    return _carried(df, by, order, columns, False, slices)


def running_last(df: DataFrame, by: Sequence[str], order: str, columns: dict[str, Column], slices: int = SLICES) -> DataFrame:
    """df with each column's last value that isn't null, up to and including this row; null before the first."""
    return _carried(df, by, order, columns, True, slices)
