"""Most frequent values of a column with very many distinct values, by exact prefix refinement.

Every value has a 64-bit hash. One pass counts hash prefixes, of which there are few; only prefixes whose count,
an upper bound for each value below them, reaches the current lower bound of the k-th count can hold a result.
Further passes lengthen the prefixes that are left, by as many bits as keep a pass within a given number of groups, until
no more values than that are expected below them; those are counted in full. All counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, floor, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix length of the first pass, in bits; it decides how many counts reach the driver: 2^16.
FIRST_BITS = 16
#: Groups that a pass counts at most, and so the prefixes (8 bytes each) that are broadcast at most.
GROUPS = 1 << 21


@dataclass(frozen=True)
class Refined:
    """What refinement leaves: `rows` that can hold a result, the `bound` a count must reach, `total` rows seen, and the
    prefix `bits` in the end."""

    rows: DataFrame
    bound: int
    total: int
    bits: int


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("_hash", 64 - bits)


def _within(rows: DataFrame, bits: int, kept: list[int]) -> DataFrame:
    """The rows below the prefixes `kept`, at most GROUPS of them."""
    prefixes = rows.sparkSession.createDataFrame(pa.table({"_prefix": pa.array(kept, pa.int64())}))
    return rows.withColumn("_prefix", _prefix(bits)).join(F.broadcast(prefixes), "_prefix", "left_semi").select("_value", "_hash")


def _values(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def next_bits(bits: int, kept: int, groups: int = GROUPS) -> int:
    """The prefix length of the next pass: `kept` prefixes part into `groups` at most."""
    return min(64, bits + max(1, floor(log2(groups / max(1, kept)))))


def _descend(rows: DataFrame, usable: int, kept: list[int], bits: int, groups: int, choose: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The rows below the prefixes that stay while they are lengthened, and their length in the end.

    The hash spreads distinct values evenly, so kept / 2^bits of them are expected below the kept prefixes, at most as
    many of `usable`. It ends early where most prefixes stay, as with counts that are nearly all alike: then a longer
    prefix drops next to nothing, and values are counted by a shuffle that spills.
    """
    while kept and usable * len(kept) > groups << bits and 2 * len(kept) <= groups and bits < 64:
        left = _within(rows, bits, kept)
        bits = next_bits(bits, len(kept), groups)
        counted = left.groupBy(_prefix(bits).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        kept = choose(counted).select("_prefix").toArrow().column(0).to_pylist()
    return _within(rows, bits, kept), bits


def refine(df: DataFrame, value: Column, k: int | None = None, one_in: int | None = None, first_bits: int = FIRST_BITS, groups: int = GROUPS) -> Refined:
    """Narrow df to the rows whose value can be among the k most frequent, or make up one in `one_in` of all rows."""
    if (k is None) == (one_in is None):
        raise ValueError("give either k or one_in")
    rows = df.select(value.alias("_value")).withColumn("_hash", F.xxhash64("_value"))
    usable = rows.filter(F.col("_value").isNotNull())
    first = rows.groupBy(F.when(F.col("_value").isNotNull(), _prefix(first_bits)).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["_prefix"]: r["_n"] for r in first.collect()}  # at most 2^first_bits + 1 rows
    total = sum(counts.values())
    counts.pop(None, None)
    n_usable = sum(counts.values())
    if one_in is not None:
        bound = max(1, ceil(total / one_in))
    else:
        # The values of the heaviest prefixes give k counts that some values really have: the k-th is a lower bound.
        heaviest = sorted(counts, key=lambda p: (-counts[p], p))[:k]
        probe, _ = _descend(usable, n_usable, heaviest, first_bits, groups, lambda c: c.orderBy(F.desc("_n"), "_prefix").limit(k))
        best = _values(probe).orderBy(F.desc("n")).limit(k).collect()
        bound = best[-1]["n"] if len(best) == k else 1
    left, bits = _descend(usable, n_usable, [p for p, n in counts.items() if n >= bound], first_bits, groups, lambda c: c.filter(F.col("_n") >= bound))
    return Refined(left, bound, total, bits)


def frequent_values(df: DataFrame, value: Column, k: int | None = None, one_in: int | None = None, first_bits: int = FIRST_BITS, groups: int = GROUPS) -> DataFrame:
    """value, n: the k most frequent values, or all that make up at least one in `one_in` of all rows, with exact counts.

    * A null value is never a result, but its rows count in the total of which `one_in` is a share.
    * Rows count as often as they are stored. Ties at the k-th place go to the smaller value.
    * Fewer than k values give them all; an empty table gives no rows. Other columns of df play no part.
    * No pass over prefixes holds more than `groups` groups. The last one, over values, is expected to hold no more either,
      unless more than groups / 2 prefixes reach the k-th count, of which there are at most rows / count.
    """
    left = refine(df, value, k, one_in, first_bits, groups)
    found = _values(left.rows).filter(F.col("n") >= left.bound)
    return found if k is None else found.orderBy(F.desc("n"), "value").limit(k)
