"""Percentiles with a proven rank error, from summaries that can be merged.

A summary is a sorted list of tuples (value, least rank, greatest rank) that brackets the rank of each value kept.
Partitions build exact summaries and compress them to a fixed number of tuples; merging adds the brackets of the
parts; the uncertainty that is really there, the widest gap between neighbouring brackets, comes with every answer.
It is never more than what can be told before: each compression on a row's way adds at most n / (tuples - 2) ranks.
Everything is deterministic: the same partitions give the same summaries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tuples that a summary keeps after compression; see rounds_ahead for the error that this gives.
TUPLES = 2_000
#: Values that a partition buffers before it summarises them.
BUFFER = 1 << 20
#: Summaries that one task merges at once.
FAN_IN = 32

SUMMARY = "n bigint, rounds int, values array<bigint>, least array<bigint>, greatest array<bigint>"


@dataclass(frozen=True)
class RankSummary:
    values: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    n: int
    #: Compressions that any row went through at most.
    rounds: int = 0

    @classmethod
    def exact(cls, values: np.ndarray) -> RankSummary:
        """From sorted values: each distinct one with the ranks of its first and last occurrence."""
        kept, first, often = np.unique(values, return_index=True, return_counts=True)
        return cls(kept, first + 1, first + often, len(values))

    # Fewer than least[i] rows are smaller than values[i]; at least greatest[i] rows aren't greater.
    def merge(self, other: RankSummary) -> RankSummary:
        if not self.n or not other.n:
            return other if not self.n else self
        values = np.union1d(self.values, other.values)
        lows, highs = zip(*(s._bracket(values) for s in (self, other)), strict=True)
        return RankSummary(values, sum(lows) + 1, sum(highs), self.n + other.n, max(self.rounds, other.rounds))

    def _bracket(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value, so many rows are smaller at most, and so many not greater at least."""
        right = np.searchsorted(self.values, values, side="left")  # first kept value >= value
        below = np.where(right < len(self.values), self.least[np.minimum(right, len(self.values) - 1)] - 1, self.n)
        at = np.searchsorted(self.values, values, side="right") - 1  # last kept value <= value
        upto = np.where(at >= 0, self.greatest[np.maximum(at, 0)], 0)
        return below, upto

    @property
    def error(self) -> int:
        """No answer is further than so many ranks from the rank asked for."""
        if not self.n:
            return 0
        upto = np.append(0, self.greatest)
        # Rank r is answered by the first kept value with greatest >= r, whose first row is number `least` at most.
        return int(max(0, (self.least - 1 - upto[:-1]).max()))

    def compress(self, tuples: int = TUPLES) -> RankSummary:
        """At most `tuples` tuples at evenly spaced ranks, the ends kept; as it is where it is short enough."""
        if len(self.values) <= tuples:
            return self
        ranks = np.linspace(1, self.n, tuples - 1)
        keep = np.unique(np.append(0, np.minimum(np.searchsorted(self.greatest, ranks, side="left"), len(self.values) - 1)))
        return RankSummary(self.values[keep], self.least[keep], self.greatest[keep], self.n, self.rounds + 1)

    def at(self, permille: Sequence[int]) -> np.ndarray:
        """The values at ranks ceil(n * permille / 1000), 1 at least."""
        ranks = [max(1, (self.n * p + 999) // 1000) for p in permille]
        return self.values[np.minimum(np.searchsorted(self.greatest, ranks, side="left"), len(self.values) - 1)]


def stated_error(n: int, rounds: int, tuples: int = TUPLES) -> int:
    """Ranks by which an answer about n rows is off at most, after so many rounds of compression.

    Compression keeps the answers to ranks (n - 1) / (tuples - 2) apart, so it widens no gap between brackets by more; and
    a gap of a merged summary is the sum of one gap of each part.
    """
    return -(-rounds * n // max(1, tuples - 2))


def rounds_ahead(partitions: int, rows: int, buffer: int | None = None) -> int:
    """Rounds of compression, known before the run, for `partitions` of at most `rows` values each and one merge of all.

    A partition summarises at each full buffer, combines equal ones as a binary counter does, and once more in the end;
    then there is one round for each FAN_IN-fold merge.
    """
    flushes = max(1, -(-rows // (buffer or BUFFER)))
    merges = 0
    while partitions > 1 or not merges:
        partitions, merges = -(-partitions // FAN_IN), merges + 1
    return 2 + (flushes - 1).bit_length() + merges


_TYPES = {"label": pa.string(), "day": pa.int64(), "metric": pa.string(), "part": pa.int64()}
_KINDS = {"label": "label string", "day": "day bigint", "metric": "metric string", "part": "part bigint"}


def _arrow(rows: list[tuple[dict, RankSummary]], keys: Sequence[str]) -> pa.RecordBatch:
    columns = {n: pa.array([k[n] for k, _ in rows], _TYPES[n]) for n in keys}
    columns |= {"n": pa.array([s.n for _, s in rows], pa.int64()), "rounds": pa.array([s.rounds for _, s in rows], pa.int32())}
    columns |= {f: pa.array([getattr(s, f).astype(np.int64) for _, s in rows], pa.list_(pa.int64())) for f in ("values", "least", "greatest")}
    return pa.RecordBatch.from_pydict(columns)


def _summarise(tuples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[RankSummary]] = {}
        pending: dict[tuple, list[np.ndarray]] = {}
        waiting = 0

        def flush() -> None:
            for key, arrays in pending.items():
                stack = held.setdefault(key, [])
                stack.append(RankSummary.exact(np.sort(np.concatenate(arrays))).compress(tuples))
                while len(stack) > 1 and stack[-2].n <= stack[-1].n:  # rounds grow with the logarithm of the flushes
                    stack[-2:] = [stack[-2].merge(stack[-1]).compress(tuples)]
            pending.clear()

        for batch in batches:
            frame = batch.to_pandas()
            for (label, day, metric), part in frame.groupby(["label", "day", "metric"], dropna=False, sort=False):
                key = (label if isinstance(label, str) else None, None if day != day else int(day), metric)
                pending.setdefault(key, []).append(part["value"].to_numpy(np.int64))
            waiting += len(frame)
            if waiting >= BUFFER:
                flush()
                waiting = 0
        flush()
        rows = [(dict(zip(("label", "day", "metric"), k, strict=True)), reduce(RankSummary.merge, s).compress(tuples)) for k, s in held.items()]
        for i in range(0, len(rows), 64):
            yield _arrow(rows[i : i + 64], ("label", "day", "metric"))

    return run


def _merger(keys: Sequence[str], tuples: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["n", "rounds", "values", "least", "greatest"]).to_batches()
        parts = []
        for batch in rows:
            n, rounds, *arrays = (batch.column(i) for i in range(5))
            parts += [RankSummary(*(a[i].values.to_numpy() for a in arrays), n[i].as_py(), rounds[i].as_py()) for i in range(batch.num_rows)]
        parts.sort(key=lambda s: (s.n, s.values.tobytes()))
        whole = reduce(RankSummary.merge, parts).compress(tuples)
        return pa.Table.from_batches([_arrow([({k: group.column(k)[0].as_py() for k in keys}, whole)], keys)])

    return run


def rank_summaries(df: DataFrame, label: Column, day: Column, metrics: dict[str, Column], tuples: int = TUPLES) -> DataFrame:
    """label, day, metric and one summary for each, of the values that are neither null nor negative.

    * Null labels and null days are groups of their own. A group without a valid value has no row; nor has an empty table.
    * Rows count as often as they are stored. Other columns, whatever their names, play no part.
    """
    long = df.select(
        label.cast("string").alias("label"), day.cast("bigint").alias("day"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("bigint").alias("value")) for n, c in metrics.items()))).alias("_m"),
    ).select("label", "day", "_m.metric", "_m.value").filter(F.col("value") >= 0)
    local = long.mapInArrow(_summarise(tuples), f"label string, day bigint, metric string, {SUMMARY}")
    # One summary a group and partition at most, so partitions are what merges are numbered by.
    return merge_summaries(local, ("label", "day", "metric"), F.spark_partition_id(), max(1, long.rdd.getNumPartitions()), tuples)


def merge_summaries(summaries: DataFrame, keys: Sequence[str], part: Column, parts: int, tuples: int = TUPLES) -> DataFrame:
    """One summary for each value of `keys`, FAN_IN at a time, so that no task holds more, however many there are.

    part: a number from 0 to parts - 1 that no two summaries of the same keys share; FAN_IN neighbours are merged at a time.
    """
    numbered = [*keys, "part"]
    schema = ", ".join(_KINDS[k] for k in numbered) + f", {SUMMARY}"
    current, first = summaries.withColumn("part", part.cast("bigint")), True
    while parts > 1 or first:
        parts, first = -(-parts // FAN_IN), False
        current = current.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy(*numbered).applyInArrow(_merger(numbered, tuples), schema)
    return current.drop("part")


def merge_days(daily: DataFrame, keys: Sequence[str], tuples: int = TUPLES) -> DataFrame:
    """The days' summaries combined to one for each value of `keys`, FAN_IN days in a row at a time; a null day is one of its own.

    The summaries are read twice, for the first and the last day too, so they should be written down before.
    """
    first, last = daily.agg(F.min("day"), F.max("day")).first()
    if first is None:
        first = last = 0
    return merge_summaries(daily, keys, F.coalesce(F.col("day") - first, F.lit(last - first + 1)), last - first + 2, tuples)


def _value_at(rank: Column) -> Column:
    """The first kept value whose greatest rank reaches `rank`."""
    before = F.size(F.filter("greatest", lambda g: g < rank))
    return F.element_at("values", F.least(F.size("values"), before + 1))


def answers(summaries: DataFrame, keys: Sequence[str], percentiles: dict[str, int], tuples: int = TUPLES) -> DataFrame:
    """keys, n, smallest, largest, each percentile, rank_error (ranks), error_share (of n) and stated_error, from summaries.

    rank_error is what the summary leaves open, stated_error what its rounds of compression allow.
    """
    picked = [_value_at(F.expr(f"greatest(1, (n * {p} + 999) div 1000)")).alias(name) for name, p in percentiles.items()]
    gaps = F.transform("least", lambda v, i: v - 1 - F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("greatest", i - 1)))
    error = F.greatest(F.array_max(gaps), F.lit(0)).alias("rank_error")
    return summaries.select(*keys, "n", F.element_at("values", 1).alias("smallest"), F.element_at("values", -1).alias("largest"), *picked, error, F.expr(f"(rounds * n + {max(1, tuples - 2) - 1}) div {max(1, tuples - 2)}").alias("stated_error")).withColumn("error_share", F.col("rank_error") / F.col("n"))
