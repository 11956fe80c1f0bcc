"""Free space: a ledger of reservations, its hysteresis, and what has to be decided in sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.running import running_last, running_sums


def available(free: Column, reserved: Column, committed: Column, headroom: Column) -> Column:
    """What may still be reserved; never below 0."""
    return F.greatest(free - reserved - committed - headroom, F.lit(0).cast("bigint"))


def running_ledger(ops: DataFrame, by: str, order: str) -> DataFrame:
    """ops with reserved, committed_since and free as unconditional sums: reserve, release and commit move bytes, observe sets free.

    For logs whose operations have all succeeded; what depends on earlier outcomes is ledger().
    """
    op, size = F.col("op"), F.col("bytes").cast("bigint")
    moved = F.when(op == "reserve", size).when(op.isin("release", "commit"), -size).otherwise(F.lit(0).cast("bigint"))
    spent = F.when(op == "commit", size).otherwise(F.lit(0).cast("bigint"))
    summed = running_sums(ops, [by], order, {"reserved": moved, "_spent": spent})
    seen = op == "observe"
    marked = running_last(summed, [by], order, {"free": F.when(seen, size), "_at_observe": F.when(seen, F.col("_spent"))})
    return marked.withColumn("committed_since", F.col("_spent") - F.coalesce("_at_observe", F.lit(0))).drop("_spent", "_at_observe")


def hysteresis(rows: DataFrame, by: str, order: str, low: int, high: int, value: str = "available") -> DataFrame:
    """rows with `mode`: reclaiming once the value is below low, normal again from high on, else as before."""
    if high < low:
        raise ValueError("the upper threshold is below the lower one")
    signal = F.when(F.col(value) < low, "reclaiming").when(F.col(value) >= high, "normal")
    return running_last(rows, [by], order, {"mode": signal}).withColumn("mode", F.coalesce("mode", F.lit("normal")))


class Ledger:
    """The ledger of one replica, operation by operation."""

    def __init__(self, headroom: int = 0) -> None:
        self.free, self.reserved, self.committed, self.degraded, self.headroom = 0, 0, 0, True, headroom

    @property
    def available(self) -> int:
        return max(0, self.free - self.reserved - self.committed - self.headroom)

    def apply(self, op: str, size: int | None) -> bool:
        """Whether the operation succeeded. A null observation is a sensor that failed: the last value stays."""
        size = 0 if size is None or size != size else int(size)
        if op == "observe":
            self.free, self.committed, self.degraded = size, 0, False
        elif op == "fail":
            self.degraded = True
        elif op == "reserve":
            if size and (self.degraded or self.available < size):
                return False
            self.reserved += size
        else:
            self.reserved = max(0, self.reserved - size)
            self.committed += size if op == "commit" else 0
        return True

    def state(self) -> tuple[int, int, int, bool]:
        return self.free, self.reserved, self.committed, self.degraded


_LEDGER = "replica bigint, seq bigint, op string, bytes bigint, ok boolean, free bigint, reserved bigint, committed_since bigint, degraded boolean"


def ledger(ops: DataFrame, headroom: int = 0) -> DataFrame:
    """replica, seq, op, bytes, ok and the state after each operation (observe, fail, reserve, release, commit).

    Whether a reservation succeeds depends on which ones did before, so a replica's operations are taken in order of
    seq, streamed through one task in Arrow batches; replicas run side by side.
    """
    ordered = ops.select("replica", "seq", "op", "bytes").repartition("replica").sortWithinPartitions("replica", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, book = None, Ledger(headroom)
        for frame in frames:
            out = []
            for replica, op, size in zip(*(frame[c].tolist() for c in ("replica", "op", "bytes")), strict=True):
                if replica != current:
                    current, book = replica, Ledger(headroom)
                out.append((book.apply(op, size), *book.state()))
            state = pd.DataFrame(out, columns=["ok", "free", "reserved", "committed_since", "degraded"], index=frame.index)
            yield pd.concat([frame, state], axis=1)

    return ordered.mapInPandas(run, _LEDGER)


def reservation_deltas(events: DataFrame) -> DataFrame:
    """events with reserved_delta and committed_delta: what each step of a reservation's life moves.

    reserve: +bytes; extend: +bytes; publish: the stored length is committed and the slack released; discard: all is released.
    """
    kind = F.col("event")
    return events.withColumns({
        "reserved_delta": F.when(kind.isin("reserve", "extend"), F.col("bytes")).when(kind.isin("publish", "discard"), -F.col("held")).otherwise(F.lit(0)),
        "committed_delta": F.when(kind == "publish", F.least("stored_len", "held")).otherwise(F.lit(0)),
    })


def concurrency(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """by, peak, spans: the greatest number of spans [start, end) of a group that are open at once."""
    edges = spans.select(by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("_e")).select(by, "_e.*")
    steps = edges.groupBy(by, "at").agg(F.sum("step").alias("step"), F.count_if(F.col("step") > 0).alias("_opened"))
    running = running_sums(steps, [by], "at", {"_open": F.col("step")})
    return running.groupBy(by).agg(F.max("_open").alias("peak"), F.sum("_opened").alias("spans"))


def admissions(spans: DataFrame, permits: int) -> DataFrame:
    """group, id, admitted: whether each request (start, end), in order of start and id, finds one of its group's permits free.

    A request that isn't admitted holds no permit, so this goes in sequence, group by group.
    """
    import heapq

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, open_until = None, []
        for frame in frames:
            out = []
            for group, start, end in zip(*(frame[c].tolist() for c in ("group", "start", "end")), strict=True):
                if group != current:
                    current, open_until = group, []
                while open_until and open_until[0] <= start:
                    heapq.heappop(open_until)
                admitted = len(open_until) < permits
                if admitted:
                    heapq.heappush(open_until, end)
                out.append(admitted)
            yield pd.DataFrame({"group": frame["group"], "id": frame["id"], "admitted": out})

    ordered = spans.select("group", "id", "start", "end").repartition("group").sortWithinPartitions("group", "start", "id")
    return ordered.mapInPandas(run, "group bigint, id bigint, admitted boolean")


def bounded_schedule(tasks: DataFrame, permits: int) -> DataFrame:
    """group, id, start, stop of tasks (group, id, took) that wait for one of a group's permits, in order of id.

    The next task begins when the first running one ends, so `permits` run at most; a group's tasks go in sequence, streamed
    through one task in Arrow batches.
    """
    import heapq

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ends = None, []
        for frame in frames:
            starts, stops = [], []
            for group, took in zip(frame["group"].tolist(), frame["took"].tolist(), strict=True):
                if group != current:
                    current, ends = group, []
                start = heapq.heappop(ends) if len(ends) >= permits else 0
                heapq.heappush(ends, start + took)
                starts.append(start)
                stops.append(start + took)
            yield pd.DataFrame({"group": frame["group"], "id": frame["id"], "start": starts, "stop": stops})

    ordered = tasks.select("group", "id", "took").repartition("group").sortWithinPartitions("group", "id")
    return ordered.mapInPandas(run, "group bigint, id bigint, start bigint, stop bigint")
