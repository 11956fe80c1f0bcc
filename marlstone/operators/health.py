"""Ejection of failing members, event by event: batch and streaming share one state machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Health:
    """A member's failures in a row, and until when it is out of the ring."""

    failures: int = 0
    next_retry: int | None = None

    def apply(self, event: str, now: int, limit: int, retry: int) -> bool:
        """Whether the member is out of the ring after the event (fail, success, or look: the ring is asked for)."""
        limit = max(1, limit)
        if event == "look" and self.next_retry is not None and now >= self.next_retry:
            self.failures, self.next_retry = 0, None
        elif event == "fail":
            self.failures += 1
            if self.next_retry is None and self.failures >= limit:
                self.next_retry = now + retry
        elif event == "success":
            self.failures = 0
        return self.next_retry is not None


#: What a replica needs to be ready, in the order in which it looks.
PARTS = ("metadata", "files", "space")


def readiness(checks: DataFrame) -> DataFrame:
    """replica, ready, failing: ready where the last check (replica, part, seq, good) of each of PARTS was good; failing: the first
    part that wasn't, or was never looked at.
    """
    last = checks.groupBy("replica", "part").agg(F.max_by("good", "seq").alias("good"))
    good = {p: F.coalesce(F.max(F.when(F.col("part") == p, F.col("good"))), F.lit(False)).alias(p) for p in PARTS}
    failing = F.coalesce(*(F.when(~F.col(p), p) for p in PARTS))
    return last.groupBy("replica").agg(*good.values()).select("replica", failing.isNull().alias("ready"), failing.alias("failing"))


_OUT = "member string, seq bigint, failures bigint, ejected boolean, next_retry bigint"
_NAMES = ["member", "seq", "failures", "ejected", "next_retry"]


def ejections(events: DataFrame, limit: int, retry: int) -> DataFrame:
    """member, seq, failures, ejected, next_retry after each event (member, seq, now, event), in order of seq.

    Members run side by side; one member's events are streamed through a task in Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Health()
        for frame in frames:
            out = []
            for member, seq, now, event in zip(*(frame[c].tolist() for c in ("member", "seq", "now", "event")), strict=True):
                if member != current:
                    current, state = member, Health()
                ejected = state.apply(event, int(now), limit, retry)
                out.append((member, seq, state.failures, ejected, state.next_retry))
            yield pd.DataFrame(out, columns=_NAMES).astype({"next_retry": "Int64"})

    ordered = events.select("member", "seq", "now", "event").repartition("member").sortWithinPartitions("member", "seq")
    return ordered.mapInPandas(run, _OUT)


def streaming_ejections(events: DataFrame, limit: int, retry: int) -> DataFrame:
    """The same over a stream: state for each member is kept between micro-batches, events of a batch go by seq."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, next_retry = state.get if state.exists else (0, None)
        health = Health(failures, None if next_retry is None or next_retry < 0 else next_retry)
        batch = pd.concat(list(frames)).sort_values("seq")  # one member's events of one micro-batch
        out = []
        for r in batch.itertuples(index=False):
            ejected = health.apply(r.event, int(r.now), limit, retry)
            out.append((key[0], r.seq, health.failures, ejected, health.next_retry))
        state.update((health.failures, -1 if health.next_retry is None else health.next_retry))
        yield pd.DataFrame(out, columns=_NAMES).astype({"next_retry": "Int64"})

    return events.select("member", "seq", "now", "event").groupBy("member").applyInPandasWithState(run, _OUT, "failures bigint, next_retry bigint", "append", GroupStateTimeout.NoTimeout)
