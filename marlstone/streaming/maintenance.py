"""Maintenance as a streaming query: each micro-batch of queue rows is merged into the tables and a pass is planned."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

# Seconds between bursts of passes, and after a pass under pressure that found nothing.
INTERVAL, BACKOFF = 30, 1


def run_burst(one_pass: Callable[[], int], reclaiming: Callable[[], bool], wait: Callable[[float], None] = time.sleep, cancelled: Callable[[], bool] = lambda: False) -> int:
    """One pass, and more right behind it as long as space is being reclaimed; how many there were.

    A pass that reclaims nothing then is followed by a wait of BACKOFF seconds: the catalog has to change first.
    """
    passes = 0
    while True:
        reclaimed, passes = one_pass(), passes + 1
        if not reclaiming() or cancelled():
            return passes
        if not reclaimed:
            wait(BACKOFF)


def run_passes(stream: DataFrame, one_pass: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that calls one_pass(rows, number) for each micro-batch, every INTERVAL seconds or once over what is there.

    A pass must give the same result if it is run again with the same number, as after a failure.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, number: one_pass(rows, number)).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{INTERVAL} seconds")
    return trigger.start()
