"""When a refresh is due, and how long a failed one waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of a lifetime between which a refresh is due, in hundredths.
EARLIEST, LATEST = 70, 90


def refresh_bounds(ttl: Column, least: int, most: int) -> tuple[Column, Column]:
    """Between which a refresh is due, in milliseconds, of a lifetime in whole seconds, which is kept within its limits."""
    kept = F.least(F.greatest(ttl, F.lit(least)), F.lit(most))
    return kept * (EARLIEST * 10), kept * (LATEST * 10)


def next_backoff(current: Column, most: int) -> Column:
    """A failed refresh waits twice as long, up to a limit."""
    return F.least(current * 2, F.lit(most))


def backoff_after(failures: Column, first: int, most: int) -> Column:
    """The wait after so many failures in a row: next_backoff again and again, from `first` on; null after none."""
    doubled = F.lit(first) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(62)))
    return F.when(failures > 0, F.least(doubled, F.lit(most)).cast("bigint"))
