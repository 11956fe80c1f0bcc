"""Operational metrics: counters, histograms with fixed bounds, ratios, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of histograms, in seconds.
REQUEST_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
TRANSFER_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def histogram(df: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """labels, le, n: cumulative counts at each bound and +Inf.

    Each row goes to its own bucket first, so a partial count of few rows is shuffled, and sums over buckets follow.
    """
    slot = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        slot = F.when(F.col(value) <= bounds[i], i).otherwise(slot)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*labels, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    by = counted.groupBy(*labels).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_n"))).alias("_m"))  # at most one for each bound
    upto = lambda i: F.aggregate(F.array(*(F.coalesce(F.col("_m")[j], F.lit(0)) for j in range(i + 1))), F.lit(0).cast("bigint"), lambda a, b: a + b)
    names = [*(f"{b:g}" for b in bounds), "+Inf"]
    rows = F.array(*(F.struct(F.lit(n).alias("le"), upto(i).alias("n")) for i, n in enumerate(names)))
    return by.select(*labels, F.explode(rows).alias("_b")).select(*labels, "_b.*")


def totals(df: DataFrame, labels: list[str], value: str) -> DataFrame:
    """labels, n, total of a histogram's values."""
    return df.groupBy(*labels).agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def transfers(chunks: DataFrame, by: str, order: str, ts: str) -> DataFrame:
    """by, chunks, bytes, outcome, micros of each response body: completed unless its last chunk (bytes, good) failed."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("bytes").alias("bytes"), F.max_by("good", order).alias("_good"), (F.max(micros) - F.min(micros)).alias("micros"))
    return rows.select(by, "chunks", "bytes", F.when(F.col("_good"), "completed").otherwise("cancelled").alias("outcome"), "micros")


def fetch_outcome(status: Column) -> Column:
    """hit for 2xx, miss for 404, unavailable for anything else."""
    return F.when(status.between(200, 299), "hit").when(status == 404, "miss").otherwise("unavailable")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(denominator != 0, numerator / denominator)


def _collected(log: DataFrame, metrics: list[tuple[str, str, str, Column]]) -> DataFrame:
    """name, kind, labels, value of (name, kind, labels, aggregate); one aggregate over the log. A labelled series that nothing
    was counted in isn't there; values stay within 64 bits.
    """
    one = log.agg(*(c.cast("bigint").alias(f"_{i}") for i, (*_, c) in enumerate(metrics)))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(labels).alias("labels"), F.col(f"_{i}").alias("value")) for i, (n, k, labels, _) in enumerate(metrics)))
    return one.select(F.explode(rows).alias("_m")).select("_m.*").filter((F.col("labels") == "") | (F.col("value") > 0))


def _times(event: str) -> Column:
    return F.count_if(F.col("event") == event)


def _amount(event: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("event") == event, F.col("amount"))), F.lit(0))


def _outcomes(event: str) -> dict[str, Column]:
    return {o: F.count_if((F.col("event") == event) & (fetch_outcome(F.col("status")) == o)) for o in ("hit", "miss", "unavailable")}


def _ends(event: str) -> dict[str, Column]:
    ended = F.col("event") == event
    return {"completed": F.count_if(ended & F.col("completed")), "cancelled": F.count_if(ended & ~F.col("completed"))}


def replica_metrics(log: DataFrame, foreground_limit: int) -> DataFrame:
    """name, kind, labels, value of a replica's counters and gauges, from what happened on it.

    log: seq, event, amount, status, completed, free, reserved, committed. Events: request; hit and miss of an artifact (amount:
    bytes); staged (bytes); denied; reclaimed (how many); requeued; bypassed; refused; admitted, released and rejected in the
    foreground; prefetch, prefetch_response (status) and prefetch_end (bytes, completed); space (free, reserved, committed),
    of which the last counts.
    """
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col("event") == "space", F.col("seq"))), F.lit(0))
    counter, gauge = "counter", "gauge"
    # The names of the metrics, their kinds and labels.
    return _collected(log, [
        ("requests_total", counter, "", _times("request")),
        ("artifact_hits_total", counter, "", _times("hit")),
        ("artifact_misses_total", counter, "", _times("miss")),
        ("bytes_read_total", counter, "", _amount("hit")),
        ("bytes_written_total", counter, "", _amount("staged")),
        ("authorization_denials_total", counter, "", _times("denied")),
        ("maintenance_reclaimed_total", counter, "", _amount("reclaimed")),
        ("maintenance_requeued_total", counter, "", _times("requeued")),
        ("build_cache_bypasses_total", counter, "", _times("bypassed")),
        ("raw_pressure_errors_total", counter, "", _times("refused")),
        ("foreground_concurrency_limit", gauge, "", F.coalesce(F.max(F.lit(foreground_limit)), F.lit(foreground_limit))),
        ("foreground_in_flight", gauge, "", _times("admitted") - _times("released")),
        ("foreground_rejections_total", counter, "", _times("rejected")),
        ("prefetch_requests_total", counter, "", _times("prefetch")),
        *(("prefetch_responses_total", counter, f'outcome="{o}"', c) for o, c in _outcomes("prefetch_response").items()),
        ("prefetch_in_flight", gauge, "", _times("prefetch") - _times("prefetch_end")),
        *(("prefetch_transfers_total", counter, f'outcome="{o}"', c) for o, c in _ends("prefetch_end").items()),
        ("prefetch_response_bytes_total", counter, "", _amount("prefetch_end")),
        ("free_observed_bytes", gauge, "", last("free")),
        ("reserved_bytes", gauge, "", last("reserved")),
        ("committed_since_bytes", gauge, "", last("committed")),
    ])


def agent_metrics(log: DataFrame, ring: DataFrame) -> DataFrame:
    """name, kind, labels, value of a routing agent's counters and gauges.

    log as that of replica_metrics. Events: request; forwarded; forward_failed; miss_made and bypass_made without a shard;
    unavailable; ejected; prefetch, prefetch_response and prefetch_end. ring: one row of members and ejected.
    """
    counter, gauge = "counter", "gauge"
    # As above.
    counted = _collected(log, [
        ("requests_total", counter, "", _times("request")),
        ("forwarded_total", counter, "", _times("forwarded")),
        ("forward_failures_total", counter, "", _times("forward_failed")),
        ("synthesized_misses_total", counter, "", _times("miss_made")),
        ("synthesized_write_bypasses_total", counter, "", _times("bypass_made")),
        ("unavailable_total", counter, "", _times("unavailable")),
        ("ejections_total", counter, "", _times("ejected")),
        ("prefetch_requests_total", counter, "", _times("prefetch")),
        *((f"prefetch_{n}_total", counter, "", _outcomes("prefetch_response")[o]) for n, o in (("hits", "hit"), ("misses", "miss"), ("unavailable", "unavailable"))),
        ("prefetch_response_bytes_total", counter, "", _amount("prefetch_end")),
        ("prefetch_in_flight", gauge, "", _times("prefetch") - _times("prefetch_end")),
        *((f"prefetch_{o}_total", counter, "", c) for o, c in _ends("prefetch_end").items()),
    ])
    named = F.array(*(F.struct(F.lit(f"ring_{n}").alias("name"), F.lit(gauge).alias("kind"), F.lit("").alias("labels"), F.col(n).cast("bigint").alias("value")) for n in ("members", "ejected")))
    return counted.unionByName(ring.select(F.explode(named).alias("_m")).select("_m.*"))


def histogram_series(df: DataFrame, labels: list[str], micros: str, bounds: tuple[float, ...]) -> DataFrame:
    """labels, series, le, value: a histogram as it is exported; series: bucket (cumulative, by le), sum (microseconds) and count.

    Durations are whole microseconds, so the sum doesn't depend on the order of rows.
    """
    seconds = df.withColumn("_seconds", F.col(micros) / 1_000_000)
    buckets = histogram(seconds, labels, "_seconds", bounds).select(*labels, F.lit("bucket").alias("series"), "le", F.col("n").alias("value"))
    sums = totals(df, labels, micros)
    rest = F.array(*(F.struct(F.lit(s).alias("series"), F.lit(None).cast("string").alias("le"), F.col(c).alias("value")) for s, c in (("sum", "total"), ("count", "n"))))
    return buckets.unionByName(sums.filter("n > 0").select(*labels, F.explode(rest).alias("_r")).select(*labels, "_r.*"))


def exposition(metrics: DataFrame) -> DataFrame:
    """name, text: the lines of name, kind, labels, value rows: a type line for each name, then its samples by label."""
    sample = F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    lines = metrics.groupBy("name", "kind").agg(F.array_sort(F.collect_list(sample)).alias("_samples"))  # a series for each label
    return lines.select("name", F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"), F.array_join("_samples", "\n")).alias("text"))
