"""Proxied documents: freshness, revalidation, flights, redirects and allowed origins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.http import REDIRECTS

#: Fixed value: redirects that are followed at most.
MAX_REDIRECTS = 5


def is_fresh(updated_at: Column, now: Column, ttl: int) -> Column:
    """Younger than ttl; a time in the future has the age 0, no record is never fresh."""
    return F.coalesce(F.greatest(now - updated_at, F.lit(0).cast("bigint")) < ttl, F.lit(False))


def revalidation(rows: DataFrame, ttl: int) -> DataFrame:
    """rows with `decision`: cached, rebound, republished, uncached, passthrough or unavailable.

    rows: now, updated_at, has_body, status (of the upstream, where asked), admitted. A record counts as long as its
    body is there.
    """
    record = F.col("updated_at").isNotNull() & F.col("has_body")
    decision = (
        F.when(record & is_fresh(F.col("updated_at"), F.col("now"), ttl), "cached")
        .when(F.col("status").isNull(), "unavailable")
        .when(F.col("status") == 304, F.when(record, "rebound").otherwise("unavailable"))
        .when(~F.col("status").between(200, 299), "passthrough")
        .when(F.col("admitted"), "republished")
        .otherwise("uncached")
    )
    return rows.withColumn("decision", decision)


def allowed_origins(*sources: DataFrame) -> DataFrame:
    """protocol, origin: the union of the sources, each once."""
    out = sources[0].select("protocol", "origin")
    for s in sources[1:]:
        out = out.unionByName(s.select("protocol", "origin"))
    return out.filter("origin is not null").distinct()


#: Fixed value: seconds for which an empty answer without a lifetime of its own holds.
EMPTY_TTL = 5


def resolved(answers: DataFrame) -> DataFrame:
    """answers with `records` and `ttl` as a resolver gives them, and `failed`.

    answers: status (`found`, `empty`, anything else: failed), records, ttl, of a lookup. An empty answer names no members, which is
    an answer; a failed one tells nothing.
    """
    empty = F.col("status") == "empty"
    failed = ~F.coalesce(empty | (F.col("status") == "found"), F.lit(False))
    none = F.array().cast(answers.schema["records"].dataType)
    return answers.withColumns({
        "failed": failed, "records": F.when(~failed, F.when(empty, none).otherwise(F.coalesce("records", none))), "ttl": F.when(~failed, F.when(empty, F.coalesce("ttl", F.lit(EMPTY_TTL))).otherwise(F.col("ttl"))),
    })


def follow_redirects(requests: DataFrame, responses: DataFrame, hops: int = MAX_REDIRECTS) -> DataFrame:
    """request, url, status, hops of where each request ends: at a response that is no redirect, at a missing one (status
    null), or after `hops` redirects (the redirect itself).

    responses: url, status, location. Each hop is one join of the requests that are still under way; those at their end are
    set aside. Under way are only requests that were redirected, so the joins shrink, and the shuffles they share are reused.
    """
    table = responses.select(F.col("url").alias("_url"), "status", "location")
    way = requests.select("request", "url")
    done = None
    for hop in range(hops + 1):
        at = way.join(table, F.col("url") == F.col("_url"), "left")
        on = F.coalesce(F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull(), F.lit(False))
        ended = (at if hop == hops else at.filter(~on)).select("request", "url", "status", F.lit(hop).alias("hops"))
        done = ended if done is None else done.unionByName(ended)
        way = at.filter(on).select("request", F.col("location").alias("url"))
    return done


def revalidated(requests: DataFrame, ttl: int) -> DataFrame:
    """key, id, decision, updated_at: what each request (key, id, now, status, admitted, body_kept) comes to, in order of time.

    As revalidation, with the record that earlier requests of the key left: a rebound one is as new as the request, a
    republished one has a body again, which is lost where body_kept is false. A key's requests go in sequence, streamed through
    one task in Arrow batches; keys run side by side.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, updated, body = None, None, False
        for frame in frames:
            decisions, times = [], []
            for key, now, status, admitted, kept in zip(*(frame[c].tolist() for c in ("key", "now", "status", "admitted", "body_kept")), strict=True):
                if key != current:
                    current, updated, body = key, None, False
                body = body and bool(kept)
                there = updated is not None and body
                if there and max(now - updated, 0) < ttl:
                    decision = "cached"
                elif status is None or status != status:
                    decision = "unavailable"
                elif status == 304:
                    decision = "rebound" if there else "unavailable"
                elif not 200 <= status <= 299:
                    decision = "passthrough"
                else:
                    decision = "republished" if admitted else "uncached"
                if decision in ("rebound", "republished"):
                    updated, body = now, True
                decisions.append(decision)
                times.append(updated)
            yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "decision": decisions, "updated_at": pd.array(times, "Int64")})

    kind = requests.schema["key"].dataType.simpleString()
    ordered = requests.select("key", "id", "now", "status", "admitted", "body_kept").repartition("key").sortWithinPartitions("key", "now", "id")
    return ordered.mapInPandas(run, f"key {kind}, id bigint, decision string, updated_at bigint")


def flights(requests: DataFrame, ttl: int) -> DataFrame:
    """key, id, fetched: whether each request (key, id, at, ok) asks the upstream, the others wait for or find its result.

    A request finds the document fresh if an earlier one fetched it successfully less than ttl before; a failed fetch
    lets the next one try. That depends on earlier outcomes, so a key's requests go in sequence; they are streamed
    through one task in Arrow batches and never held together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fetched_at = None, None
        for frame in frames:
            out = []
            for key, at, ok in zip(*(frame[c].tolist() for c in ("key", "at", "ok")), strict=True):
                if key != current:
                    current, fetched_at = key, None
                ask = fetched_at is None or max(at - fetched_at, 0) >= ttl
                if ask and ok:
                    fetched_at = at
                out.append(ask)
            yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "fetched": out})

    ordered = requests.select("key", "id", "at", "ok").repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, "key string, id bigint, fetched boolean")
