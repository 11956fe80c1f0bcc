"""Consistent hashing: ring points, owners of keys, membership snapshots and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.identity import VIRTUAL_NODES, member_point
from marlstone.operators.running import running_last, running_sums

#: Members that a ring is meant for; a ring is broadcast, two rows an arc at most, so its size is checked.
MOST_MEMBERS = 10_000


def ring_points(members: DataFrame, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """member, node, point of each distinct member."""
    spread = members.select("member").filter("member is not null").distinct().select("member", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"))
    return spread.select("member", "node", member_point(F.col("member"), F.col("node")).alias("point"))


def ring_arcs(members: DataFrame, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """low, high, member of arcs (low, high] that cover every position; members that share a point: the smaller owns it."""
    points = ring_points(members, nodes).groupBy("point").agg(F.min("member").alias("member"))
    everywhere = Window.orderBy("point")  # a ring's points, not its keys
    arcs = points.select(F.coalesce(F.lag("point").over(everywhere), F.lit("")).alias("low"), F.col("point").alias("high"), "member")
    ends = points.agg(F.max("point").alias("low"), F.min_by("member", "point").alias("member")).filter("low is not null")
    return arcs.unionByName(ends.select("low", F.lit("g").alias("high"), "member"))  # "g" is behind every hex digit


def ring_owners(keys: DataFrame, members: DataFrame, nodes: int = VIRTUAL_NODES, most: int = MOST_MEMBERS) -> DataFrame:
    """keys (with a column `position`) and their owner: the member of the first point not before the position, around the ring.

    Keys without a position, and all keys of an empty ring, have a null owner. The ring is broadcast by buckets of
    positions, no more of them than arcs, so the as-of join is a hash join with few candidates at any size; more than `most`
    members are refused.
    """
    distinct = members.select("member").distinct()
    n = distinct.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a ring of more than {most} members")
    bits = max(1, min(31, (n * nodes).bit_length() - 1))
    number = lambda c: F.shiftright(F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint"), 32 - bits)
    low = F.when(F.col("low") == "", F.lit(0).cast("bigint")).otherwise(number(F.col("low")))
    high = F.when(F.col("high") == "g", F.lit((1 << bits) - 1).cast("bigint")).otherwise(number(F.col("high")))
    spread = ring_arcs(distinct, nodes).select("low", "high", F.col("member").alias("owner"), F.explode(F.sequence(low, high)).alias("_bucket"))
    bucketed = keys.withColumn("_bucket", number(F.col("position")))
    inside = (F.col("position") > F.col("low")) & (F.col("position") <= F.col("high"))
    return bucketed.join(F.broadcast(spread), (bucketed["_bucket"] == spread["_bucket"]) & inside, "left").drop("_bucket", "low", "high")


def ring_fingerprint(members: DataFrame) -> DataFrame:
    """fingerprint, members: SHA-256 of the sorted distinct member ids, a line each."""
    return members.select("member").distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_set("member")), "\n").cast("binary"), 256).alias("fingerprint"), F.count("member").alias("members"))


def owner_spread(owned: DataFrame) -> DataFrame:
    """owner, keys: how many keys each member owns."""
    return owned.groupBy("owner").agg(F.count(F.lit(1)).alias("keys"))


def remapped(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """keys, moved, moved_needlessly: keys whose owner changed, and those of them whose owner is still there."""
    both = before.select(key, F.col("owner").alias("_was")).join(after.select(key, F.col("owner").alias("_is")), key)
    stays = after.select(F.col("owner").alias("_was")).distinct().withColumn("_stays", F.lit(True))
    changed = ~F.col("_was").eqNullSafe(F.col("_is"))
    return both.join(stays, "_was", "left").agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(changed).alias("moved"), F.count_if(changed & F.coalesce("_stays", F.lit(False))).alias("moved_needlessly")
    )


def refreshed_members(snapshot: DataFrame, health: DataFrame) -> DataFrame:
    """member, address, failures, next_retry: the new members with the old health; members no longer named are dropped.

    snapshot: member, address, ordinal. A member named twice keeps the address that was discovered first.
    """
    first = snapshot.groupBy("member").agg(F.min_by("address", "ordinal").alias("address"))
    return first.join(health.select("member", "failures", "next_retry"), "member", "left").select("member", "address", F.coalesce("failures", F.lit(0)).alias("failures"), "next_retry")


def resolved_targets(targets: DataFrame, addresses: DataFrame, known: DataFrame) -> DataFrame:
    """member, address of each target: its least resolved IP, else the last known one, with the new port; else dropped.

    targets: member, port; addresses: member, ip; known: member, ip. IPv4 comes before IPv6, each in numeric order.
    """
    four = F.split("ip", "[.]")
    order = F.when(F.col("ip").contains(":"), F.concat(F.lit("6"), F.lower("ip"))).otherwise(F.concat(F.lit("4"), *(F.lpad(four[i], 3, "0") for i in range(4))))
    least = addresses.filter("ip is not null").groupBy("member").agg(F.min_by("ip", order).alias("_ip"))
    last = known.groupBy("member").agg(F.max("ip").alias("_last"))
    found = targets.join(least, "member", "left").join(last, "member", "left").withColumn("ip", F.coalesce("_ip", "_last"))
    return found.filter("ip is not null").select("member", F.concat_ws(":", "ip", F.col("port").cast("string")).alias("address"))


def retry_summary(health: DataFrame, now: int) -> DataFrame:
    """members, ejected, next_retry: the earliest deadline among ejected members."""
    out = F.col("next_retry") > now
    return health.agg(F.count(F.lit(1)).alias("members"), F.count_if(out).alias("ejected"), F.min(F.when(out, F.col("next_retry"))).alias("next_retry"))


def failure_streaks(events: DataFrame, by: str, order: str) -> DataFrame:
    """events with `streak`: failures in a row up to and including this one; a success sets it to 0."""
    failures = running_sums(events, [by], order, {"_failures": F.col("failed").cast("bigint")})
    marked = running_last(failures, [by], order, {"_at_success": F.when(~F.col("failed"), F.col("_failures"))})
    return marked.withColumn("streak", F.col("_failures") - F.coalesce("_at_success", F.lit(0))).drop("_failures", "_at_success")
