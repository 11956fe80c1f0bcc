"""Planning which candidates a maintenance pass evicts, requeues or finds stale, within its budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NORMAL, RECLAIMING = "normal", "reclaiming"
U64_SECONDS = 2**63 - 1


def channel_turns(channels: DataFrame, cursor: int) -> DataFrame:
    """channel_id, expiry_seconds, turn: the active channels in id order, begun at `cursor` modulo their number."""
    active = channels.filter("state = 'active'").select("channel_id", "expiry_seconds")
    everywhere = Window.orderBy("channel_id")  # channels, not rows: a catalog has few
    ranked = active.withColumn("_at", F.row_number().over(everywhere) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.select("channel_id", "expiry_seconds", F.pmod(F.col("_at") - F.lit(cursor), F.col("_n")).alias("turn"))


def recently_used(marks: DataFrame, rotations_now: int) -> DataFrame:
    """channel_id, digest of marks (with the rotation each was made in) of this rotation or the one before."""
    return marks.filter((F.lit(rotations_now) - F.col("rotation")).between(0, 1)).select("channel_id", "digest").distinct()


def maintenance_plan(
    queue: DataFrame, artifacts: DataFrame, channels: DataFrame, recent: DataFrame, mode: str, now: int, cursor: int, candidates: int, budget: int
) -> DataFrame:
    """seq, channel_id, digest, eligible_at, stored_len, action, matched and new_eligible_at of the candidates that a pass acts on.

    Candidates come by channel turn, deadline and digest. In normal mode only due ones are looked at, and those used
    recently are requeued `expiry_seconds` from now; others are evicted if the artifact still has the queued deadline,
    else stale. matched tells whether the artifact has that deadline: a requeue without does nothing. stored_len is the
    artifact's, of matched rows. The pass ends with `candidates` candidates, or once `budget` bytes of artifacts were
    evicted, which the last eviction may overshoot. Null lengths evict no bytes.

    The first `candidates` rows of the whole order are taken first, a top-k over the queue; all else is done for those.
    """
    turns = channel_turns(channels, cursor)
    keys = ["channel_id", "digest"]
    due = queue if mode == RECLAIMING else queue.filter(F.col("eligible_at") <= now)
    first = due.join(turns, "channel_id").select(*keys, "eligible_at", "turn", "expiry_seconds").orderBy("turn", "eligible_at", "digest").limit(candidates)
    asked = F.broadcast(first.select(*keys).distinct())  # at most `candidates` rows
    rows = artifacts.join(asked, keys, "left_semi").select(*keys, F.col("eligible_at").alias("_due"), "stored_len")
    used = recent.join(asked, keys, "left_semi").select(*keys, F.lit(True).alias("_recent")).distinct()
    joined = first.join(rows, keys, "left").join(used, keys, "left")
    matched = F.coalesce(F.col("_due") == F.col("eligible_at"), F.lit(False))
    keep = F.col("_recent").isNotNull() if mode == NORMAL else F.lit(False)
    action = F.when(keep, "requeue").when(matched, "evict").otherwise("stale")
    acted = joined.withColumns({"matched": matched, "action": action}).withColumn("stored_len", F.when(F.col("matched"), F.col("stored_len")))
    order = Window.orderBy("turn", "eligible_at", "digest")  # over `candidates` rows
    freed = F.when(F.col("action") == "evict", F.coalesce("stored_len", F.lit(0))).otherwise(F.lit(0))
    spent = F.coalesce(F.sum(freed).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    planned = acted.withColumn("seq", F.row_number().over(order)).withColumn("_spent", spent).filter(F.col("_spent") < budget)
    later = F.when(F.col("action") == "requeue", F.lit(now) + F.least(F.col("expiry_seconds"), F.lit(U64_SECONDS - now)))
    return planned.select("seq", *keys, "eligible_at", "stored_len", "action", "matched", later.alias("new_eligible_at"))


def pass_summary(plan: DataFrame) -> DataFrame:
    """reclaimed, reclaimed_bytes, requeued, stale of a plan; a requeue counts whether or not the artifact matched."""
    of = lambda a: F.count_if(F.col("action") == a)
    freed = F.coalesce(F.sum(F.when(F.col("action") == "evict", F.col("stored_len"))), F.lit(0))
    return plan.agg(of("evict").alias("reclaimed"), freed.alias("reclaimed_bytes"), of("requeue").alias("requeued"), of("stale").alias("stale"))


def requeue(queue: DataFrame, artifacts: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue and the artifacts after `moves` (channel_id, digest, eligible_at, new_eligible_at), each artifact once.

    Only an artifact that has the old deadline is moved: its queue row gives way to one at the new deadline, with the
    artifact's stored length, and the artifact gets that deadline. Of any other artifact nothing changes in either table.
    A queue row that the artifact lacks is made; one that is at the new deadline already is replaced.
    """
    keys = ["channel_id", "digest"]
    held = artifacts.select(*keys, "eligible_at", "stored_len")
    good = moves.select(*keys, "eligible_at", "new_eligible_at").join(held, [*keys, "eligible_at"]).distinct()
    old = good.select(*keys, "eligible_at")
    new = good.select(*keys, F.col("new_eligible_at").alias("eligible_at"), "stored_len")
    left = queue.join(old.unionByName(new.select(*keys, "eligible_at")), [*keys, "eligible_at"], "left_anti").select(*queue.columns)
    queue_after = left.unionByName(new, allowMissingColumns=True).select(*queue.columns)
    moved = artifacts.join(good.select(*keys, "new_eligible_at"), keys, "left")
    return queue_after, moved.withColumn("eligible_at", F.coalesce("new_eligible_at", "eligible_at")).select(*artifacts.columns)


def apply_plan(plan: DataFrame, queue: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue and the artifacts after a plan: evicted rows leave both, stale ones the queue, and requeued ones that matched
    move to their new deadline in both (see requeue). A requeue that didn't match leaves both as they are.
    """
    keys = ["channel_id", "digest"]
    gone = plan.filter(F.col("action").isin("evict", "stale")).select(*keys, "eligible_at", "action")
    queue_left = queue.join(F.broadcast(gone), [*keys, "eligible_at"], "left_anti").select(*queue.columns)  # a plan is bounded
    evicted = F.broadcast(gone.filter("action = 'evict'").select(*keys))
    artifacts_left = artifacts.join(evicted, keys, "left_anti").select(*artifacts.columns)
    return requeue(queue_left, artifacts_left, F.broadcast(plan.filter("action = 'requeue' and matched")))
