"""Maintenance passes, space and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.identity import VIRTUAL_NODES, member_key, ring_position, routing_key
from marlstone.functions.spelling import digest_hex
from marlstone.functions.timing import next_backoff, refresh_bounds
from marlstone.operators import maintenance as M
from marlstone.operators import ring as G
from marlstone.operators import space as S
from marlstone.operators.running import running_last
from marlstone.plans import catalog as C
from marlstone.plans.identity import position_sql
from marlstone.plans.registry import Registry, plain, portable
from marlstone.session import cut_lineage
from marlstone.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: The time of the passes below, inside that of the tables.
NOW = 1_745_000_000
CURSOR, CANDIDATES, BUDGET = 5, 256, 8 << 30

_MARKS = f"(SELECT channel_id, digest, created_at // 86400 AS rotation FROM {C.UPLOADS})"
_RECENT = f"(SELECT DISTINCT channel_id, digest FROM {_MARKS} WHERE {NOW // 86400} - rotation BETWEEN 0 AND 1)"


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """Uses by channel and digest, a rotation a day."""
    return C.uploads(spark, folder, once=False).select("channel_id", "digest", F.expr("created_at div 86400").alias("rotation"))


def recent(spark: SparkSession, folder: str) -> DataFrame:
    return M.recently_used(marks(spark, folder), NOW // 86400)


def distinct_queue(spark: SparkSession, folder: str) -> DataFrame:
    """A queue has one row for each channel, deadline and digest."""
    rows = C.queue(spark, folder, once=False).filter("eligible_at is not null")
    return rows.groupBy("channel_id", "eligible_at", "digest").agg(F.max("stored_len").alias("stored_len"))


_QUEUE = f"(SELECT channel_id, eligible_at, digest, max(stored_len) AS stored_len FROM {C.QUEUE} WHERE eligible_at IS NOT NULL GROUP BY 1, 2, 3)"


def _plan_sql(mode: str) -> str:
    """What evicting tells of the artifact, and what it frees, is the artifact's deadline and length, not the queue's."""
    due = "TRUE" if mode == M.RECLAIMING else f"q.eligible_at <= {NOW}"
    recent_ = "FALSE" if mode == M.RECLAIMING else "r.digest IS NOT NULL"
    return f"""WITH turns AS (SELECT channel_id, expiry_seconds, (((row_number() OVER (ORDER BY channel_id) - 1 - {CURSOR}) % count(*) OVER ()) + count(*) OVER ()) % count(*) OVER () AS turn FROM channel_record WHERE state = 'active'),
      cand AS (SELECT q.channel_id, q.digest, q.eligible_at, t.turn, t.expiry_seconds, a.eligible_at IS NOT DISTINCT FROM q.eligible_at AS matched,
        CASE WHEN a.eligible_at = q.eligible_at THEN a.stored_len END AS stored_len, CASE WHEN {recent_} THEN 'requeue' WHEN a.eligible_at = q.eligible_at THEN 'evict' ELSE 'stale' END AS action
        FROM {_QUEUE} q JOIN turns t USING (channel_id) LEFT JOIN {C.ARTIFACTS} a ON a.channel_id = q.channel_id AND a.digest = q.digest LEFT JOIN {_RECENT} r ON r.channel_id = q.channel_id AND r.digest = q.digest WHERE {due}),
      ranked AS (SELECT *, row_number() OVER w AS seq, coalesce(sum(CASE WHEN action = 'evict' THEN coalesce(stored_len, 0) ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM cand WINDOW w AS (ORDER BY turn, eligible_at, digest))
      SELECT CAST(seq AS INTEGER) AS seq, channel_id, digest, eligible_at, stored_len, action, matched, CASE WHEN action = 'requeue' THEN CAST({NOW} + expiry_seconds AS BIGINT) END AS new_eligible_at FROM ranked WHERE seq <= {CANDIDATES} AND spent < {BUDGET}"""


def _plan(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    return M.maintenance_plan(distinct_queue(spark, folder), C.artifacts(spark, folder), C.channels(spark, folder), recent(spark, folder), mode, NOW, CURSOR, CANDIDATES, BUDGET)


@R.add(_plan_sql(M.NORMAL))
def o1_maintenance_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder, M.NORMAL)


@R.add(_plan_sql(M.RECLAIMING))
def o1_reclaiming_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder, M.RECLAIMING)


@R.add(f"SELECT CAST(count(*) FILTER (action = 'evict') AS BIGINT) AS reclaimed, CAST(coalesce(sum(CASE WHEN action = 'evict' THEN stored_len END), 0) AS BIGINT) AS reclaimed_bytes, CAST(count(*) FILTER (action = 'requeue') AS BIGINT) AS requeued, CAST(count(*) FILTER (action = 'stale') AS BIGINT) AS stale FROM ({_plan_sql(M.NORMAL)})")
def a13_pass_summary(spark: SparkSession, folder: str) -> DataFrame:
    return M.pass_summary(_plan(spark, folder, M.NORMAL))


_AFTER_PASS = f"""WITH p AS ({_plan_sql(M.NORMAL)}),
  moved AS (SELECT channel_id, digest, new_eligible_at AS eligible_at, stored_len FROM p WHERE action = 'requeue' AND matched),
  left_over AS (SELECT q.channel_id, q.digest, q.eligible_at, q.stored_len FROM {_QUEUE} q LEFT JOIN p USING (channel_id, eligible_at, digest)
    WHERE (p.action IS NULL OR (p.action = 'requeue' AND NOT p.matched)) AND (q.channel_id, q.digest, q.eligible_at) NOT IN (SELECT channel_id, digest, eligible_at FROM moved))"""


@R.add(f"{_AFTER_PASS} SELECT channel_id, digest, eligible_at, stored_len FROM left_over UNION ALL SELECT channel_id, digest, eligible_at, stored_len FROM moved")
def o1_queue_after_pass(spark: SparkSession, folder: str) -> DataFrame:
    plan = cut_lineage(_plan(spark, folder, M.NORMAL))
    after, _ = M.apply_plan(plan, distinct_queue(spark, folder), C.artifacts(spark, folder))
    return after.select("channel_id", "digest", "eligible_at", "stored_len")


@R.add(f"""{_AFTER_PASS} SELECT a.channel_id, a.digest, coalesce(m.eligible_at, a.eligible_at) AS eligible_at, a.stored_len FROM {C.ARTIFACTS} a LEFT JOIN moved m ON m.channel_id = a.channel_id AND m.digest = a.digest
  WHERE (a.channel_id, a.digest) NOT IN (SELECT channel_id, digest FROM p WHERE action = 'evict')""")
def o1_artifacts_after_pass(spark: SparkSession, folder: str) -> DataFrame:
    plan = cut_lineage(_plan(spark, folder, M.NORMAL))
    _, after = M.apply_plan(plan, distinct_queue(spark, folder), C.artifacts(spark, folder))
    return after.select("channel_id", "digest", "eligible_at", "stored_len")


# The two cases that tell the artifact's length and deadline from the queue's: fixed rows.
_CASE_QUEUE = "SELECT * FROM VALUES ('a', 10, 'x', CAST(NULL AS BIGINT)), ('a', 11, 'y', 8), ('b', 10, 'z', 5), ('b', 12, 'w', 7) AS q(channel_id, eligible_at, digest, stored_len)"
_CASE_ARTIFACTS = "SELECT * FROM VALUES ('a', 'x', 10, 100), ('a', 'y', 11, 8), ('b', 'z', 50, 5), ('b', 'w', 12, 9) AS a(channel_id, digest, eligible_at, stored_len)"


@R.add("""SELECT * FROM (VALUES ('budget', 'queue', 'a', 'y', 11, 8), ('budget', 'queue', 'b', 'z', 10, 5), ('budget', 'queue', 'b', 'w', 12, 7),
    ('budget', 'artifacts', 'a', 'y', 11, 8), ('budget', 'artifacts', 'b', 'z', 50, 5), ('budget', 'artifacts', 'b', 'w', 12, 9),
    ('requeue', 'queue', 'b', 'z', 10, 5), ('requeue', 'queue', 'b', 'w', 1100, 9), ('requeue', 'artifacts', 'b', 'z', 50, 5), ('requeue', 'artifacts', 'b', 'w', 1100, 9)) AS t("case", family, channel_id, digest, eligible_at, stored_len)""")
def o1_planted_cases(spark: SparkSession, folder: str) -> DataFrame:
    """budget: the first eviction's 100 bytes end a pass of 50, whatever its queue row says. requeue: a stale row stays."""
    queue = spark.sql(_CASE_QUEUE)
    rows = spark.sql(_CASE_ARTIFACTS)
    channels = spark.sql("SELECT * FROM VALUES ('a', 1000, 'active'), ('b', 1000, 'active') AS c(channel_id, expiry_seconds, state)")
    used = spark.sql("SELECT * FROM VALUES ('b', 'z'), ('b', 'w') AS u(channel_id, digest)")
    out = None
    for case, budget in (("budget", 50), ("requeue", 1_000)):
        plan = M.maintenance_plan(queue, rows, channels, used, M.NORMAL, 100, 0, 10, budget)
        for family, after in zip(("queue", "artifacts"), M.apply_plan(plan, queue, rows), strict=True):
            part = after.select(F.lit(case).alias("case"), F.lit(family).alias("family"), "channel_id", "digest", "eligible_at", F.col("stored_len").cast("int").alias("stored_len"))
            out = part if out is None else out.unionByName(part)
    return out


@R.add(f"SELECT channel_id, CAST((((row_number() OVER (ORDER BY channel_id) - 1 - {CURSOR}) % count(*) OVER ()) + count(*) OVER ()) % count(*) OVER () AS BIGINT) AS turn FROM channel_record WHERE state = 'active'")
def o2_channel_turns(spark: SparkSession, folder: str) -> DataFrame:
    return M.channel_turns(C.channels(spark, folder), CURSOR).select("channel_id", F.col("turn").cast("bigint").alias("turn"))


@R.add(f"SELECT q.channel_id, q.digest, q.eligible_at, CASE WHEN a.digest IS NULL THEN 'absent' WHEN a.eligible_at = q.eligible_at THEN 'match' ELSE 'stale' END AS state, q.eligible_at <= {NOW} AS due FROM {_QUEUE} q LEFT JOIN {C.ARTIFACTS} a ON a.channel_id = q.channel_id AND a.digest = q.digest")
def j2_queue_artifact(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["channel_id", "digest"]
    joined = distinct_queue(spark, folder).join(C.artifacts(spark, folder).select(*keys, F.col("eligible_at").alias("_due"), F.lit(True).alias("_there")), keys, "left")
    state = F.when(F.col("_there").isNull(), "absent").when(F.col("_due") == F.col("eligible_at"), "match").otherwise("stale")
    return joined.select(*keys, "eligible_at", state.alias("state"), (F.col("eligible_at") <= NOW).alias("due"))


@R.add(f"SELECT channel_id, digest, content_len FROM {C.ARTIFACTS} WHERE (channel_id, digest) IN (SELECT channel_id, digest FROM {_RECENT})")
def j11_recently_used(spark: SparkSession, folder: str) -> DataFrame:
    return C.artifacts(spark, folder).join(recent(spark, folder), ["channel_id", "digest"], "left_semi").select("channel_id", "digest", "content_len")


@R.add(f"SELECT CAST(count(*) FILTER (age BETWEEN 0 AND 1) AS BIGINT) AS live, CAST(count(*) FILTER (age > 1) AS BIGINT) AS rotated_out, CAST(count(*) FILTER (age < 0) AS BIGINT) AS later FROM (SELECT channel_id, digest, min(CASE WHEN {NOW // 86400} - rotation >= 0 THEN {NOW // 86400} - rotation END) AS past, coalesce(min(CASE WHEN {NOW // 86400} - rotation >= 0 THEN {NOW // 86400} - rotation END), -1) AS age FROM {_MARKS} GROUP BY 1, 2)")
def t3_recency_rotation(spark: SparkSession, folder: str) -> DataFrame:
    age = F.lit(NOW // 86400) - F.col("rotation")
    each = marks(spark, folder).groupBy("channel_id", "digest").agg(F.coalesce(F.min(F.when(age >= 0, age)), F.lit(-1)).alias("age"))
    return each.agg(F.count_if(F.col("age").between(0, 1)).alias("live"), F.count_if(F.col("age") > 1).alias("rotated_out"), F.count_if(F.col("age") < 0).alias("later"))


# --- the ring ------------------------------------------------------------------------------------------------------------

#: Members are few: one for each nation.
_MEMBERS = "lower(n_name) || '.shards.cache'"
_KEYS = "SELECT DISTINCT route AS kind, digest AS id FROM {put_record} WHERE digest IS NOT NULL"


def members(spark: SparkSession, folder: str, but: str | None = None) -> DataFrame:
    rows = table(spark, folder, "nation")
    return (rows if but is None else rows.filter(F.col("n_name") != but)).select(member_key(F.concat("n_name", F.lit(".Shards.Cache."))).alias("member"))


def keys(spark: SparkSession, folder: str) -> DataFrame:
    return portable(spark, folder, _KEYS).withColumn("position", ring_position(routing_key(F.col("kind"), F.col("id"))))


def _owners_sql(but: str | None = None) -> str:
    where = f"WHERE n_name <> '{but}'" if but else ""
    return f"""(WITH m AS (SELECT {_MEMBERS} AS member FROM nation {where}), p AS (SELECT min(member) AS member, point FROM (SELECT member, substr(sha256(encode(member) || unhex(printf('%04x', CAST(range AS BIGINT)))), 1, 16) AS point FROM m, range({VIRTUAL_NODES})) GROUP BY point),
      k AS (SELECT kind, id, {position_sql("kind", "id")} AS position FROM ({plain(_KEYS)}))
      SELECT k.kind, k.id, k.position, coalesce(p.member, (SELECT min_by(member, point) FROM p)) AS owner FROM k ASOF LEFT JOIN p ON k.position <= p.point)"""


@R.add(f"SELECT * FROM {_owners_sql()}")
def j5_ring_owner(spark: SparkSession, folder: str) -> DataFrame:
    return G.ring_owners(keys(spark, folder), members(spark, folder)).select("kind", "id", "position", "owner")


@R.add(f"SELECT owner, CAST(count(*) AS BIGINT) AS keys FROM {_owners_sql()} GROUP BY 1")
def a18_key_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return G.owner_spread(G.ring_owners(keys(spark, folder), members(spark, folder)))


@R.add(f"""SELECT CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (a.owner <> b.owner) AS BIGINT) AS moved, CAST(count(*) FILTER (a.owner <> b.owner AND a.owner <> 'nation_3.shards.cache') AS BIGINT) AS moved_needlessly
  FROM {_owners_sql()} a JOIN {_owners_sql("NATION_3")} b USING (kind, id)""")
def a18_remap_on_removal(spark: SparkSession, folder: str) -> DataFrame:
    named = keys(spark, folder).withColumn("key", F.concat_ws("/", "kind", "id"))
    before = G.ring_owners(named, members(spark, folder))
    after = G.ring_owners(named, members(spark, folder, but="NATION_3"))
    return G.remapped(before, after, "key")


@R.add(f"SELECT sha256(string_agg(m, chr(10) ORDER BY m)) AS fingerprint, CAST(count(*) AS BIGINT) AS members FROM (SELECT DISTINCT {_MEMBERS} AS m FROM nation)")
def a9_ring_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return G.ring_fingerprint(members(spark, folder))


#: What each member (a user) went through: errors are failures, all else successes.
_HEALTH = "SELECT user_id AS member, event_id, event_type = 'error' AS failed FROM {events}"


@R.add(f"""WITH h AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY member ORDER BY event_id) AS island FROM ({plain(_HEALTH)}))
  SELECT event_id, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY member, island ORDER BY event_id) AS BIGINT) AS streak FROM h""")
def o10_failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return G.failure_streaks(portable(spark, folder, _HEALTH), "member", "event_id").select("event_id", "streak")


# Snapshots, known health and addresses come from the dearer events, which not every user has: that gives them misses.
_SNAPSHOT = "SELECT DISTINCT user_id AS member, event_type || ':' || CAST(user_id AS STRING) AS address, event_id AS ordinal FROM {events} WHERE event_type = 'view' AND value > 60"
_OLD_HEALTH = "SELECT user_id AS member, count(*) AS failures, max(CASE WHEN event_type = 'error' THEN event_id END) AS next_retry FROM {events} WHERE value > 30 GROUP BY user_id"


@R.add(f"""SELECT s.member, s.address, CAST(coalesce(failures, 0) AS BIGINT) AS failures, next_retry FROM (SELECT member, min_by(address, ordinal) AS address FROM ({plain(_SNAPSHOT)}) GROUP BY 1) s LEFT JOIN ({plain(_OLD_HEALTH)}) h USING (member)""")
def j6_o7_membership_refresh(spark: SparkSession, folder: str) -> DataFrame:
    return G.refreshed_members(portable(spark, folder, _SNAPSHOT), portable(spark, folder, _OLD_HEALTH))


_TARGETS = "SELECT DISTINCT user_id AS member, 8000 + user_id AS port FROM {events}"
_ADDRESSES = "SELECT DISTINCT user_id AS member, CASE WHEN event_id % 4 = 0 THEN 'fd00::' || CAST(event_id % 10 AS STRING) ELSE '10.0.' || CAST(event_id % 13 AS STRING) || '.' || CAST(user_id % 200 AS STRING) END AS ip FROM {events} WHERE event_type = 'click' AND value > 60"
_KNOWN = "SELECT DISTINCT user_id AS member, '192.168.0.' || CAST(user_id % 100 AS STRING) AS ip FROM {events} WHERE event_type = 'signup' AND value > 60"


@R.add(f"""WITH a AS (SELECT member, min_by(ip, CASE WHEN ip LIKE '%:%' THEN '6' || ip ELSE '4' || lpad(split_part(ip, '.', 1), 3, '0') || lpad(split_part(ip, '.', 2), 3, '0') || lpad(split_part(ip, '.', 3), 3, '0') || lpad(split_part(ip, '.', 4), 3, '0') END) AS ip FROM ({plain(_ADDRESSES)}) GROUP BY 1)
  SELECT t.member, coalesce(a.ip, k.ip) || ':' || CAST(port AS VARCHAR) AS address FROM ({plain(_TARGETS)}) t LEFT JOIN a USING (member) LEFT JOIN ({plain(_KNOWN)}) k USING (member) WHERE coalesce(a.ip, k.ip) IS NOT NULL""")
def j7_a11_resolve_targets(spark: SparkSession, folder: str) -> DataFrame:
    return G.resolved_targets(portable(spark, folder, _TARGETS), portable(spark, folder, _ADDRESSES), portable(spark, folder, _KNOWN))


_ALL_HEALTH = "SELECT user_id AS member, count(*) AS failures, max(CASE WHEN event_type = 'error' THEN event_id END) AS next_retry FROM {events} GROUP BY user_id"


@R.add(f"SELECT CAST(count(*) AS BIGINT) AS members, CAST(count(*) FILTER (next_retry > 5000) AS BIGINT) AS ejected, min(CASE WHEN next_retry > 5000 THEN next_retry END) AS next_retry FROM ({plain(_ALL_HEALTH)})")
def a8_a10_retry_summary(spark: SparkSession, folder: str) -> DataFrame:
    return G.retry_summary(portable(spark, folder, _ALL_HEALTH), 5_000)


_CALLS = "SELECT event_id, user_id AS member, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'body' WHEN 'view' THEN 'connect' ELSE 'none' END AS failure FROM {events}"


@R.add(f"SELECT c.event_id, failure IN ('connect', 'timeout') AS counts, coalesce(next_retry > 5000, false) AS ejected FROM ({plain(_CALLS)}) c LEFT JOIN ({plain(_OLD_HEALTH)}) h USING (member)")
def j13_p11_p13_call_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    health = portable(spark, folder, _OLD_HEALTH).select("member", "next_retry")
    joined = portable(spark, folder, _CALLS).join(health, "member", "left")
    return joined.select("event_id", F.col("failure").isin("connect", "timeout").alias("counts"), F.coalesce(F.col("next_retry") > 5_000, F.lit(False)).alias("ejected"))


# --- space ---------------------------------------------------------------------------------------------------------------

#: Ledger operations as the events imply them, by user; an error is a sensor that fails.
_OPS = "SELECT user_id AS replica, event_id AS seq, CASE event_type WHEN 'view' THEN 'observe' WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'release' ELSE 'fail' END AS op, CASE WHEN event_type = 'view' THEN 400 + event_id % 300 ELSE event_id % 97 END AS bytes FROM {events}"


@R.add(f"""WITH o AS (SELECT *, sum(CASE WHEN op = 'observe' THEN 1 ELSE 0 END) OVER (PARTITION BY replica ORDER BY seq) AS epoch FROM ({plain(_OPS)}))
  SELECT seq, CAST(sum(CASE op WHEN 'reserve' THEN bytes WHEN 'release' THEN -bytes WHEN 'commit' THEN -bytes ELSE 0 END) OVER (PARTITION BY replica ORDER BY seq) AS BIGINT) AS reserved,
    CAST(sum(CASE WHEN op = 'commit' THEN bytes ELSE 0 END) OVER (PARTITION BY replica, epoch ORDER BY seq) AS BIGINT) AS committed_since, CAST(last_value(CASE WHEN op = 'observe' THEN bytes END IGNORE NULLS) OVER (PARTITION BY replica ORDER BY seq) AS BIGINT) AS free FROM o""")
def t1_running_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return S.running_ledger(portable(spark, folder, _OPS), "replica", "seq").select("seq", "reserved", "committed_since", F.col("free").cast("bigint").alias("free"))


@R.add(f"""WITH RECURSIVE v AS (SELECT replica, seq, op, CAST(bytes AS BIGINT) AS bytes, row_number() OVER (PARTITION BY replica ORDER BY seq) AS n FROM ({plain(_OPS)})),
  s AS (SELECT replica, 0 AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS bytes, true AS ok, CAST(0 AS BIGINT) AS free, CAST(0 AS BIGINT) AS reserved, CAST(0 AS BIGINT) AS committed_since, true AS degraded FROM (SELECT DISTINCT replica FROM v)
    UNION ALL SELECT replica, n, seq, op, bytes, ok, CASE WHEN op = 'observe' THEN bytes ELSE free END, CASE WHEN op = 'reserve' AND ok THEN reserved + bytes WHEN op IN ('release', 'commit') THEN greatest(reserved - bytes, 0) ELSE reserved END,
      CASE op WHEN 'observe' THEN 0 WHEN 'commit' THEN committed_since + bytes ELSE committed_since END, CASE op WHEN 'observe' THEN false WHEN 'fail' THEN true ELSE degraded END
    FROM (SELECT v.replica, v.n, v.seq, v.op, v.bytes, s.free, s.reserved, s.committed_since, s.degraded, NOT (v.op = 'reserve' AND v.bytes > 0 AND (s.degraded OR greatest(s.free - s.reserved - s.committed_since - 50, 0) < v.bytes)) AS ok
      FROM s JOIN v ON v.replica = s.replica AND v.n = s.n + 1))
  SELECT replica, seq, op, bytes, ok, free, reserved, committed_since, degraded FROM s WHERE n > 0""")
def t1_conditional_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a reservation succeeds depends on those before."""
    ops = portable(spark, folder, _OPS).withColumn("bytes", F.col("bytes").cast("bigint"))
    return S.ledger(ops, headroom=50)


_OBSERVED = "SELECT user_id AS replica, event_id AS seq, CASE WHEN event_type <> 'error' THEN CAST(event_id % 500 AS BIGINT) END AS free_bytes FROM {events}"


@R.add(f"SELECT seq, coalesce(last_value(free_bytes IGNORE NULLS) OVER (PARTITION BY replica ORDER BY seq), 0) AS free, free_bytes IS NULL AS degraded FROM ({plain(_OBSERVED)})")
def s20_free_space(spark: SparkSession, folder: str) -> DataFrame:
    """A failed observation keeps the last value and marks the replica degraded; before the first there is none."""
    rows = portable(spark, folder, _OBSERVED).withColumn("degraded", F.col("free_bytes").isNull())
    return running_last(rows, ["replica"], "seq", {"free": F.col("free_bytes")}).select("seq", F.coalesce("free", F.lit(0).cast("bigint")).alias("free"), "degraded")


_LIFETIMES = "SELECT event_id, event_id % 700 AS ttl FROM {events}"


@R.add(f"SELECT event_id, 700 * least(greatest(ttl, 5), 300) AS earliest_ms, 900 * least(greatest(ttl, 5), 300) AS latest_ms, least(ttl * 2, 60) AS backoff FROM ({plain(_LIFETIMES)})")
def f36_refresh_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Between which a refresh is due, in milliseconds, and how long a failed one waits."""
    earliest, latest = refresh_bounds(F.col("ttl"), 5, 300)
    return portable(spark, folder, _LIFETIMES).select("event_id", earliest.alias("earliest_ms"), latest.alias("latest_ms"), next_backoff(F.col("ttl"), 60).alias("backoff"))


_AVAILABLE = "SELECT user_id AS replica, event_id AS seq, CAST(event_id * 7919 % 40 AS BIGINT) AS available FROM {events}"


@R.add(f"SELECT seq, coalesce(last_value(CASE WHEN available < 10 THEN 'reclaiming' WHEN available >= 20 THEN 'normal' END IGNORE NULLS) OVER (PARTITION BY replica ORDER BY seq), 'normal') AS mode FROM ({plain(_AVAILABLE)})")
def o11_hysteresis(spark: SparkSession, folder: str) -> DataFrame:
    return S.hysteresis(portable(spark, folder, _AVAILABLE), "replica", "seq", 10, 20).select("seq", "mode")


_SPACE = "SELECT event_id, CAST(event_id % 1000 AS BIGINT) AS free, CAST(user_id AS BIGINT) AS reserved, CAST(event_id % 77 AS BIGINT) AS committed FROM {events}"


@R.add(f"SELECT event_id, CAST(greatest(free - reserved - committed - 100, 0) AS BIGINT) AS available FROM ({plain(_SPACE)})")
def f35_available_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return portable(spark, folder, _SPACE).select("event_id", S.available(F.col("free"), F.col("reserved"), F.col("committed"), F.lit(100)).alias("available"))


_LIFE = "SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'reserve' WHEN 'click' THEN 'extend' WHEN 'purchase' THEN 'publish' ELSE 'discard' END AS event, event_id % 50 AS bytes, 100 + event_id % 20 AS held, 90 + event_id % 40 AS stored_len FROM {events}"


@R.add(f"SELECT user_id, CAST(sum(CASE WHEN event IN ('reserve', 'extend') THEN bytes ELSE -held END) AS BIGINT) AS reserved_delta, CAST(sum(CASE WHEN event = 'publish' THEN least(stored_len, held) ELSE 0 END) AS BIGINT) AS committed_delta FROM ({plain(_LIFE)}) GROUP BY 1")
def t2_reservation_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return S.reservation_deltas(portable(spark, folder, _LIFE)).groupBy("user_id").agg(F.sum("reserved_delta").alias("reserved_delta"), F.sum("committed_delta").alias("committed_delta"))


_SPANS = "SELECT user_id AS \"group\", event_id AS id, event_id AS start, event_id + 1 + event_id * 31 % 700 AS stop FROM {events}"
_SPANS_SPARK = _SPANS.replace('"group"', "`group`")


@R.add(f"""WITH e AS (SELECT "group", start AS t, 1 AS step FROM ({plain(_SPANS)}) UNION ALL SELECT "group", stop, -1 FROM ({plain(_SPANS)})), s AS (SELECT "group", t, sum(step) AS step, count(*) FILTER (step > 0) AS opened FROM e GROUP BY 1, 2),
  r AS (SELECT *, sum(step) OVER (PARTITION BY "group" ORDER BY t) AS open FROM s) SELECT "group", CAST(max(open) AS BIGINT) AS peak, CAST(sum(opened) AS BIGINT) AS spans FROM r GROUP BY 1""")
def o12_peak_concurrency(spark: SparkSession, folder: str) -> DataFrame:
    return S.concurrency(portable(spark, folder, _SPANS_SPARK), "group", "start", "stop")


@R.add(f"""WITH RECURSIVE v AS (SELECT "group", id, start, stop, row_number() OVER (PARTITION BY "group" ORDER BY start, id) AS n FROM ({plain(_SPANS)})),
  s AS (SELECT "group", 0 AS n, CAST(NULL AS BIGINT) AS id, false AS admitted, CAST([] AS BIGINT[]) AS held FROM (SELECT DISTINCT "group" FROM v)
    UNION ALL SELECT "group", n, id, len(held) < 4, CASE WHEN len(held) < 4 THEN list_append(held, stop) ELSE held END
    FROM (SELECT v."group", v.n, v.id, v.stop, list_filter(s.held, lambda x: x > v.start) AS held FROM s JOIN v ON v."group" = s."group" AND v.n = s.n + 1))
  SELECT "group", id, admitted FROM s WHERE n > 0""")
def t10_admissions(spark: SparkSession, folder: str) -> DataFrame:
    """A rejected request frees a permit for the next one."""
    return S.admissions(portable(spark, folder, _SPANS_SPARK).withColumn("end", F.col("stop")), permits=4)


_TASKS = "SELECT user_id AS \"group\", event_id AS id, 1 + event_id * 31 % 70 AS took FROM {events}"
_PERMITS = 3


@R.add(f"""WITH RECURSIVE v AS (SELECT "group", id, CAST(took AS BIGINT) AS took, row_number() OVER (PARTITION BY "group" ORDER BY id) AS n FROM ({plain(_TASKS)})),
  s AS (SELECT "group", 0 AS n, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, CAST([] AS BIGINT[]) AS ends FROM (SELECT DISTINCT "group" FROM v)
    UNION ALL SELECT "group", n, id, start, start + took, list_sort(list_append(CASE WHEN len(ends) >= {_PERMITS} THEN ends[2:] ELSE ends END, start + took))
    FROM (SELECT v."group", v.n, v.id, v.took, s.ends, CASE WHEN len(s.ends) >= {_PERMITS} THEN s.ends[1] ELSE 0 END AS start FROM s JOIN v ON v."group" = s."group" AND v.n = s.n + 1))
  SELECT "group", id, start, stop FROM s WHERE n > 0""")
def t11_bounded_downloads(spark: SparkSession, folder: str) -> DataFrame:
    """Downloads of each session through a pool of a few permits: when each begins and ends."""
    return S.bounded_schedule(portable(spark, folder, _TASKS.replace('"group"', "`group`")), _PERMITS)
