"""Queries on skewed keys and dangling references (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.spelling import channel_key, channel_sql, digest_bytes, digest_sql
from marlstone.operators.orphans import live_artifacts, orphan_counts, orphan_groups, orphan_rows, reference_rows
from marlstone.operators.weighted import PERCENTILES, key_statistics, keys_above_share, value_histogram
from marlstone.sources.tables import table

#: A channel is dominant from one in so many rows on.
DOMINANT_ONE_IN = 50


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    live = live_artifacts(table(spark, folder, "artifact_metadata"), table(spark, folder, "artifact_removal"), channel_key, digest_bytes)
    refs = reference_rows(table(spark, folder, "reference_record"), "reference_record", "ref_row", "updated_at", channel_key, digest_bytes).unionByName(
        reference_rows(table(spark, folder, "eviction_queue"), "eviction_queue", "queue_row", "eligible_at", channel_key, digest_bytes, eligible="eligible_at")
    )
    return orphan_groups(refs, live)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_rows(_orphans(spark, folder)).select("src", "row_id")


def p4_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_orphans(spark, folder)).select("src", F.col("period").cast("string").alias("period"), "n_orphans")


def p4_channel_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose channel isn't an active one, by table and day: few channels, so nearly all rows refer to heavy keys."""
    whole = lambda _: F.lit("")  # noqa: E731  (a channel is all of the key)
    active = table(spark, folder, "channel_record").filter("state = 'active'").select("channel_id", F.lit("").alias("digest"), F.lit(None).cast("bigint").alias("eligible_at"), "created_at")
    live = live_artifacts(active, active.limit(0).withColumn("removed_at", F.col("created_at")), channel_key, whole)
    refs = reference_rows(table(spark, folder, "reference_record"), "reference_record", "ref_row", "updated_at", channel_key, whole)
    refs = refs.unionByName(reference_rows(table(spark, folder, "eviction_queue"), "eviction_queue", "queue_row", "eligible_at", channel_key, whole))
    return orphan_counts(orphan_groups(refs, live)).select("src", F.col("period").cast("string").alias("period"), "n_orphans")


def _channels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "artifact_metadata")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _channels(spark, folder)
    stats = key_statistics(rows, channel_key(F.col("channel_id")), F.col("content_len"), percentiles={}, wanted=("n_rows",))
    return keys_above_share(stats, rows.count(), DOMINANT_ONE_IN).select(F.col("key").alias("channel_id"))


def p5_channel_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = key_statistics(_channels(spark, folder), channel_key(F.col("channel_id")), F.col("content_len"))
    return stats.withColumnRenamed("key", "channel_id").withColumn("total", F.col("total").cast("bigint"))


def p5_channel_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return value_histogram(_channels(spark, folder), channel_key(F.col("channel_id")), F.col("content_len")).withColumnRenamed("key", "channel_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_orphan_counts, p4_channel_orphans, p5_found, p5_channel_statistics, p5_channel_histogram)}

_CHANNEL, _DIGEST = channel_sql("channel_id"), digest_sql("digest")

_ORPHANS = f"""
WITH live AS (
  SELECT a.c, a.d, a.eligible_at FROM (SELECT {_CHANNEL} AS c, {_DIGEST} AS d, created_at, eligible_at FROM artifact_metadata) a
  WHERE a.d IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM (SELECT {_CHANNEL} AS c, {_DIGEST} AS d, removed_at FROM artifact_removal) r
    WHERE r.c = a.c AND r.d = a.d AND r.removed_at >= a.created_at)
), refs AS (
  SELECT 'reference_record' AS src, ref_row AS row_id, {_CHANNEL} AS c, {_DIGEST} AS d, updated_at AS t FROM reference_record
), queue AS (
  SELECT 'eviction_queue' AS src, queue_row AS row_id, {_CHANNEL} AS c, {_DIGEST} AS d, eligible_at AS t FROM eviction_queue
), orphans AS (
  SELECT DISTINCT src, row_id, t FROM refs WHERE d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live l WHERE l.c = refs.c AND l.d = refs.d)
  UNION ALL
  SELECT DISTINCT src, row_id, t FROM queue WHERE d IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM live l WHERE l.c = queue.c AND l.d = queue.d AND l.eligible_at = queue.t)
)
"""

_RANKED = f"""
WITH rows AS (
  SELECT {_CHANNEL} AS channel_id, CASE WHEN content_len >= 0 THEN content_len END AS v FROM artifact_metadata
), ranked AS (
  SELECT channel_id, v, row_number() OVER (PARTITION BY channel_id ORDER BY v NULLS LAST) AS rk, count(v) OVER (PARTITION BY channel_id) AS n FROM rows
), often AS (
  SELECT channel_id, v, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, v) AS rk FROM rows WHERE v IS NOT NULL GROUP BY channel_id, v
)
"""

SQL = {
    "p4_found": f"{_ORPHANS} SELECT DISTINCT src, row_id FROM orphans",
    "p4_orphan_counts": f"""{_ORPHANS}
        SELECT src, CAST(CAST(DATE '1970-01-01' + CAST(floor(t / 86400.0) AS INTEGER) AS DATE) AS VARCHAR) AS period, CAST(count(DISTINCT row_id) AS BIGINT) AS n_orphans
        FROM orphans GROUP BY 1, 2""",
    "p4_channel_orphans": f"""WITH r AS (SELECT 'reference_record' AS src, ref_row AS row_id, {_CHANNEL} AS c, updated_at AS t FROM reference_record UNION ALL SELECT 'eviction_queue', queue_row, {_CHANNEL}, eligible_at FROM eviction_queue)
        SELECT src, CAST(CAST(DATE '1970-01-01' + CAST(floor(t / 86400.0) AS INTEGER) AS DATE) AS VARCHAR) AS period, CAST(count(DISTINCT row_id) AS BIGINT) AS n_orphans
        FROM r WHERE NOT EXISTS (SELECT 1 FROM channel_record k WHERE k.channel_id = r.c AND k.state = 'active') GROUP BY 1, 2""",
    "p5_found": f"""SELECT {_CHANNEL} AS channel_id FROM artifact_metadata WHERE channel_id IS NOT NULL GROUP BY 1
        HAVING count(*) * {DOMINANT_ONE_IN} >= (SELECT count(*) FROM artifact_metadata)""",
    "p5_channel_statistics": f"""{_RANKED}
        SELECT r.channel_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(v) AS BIGINT) AS n_valued, CAST(count(DISTINCT v) AS BIGINT) AS n_distinct,
          CAST(sum(v) AS BIGINT) AS total, min(v) AS smallest, max(v) AS largest,
          (SELECT max(o.v) FROM often o WHERE o.channel_id IS NOT DISTINCT FROM r.channel_id AND o.rk = 1) AS mode,
          {", ".join(f"min(CASE WHEN rk >= greatest((n * {p} + 999) // 1000, 1) THEN v END) AS {n}" for n, p in PERCENTILES.items())}
        FROM ranked r GROUP BY r.channel_id""",
    "p5_channel_histogram": f"""SELECT {_CHANNEL} AS channel_id,
          CAST(CASE WHEN content_len IS NULL OR content_len < 0 THEN -1 WHEN content_len = 0 THEN 0 ELSE length(bin(content_len)) END AS INTEGER) AS bucket,
          CAST(count(*) AS BIGINT) AS n
        FROM artifact_metadata GROUP BY 1, 2""",
}
