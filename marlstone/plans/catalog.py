"""The catalog's tables: scans, lookups, publication and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.identity import DEFAULT_CHANNEL, body_path
from marlstone.functions.spelling import channel_key, channel_sql, digest_hex, digest_sql
from marlstone.operators import bodies as B
from marlstone.operators import maintenance as M
from marlstone.operators import tables as T
from marlstone.operators.health import readiness
from marlstone.plans.registry import Registry, plain, portable
from marlstone.session import cut_lineage
from marlstone.settings import first_error
from marlstone.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: Seconds after which an artifact of an unregistered channel is due.
DEFAULT_EXPIRY = 7 * 86_400
_C, _D = channel_sql("channel_id"), digest_sql("digest")
_KEY = ["channel_id", "digest"]

#: Canonical artifact rows: the first publication of each channel and digest.
ARTIFACTS = f"""(SELECT channel_id, digest, content_len, content_type, created_at, eligible_at, stored_len, encoding FROM (
  SELECT * REPLACE ({_C} AS channel_id, {_D} AS digest), row_number() OVER (PARTITION BY {_C}, {_D} ORDER BY artifact_row) AS rk FROM artifact_metadata WHERE {_D} IS NOT NULL AND channel_id IS NOT NULL) WHERE rk = 1)"""
#: Canonical references: the last binding of each channel and name.
REFERENCES = f"""(SELECT channel_id, name, digest, updated_at, etag, last_modified FROM (
  SELECT * REPLACE ({_C} AS channel_id, {_D} AS digest), row_number() OVER (PARTITION BY {_C}, name ORDER BY ref_row DESC) AS rk FROM reference_record WHERE channel_id IS NOT NULL AND name IS NOT NULL) WHERE rk = 1)"""
#: Queue rows with canonical keys, each once.
QUEUE = f"(SELECT DISTINCT queue_row, {_C} AS channel_id, eligible_at, {_D} AS digest, stored_len FROM eviction_queue WHERE {_D} IS NOT NULL AND channel_id IS NOT NULL)"
#: Uploads in order of arrival, each once; those without a channel go to the default one.
UPLOADS = f"(SELECT DISTINCT pub_seq, coalesce({_C}, '{DEFAULT_CHANNEL}') AS channel_id, route, {_D} AS digest, content_len, CAST(floor(epoch(arrived_at)) AS BIGINT) AS created_at FROM put_record WHERE {_D} IS NOT NULL)"


def _canonical(df: DataFrame) -> DataFrame:
    return df.withColumns({"channel_id": channel_key(F.col("channel_id")), "digest": digest_hex(F.col("digest"))})


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _canonical(table(spark, folder, "artifact_metadata")).filter("digest is not null and channel_id is not null")
    return T.first_wins(rows, _KEY, "artifact_row").drop("artifact_row")


def references(spark: SparkSession, folder: str) -> DataFrame:
    rows = _canonical(table(spark, folder, "reference_record")).filter("channel_id is not null and name is not null")
    return T.last_wins(rows, ["channel_id", "name"], "ref_row").drop("ref_row")


def queue(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """Queue rows; what groups them by key anyway needn't have each of them only once."""
    rows = _canonical(table(spark, folder, "eviction_queue")).filter("digest is not null and channel_id is not null")
    return rows.distinct() if once else rows


def uploads(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    rows = _canonical(table(spark, folder, "put_record")).filter("digest is not null").withColumn("channel_id", F.coalesce("channel_id", F.lit(DEFAULT_CHANNEL)))
    rows = rows.select("pub_seq", "channel_id", "route", "digest", "content_len", F.unix_timestamp(F.col("arrived_at").cast("timestamp")).alias("created_at"))
    return rows.distinct() if once else rows


def channels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "channel_record")


#: The store's format marker, the only row of the family `meta`.
FORMAT = "1"


@R.add("""SELECT 'channels' AS family, CAST(count(*) AS BIGINT) AS n FROM channel_record UNION ALL SELECT 'artifacts', CAST(count(*) AS BIGINT) FROM artifact_metadata
  UNION ALL SELECT 'references', CAST(count(*) AS BIGINT) FROM reference_record UNION ALL SELECT 'eviction', CAST(count(*) AS BIGINT) FROM eviction_queue UNION ALL SELECT 'meta', 1""")
def s1_store_families(spark: SparkSession, folder: str) -> DataFrame:
    families = {"channels": "channel_record", "artifacts": "artifact_metadata", "references": "reference_record", "eviction": "eviction_queue"}
    marker = T.store_format(spark.createDataFrame([], "value string"), FORMAT)
    out = marker.filter("error is null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("meta").alias("family"), "n")
    for family, name in families.items():
        out = out.unionByName(table(spark, folder, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(family).alias("family"), "n"))
    return out


@R.add("SELECT state AS store, CASE WHEN state = 'active' THEN '1' ELSE 'deleting' END AS value, CASE WHEN state <> 'active' THEN 'incompatible' END AS error FROM channel_record GROUP BY state UNION ALL SELECT 'fresh', '1', NULL")
def s2_store_format(spark: SparkSession, folder: str) -> DataFrame:
    """Stores whose marker is this build's, another's, or missing, which a fresh store writes."""
    out = T.store_format(spark.createDataFrame([], "value string"), FORMAT).select(F.lit("fresh").alias("store"), "value", "error")
    for state in ("active", "deleting"):
        marker = channels(spark, folder).filter(F.col("state") == state).select(F.when(F.col("state") == "active", FORMAT).otherwise(F.col("state")).alias("value")).distinct()
        out = out.unionByName(T.store_format(marker, FORMAT).select(F.lit(state).alias("store"), "value", "error"))
    return out


@R.add(f"SELECT queue_row, a.content_len, a.created_at, a.digest IS NOT NULL AS found FROM {QUEUE} q LEFT JOIN {ARTIFACTS} a USING (channel_id, digest)")
def s3_lookup_artifact(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts(spark, folder).select(*_KEY, "content_len", "created_at", F.lit(True).alias("_found"))
    return queue(spark, folder).join(rows, _KEY, "left").select("queue_row", "content_len", "created_at", F.coalesce("_found", F.lit(False)).alias("found"))


@R.add(f"SELECT ref_row, q.name, r.digest, r.updated_at FROM (SELECT DISTINCT ref_row, {_C} AS channel_id, name FROM reference_record) q LEFT JOIN {REFERENCES} r USING (channel_id, name)")
def s4_s14_resolve_reference(spark: SparkSession, folder: str) -> DataFrame:
    asked = _canonical(table(spark, folder, "reference_record")).select("ref_row", "channel_id", "name").distinct()
    return asked.join(references(spark, folder), ["channel_id", "name"], "left").select("ref_row", "name", "digest", "updated_at")


@R.add(f"SELECT q.channel_id, c.state, c.expiry_seconds, n FROM (SELECT {_C} AS channel_id, CAST(count(*) AS BIGINT) AS n FROM put_record GROUP BY 1) q LEFT JOIN channel_record c USING (channel_id)")
def s5_lookup_channel(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "put_record").groupBy(channel_key(F.col("channel_id")).alias("channel_id")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(channels(spark, folder), "channel_id", "left").select("channel_id", "state", "expiry_seconds", "n")


@R.add("SELECT channel_id, CASE WHEN protected THEN 'token' ELSE 'open' END AS access_control, expiry_seconds, state, created_at FROM channel_record")
def s6_channel_view(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).select("channel_id", F.when(F.col("protected"), "token").otherwise("open").alias("access_control"), "expiry_seconds", "state", "created_at")


@R.add("SELECT channel_id, state = 'active' AS active FROM channel_record WHERE state IN ('active', 'deleting')")
def s7_channel_states(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).filter(F.col("state").isin("active", "deleting")).select("channel_id", (F.col("state") == "active").alias("active"))


@R.add(f"SELECT * FROM (SELECT queue_row, channel_id, eligible_at, digest, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY eligible_at, digest, queue_row) AS INTEGER) AS rank FROM {QUEUE}) WHERE rank <= 256")
def s8_reclaim_candidates(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    ordered = Window.partitionBy("channel_id").orderBy("eligible_at", "digest", "queue_row")
    return queue(spark, folder).withColumn("rank", F.row_number().over(ordered)).filter("rank <= 256").select("queue_row", "channel_id", "eligible_at", "digest", "rank")


_FILES_SQL = f"(SELECT DISTINCT channel_id, digest FROM {UPLOADS})"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies on disk: those of the upload log, by the path that each has."""
    listed = uploads(spark, folder, once=False).select(body_path(F.col("channel_id"), F.col("digest")).alias("path")).distinct()
    return listed.select(*(c.alias(n) for n, c in B.parse_body_path(F.col("path")).items()))


@R.add(f"SELECT channel_id, digest FROM {_FILES_SQL} WHERE (channel_id, digest) NOT IN (SELECT channel_id, digest FROM {ARTIFACTS})")
def j3_orphan_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return B.orphan_bodies(files(spark, folder), artifacts(spark, folder)).select("channel_id", "digest")


@R.add(f"""SELECT channel_id, digest FROM (SELECT * FROM {_FILES_SQL} ORDER BY channel_id, digest LIMIT 4096) WHERE (channel_id, digest) NOT IN (SELECT channel_id, digest FROM {ARTIFACTS})""")
def s11_orphan_scan(spark: SparkSession, folder: str) -> DataFrame:
    return B.orphan_bodies(files(spark, folder), artifacts(spark, folder), limit=4096).select("channel_id", "digest")


@R.add(f"SELECT channel_id, digest, content_len FROM {ARTIFACTS} WHERE (channel_id, digest) NOT IN (SELECT channel_id, digest FROM {_FILES_SQL})")
def j4_dangling_rows(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).join(files(spark, folder), _KEY, "left_anti").select(*_KEY, "content_len")


_LOCATED = f"""SELECT q.queue_row, CASE WHEN a.digest IS NULL THEN 'miss' WHEN f.digest IS NULL THEN 'healed' ELSE 'hit' END AS outcome, CASE WHEN a.digest IS NOT NULL AND f.digest IS NOT NULL THEN a.content_len END AS bytes
  FROM {QUEUE} q LEFT JOIN {ARTIFACTS} a USING (channel_id, digest) LEFT JOIN {_FILES_SQL} f USING (channel_id, digest)"""


@R.add(_LOCATED)
def s12_s13_locate(spark: SparkSession, folder: str) -> DataFrame:
    return B.locate(queue(spark, folder), artifacts(spark, folder), files(spark, folder)).select("queue_row", "outcome", "bytes")


@R.add(f"SELECT CAST(count(*) FILTER (outcome = 'hit') AS BIGINT) AS hits, CAST(count(*) FILTER (outcome <> 'hit') AS BIGINT) AS misses, CAST(coalesce(sum(CASE WHEN bytes >= 0 THEN bytes END), 0) AS BIGINT) AS bytes_read, CAST(round(1000000.0 * count(*) FILTER (outcome = 'hit') / count(*)) AS BIGINT) AS hit_ppm FROM ({_LOCATED})")
def a2_hit_ratio(spark: SparkSession, folder: str) -> DataFrame:
    found = s12_s13_locate(spark, folder)
    hits = F.count_if(F.col("outcome") == "hit")
    return found.agg(
        hits.alias("hits"), F.count_if(F.col("outcome") != "hit").alias("misses"), F.coalesce(F.sum(F.when(F.col("bytes") >= 0, F.col("bytes"))), F.lit(0)).alias("bytes_read"),
        F.round(1000000.0 * hits / F.count(F.lit(1))).cast("bigint").alias("hit_ppm"),
    )


#: Health of replicas as the events imply it: the store answers unless the last look failed, the files and the sensor likewise.
_CHECKS = "SELECT user_id AS replica, event_id AS seq, CASE event_type WHEN 'view' THEN 'metadata' WHEN 'click' THEN 'files' ELSE 'space' END AS part, event_type <> 'error' AND value < 60 AS good FROM {events}"


@R.add(f"""WITH l AS (SELECT replica, part, max_by(good, seq) AS good FROM ({plain(_CHECKS)}) GROUP BY 1, 2), p AS (SELECT replica, coalesce(bool_and(good) FILTER (part = 'metadata'), false) AS m, coalesce(bool_and(good) FILTER (part = 'files'), false) AS f,
    coalesce(bool_and(good) FILTER (part = 'space'), false) AS s FROM l GROUP BY 1)
  SELECT replica, m AND f AND s AS ready, CASE WHEN NOT m THEN 'metadata' WHEN NOT f THEN 'files' WHEN NOT s THEN 'space' END AS failing FROM p""")
def s21_health(spark: SparkSession, folder: str) -> DataFrame:
    return readiness(portable(spark, folder, _CHECKS))


_CONFIGS = """SELECT event_id, CAST(value AS BIGINT) AS max_upload_bytes, 7 AS default_expiry_seconds, 64 AS proxy_concurrency, user_id - 3 AS upstream_timeout_seconds, 256 AS foreground_concurrency, 1 AS reservation_extent_bytes, CAST(value * 2 AS BIGINT) - 5 AS bloom_bits,
  256 AS reclaim_candidate_limit, 10 AS low_watermark_bytes, user_id AS high_watermark_bytes, CASE event_type WHEN 'error' THEN 'no url' ELSE 'https://proxy.example/' || event_type END AS upstream,
  CASE event_type WHEN 'view' THEN 'ftp://files.example' WHEN 'click' THEN 'https://files.example:8443' WHEN 'signup' THEN 'https:///path' END AS origin FROM {events}"""


@R.add(f"""SELECT event_id, CASE WHEN max_upload_bytes <= 0 THEN 'max_upload_bytes' WHEN upstream_timeout_seconds <= 0 THEN 'upstream_timeout_seconds' WHEN high_watermark_bytes < low_watermark_bytes THEN 'high_watermark_bytes' WHEN bloom_bits <= 0 THEN 'bloom_bits'
  WHEN upstream = 'no url' THEN 'upstream' WHEN origin IN ('ftp://files.example', 'https:///path') THEN 'allowed_origin' END AS error FROM (SELECT event_id, CAST(trunc(value) AS BIGINT) AS max_upload_bytes, user_id - 3 AS upstream_timeout_seconds, CAST(trunc(value * 2) AS BIGINT) - 5 AS bloom_bits,
  10 AS low_watermark_bytes, user_id AS high_watermark_bytes, CASE event_type WHEN 'error' THEN 'no url' END AS upstream, CASE event_type WHEN 'view' THEN 'ftp://files.example' WHEN 'signup' THEN 'https:///path' END AS origin FROM events)""")
def proj_p18_config_rules(spark: SparkSession, folder: str) -> DataFrame:
    return portable(spark, folder, _CONFIGS).select("event_id", first_error(F.col("upstream"), F.col("origin")).alias("error"))


@R.add(f"SELECT channel_id, digest, content_len FROM {ARTIFACTS} WHERE content_len IS NULL OR content_len < 0")
def s21_damaged_records(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts(spark, folder).filter(~F.coalesce(F.col("content_len") >= 0, F.lit(False))).select(*_KEY, "content_len")


@R.add(f"""SELECT r.channel_id, r.name, r.digest, CASE WHEN r.digest IS NULL THEN 'unusable' WHEN a.digest IS NULL THEN 'miss' ELSE 'hit' END AS outcome, a.content_len FROM {REFERENCES} r LEFT JOIN {ARTIFACTS} a USING (channel_id, digest)""")
def j1_reference_artifact(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts(spark, folder).select(*_KEY, "content_len", F.lit(True).alias("_there"))
    joined = references(spark, folder).join(rows, _KEY, "left")
    outcome = F.when(F.col("digest").isNull(), "unusable").when(F.col("_there").isNull(), "miss").otherwise("hit")
    return joined.select("channel_id", "name", "digest", outcome.alias("outcome"), "content_len")


# --- writes ------------------------------------------------------------------------------------------------------------


@R.add("""WITH w AS (SELECT doc_id, source, sha256(text) AS digest, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL), d AS (SELECT source, digest, count(*) AS c, sum(n) AS b, max(n) AS one FROM w GROUP BY 1, 2)
  SELECT source, CAST(sum(c) AS BIGINT) AS bodies, CAST(sum(b) AS BIGINT) AS logical_bytes, CAST(count(*) AS BIGINT) AS distinct_bodies, CAST(sum(one) AS BIGINT) AS stored_bytes FROM d GROUP BY 1""")
def w2_content_address(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").filter("text is not null")
    bodies = texts.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("bigint").alias("size"))
    return B.content_addressed(bodies, "source", "digest", "size")


@R.add("SELECT doc_id AS upload_id, CAST(octet_length(encode(text)) AS BIGINT) AS content_len, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def w1_assemble_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut into chunks of 4 KiB, the empty one into a single empty chunk, and put together again."""
    texts = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("body"))
    cut = F.transform(F.sequence(F.lit(0), F.expr("greatest(octet_length(body) - 1, 0) div 4096")), lambda i: F.struct(i.alias("seq"), F.substring(F.col("body"), i * 4096 + 1, F.lit(4096)).alias("chunk")))
    chunks = texts.select(F.col("doc_id").alias("upload_id"), F.explode(cut).alias("_c")).select("upload_id", "_c.*")
    return B.assemble(chunks)


@R.add("SELECT doc_id, CASE WHEN lang = 'en' THEN 'zstd' WHEN lang IS NULL THEN NULL ELSE 'identity' END AS encoding, CASE WHEN lang IS NOT NULL THEN CAST(octet_length(encode(text)) AS BIGINT) END AS content_len, CASE WHEN lang IS NOT NULL THEN sha256(text) END AS digest, CASE WHEN lang IS NOT NULL AND lang <> 'en' THEN CAST(octet_length(encode(text)) AS BIGINT) END AS identity_len FROM documents WHERE text IS NOT NULL")
def w20_encoded_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies stored in either encoding and read back; identity is over the logical bytes, whatever is stored."""
    encoding = F.when(F.col("lang") == "en", "zstd").when(F.col("lang").isNotNull(), "identity")
    bodies = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("body"), encoding.alias("encoding"))
    stored = B.encoded(bodies).select("doc_id", "encoding", "stored", "stored_len")
    content = B.decoded(stored)
    return content.select("doc_id", "encoding", F.octet_length("content").cast("bigint").alias("content_len"), F.sha2("content", 256).alias("digest"), F.when(F.col("encoding") == "identity", F.col("stored_len")).alias("identity_len"))


_STAGED = "SELECT doc_id AS upload_id, CASE WHEN n_chars >= 0 AND doc_id % 2 = 0 THEN n_chars END AS declared, coalesce(length(text), 0) AS size FROM {documents}"


@R.add(f"""SELECT upload_id, CAST(size AS BIGINT) AS content_len, CASE WHEN size <= 20000 THEN CAST(f + (greatest(size - f, 0) + 1023) // 1024 * 1024 AS BIGINT) END AS reserved, CASE WHEN size > 20000 THEN 'too_large' ELSE 'staged' END AS outcome
  FROM (SELECT *, coalesce(CASE WHEN declared IS NOT NULL THEN least(declared, 20000) END, 1024) AS f FROM ({plain(_STAGED)}))""")
def w1_staging_reservations(spark: SparkSession, folder: str) -> DataFrame:
    whole = portable(spark, folder, _STAGED)
    cut = F.transform(F.sequence(F.lit(0), F.expr("size div 500")), lambda i: F.struct(i.alias("seq"), F.least(F.lit(500), F.col("size") - i * 500).cast("bigint").alias("size")))
    chunks = whole.select("upload_id", "declared", F.explode(cut).alias("_c")).select("upload_id", "declared", "_c.*")
    return B.staging(chunks, limit=20_000, extent=1_024)


@R.add(f"""WITH u AS (SELECT *, CASE WHEN pub_seq % 10 = 0 THEN sha256(digest) ELSE digest END AS declared FROM {UPLOADS}), e AS (SELECT DISTINCT channel_id, digest FROM {ARTIFACTS}),
  f AS (SELECT channel_id, digest, min(pub_seq) AS first FROM u WHERE declared = digest GROUP BY 1, 2)
  SELECT pub_seq, CASE WHEN declared <> u.digest THEN 'mismatch' WHEN e.digest IS NOT NULL OR pub_seq > first THEN 'existing' ELSE 'created' END AS outcome FROM u LEFT JOIN e USING (channel_id, digest) LEFT JOIN f USING (channel_id, digest)""")
def w2_publish_bodies(spark: SparkSession, folder: str) -> DataFrame:
    sent = uploads(spark, folder).withColumn("order", F.col("pub_seq"))
    declared = F.when(F.col("pub_seq") % 10 == 0, F.sha2("digest", 256)).otherwise(F.col("digest"))
    return B.publish_bodies(sent.withColumn("declared", declared), artifacts(spark, folder)).select("pub_seq", "outcome")


_COMMITTED = f"""SELECT u.channel_id, u.digest, u.content_len, u.created_at, u.created_at + coalesce(c.expiry_seconds, {DEFAULT_EXPIRY}) AS eligible_at
  FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, digest ORDER BY pub_seq) AS rk FROM {UPLOADS}) u LEFT JOIN channel_record c USING (channel_id)
  WHERE rk = 1 AND (u.channel_id, u.digest) NOT IN (SELECT channel_id, digest FROM {ARTIFACTS})"""


def committed(spark: SparkSession, folder: str) -> DataFrame:
    return B.commit_artifacts(artifacts(spark, folder), uploads(spark, folder, once=False).withColumn("order", F.col("pub_seq")), channels(spark, folder), DEFAULT_EXPIRY)


@R.add(_COMMITTED)
def w3_commit_publication(spark: SparkSession, folder: str) -> DataFrame:
    return committed(spark, folder)


@R.add(f"SELECT channel_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN eligible_at < 0 THEN 1 ELSE 0 END) AS BIGINT) AS overdue, min(created_at) AS first_at FROM (SELECT channel_id, digest, created_at, eligible_at FROM {ARTIFACTS} UNION ALL SELECT channel_id, digest, created_at, eligible_at FROM ({_COMMITTED})) GROUP BY 1")
def w4_catalog_after_publication(spark: SparkSession, folder: str) -> DataFrame:
    kept = ["channel_id", "digest", "created_at", "eligible_at"]
    after = T.insert_absent(artifacts(spark, folder).select(*kept), committed(spark, folder).select(*kept), _KEY)
    return after.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("eligible_at") < 0).cast("bigint")).alias("overdue"), F.min("created_at").alias("first_at"))


_BOUND = "SELECT DISTINCT pub_seq, coalesce(channel_id, '00000000000000000000000000') AS channel_id, 'build-' || route || '-' || substr(digest, 1, 1) AS name, digest, pub_seq + 1750000000 AS updated_at FROM {put_record} WHERE digest IS NOT NULL"


@R.add(f"""WITH n AS (SELECT channel_id, name, digest, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, name ORDER BY pub_seq DESC) AS rk FROM ({plain(_BOUND)})) WHERE rk = 1)
  SELECT channel_id, name, digest, updated_at FROM {REFERENCES} WHERE (channel_id, name) NOT IN (SELECT channel_id, name FROM n) UNION ALL SELECT * FROM n""")
def w6_bind_references(spark: SparkSession, folder: str) -> DataFrame:
    new = T.last_wins(portable(spark, folder, _BOUND), ["channel_id", "name"], "pub_seq").drop("pub_seq")
    return T.upsert(references(spark, folder).select("channel_id", "name", "digest", "updated_at"), new, ["channel_id", "name"])


_REMOVED = f"(SELECT DISTINCT {_C} AS channel_id, {_D} AS digest FROM artifact_removal WHERE {_D} IS NOT NULL)"


def removed(spark: SparkSession, folder: str) -> DataFrame:
    return _canonical(table(spark, folder, "artifact_removal")).filter("digest is not null").select(*_KEY).distinct()


@R.add(f"SELECT channel_id, name, digest FROM {REFERENCES} r WHERE NOT EXISTS (SELECT 1 FROM {_REMOVED} g WHERE g.channel_id = r.channel_id AND g.digest = r.digest)")
def w7_delete_references(spark: SparkSession, folder: str) -> DataFrame:
    return T.without(references(spark, folder), removed(spark, folder), _KEY).select("channel_id", "name", "digest")


@R.add(f"""SELECT 'artifacts' AS family, channel_id, digest FROM {ARTIFACTS} WHERE (channel_id, digest) NOT IN (SELECT channel_id, digest FROM {_REMOVED} WHERE channel_id IS NOT NULL)
  UNION ALL SELECT 'eviction', channel_id, digest FROM {QUEUE} WHERE (channel_id, digest) NOT IN (SELECT channel_id, digest FROM {_REMOVED} WHERE channel_id IS NOT NULL)""")
def w8_remove_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    gone = removed(spark, folder)
    left = T.without(artifacts(spark, folder), gone, _KEY).select(F.lit("artifacts").alias("family"), *_KEY)
    return left.unionByName(T.without(queue(spark, folder), gone, _KEY).select(F.lit("eviction").alias("family"), *_KEY))


@R.add(f"""WITH q AS (SELECT channel_id, digest, eligible_at, max(stored_len) AS stored_len FROM {QUEUE} WHERE eligible_at IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT channel_id, digest, eligible_at, stored_len FROM {ARTIFACTS}),
  m AS (SELECT a.channel_id, a.digest, a.eligible_at, a.stored_len FROM a JOIN (SELECT channel_id, digest, min(eligible_at) AS eligible_at FROM q GROUP BY 1, 2) o USING (channel_id, digest, eligible_at))
  SELECT 'artifacts' AS family, a.channel_id, a.digest, a.eligible_at + CASE WHEN m.digest IS NOT NULL THEN 3600 ELSE 0 END AS eligible_at, a.stored_len FROM a LEFT JOIN m USING (channel_id, digest)
  UNION ALL SELECT 'eviction', channel_id, digest, eligible_at, stored_len FROM q WHERE (channel_id, digest, eligible_at) NOT IN (SELECT channel_id, digest, eligible_at FROM m UNION ALL SELECT channel_id, digest, eligible_at + 3600 FROM m)
  UNION ALL SELECT 'eviction', channel_id, digest, eligible_at + 3600, stored_len FROM m""")
def w9_requeue(spark: SparkSession, folder: str) -> DataFrame:
    """Each artifact's first queue row is moved by an hour, in both families, where the artifact has its deadline."""
    rows = queue(spark, folder, once=False).filter("eligible_at is not null").groupBy(*_KEY, "eligible_at").agg(F.max("stored_len").alias("stored_len"))
    moves = rows.groupBy(*_KEY).agg(F.min("eligible_at").alias("eligible_at")).withColumn("new_eligible_at", F.col("eligible_at") + 3600)
    queue_after, artifacts_after = M.requeue(rows, artifacts(spark, folder).select(*_KEY, "eligible_at", "stored_len"), moves)
    kept = [*_KEY, "eligible_at", "stored_len"]
    return artifacts_after.select(F.lit("artifacts").alias("family"), *kept).unionByName(queue_after.select(F.lit("eviction").alias("family"), *kept))


@R.add(f"SELECT q.queue_row, CASE WHEN a.eligible_at = q.eligible_at THEN 'removed' ELSE 'stale' END AS outcome FROM {QUEUE} q LEFT JOIN {ARTIFACTS} a USING (channel_id, digest)")
def w10_evict_outcome(spark: SparkSession, folder: str) -> DataFrame:
    rows = artifacts(spark, folder).select(*_KEY, F.col("eligible_at").alias("_due"))
    same = F.coalesce(F.col("_due") == F.col("eligible_at"), F.lit(False))
    return queue(spark, folder).join(rows, _KEY, "left").select("queue_row", F.when(same, "removed").otherwise("stale").alias("outcome"))


_REGISTERED = "SELECT DISTINCT channel_id FROM {put_record} WHERE channel_id IS NOT NULL UNION SELECT source AS channel_id FROM {documents} WHERE source IS NOT NULL"


@R.add(f"SELECT n.channel_id, c.channel_id IS NOT NULL AS exists_already FROM ({plain(_REGISTERED)}) n LEFT JOIN channel_record c USING (channel_id)")
def w11_create_channels(spark: SparkSession, folder: str) -> DataFrame:
    there = channels(spark, folder).select("channel_id", F.lit(True).alias("_there"))
    return portable(spark, folder, _REGISTERED).join(there, "channel_id", "left").select("channel_id", F.coalesce("_there", F.lit(False)).alias("exists_already"))


@R.add("SELECT c.channel_id, coalesce(p.e, c.expiry_seconds) AS expiry_seconds FROM channel_record c LEFT JOIN (SELECT channel_id, CAST(1000 + count(*) AS BIGINT) AS e FROM put_record GROUP BY 1) p USING (channel_id)")
def w12_update_expiry(spark: SparkSession, folder: str) -> DataFrame:
    change = table(spark, folder, "put_record").groupBy("channel_id").agg((F.count(F.lit(1)) + 1000).alias("expiry_seconds"))
    return T.patch(channels(spark, folder).select("channel_id", "expiry_seconds"), change, ["channel_id"], "expiry_seconds")


_GONE = "SELECT channel_id FROM channel_record WHERE state = 'deleting'"


@R.add(f"""SELECT 'artifacts' AS family, channel_id, digest AS key FROM {ARTIFACTS} WHERE channel_id NOT IN ({_GONE}) UNION ALL SELECT 'references', channel_id, name FROM {REFERENCES} WHERE channel_id NOT IN ({_GONE})
  UNION ALL SELECT 'eviction', channel_id, CAST(queue_row AS VARCHAR) FROM {QUEUE} WHERE channel_id NOT IN ({_GONE}) UNION ALL SELECT 'channels', channel_id, state FROM channel_record WHERE channel_id NOT IN ({_GONE})
  UNION ALL SELECT 'bodies', channel_id, digest FROM {_FILES_SQL} WHERE channel_id NOT IN ({_GONE})""")
def w13_w15_finish_deletions(spark: SparkSession, folder: str) -> DataFrame:
    """What each family holds once the deletions that were under way are finished."""
    gone = channels(spark, folder).filter("state = 'deleting'").select("channel_id")
    families = {"artifacts": (artifacts, "digest"), "references": (references, "name"), "eviction": (queue, "queue_row"), "channels": (channels, "state"), "bodies": (files, "digest")}
    out = None
    for family, (rows, key) in families.items():
        left = T.without(rows(spark, folder), gone, ["channel_id"]).select(F.lit(family).alias("family"), "channel_id", F.col(key).cast("string").alias("key"))
        out = left if out is None else out.unionByName(left)
    return out


@R.add(f"""SELECT channel_id, expiry_seconds, state FROM channel_record UNION ALL SELECT '{DEFAULT_CHANNEL}', CAST({DEFAULT_EXPIRY} AS BIGINT), 'active' WHERE '{DEFAULT_CHANNEL}' NOT IN (SELECT channel_id FROM channel_record)""")
def w15_ensure_default(spark: SparkSession, folder: str) -> DataFrame:
    seed = spark.createDataFrame([(DEFAULT_CHANNEL, DEFAULT_EXPIRY, "active")], "channel_id string, expiry_seconds bigint, state string")
    return T.insert_absent(channels(spark, folder).select("channel_id", "expiry_seconds", "state"), seed, ["channel_id"])


_LOCAL = "SELECT DISTINCT entry_row, CASE WHEN entry_row % 7 = 0 THEN '.' || action || '.tmp' ELSE action END AS name, 1750000000 - last_seen AS age_seconds, size FROM {manifest_entry}"


@R.add(f"SELECT entry_row, coalesce(CASE WHEN name LIKE '.%.tmp' THEN age_seconds > 3600 ELSE age_seconds > 1209600 END, false) AS pruned FROM ({plain(_LOCAL)})")
def w16_w17_prune_files(spark: SparkSession, folder: str) -> DataFrame:
    return B.pruned_files(portable(spark, folder, _LOCAL), max_age=14 * 86_400).select("entry_row", F.coalesce("pruned", F.lit(False)).alias("pruned"))


@R.add("""SELECT DISTINCT m.output, m.size FROM manifest_entry m WHERE m.output IS NOT NULL AND m.size IS NOT NULL AND NOT EXISTS (SELECT 1 FROM put_record p WHERE p.digest = m.output AND p.content_len = m.size)""")
def w18_files_to_write(spark: SparkSession, folder: str) -> DataFrame:
    there = table(spark, folder, "put_record").select(F.col("digest").alias("output"), F.col("content_len").alias("size"))
    wanted = table(spark, folder, "manifest_entry").select("output", "size").filter("output is not null and size is not null").distinct()
    return T.without(wanted, there, ["output", "size"])


@R.add("SELECT CASE WHEN v IS NULL THEN 'empty' WHEN v <> 1 THEN 'version' END AS record_error, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN expiry_seconds = 3600 THEN NULL WHEN expiry_seconds = 86400 THEN 2 ELSE 1 END AS v FROM channel_record) GROUP BY 1")
def s10_record_versions(spark: SparkSession, folder: str) -> DataFrame:
    version = F.when(F.col("expiry_seconds") == 3600, None).when(F.col("expiry_seconds") == 86400, 2).otherwise(1)
    return T.decode_records(channels(spark, folder).withColumn("schema_version", version), 1).groupBy("record_error").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT channel_id, protected, token_digest, expiry_seconds, state, created_at, 1 AS schema_version, CAST(NULL AS VARCHAR) AS record_error FROM channel_record")
def w19_encode_records(spark: SparkSession, folder: str) -> DataFrame:
    """Channel records encoded, written, and read again."""
    return T.decode_records(cut_lineage(T.encode_records(channels(spark, folder), 1)), 1)


# --- access ------------------------------------------------------------------------------------------------------------

_CALLS = "SELECT DISTINCT p.pub_seq, p.channel_id, CASE WHEN p.pub_seq % 3 = 0 THEN p.channel_id ELSE 'wrong' END AS token FROM {put_record} p"


@R.add(f"""SELECT pub_seq, CASE WHEN c.channel_id IS NULL THEN 'not_found' WHEN protected AND coalesce(sha256(token) <> token_digest, true) THEN 'unauthorized' WHEN state <> 'active' THEN 'deleting' ELSE 'allowed' END AS outcome
  FROM ({plain(_CALLS)}) LEFT JOIN channel_record c USING (channel_id)""")
def proj_p5_authorize(spark: SparkSession, folder: str) -> DataFrame:
    from marlstone.functions.identity import token_matches

    rows = channels(spark, folder).withColumn("_there", F.lit(True))
    joined = portable(spark, folder, _CALLS).join(rows, "channel_id", "left")
    outcome = (
        F.when(F.col("_there").isNull(), "not_found")
        .when(F.col("protected") & ~token_matches(F.col("token"), F.col("token_digest")), "unauthorized")
        .when(F.col("state") != "active", "deleting")
        .otherwise("allowed")
    )
    return joined.select("pub_seq", outcome.alias("outcome"))


@R.add(f"""SELECT CASE WHEN c.channel_id IS NULL THEN 'missing' WHEN state = 'deleting' THEN 'deleting' ELSE 'active' END AS fence, CAST(count(*) AS BIGINT) AS n FROM {UPLOADS} u LEFT JOIN channel_record c USING (channel_id) GROUP BY 1""")
def proj_p19_channel_fence(spark: SparkSession, folder: str) -> DataFrame:
    joined = uploads(spark, folder).join(channels(spark, folder).select("channel_id", "state"), "channel_id", "left")
    fence = F.when(F.col("state").isNull(), "missing").when(F.col("state") == "deleting", "deleting").otherwise("active")
    return joined.groupBy(fence.alias("fence")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"SELECT channel_id FROM channel_record WHERE state = 'active'")
def proj_p1_active_channels(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder).filter("state = 'active'").select("channel_id")


@R.add(f"""SELECT a.channel_id, a.digest, coalesce(c.expiry_seconds, {DEFAULT_EXPIRY}) AS expiry_seconds, a.eligible_at - a.created_at = coalesce(c.expiry_seconds, {DEFAULT_EXPIRY}) AS as_configured FROM {ARTIFACTS} a LEFT JOIN channel_record c USING (channel_id)""")
def j10_channel_expiry(spark: SparkSession, folder: str) -> DataFrame:
    joined = artifacts(spark, folder).join(channels(spark, folder).select("channel_id", "expiry_seconds"), "channel_id", "left")
    expiry = F.coalesce("expiry_seconds", F.lit(DEFAULT_EXPIRY).cast("bigint"))
    return joined.select(*_KEY, expiry.alias("expiry_seconds"), ((F.col("eligible_at") - F.col("created_at")) == expiry).alias("as_configured"))


@R.add(f"""SELECT CAST(count(*) FILTER (n = 2) AS BIGINT) AS common, CAST(count(*) FILTER (n = 1 AND s = 1) AS BIGINT) AS only_catalog, CAST(count(*) FILTER (n = 1 AND s = 2) AS BIGINT) AS only_bodies FROM (
  SELECT channel_id, digest, count(*) AS n, min(s) AS s FROM (SELECT channel_id, digest, 1 AS s FROM {ARTIFACTS} UNION ALL SELECT channel_id, digest, 2 FROM {_FILES_SQL}) GROUP BY 1, 2)""")
def u3_catalog_difference(spark: SparkSession, folder: str) -> DataFrame:
    both = artifacts(spark, folder).select(*_KEY, F.lit(1).alias("s")).unionByName(files(spark, folder).select(*_KEY, F.lit(2).alias("s")))
    each = both.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    alone = F.col("n") == 1
    return each.agg(F.count_if(F.col("n") == 2).alias("common"), F.count_if(alone & (F.col("s") == 1)).alias("only_catalog"), F.count_if(alone & (F.col("s") == 2)).alias("only_bodies"))


@R.add(f"""SELECT CASE WHEN content_len IS NULL OR content_len < 0 THEN 'bad_size' WHEN digest IS NULL THEN 'bad_digest' ELSE 'ok' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT content_len, {_D} AS digest FROM put_record) GROUP BY 1""")
def proj_p16_put_validation(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("content_len")
    verdict = F.when(size.isNull() | (size < 0), "bad_size").when(digest_hex(F.col("digest")).isNull(), "bad_digest").otherwise("ok")
    return table(spark, folder, "put_record").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""SELECT pub_seq, outcome FROM (SELECT u.pub_seq, CASE WHEN u.pub_seq % 9 = 0 THEN CASE WHEN route IN ('raw', 'bazel-cas') THEN 'insufficient_storage' WHEN route = 'http-cache' THEN 'bypassed' ELSE 'streamed' END ELSE 'stored' END AS outcome FROM {UPLOADS} u)""")
def w5_publish_or_reject(spark: SparkSession, folder: str) -> DataFrame:
    """What an upload that finds no space comes to, by the contract of its route."""
    rows = uploads(spark, folder).withColumn("admitted", F.col("pub_seq") % 9 != 0)
    return rows.select("pub_seq", B.pressure_outcome(F.col("route"), F.col("admitted")).alias("outcome"))


@R.add(f"""WITH n AS (SELECT channel_id, CASE WHEN state = 'active' AND channel_id IN (SELECT channel_id FROM {_REMOVED}) AND channel_id <> '{DEFAULT_CHANNEL}' THEN 'deleting' WHEN state = 'active' THEN 'active' END AS state FROM channel_record)
  SELECT coalesce(state, 'absent') AS state, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY 1""")
def t8_channel_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """One step: asked deletions begin, those under way end; the default channel can't be deleted."""
    asked = removed(spark, folder).select("channel_id").distinct().withColumn("_asked", F.lit(True))
    joined = channels(spark, folder).join(asked, "channel_id", "left")
    begins = F.coalesce("_asked", F.lit(False)) & (F.col("channel_id") != DEFAULT_CHANNEL)
    state = F.when(F.col("state") == "deleting", "absent").when(begins, "deleting").otherwise("active")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
