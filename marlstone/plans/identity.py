"""Identities, keys and references over the test tables (functions F1-F15, F21-F22, F33-F34, F42; scans S9-S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import identity as I
from marlstone.functions.spelling import channel_key, channel_sql, digest_hex, digest_sql
from marlstone.plans.registry import Registry, plain, portable
from marlstone.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

_IDS = "(SELECT pub_seq, coalesce(channel_id, '00000000000000000000000000') AS channel, route, digest, content_len FROM {put_record})"


@R.add("SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS content_len FROM documents")
def f1_body_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", I.body_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("content_len"))


_DIGEST_RE, _ULID_RE, _NAME_RE = "'^[0-9a-f]{64}$'", "'^[0-7][0-9A-HJKMNP-TV-Z]{25}$'", "'^[A-Za-z0-9._~-]{1,512}$'"


@R.add(f"""SELECT entry_row, coalesce(regexp_full_match(output, {_DIGEST_RE}), false) AS valid,
  CASE WHEN regexp_full_match(output, {_DIGEST_RE}) THEN 'sha256:' || output END AS artifact_id FROM (SELECT DISTINCT entry_row, output FROM manifest_entry)""")
def f2_digest_check(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "manifest_entry").select("entry_row", "output").distinct()
    return entries.select("entry_row", I.is_digest(F.col("output")).alias("valid"), I.artifact_id(I.artifact_digest(F.lit("sha256"), F.col("output"))).alias("artifact_id"))


_SPLIT = "SELECT entry_row, output, CASE WHEN output LIKE '%:%' THEN split_part(output, ':', 1) ELSE 'sha256' END AS algorithm, CASE WHEN output LIKE '%:%' THEN split_part(output, ':', 2) ELSE output END AS hex FROM {manifest_entry}"


@R.add(f"SELECT DISTINCT entry_row, CASE WHEN algorithm = 'sha256' AND regexp_full_match(hex, {_DIGEST_RE}) THEN hex END AS digest FROM ({plain(_SPLIT)})")
def f3_artifact_id_parse(spark: SparkSession, folder: str) -> DataFrame:
    ids = portable(spark, folder, _SPLIT)
    return ids.select("entry_row", I.artifact_digest(F.col("algorithm"), F.col("hex")).alias("digest")).distinct()


@R.add(f"SELECT channel_id, coalesce(regexp_full_match(channel_id, {_ULID_RE}), false) AS valid, channel_id = '00000000000000000000000000' AS is_default, CAST(count(*) AS BIGINT) AS n FROM artifact_metadata GROUP BY ALL")
def f4_channel_id_check(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("channel_id")
    rows = table(spark, folder, "artifact_metadata").groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(c, I.is_channel_id(c).alias("valid"), (c == I.DEFAULT_CHANNEL).alias("is_default"), "n")


@R.add(f"SELECT name, coalesce(regexp_full_match(name, {_NAME_RE}), false) AS valid, coalesce(regexp_full_match(name || '/' || digest, {_NAME_RE}), false) AS path_valid, CAST(count(*) AS BIGINT) AS n FROM reference_record GROUP BY ALL")
def f6_reference_name_check(spark: SparkSession, folder: str) -> DataFrame:
    name, path = F.col("name"), F.concat_ws("/", F.col("name"), F.col("digest"))
    rows = table(spark, folder, "reference_record").select(name, I.is_reference_name(name).alias("valid"), F.when(F.col("digest").isNull(), False).otherwise(I.is_reference_name(path)).alias("path_valid"))
    return rows.groupBy("name", "valid", "path_valid").agg(F.count(F.lit(1)).alias("n"))


def sized_sql(part: str, digits: int = 4) -> str:
    return f"unhex(printf('%0{digits}x', octet_length(encode({part})))) || encode({part})"


def position_sql(kind: str, key: str) -> str:
    return f"substr(sha256({sized_sql(chr(39) + I.ROUTING_VERSION + chr(39))} || {sized_sql(kind)} || {sized_sql(key)}), 1, 16)"


@R.add(f"SELECT pub_seq, {position_sql('route', 'digest')} AS position FROM (SELECT DISTINCT pub_seq, route, digest FROM put_record WHERE digest IS NOT NULL)")
def f7_routing_position(spark: SparkSession, folder: str) -> DataFrame:
    puts = table(spark, folder, "put_record").filter("digest is not null").select("pub_seq", "route", "digest").distinct()
    return puts.select("pub_seq", I.ring_position(I.routing_key(F.col("route"), F.col("digest"))).alias("position"))


@R.add(f"SELECT lower(regexp_replace(s_name || '.Shards.Cache..', '[.]+$', '')) AS member, n AS node, substr(sha256(encode(lower(regexp_replace(s_name || '.Shards.Cache..', '[.]+$', ''))) || unhex(printf('%04x', n))), 1, 16) AS point FROM supplier, (SELECT CAST(range AS BIGINT) AS n FROM range({I.VIRTUAL_NODES}))")
def f9_ring_points(spark: SparkSession, folder: str) -> DataFrame:
    from marlstone.operators.ring import ring_points

    members = table(spark, folder, "supplier").select(I.member_key(F.concat(F.col("s_name"), F.lit(".Shards.Cache.."))).alias("member"))
    return ring_points(members).select("member", F.col("node").cast("bigint").alias("node"), "point")


@R.add("SELECT label, 'go-manifest-' || sha256(label) AS manifest_key, CAST(count(*) AS BIGINT) AS n FROM manifest_entry WHERE label IS NOT NULL GROUP BY label")
def f11_manifest_key(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "manifest_entry").filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.select("label", I.manifest_key(F.col("label")).alias("manifest_key"), "n")


_URLS = "SELECT DISTINCT pub_seq, route, 'https://files.example/' || route || '/' || coalesce(digest, 'né') AS url, CASE WHEN pub_seq % 2 = 0 THEN 'json' ELSE '' END AS variant FROM {put_record}"


@R.add(f"SELECT pub_seq, 'proxy:' || route || ':' || sha256({sized_sql('url', 16)} || encode(variant)) AS reference FROM ({plain(_URLS)})")
def f12_proxy_reference(spark: SparkSession, folder: str) -> DataFrame:
    return portable(spark, folder, _URLS).select("pub_seq", I.proxy_reference(F.col("route"), F.col("url"), F.col("variant")).alias("reference"))


@R.add("SELECT pub_seq, 'build:' || route || ':' || coalesce(digest, '') AS reference FROM (SELECT DISTINCT pub_seq, route, digest FROM put_record)")
def f13_build_reference(spark: SparkSession, folder: str) -> DataFrame:
    puts = table(spark, folder, "put_record").select("pub_seq", "route", "digest").distinct()
    return puts.select("pub_seq", I.build_reference(F.col("route"), F.coalesce("digest", F.lit(""))).alias("reference"))


@R.add("""SELECT channel_id, coalesce(sha256(channel_id) = token_digest, false) AS by_id, coalesce(sha256(secret) = sha256(channel_id || ':secret'), false) AS by_secret
  FROM (SELECT *, channel_id || ':secret' AS secret FROM channel_record)""")
def f14_token_verify(spark: SparkSession, folder: str) -> DataFrame:
    secret = F.concat(F.col("channel_id"), F.lit(":secret"))
    rows = table(spark, folder, "channel_record")
    return rows.select("channel_id", I.token_matches(F.col("channel_id"), F.col("token_digest")).alias("by_id"), I.token_matches(secret, F.sha2(secret.cast("binary"), 256)).alias("by_secret"))


_AUTH = """SELECT event_id, CASE event_type WHEN 'view' THEN 'Bearer tok-' || CAST(user_id AS STRING) WHEN 'click' THEN 'token_' || CAST(user_id AS STRING)
  WHEN 'signup' THEN 'Digest abc' WHEN 'error' THEN CAST(NULL AS STRING) ELSE 'basic' END AS auth, 'user' || CAST(user_id AS STRING) || ':pass:' || event_type AS pair FROM {events}"""


@R.add(f"""SELECT event_id, CASE WHEN auth = 'basic' THEN substr(pair, strpos(pair, ':') + 1) WHEN auth LIKE 'Bearer %' THEN substr(auth, 8) WHEN auth LIKE 'token\\_%' ESCAPE '\\' THEN auth END AS token
  FROM ({plain(_AUTH)})""")
def f15_credential(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _AUTH)
    basic = F.concat(F.lit("Basic "), F.translate(F.base64(F.col("pair").cast("binary")), "\r\n", ""))
    sent = F.when(F.col("auth") == "basic", basic).otherwise(F.col("auth"))
    return rows.select("event_id", sent.alias("sent")).select("event_id", I.credential(F.col("sent")).alias("token"))


@R.add(f"SELECT pub_seq, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS encoded, url AS decoded FROM ({plain(_URLS)})")
def f21_base64url(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _URLS).withColumn("encoded", I.base64url(F.col("url")))
    return rows.select("pub_seq", "encoded", F.decode(I.from_base64url(F.col("encoded")), "UTF-8").alias("decoded"))


@R.add("""SELECT DISTINCT pub_seq, channel || '/sha256/' || substr(digest, 1, 2) || '/' || substr(digest, 3, 2) || '/' || digest AS path FROM """ + plain(_IDS) + " WHERE digest IS NOT NULL")
def f33_body_path(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, f"SELECT * FROM {_IDS} WHERE digest IS NOT NULL")
    return rows.select("pub_seq", I.body_path(F.col("channel"), F.col("digest")).alias("path")).distinct()


_QUEUE = "SELECT DISTINCT queue_row, channel_id, eligible_at, digest FROM {eviction_queue} WHERE digest IS NOT NULL AND eligible_at IS NOT NULL AND channel_id IS NOT NULL"


@R.add(f"""SELECT queue_row, lower(hex(encode(channel_id))) || printf('%016x', eligible_at) || digest AS eviction_key, lower(hex(encode(channel_id))) || digest AS artifact_key,
  lower(hex(encode(channel_id || 'name'))) AS reference_key FROM ({plain(_QUEUE)})""")
def f34_key_encoding(spark: SparkSession, folder: str) -> DataFrame:
    rows, c, d = portable(spark, folder, _QUEUE), F.col("channel_id"), F.col("digest")
    return rows.select("queue_row", I.eviction_key(c, F.col("eligible_at"), d).alias("eviction_key"), I.artifact_key(c, d).alias("artifact_key"), I.reference_key(c, F.lit("name")).alias("reference_key"))


@R.add(f"""SELECT queue_row, CASE WHEN octet_length(encode(channel_id)) = 26 AND length(digest) = 64 THEN eligible_at END AS eligible_at,
  CASE WHEN octet_length(encode(channel_id)) = 26 AND length(digest) = 64 THEN digest END AS digest FROM ({plain(_QUEUE)})""")
def s9_decode_queue_key(spark: SparkSession, folder: str) -> DataFrame:
    key = I.eviction_key(F.col("channel_id"), F.col("eligible_at"), F.col("digest"))
    keys = portable(spark, folder, _QUEUE).select("queue_row", "channel_id", key.alias("key"))
    return keys.select("queue_row", *(c.alias(n) for n, c in I.decode_eviction_key(F.col("key"), F.col("channel_id")).items()))


@R.add("""SELECT CAST(count(*) AS BIGINT) AS n_elided, CAST(count(*) FILTER (output = sha256('')) AS BIGINT) AS n_empty_digest FROM manifest_entry WHERE size = 0""")
def f42_empty_outputs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest_entry").filter("size = 0")
    return rows.agg(F.count(F.lit(1)).alias("n_elided"), F.count_if(F.col("output") == I.body_digest(F.lit(""))).alias("n_empty_digest"))


_ULIDS = "SELECT event_id, epoch_us(ts) // 1000 AS millis, (event_id * 7919) % 1000003 * 1000003 AS high, user_id * 104729 + event_id AS low FROM {events}"
_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _digits_sql(number: str, digits: int) -> str:
    return " || ".join(f"substr('{_DIGITS}', CAST(({number} >> {5 * i}) & 31 AS INT) + 1, 1)" for i in range(digits - 1, -1, -1))


@R.add(f"SELECT event_id, {_digits_sql('millis', 10)} || {_digits_sql('high', 8)} || {_digits_sql('low', 8)} AS channel_id FROM ({plain(_ULIDS)})")
def f5_channel_ulid(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), F.expr("(event_id * 7919) % 1000003 * 1000003 AS high"), F.expr("user_id * 104729 + event_id AS low"))
    return rows.select("event_id", I.channel_ulid(F.col("millis"), F.col("high"), F.col("low")).alias("channel_id"))


@R.add(f"SELECT DISTINCT {channel_sql('channel_id')} AS channel_id, {digest_sql('digest')} AS digest, CAST(1 AS BIGINT) AS stripes, TRUE AS in_range FROM put_record WHERE channel_id IS NOT NULL AND {digest_sql('digest')} IS NOT NULL")
def f43_stripes(spark: SparkSession, folder: str) -> DataFrame:
    """Which stripe is of no consequence; that equal artifacts have the same one is."""
    rows = table(spark, folder, "put_record").select(channel_key(F.col("channel_id")).alias("channel_id"), digest_hex(F.col("digest")).alias("digest")).filter("channel_id is not null and digest is not null")
    striped = rows.withColumn("_stripe", I.stripe(F.col("channel_id"), F.col("digest")))
    return striped.groupBy("channel_id", "digest").agg(F.countDistinct("_stripe").alias("stripes"), F.every(F.col("_stripe").between(0, I.STRIPES - 1)).alias("in_range"))
