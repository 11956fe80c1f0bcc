"""Manifests, protocol, proxied documents and metrics (J8-J9, J12, O4, O8, A1-A7, A12, A14, A17, U1-U2, U4-U5, F22-F26, F30-F32, P3-P4, P6, P14-P15, P17, S16, S18-S19, S22, T4-T7, T12-T14, W18, W21-W24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import rewriting as W
from marlstone.functions.spelling import digest_hex, digest_sql
from marlstone.operators import manifest as N
from marlstone.operators import metrics as X
from marlstone.operators import proxy as Y
from marlstone.functions.timing import backoff_after, refresh_bounds
from marlstone.operators.health import ejections
from marlstone.operators.ring import failure_streaks
from marlstone.operators.running import running_last
from marlstone.plans.registry import Registry, plain, portable
from marlstone.sources import protocol as P
from marlstone.sources.tables import table
from marlstone.streaming.metrics import windowed_counters

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: The time of the merges below; entries before SPLIT are stored, later ones used.
NOW, SPLIT = 1_746_000_000, 1_744_000_000
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_D = digest_sql("output")

#: The last entry of each label and action on either side of SPLIT.
_STORED = f"(SELECT label, action, output, size, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY label, action ORDER BY entry_row DESC) AS rk FROM manifest_entry WHERE last_seen < {SPLIT} AND label IS NOT NULL) WHERE rk = 1)"
_USED = f"(SELECT label, action, output, size FROM (SELECT *, row_number() OVER (PARTITION BY label, action ORDER BY entry_row DESC) AS rk FROM manifest_entry WHERE last_seen >= {SPLIT} AND label IS NOT NULL) WHERE rk = 1)"


def _entries(spark: SparkSession, folder: str, later: bool) -> DataFrame:
    when = F.col("last_seen") >= SPLIT if later else F.col("last_seen") < SPLIT
    rows = table(spark, folder, "manifest_entry").filter(when & F.col("label").isNotNull())
    last = rows.groupBy("label", "action").agg(F.max(F.struct("entry_row", "output", "size", "last_seen")).alias("_e"))
    return last.select("label", "action", "_e.output", "_e.size", "_e.last_seen")


def _merged_sql(limit: int) -> str:
    return f"""SELECT label, action, output, size, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY last_seen DESC, action DESC) AS rk FROM (
      SELECT label, action, output, size, last_seen FROM {_STORED} s WHERE greatest({NOW} - last_seen, 0) <= {N.MAX_AGE} AND NOT EXISTS (SELECT 1 FROM {_USED} u WHERE u.label = s.label AND u.action = s.action)
      UNION ALL SELECT label, action, output, size, CAST({NOW} AS BIGINT) FROM {_USED})) WHERE rk <= {limit}"""


@R.add(_merged_sql(N.MAX_ENTRIES))
def j8_manifest_merge(spark: SparkSession, folder: str) -> DataFrame:
    return N.merge_manifests(_entries(spark, folder, False), _entries(spark, folder, True), NOW, ["label"])


@R.add(f"SELECT label, CAST(count(*) AS BIGINT) AS kept, min(last_seen) AS oldest FROM ({_merged_sql(50)}) GROUP BY 1")
def o4_manifest_cap(spark: SparkSession, folder: str) -> DataFrame:
    capped = N.merge_manifests(_entries(spark, folder, False), _entries(spark, folder, True), NOW, ["label"], limit=50)
    return capped.groupBy("label").agg(F.count(F.lit(1)).alias("kept"), F.min("last_seen").alias("oldest"))


@R.add(f"""WITH used AS (SELECT * FROM {_USED} WHERE label LIKE '%arm64'), touched AS (SELECT DISTINCT label FROM used) SELECT label, action, output, size, last_seen FROM {_STORED} WHERE label NOT IN (SELECT label FROM touched)
  UNION ALL SELECT label, action, output, size, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY last_seen DESC, action DESC) AS rk FROM (SELECT label, action, output, size, last_seen FROM {_STORED} s
    WHERE label IN (SELECT label FROM touched) AND greatest({NOW} - last_seen, 0) <= {N.MAX_AGE} AND NOT EXISTS (SELECT 1 FROM used u WHERE u.label = s.label AND u.action = s.action) UNION ALL SELECT label, action, output, size, CAST({NOW} AS BIGINT) FROM used)) WHERE rk <= {N.MAX_ENTRIES}""")
def w24_manifest_finalize(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions on arm64 used something; the manifests of others stay as they are."""
    used = _entries(spark, folder, True).filter("label like '%arm64'")
    return N.finalize_manifests(_entries(spark, folder, False), used, NOW, ["label"])


@R.add("""SELECT event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","level":"' || CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END || '","message":"' || event_type || '","fields":{"user":' || CAST(user_id AS VARCHAR) || '}}' AS line FROM events""")
def w23_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    fields = F.struct(F.col("user_id").alias("user"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    level = F.when(F.col("event_type") == "error", "WARN").otherwise("INFO")
    return table(spark, folder, "events").select("event_id", F.to_json(F.struct(stamp.alias("timestamp"), level.alias("level"), F.col("event_type").alias("message"), fields.alias("fields"))).alias("line"))


@R.add(f"SELECT greatest({NOW} - last_seen, 0) <= {N.MAX_AGE} AS kept, last_seen > {NOW} AS future, CAST(count(*) AS BIGINT) AS n FROM manifest_entry GROUP BY 1, 2")
def proj_p4_manifest_age(spark: SparkSession, folder: str) -> DataFrame:
    age = F.greatest(F.lit(NOW) - F.col("last_seen"), F.lit(0).cast("bigint"))
    return table(spark, folder, "manifest_entry").groupBy((age <= N.MAX_AGE).alias("kept"), (F.col("last_seen") > NOW).alias("future")).agg(F.count(F.lit(1)).alias("n"))


_LOCAL = "(SELECT DISTINCT digest AS name, content_len AS size FROM put_record WHERE digest IS NOT NULL)"
_PREFETCH = f"""WITH e AS (SELECT DISTINCT action, {_D} AS output, size FROM manifest_entry WHERE size IS NOT NULL), o AS (SELECT output, min_by(size, (action, size)) AS size, min(action) AS action FROM e WHERE output IS NOT NULL GROUP BY 1)
  SELECT o.output, o.size, o.action, CASE WHEN o.size = 0 THEN CASE WHEN output = '{EMPTY}' THEN 'local' ELSE 'dropped' END WHEN l.name IS NOT NULL THEN 'local' ELSE 'wanted' END AS state FROM o LEFT JOIN {_LOCAL} l ON l.name = o.output AND l.size = o.size"""


def _local(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "put_record").filter("digest is not null").select(F.col("digest").alias("name"), F.col("content_len").alias("size")).distinct()


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_entry").filter("size is not null").select("action", digest_hex(F.col("output")).alias("output"), "size").distinct()


@R.add(_PREFETCH)
def j9_prefetch_plan(spark: SparkSession, folder: str) -> DataFrame:
    return N.prefetch_plan(_outputs(spark, folder), _local(spark, folder), EMPTY)


@R.add(f"SELECT CAST(count(*) AS BIGINT) AS advertised, CAST(count(*) FILTER (state = 'local') AS BIGINT) AS local, CAST(count(*) FILTER (state = 'wanted') AS BIGINT) AS wanted, CAST(count(*) FILTER (state = 'dropped') AS BIGINT) AS dropped, CAST(coalesce(sum(CASE WHEN state = 'wanted' THEN size END), 0) AS BIGINT) AS wanted_bytes FROM ({_PREFETCH})")
def a12_prefetch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return N.prefetch_summary(j9_prefetch_plan(spark, folder))


#: How the downloads of wanted outputs went, by their digests: where most are published, some were local meanwhile, some missed.
_DOWNLOADS = "SELECT output, size, CASE WHEN substr(output, 1, 1) IN ('e', 'f') THEN 'miss' WHEN substr(output, 1, 1) = 'd' THEN 'local' ELSE 'published' END AS outcome, size % 5000 AS start, size % 5000 + 1 + size % 70 AS stop FROM {plan} WHERE state = 'wanted'"


@R.add(f"""WITH p AS ({_PREFETCH}), d AS ({_DOWNLOADS.replace('{plan}', 'p')}), e AS (SELECT start AS t, 1 AS step FROM d UNION ALL SELECT stop, -1 FROM d), c AS (SELECT sum(sum(step)) OVER (ORDER BY t) AS open FROM e GROUP BY t)
  SELECT (SELECT CAST(count(*) AS BIGINT) FROM p) AS advertised, (SELECT CAST(count(*) AS BIGINT) FROM p WHERE state = 'local') + CAST(count(*) FILTER (outcome = 'local') AS BIGINT) AS local, CAST(count(*) AS BIGINT) AS attempted,
    CAST(count(*) FILTER (outcome = 'published') AS BIGINT) AS downloaded, CAST(count(*) FILTER (outcome = 'miss') AS BIGINT) AS missed, CAST(coalesce(sum(size) FILTER (outcome = 'published'), 0) AS BIGINT) AS bytes,
    CAST(max(stop) - min(start) AS BIGINT) AS duration, (SELECT CAST(coalesce(max(open), 0) AS BIGINT) FROM c) AS peak_concurrency FROM d""")
def a12_prefetch_accounting(spark: SparkSession, folder: str) -> DataFrame:
    plan = j9_prefetch_plan(spark, folder)
    return N.prefetch_accounting(plan, spark.sql(_DOWNLOADS, plan=plan))


@R.add(f"SELECT label, CAST(count(DISTINCT {_D}) AS BIGINT) AS outputs, CAST(count(DISTINCT action) AS BIGINT) AS actions FROM manifest_entry GROUP BY 1")
def a14_u4_distinct_outputs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest_entry").select("label", "action", digest_hex(F.col("output")).alias("output"))
    return rows.groupBy("label").agg(F.countDistinct("output").alias("outputs"), F.countDistinct("action").alias("actions"))


@R.add(f"SELECT DISTINCT name, size FROM {_LOCAL} l WHERE EXISTS (SELECT 1 FROM manifest_entry m WHERE {digest_sql('m.output')} = l.name AND m.size = l.size)")
def u5_p14_manifest_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    named = _outputs(spark, folder).select(F.col("output").alias("name"), "size")
    return _local(spark, folder).join(named, ["name", "size"], "left_semi")


_ASKED = "SELECT DISTINCT action FROM {manifest_entry} WHERE action IS NOT NULL UNION SELECT DISTINCT digest AS action FROM {known_digest} WHERE digest IS NOT NULL"


@R.add(f"""WITH k AS (SELECT action, output, size FROM (SELECT DISTINCT action, last_seen, output, size, row_number() OVER (PARTITION BY action ORDER BY last_seen DESC, output DESC, size DESC) AS rk FROM (SELECT action, last_seen, {_D} AS output, size FROM manifest_entry WHERE {_D} IS NOT NULL AND size IS NOT NULL)) WHERE rk = 1)
  SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.action, CASE WHEN l.name IS NOT NULL THEN 'local' WHEN k.output IS NOT NULL THEN 'manifest' ELSE 'remote' END AS source FROM ({plain(_ASKED)}) a LEFT JOIN k USING (action) LEFT JOIN {_LOCAL} l ON l.name = k.output AND l.size = k.size) GROUP BY 1""")
def j12_lookup_chain(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "manifest_entry").withColumn("output", digest_hex(F.col("output"))).filter("output is not null and size is not null")
    found = N.lookup_chain(portable(spark, folder, _ASKED), entries, _local(spark, folder))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT label, action, output, size FROM (SELECT *, row_number() OVER (PARTITION BY label, action ORDER BY entry_row DESC) AS rk FROM manifest_entry WHERE label IS NOT NULL) WHERE rk = 1")
def t13_latest_used(spark: SparkSession, folder: str) -> DataFrame:
    return N.latest_used(table(spark, folder, "manifest_entry").filter("label is not null"), ["label"], "entry_row")


@R.add("SELECT entry_row, action, output, size, last_seen FROM (SELECT DISTINCT * FROM manifest_entry) WHERE entry_row % 3 = 0 AND action IS NOT NULL")
def s19_manifest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one entry each: a third in this version, the others broken or of another version."""
    rows = table(spark, folder, "manifest_entry").distinct()
    entry = F.create_map(F.coalesce("action", F.lit("")), F.struct("output", "size", "last_seen"))
    version = F.when(F.col("entry_row") % 3 == 0, 1).otherwise(2)
    text = F.when(F.col("entry_row") % 3 == 2, F.lit("{broken")).otherwise(F.to_json(F.struct(version.alias("version"), entry.alias("entries"))))
    parsed = N.parse_manifests(rows.select("entry_row", text.alias("document")), "document")
    return parsed.filter("action <> ''").select("entry_row", "action", "output", "size", "last_seen")


_MODULES = "SELECT DISTINCT label, CASE WHEN label LIKE '% linux/%' THEN split_part(label, ' ', 1) END AS module FROM {manifest_entry} WHERE label IS NOT NULL"


@R.add(f"SELECT label, module, coalesce(module || ' darwin/arm64', '/work') AS session FROM ({plain(_MODULES)})")
def f30_f32_session_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _MODULES)
    text = F.concat(F.lit("// a comment\ngo 1.22\n"), F.coalesce(F.concat(F.lit('module "'), "module", F.lit('" // path\n')), F.lit("require x\n")))
    parsed = rows.withColumn("module", N.module_path(text))
    names = N.platform(F.lit("macos"), F.lit("aarch64"))
    return parsed.select("label", "module", N.session_label(F.lit(None).cast("string"), F.col("module"), names["os"], names["arch"], F.lit("/work")).alias("session"))


# --- protocol --------------------------------------------------------------------------------------------------------------


@R.add("SELECT doc_id, 'put' AS command, sha256('action' || CAST(doc_id AS VARCHAR)) AS action, sha256(text) AS output, CAST(octet_length(encode(text)) AS BIGINT) AS size, CASE WHEN doc_id % 5 = 0 THEN 'body' END AS error, sha256(text) AS body_digest FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL, NULL, 0, 'malformed', NULL FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0")
def s18_p16_protocol_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of lines for each document: a put, a blank line, its body, and now and then a broken line."""
    texts = table(spark, folder, "documents").filter("text is not null")
    b64 = lambda c: F.translate(F.base64(c), "\r\n", "")
    size = F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    request = F.to_json(F.struct(
        F.lit(1).alias("ID"), F.lit("put").alias("Command"), b64(F.unhex(F.sha2(F.concat(F.lit("action"), F.col("doc_id").cast("string")).cast("binary"), 256))).alias("ActionID"),
        b64(F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("OutputID"), size.alias("BodySize"),
    ))
    body = F.concat(F.lit('"'), b64(F.col("text").cast("binary")), F.lit('"'))
    lines = F.array_compact(F.array(request, F.lit("  "), body, F.when(F.col("doc_id") % 7 == 0, "not json")))
    numbered = texts.select(F.col("doc_id").alias("file"), F.posexplode(lines).alias("seq", "line"))
    parsed = P.parse_requests(numbered).withColumn("size", F.when(F.col("error") == "body", F.col("size") - 1).otherwise(F.col("size")))
    return parsed.select(F.col("file").alias("doc_id"), "command", "action", "output", "size", "error", F.sha2("body", 256).alias("body_digest"))


@R.add("""SELECT event_id, '{"ID":' || CAST(event_id AS VARCHAR) || CASE WHEN event_type = 'error' THEN ',"Miss":true}' ELSE CASE WHEN user_id > 0 THEN ',"Size":' || CAST(user_id AS VARCHAR) ELSE '' END || ',"DiskPath":"/cache/' || event_type || '"}' END AS line FROM events""")
def w22_protocol_responses(spark: SparkSession, folder: str) -> DataFrame:
    miss = F.col("event_type") == "error"
    fields = {"ID": F.col("event_id"), "Miss": miss, "Size": F.when(~miss, F.col("user_id")), "DiskPath": F.when(~miss, F.concat(F.lit("/cache/"), "event_type"))}
    return table(spark, folder, "events").select("event_id", P.response(fields).alias("line"))


@R.add("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 3 THEN doc_id % 4 = 1 END, false) AS tampered FROM documents WHERE text IS NOT NULL")
def proj_p15_p17_tampered(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").filter("text is not null")
    etag = F.when(F.col("doc_id") % 4 == 3, None).otherwise(F.concat(F.lit('"'), F.sha2(F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256), F.lit('"')))
    return texts.select("doc_id", P.tampered(F.col("text"), etag).alias("tampered"))


# --- proxied documents -------------------------------------------------------------------------------------------------------

_REVALIDATED = f"SELECT DISTINCT ref_row, CAST({NOW} AS BIGINT) AS now, CASE WHEN ref_row % 11 <> 0 THEN updated_at + 1000000 END AS updated_at, ref_row % 5 <> 0 AS has_body, CASE ref_row % 4 WHEN 0 THEN 304 WHEN 1 THEN 200 WHEN 2 THEN 404 END AS status, ref_row % 3 <> 0 AS admitted FROM {{reference_record}}"


@R.add(f"""SELECT ref_row, CASE WHEN updated_at IS NOT NULL AND has_body AND greatest(now - updated_at, 0) < 300000 THEN 'cached' WHEN status IS NULL THEN 'unavailable' WHEN status = 304 THEN CASE WHEN updated_at IS NOT NULL AND has_body THEN 'rebound' ELSE 'unavailable' END
  WHEN status NOT BETWEEN 200 AND 299 THEN 'passthrough' WHEN admitted THEN 'republished' ELSE 'uncached' END AS decision FROM ({plain(_REVALIDATED)})""")
def t7_p3_revalidation(spark: SparkSession, folder: str) -> DataFrame:
    return Y.revalidation(portable(spark, folder, _REVALIDATED), 300_000).select("ref_row", "decision")


_VISITS = "SELECT event_id AS id, user_id AS key, event_id AS now, CASE event_type WHEN 'view' THEN 304 WHEN 'click' THEN 200 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 200 END AS status, value < 40 AS admitted, value > 3 AS body_kept FROM {events}"
_VISIT_TTL = 300


@R.add(f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY now, id) AS n FROM ({plain(_VISITS)})),
  s AS (SELECT key, 0 AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS updated, false AS body, CAST(NULL AS VARCHAR) AS decision FROM (SELECT DISTINCT key FROM v)
    UNION ALL SELECT key, n, id, CASE WHEN decision IN ('rebound', 'republished') THEN now ELSE updated END, CASE WHEN decision = 'republished' THEN true ELSE there END, decision FROM (
      SELECT *, CASE WHEN updated IS NOT NULL AND there AND greatest(now - updated, 0) < {_VISIT_TTL} THEN 'cached' WHEN status IS NULL THEN 'unavailable' WHEN status = 304 THEN CASE WHEN updated IS NOT NULL AND there THEN 'rebound' ELSE 'unavailable' END
        WHEN status NOT BETWEEN 200 AND 299 THEN 'passthrough' WHEN admitted THEN 'republished' ELSE 'uncached' END AS decision
      FROM (SELECT v.key, v.n, v.id, v.now, v.status, v.admitted, s.updated, s.body AND v.body_kept AS there FROM s JOIN v ON v.key = s.key AND v.n = s.n + 1)))
  SELECT id, decision, updated AS updated_at FROM s WHERE n > 0""")
def t7_revalidation_through_time(spark: SparkSession, folder: str) -> DataFrame:
    return Y.revalidated(portable(spark, folder, _VISITS), _VISIT_TTL).select("id", "decision", "updated_at")


_FLIGHTS = "SELECT DISTINCT pub_seq AS id, coalesce(channel_id, '') || ':' || route AS key, pub_seq * 3 AS at, pub_seq % 4 <> 0 AS ok FROM {put_record}"


@R.add(f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", id) AS n FROM (SELECT * FROM ({plain(_FLIGHTS)}))),
  s AS (SELECT key, 0 AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS since, false AS ask FROM (SELECT DISTINCT key FROM v)
    UNION ALL SELECT key, n, id, CASE WHEN ask AND ok THEN "at" ELSE since END, ask FROM (SELECT v.key, v.n, v.id, v."at", v.ok, s.since, s.since IS NULL OR greatest(v."at" - s.since, 0) >= 300 AS ask FROM s JOIN v ON v.key = s.key AND v.n = s.n + 1))
  SELECT key, id, ask AS fetched FROM s WHERE n > 0""")
def t5_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a request asks the upstream depends on how those before it ended."""
    return Y.flights(portable(spark, folder, _FLIGHTS), 300)


@R.add(f"SELECT key, min(id) AS id FROM ({plain(_FLIGHTS)}) WHERE ok GROUP BY 1")
def t5_first_flights(spark: SparkSession, folder: str) -> DataFrame:
    """The request of each key that first fetches successfully."""
    flown = Y.flights(portable(spark, folder, _FLIGHTS), 300).join(portable(spark, folder, _FLIGHTS).filter("ok").select("key", "id"), ["key", "id"], "left_semi")
    return flown.filter("fetched").groupBy("key").agg(F.min("id").alias("id"))


_WAITS = "SELECT user_id AS object, event_id AS id, event_id AS at, event_type FROM {events}"


@R.add("SELECT CAST(count(*) FILTER (waited) AS BIGINT) AS waited, CAST(count(*) AS BIGINT) AS asked FROM (SELECT r.event_id, EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = r.user_id AND d.event_id <= r.event_id AND r.event_id < d.event_id + 400) AS waited FROM events r WHERE r.event_type = 'view')")
def t6_download_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that find a download of their object under way: the last download before them decides, so one ordered pass does."""
    rows = running_last(portable(spark, folder, _WAITS), ["object"], "at", {"_last": F.when(F.col("event_type") == "purchase", F.col("at"))})
    asked = rows.filter("event_type = 'view'")
    return asked.agg(F.count_if(F.coalesce(F.col("at") < F.col("_last") + 400, F.lit(False))).alias("waited"), F.count(F.lit(1)).alias("asked"))


_ORIGINS = "SELECT DISTINCT route AS protocol, 'HTTPS://Files-' || CAST(pub_seq % 7 AS STRING) || '.Example' || CASE WHEN pub_seq % 2 = 0 THEN ':443' ELSE '' END || '/x?q#f' AS url FROM {put_record}"


@R.add(f"SELECT DISTINCT protocol, 'https://files-' || regexp_extract(lower(url), 'files-([0-9]+)', 1) || '.example:443' AS origin FROM ({plain(_ORIGINS)}) UNION SELECT 'go', 'http://proxy.example:80'")
def u2_allowed_origins(spark: SparkSession, folder: str) -> DataFrame:
    listed = portable(spark, folder, _ORIGINS).select("protocol", W.url_origin(F.col("url")).alias("origin"))
    base = spark.createDataFrame([("go", "http://proxy.example")], "protocol string, url string").select("protocol", W.url_origin(F.col("url")).alias("origin"))
    return Y.allowed_origins(listed, base)


_LINKS = "SELECT DISTINCT pub_seq, CASE pub_seq % 4 WHEN 0 THEN 'https://files.example/a/' WHEN 1 THEN 'https://user@files.example/' WHEN 2 THEN 'http://other.example:81/' ELSE 'ftp://files.example/' END || coalesce(digest, 'é') AS url FROM {put_record}"


@R.add(f"SELECT pub_seq, coalesce(CASE pub_seq % 4 WHEN 0 THEN 'https://files.example:443' WHEN 1 THEN 'https://files.example:443' WHEN 2 THEN 'http://other.example:81' END = 'https://files.example:443', false) AS allowed FROM ({plain(_LINKS)})")
def proj_p6_origin_check(spark: SparkSession, folder: str) -> DataFrame:
    allowed = spark.createDataFrame([("https://files.example:443", True)], "origin string, _ok boolean")
    rows = portable(spark, folder, _LINKS).withColumn("origin", W.url_origin(F.col("url")))
    return rows.join(allowed, "origin", "left").select("pub_seq", F.coalesce("_ok", F.lit(False)).alias("allowed"))


@R.add(f"SELECT pub_seq, '/channels/c/proxy/python/files/' || rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') || '#sha256=' || CAST(pub_seq AS VARCHAR) AS routed, CASE WHEN pub_seq % 4 IN (0, 2) THEN url || '.metadata' END AS decoded FROM ({plain(_LINKS)})")
def f22_f23_routed_urls(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _LINKS)
    routed = W.routed_url(F.lit("/channels/c"), W.PYTHON_FILES, F.concat("url", F.lit("#sha256="), F.col("pub_seq").cast("string")))
    encoded = F.regexp_extract(routed, r"/files/([^#]*)", 1)
    return rows.select("pub_seq", routed.alias("routed"), W.decode_routed(encoded, F.lit(".metadata")).alias("decoded"))


_ALLOWED = frozenset({"https://files.example:443"})
_USABLE = digest_sql("digest")


def _usable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "put_record").select("pub_seq", digest_hex(F.col("digest")).alias("digest")).filter("digest is not null").distinct()


_B64 = "rtrim(replace(replace(to_base64(encode({0})), '+', '-'), '/', '_'), '=')"


@R.add("SELECT pub_seq, '<!-- <a href=\"x\">c</a> --><a class=''k'' href=\"/p/proxy/python/files/' || " + _B64.format("'https://files.example/simple/' || digest || '.whl'") + " || '#sha256=1\" data-provenance=\"/p/proxy/python/files/' || " + _B64.format("'https://files.example/prov?a=1&b=2'") + " || '\">f</a><a href=\"https://else.example/y\">g</a>' AS html FROM (SELECT DISTINCT pub_seq, " + _USABLE + " AS digest FROM put_record) WHERE digest IS NOT NULL")
def f24_rewrite_html(spark: SparkSession, folder: str) -> DataFrame:
    rows = _usable(spark, folder)
    page = F.concat(F.lit("<!-- <a href=\"x\">c</a> --><a class='k' href=\"../simple/"), "digest", F.lit('.whl#sha256=1" data-provenance="/prov?a=1&amp;b=2">f</a><a href="https://else.example/y">g</a>'))
    rewrite = W.rewriter("html", _ALLOWED)
    return rows.select("pub_seq", rewrite(F.lit("https://files.example/simple/pkg"), F.lit("/p"), F.lit(True), page).alias("html"))


#: Pages whose markup a pattern would misread, and what they become: attributes inside values, text elements, other spellings.
_PAGES = {
    '<a title=" href=z" href="pkg/">t</a>': "<a title=\" href=z\" href=\"/p/proxy/python/simple/pkg/\">t</a>", "<textarea><a href='q/'>no</a></textarea><A HREF=q/ >y</A>": '<textarea><a href=\'q/\'>no</a></textarea><A HREF="/p/proxy/python/simple/q/" >y</A>',
    '<script>s = "<a href=\\"r/\\">";</script><!-- <a href="c/"> --><a\n href = "r/"\n>r</a>': '<script>s = "<a href=\\"r/\\">";</script><!-- <a href="c/"> --><a\n href = "/p/proxy/python/simple/r/"\n>r</a>', '<a name=n>n</a><a href="../up/">u</a><abbr href="x/">a</abbr>': '<a name=n>n</a><a href="../up/">u</a><abbr href="x/">a</abbr>',
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@R.add("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(page)})" for i, page in enumerate(_PAGES.values())) + ") AS t(page, html)")
def f24_rewrite_misleading_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.createDataFrame(list(enumerate(_PAGES)), "page int, document string")
    return pages.select("page", W.rewriter("html", _ALLOWED)(F.lit("https://files.example/simple/"), F.lit("/p"), F.lit(False), F.col("document")).alias("html"))


@R.add("SELECT pub_seq, '{\"meta\":{\"v\":1},\"files\":[{\"filename\":\"f\",\"url\":\"/proxy/python/files/' || " + _B64.format("'https://files.example/' || digest") + " || '#s\",\"yanked\":false},{\"url\":\"https://else.example/z\"}]}' AS json FROM (SELECT DISTINCT pub_seq, " + _USABLE + " AS digest FROM put_record) WHERE digest IS NOT NULL")
def f25_rewrite_index_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = _usable(spark, folder)
    document = F.concat(F.lit('{"meta": {"v": 1}, "files": [{"filename": "f", "url": "https://files.example/'), "digest", F.lit('#s", "yanked": false}, {"url": "https://else.example/z"}]}'))
    rewrite = W.rewriter("json", _ALLOWED)
    return rows.select("pub_seq", rewrite(F.lit("https://files.example/simple/pkg/"), F.lit(""), F.lit(True), document).alias("json"))


@R.add("SELECT pub_seq, '{\"name\":\"@s/n\",\"versions\":{\"1\":{\"dist\":{\"tarball\":\"/proxy/npm/-/tarball/' || " + _B64.format("'https://files.example/' || digest || '#f'") + " || '\"}},\"2\":[{\"tarball\":{\"tarball\":\"keep\"}}]},\"tarball\":5}' AS json FROM (SELECT DISTINCT pub_seq, " + _USABLE + " AS digest FROM put_record) WHERE digest IS NOT NULL")
def f26_rewrite_tarballs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _usable(spark, folder)
    document = F.concat(F.lit('{"name":"@s/n","versions":{"1":{"dist":{"tarball":"https://files.example/'), "digest", F.lit('#f"}},"2":[{"tarball":{"tarball":"keep"}}]},"tarball":5}'))
    rewrite = W.rewriter("npm", _ALLOWED)
    return rows.select("pub_seq", rewrite(F.lit("https://files.example/@s/n"), F.lit(""), F.lit(False), document).alias("json"))


@R.add("SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (d IS NOT NULL) AS BIGINT) AS served, CAST(count(*) FILTER (routed) AS BIGINT) AS rewritten FROM (SELECT r.name, a.d, a.d IS NOT NULL AND r.name LIKE 'latest%' AS routed FROM (SELECT DISTINCT ref_row, name, " + _USABLE + " AS d FROM reference_record) r LEFT JOIN (SELECT DISTINCT " + _USABLE + " AS d FROM put_record) a USING (d)) GROUP BY 1")
def s22_cached_documents(spark: SparkSession, folder: str) -> DataFrame:
    """References joined to their bodies and rewritten for the request; those whose origin isn't allowed stay as they are."""
    asked = table(spark, folder, "reference_record").select("ref_row", "name", digest_hex(F.col("digest")).alias("digest")).distinct()
    bodies = _usable(spark, folder).select("digest").distinct().withColumn("_there", F.lit(True))
    origin = F.when(F.col("name").startswith("latest"), "https://files.example/").otherwise("https://else.example/")
    document = F.when(F.col("_there"), F.concat(F.lit('{"tarball":"'), origin, "digest", F.lit('"}')))
    joined = asked.join(bodies, "digest", "left").select("name", document.alias("document"))
    rewritten = W.rewriter("npm", _ALLOWED)(F.lit("https://files.example/"), F.lit("/p"), F.lit(False), F.col("document"))
    served = joined.select("name", "document", rewritten.alias("answer"))
    return served.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("served"), F.count_if(F.coalesce(F.col("answer") != F.col("document"), F.lit(False))).alias("rewritten"))


_HOPS = "SELECT event_id AS url, CASE WHEN event_type = 'error' THEN 302 WHEN event_type = 'click' THEN 304 ELSE 200 END AS status, CASE WHEN event_type = 'error' THEN event_id + user_id + 1 END AS location FROM {events}"


def _hop_sql() -> str:
    out = f"WITH t AS ({plain(_HOPS)}), h0 AS (SELECT url AS request, url, status, location, 0 AS hops FROM t)"
    for i in range(1, Y.MAX_REDIRECTS + 1):
        out += f", m{i} AS (SELECT request, CASE WHEN status = 302 THEN location ELSE url END AS url, hops + CASE WHEN status = 302 THEN 1 ELSE 0 END AS hops FROM h{i - 1}), h{i} AS (SELECT m.request, m.url, t.status, t.location, m.hops FROM m{i} m LEFT JOIN t USING (url))"
    return f"{out} SELECT request, url, CAST(status AS INTEGER) AS status, CAST(hops AS INTEGER) AS hops FROM h{Y.MAX_REDIRECTS}"


@R.add(_hop_sql())
def s16_redirects(spark: SparkSession, folder: str) -> DataFrame:
    responses = portable(spark, folder, _HOPS)
    return Y.follow_redirects(responses.select(F.col("url").alias("request"), "url"), responses)


@R.add("""WITH RECURSIVE v AS (SELECT CAST(user_id AS VARCHAR) AS member, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS now, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'look' ELSE 'success' END AS event,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  s AS (SELECT member, 0 AS n, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS failures, CAST(NULL AS BIGINT) AS next_retry FROM (SELECT DISTINCT member FROM v)
    UNION ALL SELECT v.member, v.n, v.seq, CASE WHEN v.event = 'fail' THEN s.failures + 1 WHEN v.event = 'success' OR v.now >= s.next_retry THEN 0 ELSE s.failures END,
      CASE WHEN v.event = 'look' AND v.now >= s.next_retry THEN NULL WHEN v.event = 'fail' AND s.next_retry IS NULL AND s.failures + 1 >= 2 THEN v.now + 86400 ELSE s.next_retry END FROM s JOIN v ON v.member = s.member AND v.n = s.n + 1)
  SELECT member, seq, failures, next_retry IS NOT NULL AS ejected, next_retry FROM s WHERE n > 0""")
def t4_ejections(spark: SparkSession, folder: str) -> DataFrame:
    """When a member is let in again depends on when it was put out."""
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "look").otherwise("success")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("member"), F.col("event_id").alias("seq"), seconds.alias("now"), kind.alias("event"))
    return ejections(events, limit=2, retry=86_400)


_SNAPSHOTS = "SELECT event_id, user_id % 10 AS service, CASE WHEN event_type <> 'error' THEN user_id END AS snapshot FROM {events}"


@R.add(f"SELECT event_id, last_value(snapshot IGNORE NULLS) OVER (PARTITION BY service ORDER BY event_id) AS snapshot FROM ({plain(_SNAPSHOTS)})")
def t12_last_good_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _SNAPSHOTS)
    return running_last(rows, ["service"], "event_id", {"snapshot": F.col("snapshot")}).select("event_id", "snapshot")


_ANSWERS = "SELECT event_id, user_id % 10 AS service, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'empty' ELSE 'found' END AS status, CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN 'shard-' || CAST(user_id AS STRING) END AS name, CASE WHEN event_type <> 'click' OR value > 20 THEN event_id % 90 END AS ttl FROM {events}"


@R.add(f"""WITH a AS (SELECT *, CASE status WHEN 'found' THEN name WHEN 'empty' THEN '' END AS named, CASE status WHEN 'found' THEN ttl WHEN 'empty' THEN coalesce(ttl, {Y.EMPTY_TTL}) END AS kept FROM ({plain(_ANSWERS)}))
  SELECT event_id, last_value(named IGNORE NULLS) OVER (PARTITION BY service ORDER BY event_id) AS members, CAST(kept AS BIGINT) AS ttl, status = 'failed' AS failed FROM a""")
def s17_resolver_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The members of each service after each lookup: an empty answer empties the ring, a failed one leaves it."""
    rows = portable(spark, folder, _ANSWERS).withColumn("records", F.when(F.col("name").isNotNull(), F.array("name")))
    known = running_last(Y.resolved(rows), ["service"], "event_id", {"members": F.array_join("records", ",")})
    return known.select("event_id", "members", F.col("ttl").cast("bigint").alias("ttl"), "failed")


_REFRESHES = "SELECT event_id, user_id AS service, event_type = 'error' AS failed, event_id % 700 AS ttl FROM {events}"


@R.add(f"""WITH r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY service ORDER BY event_id) AS island FROM ({plain(_REFRESHES)})),
  f AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY service, island ORDER BY event_id) AS streak FROM r)
  SELECT event_id, CASE WHEN NOT failed THEN 700 * least(greatest(ttl, 5), 300) END AS earliest_ms, CASE WHEN NOT failed THEN 900 * least(greatest(ttl, 5), 300) END AS latest_ms,
    CASE WHEN failed THEN CAST(least(pow(2, streak - 1), 60) AS BIGINT) END AS backoff FROM f""")
def t12_refresh_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """When the next refresh follows each one: within its clamped lifetime after a success, doubled waits after failures in a row."""
    rows = failure_streaks(portable(spark, folder, _REFRESHES), "service", "event_id")
    earliest, latest = refresh_bounds(F.col("ttl"), 5, 300)
    good = ~F.col("failed")
    return rows.select("event_id", F.when(good, earliest).alias("earliest_ms"), F.when(good, latest).alias("latest_ms"), backoff_after(F.col("streak"), 1, 60).alias("backoff"))


# --- metrics -----------------------------------------------------------------------------------------------------------------

# What happened on a replica and on an agent, as the events imply it: the kind by the value, the rest by the type.
_REPLICA_EVENTS = ("request", "hit", "miss", "staged", "denied", "reclaimed", "requeued", "bypassed", "refused", "admitted", "released", "rejected", "prefetch", "prefetch_response", "prefetch_end", "space")
_AGENT_EVENTS = ("request", "forwarded", "forward_failed", "miss_made", "bypass_made", "unavailable", "ejected", "prefetch", "prefetch_response", "prefetch_end")


def _log_sql(events: tuple[str, ...]) -> str:
    kinds = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(events))
    return f"""SELECT event_id AS seq, CASE CAST(floor(value) AS INT) % {len(events)} {kinds} END AS event, CAST(round(value * 100) AS BIGINT) AS amount, event_type <> 'error' AS completed,
      CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 206 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 304 ELSE 503 END AS status, event_id * 10 AS free, event_id * 2 AS reserved, event_id AS committed FROM {{events}}"""


_REPLICA_LOG, _AGENT_LOG = _log_sql(_REPLICA_EVENTS), _log_sql(_AGENT_EVENTS)
_FOREGROUND = 256
_OUTCOME_SQL = {"hit": "status BETWEEN 200 AND 299", "miss": "status = 404", "unavailable": "status NOT BETWEEN 200 AND 299 AND status <> 404"}
_END_SQL = {"completed": "completed", "cancelled": "NOT completed"}


def _metric_sql(log: str, metrics: list[tuple[str, str, str, str]]) -> str:
    parts = [f"SELECT '{n}' AS name, '{k}' AS kind, '{labels}' AS labels, CAST({v} AS BIGINT) AS value FROM l" for n, k, labels, v in metrics]
    return f"WITH l AS ({plain(log)}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE labels = '' OR value > 0"


def _n(event: str, more: str = "") -> str:
    return f"count(*) FILTER (event = '{event}'{' AND ' + more if more else ''})"


def _sum(event: str) -> str:
    return f"coalesce(sum(amount) FILTER (event = '{event}'), 0)"


_REPLICA_SQL = _metric_sql(_REPLICA_LOG, [
    ("requests_total", "counter", "", _n("request")), ("artifact_hits_total", "counter", "", _n("hit")), ("artifact_misses_total", "counter", "", _n("miss")),
    ("bytes_read_total", "counter", "", _sum("hit")), ("bytes_written_total", "counter", "", _sum("staged")), ("authorization_denials_total", "counter", "", _n("denied")),
    ("maintenance_reclaimed_total", "counter", "", _sum("reclaimed")), ("maintenance_requeued_total", "counter", "", _n("requeued")), ("build_cache_bypasses_total", "counter", "", _n("bypassed")),
    ("raw_pressure_errors_total", "counter", "", _n("refused")), ("foreground_concurrency_limit", "gauge", "", f"max({_FOREGROUND})"), ("foreground_in_flight", "gauge", "", f"{_n('admitted')} - {_n('released')}"),
    ("foreground_rejections_total", "counter", "", _n("rejected")), ("prefetch_requests_total", "counter", "", _n("prefetch")),
    *(("prefetch_responses_total", "counter", f'outcome="{o}"', _n("prefetch_response", c)) for o, c in _OUTCOME_SQL.items()),
    ("prefetch_in_flight", "gauge", "", f"{_n('prefetch')} - {_n('prefetch_end')}"), *(("prefetch_transfers_total", "counter", f'outcome="{o}"', _n("prefetch_end", c)) for o, c in _END_SQL.items()),
    ("prefetch_response_bytes_total", "counter", "", _sum("prefetch_end")),
    *((n, "gauge", "", f"coalesce(max_by({c}, seq) FILTER (event = 'space'), 0)") for n, c in (("free_observed_bytes", "free"), ("reserved_bytes", "reserved"), ("committed_since_bytes", "committed"))),
])
_RING = "SELECT count(*) AS members, count(CASE WHEN n > 20 THEN 1 END) AS ejected FROM (SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY user_id)"
_AGENT_SQL = _metric_sql(_AGENT_LOG, [
    ("requests_total", "counter", "", _n("request")), ("forwarded_total", "counter", "", _n("forwarded")), ("forward_failures_total", "counter", "", _n("forward_failed")),
    ("synthesized_misses_total", "counter", "", _n("miss_made")), ("synthesized_write_bypasses_total", "counter", "", _n("bypass_made")), ("unavailable_total", "counter", "", _n("unavailable")),
    ("ejections_total", "counter", "", _n("ejected")), ("prefetch_requests_total", "counter", "", _n("prefetch")),
    *((f"prefetch_{n}_total", "counter", "", _n("prefetch_response", _OUTCOME_SQL[o])) for n, o in (("hits", "hit"), ("misses", "miss"), ("unavailable", "unavailable"))),
    ("prefetch_response_bytes_total", "counter", "", _sum("prefetch_end")), ("prefetch_in_flight", "gauge", "", f"{_n('prefetch')} - {_n('prefetch_end')}"),
    *((f"prefetch_{o}_total", "counter", "", _n("prefetch_end", c)) for o, c in _END_SQL.items()),
]) + f" UNION ALL SELECT 'ring_members', 'gauge', '', CAST(members AS BIGINT) FROM ({plain(_RING)}) UNION ALL SELECT 'ring_ejected', 'gauge', '', CAST(ejected AS BIGINT) FROM ({plain(_RING)})"


@R.add(_REPLICA_SQL)
def a1_replica_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return X.replica_metrics(portable(spark, folder, _REPLICA_LOG), _FOREGROUND)


@R.add(_AGENT_SQL)
def a7_agent_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return X.agent_metrics(portable(spark, folder, _AGENT_LOG), portable(spark, folder, _RING))


_REQUESTS = "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'PUT' END AS method, CASE WHEN value < 30 THEN 'raw' ELSE 'http-cache' END AS route, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END AS status, CAST(round(value * 20000) AS BIGINT) AS micros FROM {events}"


def _series_sql(rows: str, labels: str, bounds: tuple[float, ...]) -> str:
    out = " UNION ALL ".join(f"SELECT {labels}, 'bucket' AS series, '{b:g}' AS le, CAST(count(*) FILTER (micros / 1000000.0 <= {b!r}) AS BIGINT) AS value FROM r GROUP BY ALL" for b in bounds)
    return f"""WITH r AS ({plain(rows)}) {out} UNION ALL SELECT {labels}, 'bucket', '+Inf', CAST(count(micros) AS BIGINT) FROM r GROUP BY ALL
      UNION ALL SELECT {labels}, 'sum', NULL, CAST(sum(micros) AS BIGINT) FROM r GROUP BY ALL UNION ALL SELECT {labels}, 'count', NULL, CAST(count(micros) AS BIGINT) FROM r GROUP BY ALL"""


@R.add(_series_sql(_REQUESTS, "method, route, status", X.REQUEST_BOUNDS))
def a3_a4_request_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return X.histogram_series(portable(spark, folder, _REQUESTS), ["method", "route", "status"], "micros", X.REQUEST_BOUNDS)


_BOUNDS = tuple(b * 10 for b in X.TRANSFER_BOUNDS)


@R.add(" UNION ALL ".join([f"SELECT event_type, '{b:g}' AS le, CAST(count(*) FILTER (value <= {b!r}) AS BIGINT) AS n FROM events GROUP BY 1" for b in _BOUNDS] + ["SELECT event_type, '+Inf', CAST(count(value) AS BIGINT) FROM events GROUP BY 1"]))
def a3_a4_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return X.histogram(table(spark, folder, "events"), ["event_type"], "value", _BOUNDS)


_STATUS = "SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 206 WHEN 'error' THEN 404 ELSE 502 END AS status FROM {events}"


@R.add(f"SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'hit' WHEN status = 404 THEN 'miss' ELSE 'unavailable' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM ({plain(_STATUS)}) GROUP BY 1")
def a5_prefetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return portable(spark, folder, _STATUS).groupBy(X.fetch_outcome(F.col("status")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


#: Chunks of response bodies; a body (a user's day) that ends with an error was cancelled.
_CHUNKS = "SELECT user_id * 100 + extract(DAY FROM ts) AS transfer, event_id, ts, CAST(round(value * 100) AS BIGINT) AS bytes, event_type <> 'error' AS good FROM {events}"
_TRANSFERS = f"SELECT transfer, count(*) AS chunks, sum(bytes) AS bytes, CASE WHEN max_by(good, event_id) THEN 'completed' ELSE 'cancelled' END AS outcome, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM ({plain(_CHUNKS)}) GROUP BY 1"


def _transfers(spark: SparkSession, folder: str) -> DataFrame:
    return X.transfers(portable(spark, folder, _CHUNKS), "transfer", "event_id", "ts")


@R.add(f"SELECT CAST(transfer AS BIGINT) AS transfer, CAST(chunks AS BIGINT) AS chunks, CAST(bytes AS BIGINT) AS bytes, outcome, CAST(micros AS BIGINT) AS micros FROM ({_TRANSFERS})")
def a6_t14_prefetch_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return _transfers(spark, folder).withColumn("transfer", F.col("transfer").cast("bigint"))


@R.add(_series_sql(f"SELECT outcome, CAST(micros // 1000 AS BIGINT) AS micros FROM ({_TRANSFERS})", "outcome", X.TRANSFER_BOUNDS))
def a6_transfer_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Durations in thousandths, so that days fall between the bounds of seconds."""
    rows = _transfers(spark, folder).withColumn("micros", F.expr("micros div 1000"))
    return X.histogram_series(rows, ["outcome"], "micros", X.TRANSFER_BOUNDS)


@R.add("SELECT event_type, CAST(round(1000000.0 * count(*) FILTER (value > 20) / count(*)) AS BIGINT) AS occupancy_ppm FROM events GROUP BY 1")
def a17_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    shares = table(spark, folder, "events").groupBy("event_type").agg(X.ratio(F.count_if(F.col("value") > 20), F.count(F.lit(1))).alias("r"))
    return shares.select("event_type", F.round(F.col("r") * 1000000.0).cast("bigint").alias("occupancy_ppm"))


@R.add(f"""SELECT name, '# TYPE ' || name || ' ' || kind || chr(10) || string_agg(name || CASE WHEN labels <> '' THEN '{{' || labels || '}}' ELSE '' END || ' ' || CAST(value AS VARCHAR), chr(10)
  ORDER BY name || CASE WHEN labels <> '' THEN '{{' || labels || '}}' ELSE '' END || ' ' || CAST(value AS VARCHAR)) AS text FROM ({_REPLICA_SQL}) GROUP BY name, kind""")
def w21_exposition(spark: SparkSession, folder: str) -> DataFrame:
    return X.exposition(a1_replica_metrics(spark, folder))


@R.add("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def a1_hourly_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming form over a finished table: an extension."""
    return windowed_counters(table(spark, folder, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")
