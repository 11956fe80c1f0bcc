"""Requests and responses over the upload log (functions F16-F20, F27-F29, F37-F41; predicates P7-P9, P12; scan S15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import http as H
from marlstone.operators.dictionary import through_distinct
from marlstone.plans.registry import Registry, plain, portable
from marlstone.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: Requests as the upload log implies them: the path and method of each record.
REQUESTS = """SELECT DISTINCT pub_seq, CASE pub_seq % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' WHEN 2 THEN 'HEAD' WHEN 3 THEN 'POST' ELSE 'DELETE' END AS method,
  CASE WHEN channel_id IS NULL THEN '' ELSE '/channels/' || channel_id END AS prefix,
  CASE route WHEN 'raw' THEN '/artifacts/sha256/' || digest WHEN 'http-cache' THEN '/build-cache/http/' || digest
    WHEN 'bazel-cas' THEN CASE WHEN pub_seq % 3 = 0 THEN '/build-cache/bazel/ac/' || digest ELSE '/build-cache/bazel/cas/' || digest END
    WHEN 'go' THEN '/proxy/go/example.com/@v/' || digest || '.zip' WHEN 'npm-tarball' THEN '/proxy/npm/-/tarball/' || digest
    ELSE CASE WHEN pub_seq % 4 = 0 THEN '/references/' || digest WHEN pub_seq % 4 = 1 THEN '/proxy/python' ELSE '/future/' || digest END END AS path, content_len
  FROM {put_record} WHERE digest IS NOT NULL"""

_ROUTED = f"""SELECT pub_seq, method, path, string_split(ltrim(path, '/'), '/') AS s FROM ({plain(REQUESTS)})"""
_KIND = """CASE WHEN s[1] = 'artifacts' AND len(s) = 3 THEN 'artifact' WHEN s[1] = 'build-cache' AND s[2] = 'bazel' AND s[3] = 'cas' AND len(s) = 4 THEN 'artifact'
  WHEN s[1] = 'build-cache' AND s[2] = 'bazel' AND s[3] = 'ac' AND len(s) = 4 THEN 'bazel-action' WHEN s[1] = 'build-cache' AND s[2] = 'http' AND len(s) = 3 THEN 'http-cache'
  WHEN s[1] = 'references' AND len(s) = 2 THEN 'reference' WHEN s[1] = 'proxy' AND len(s) > 2 THEN s[2] ELSE 'path' END"""
_KEY = f"CASE WHEN {_KIND} = 'path' THEN path WHEN s[1] = 'proxy' THEN array_to_string(s[3:], '/') ELSE s[len(s)] END"
_CLASS = f"CASE WHEN s[1] = 'build-cache' AND {_KIND} <> 'path' AND method IN ('GET', 'HEAD') THEN 'build_cache_read' WHEN s[1] = 'build-cache' AND {_KIND} <> 'path' AND method IN ('PUT', 'POST') THEN 'build_cache_write' ELSE 'passthrough' END"


@R.add(f'SELECT pub_seq, {_KIND} AS kind, {_KEY} AS id, {_CLASS} AS "class" FROM ({_ROUTED})')
def proj_p7_route_classify(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, REQUESTS)
    return rows.select("pub_seq", *(c.alias(n) for n, c in H.route(F.col("method"), F.col("path")).items()))


@R.add(f"SELECT pub_seq, {_KIND} AS kind, {_KEY} AS id FROM ({_ROUTED})")
def proj_p8_request_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, REQUESTS)
    found = H.route(F.col("method"), F.concat("prefix", "path"), strip_channel=True)
    # A request without a meaning of its own is identified by its bare path.
    key = F.when(found["kind"] == "path", F.col("path")).otherwise(found["id"])
    return rows.select("pub_seq", found["kind"].alias("kind"), key.alias("id"))


@R.add(f"SELECT CAST(CASE {_CLASS} WHEN 'build_cache_read' THEN 404 WHEN 'build_cache_write' THEN 200 ELSE CASE WHEN pub_seq % 2 = 0 THEN 503 ELSE 502 END END AS INTEGER) AS status, CAST(count(*) AS BIGINT) AS n FROM ({_ROUTED}) GROUP BY 1")
def f39_degraded_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, REQUESTS)
    found = H.route(F.col("method"), F.col("path"))
    return rows.groupBy(H.degraded_status(found["class"], F.col("pub_seq") % 2 == 0).alias("status")).agg(F.count(F.lit(1)).alias("n"))


#: Range values of every kind, one for each record.
_RANGES = """SELECT DISTINCT pub_seq, coalesce(content_len, 0) AS len, CASE pub_seq % 13 WHEN 0 THEN 'bytes=2-5' WHEN 1 THEN 'bytes=broken' WHEN 2 THEN 'items=0-1'
  WHEN 3 THEN 'bytes=18446744073709551616-' WHEN 4 THEN 'bytes=0-18446744073709551615' WHEN 5 THEN 'bytes=0-1,4-5' WHEN 6 THEN 'bytes=5-4' WHEN 7 THEN 'bytes=20000-30000' WHEN 8 THEN 'bytes=-0'
  WHEN 9 THEN 'bytes=-' || CAST(pub_seq AS STRING) WHEN 10 THEN 'bytes=' || CAST(pub_seq AS STRING) || '-' WHEN 11 THEN 'bytes=+7-09' ELSE CAST(NULL AS STRING) END AS header FROM {put_record} WHERE content_len >= 0 OR content_len IS NULL"""
_RANGE_SQL = f"""WITH r AS (SELECT pub_seq, len, header, header LIKE 'bytes=%' AND header NOT LIKE '%,%' AND header LIKE '%-%' AS ok, regexp_extract(substr(header, 7), '^([^-]*)-(.*)$', ['a', 'b']) AS p FROM ({plain(_RANGES)})),
  n AS (SELECT *, CASE WHEN regexp_full_match(p.a, '[+]?[0-9]+') THEN TRY_CAST(ltrim(p.a, '+') AS UBIGINT) END AS a, CASE WHEN regexp_full_match(p.b, '[+]?[0-9]+') THEN TRY_CAST(ltrim(p.b, '+') AS UBIGINT) END AS b FROM r),
  k AS (SELECT *, CASE WHEN NOT coalesce(ok, false) THEN 'full' WHEN p.a = '' THEN CASE WHEN b IS NULL THEN 'full' WHEN b = 0 OR len = 0 THEN 'unsatisfiable' ELSE 'partial' END
    WHEN a IS NULL OR (p.b <> '' AND b IS NULL) OR (p.b <> '' AND b < a) THEN 'full' WHEN a >= len THEN 'unsatisfiable' ELSE 'partial' END AS kind FROM n)"""


@R.add(f"""{_RANGE_SQL} SELECT pub_seq, kind, CASE WHEN kind = 'partial' THEN CAST(CASE WHEN p.a = '' THEN greatest(len - CAST(b AS HUGEINT), 0) ELSE a END AS BIGINT) END AS start,
  CASE WHEN kind = 'partial' THEN CAST(CASE WHEN p.a = '' OR p.b = '' THEN len - 1 ELSE least(CAST(b AS HUGEINT), len - 1) END AS BIGINT) END AS "end" FROM k""")
def f16_byte_range(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _RANGES)
    return rows.select("pub_seq", *(c.alias(n) for n, c in H.byte_range(F.col("header"), F.col("len")).items()))


@R.add(f"""{_RANGE_SQL}, s AS (SELECT *, CASE WHEN encoding = 'identity' AND method = 'GET' THEN kind ELSE 'full' END AS served FROM (SELECT *, CASE WHEN pub_seq % 2 = 0 THEN 'identity' ELSE 'zstd' END AS encoding,
    CASE WHEN pub_seq % 3 = 0 THEN 'HEAD' ELSE 'GET' END AS method FROM k))
  SELECT CAST(CASE served WHEN 'full' THEN 200 WHEN 'partial' THEN 206 ELSE 416 END AS INTEGER) AS status, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN method = 'HEAD' OR served = 'unsatisfiable' THEN 0 WHEN served = 'full' THEN len ELSE CASE WHEN p.a = '' THEN least(CAST(b AS HUGEINT), len) WHEN p.b = '' THEN len - CAST(a AS HUGEINT) ELSE least(CAST(b AS HUGEINT), len - 1) - a + 1 END END) AS BIGINT) AS bytes
  FROM s GROUP BY 1""")
def s15_serve_bodies(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _RANGES).withColumns({"encoding": F.expr("CASE WHEN pub_seq % 2 = 0 THEN 'identity' ELSE 'zstd' END"), "method": F.expr("CASE WHEN pub_seq % 3 = 0 THEN 'HEAD' ELSE 'GET' END")})
    asked = H.byte_range(F.when((F.col("encoding") == "identity") & (F.col("method") == "GET"), F.col("header")), F.col("len"))
    ranged = rows.select("method", "len", *(c.alias(n) for n, c in asked.items()))
    sent = F.when((F.col("method") == "HEAD") | (F.col("kind") == "unsatisfiable"), 0).when(F.col("kind") == "full", F.col("len")).otherwise(F.col("end") - F.col("start") + 1)
    status = F.when(F.col("kind") == "full", 200).when(F.col("kind") == "partial", 206).otherwise(416)
    return ranged.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(sent.cast("bigint")).alias("bytes"))


_ENCODINGS = """SELECT DISTINCT pub_seq, CASE pub_seq % 6 WHEN 0 THEN 'gzip, ZSTD' WHEN 1 THEN 'zstd;q=0' WHEN 2 THEN 'zstdx, br' WHEN 3 THEN '' WHEN 4 THEN 'br;q=1 , zstd ; q=0.5' ELSE CAST(NULL AS STRING) END AS header FROM {put_record}"""


@R.add(f"SELECT pub_seq, coalesce(len(list_filter(string_split(header, ','), lambda x: lower(trim(split_part(x, ';', 1))) = 'zstd')) > 0, false) AS zstd FROM ({plain(_ENCODINGS)})")
def f17_accepts_zstd(spark: SparkSession, folder: str) -> DataFrame:
    return portable(spark, folder, _ENCODINGS).select("pub_seq", H.accepts_zstd(F.col("header")).alias("zstd"))


_ACCEPTS = """SELECT DISTINCT pub_seq, CASE pub_seq % 11 WHEN 0 THEN 'application/vnd.pypi.simple.v1+json;q=0.1, text/html' WHEN 1 THEN 'application/vnd.pypi.simple.v1+json' WHEN 2 THEN 'application/xml'
  WHEN 3 THEN '*/*' WHEN 4 THEN 'application/*;q=0.5, text/*;q=0.5' WHEN 5 THEN 'application/vnd.npm.install-v1+json; q=0.8, application/json;q=0.8' WHEN 6 THEN 'application/json;q=0' WHEN 7 THEN '  '
  WHEN 8 THEN 'text/html;q=bad;q=0.3, APPLICATION/*;level=1;q=0.4' WHEN 9 THEN 'application/json, application/vnd.npm.install-v1+json;q=2' ELSE CAST(NULL AS STRING) END AS accept FROM {put_record}"""


def _negotiation_sql(first: tuple[str, ...], second: tuple[str, ...], names: tuple[str, str], default: str, text: bool, compare: bool) -> str:
    """The same rules as one row for each media range, aggregated."""
    listed = lambda types: ", ".join(f"'{t}'" for t in types)
    a = f"CASE WHEN t IN ({listed(first)}) THEN 2 WHEN t = 'application/*'{' OR t = ' + repr('text/*') if text else ''} THEN 1 WHEN t = '*/*' THEN 0 END"
    b = f"CASE WHEN t IN ({listed(second)}) THEN 2 WHEN t = 'application/*' THEN 1 WHEN t = '*/*' THEN 0 END"
    return f"""WITH x AS ({plain(_ACCEPTS)}), r AS (SELECT pub_seq, unnest(string_split(accept, ',')) AS r FROM x),
      p AS (SELECT pub_seq, lower(trim(split_part(r, ';', 1))) AS t, least(greatest(coalesce(list_filter(list_transform(list_filter(string_split(r, ';')[2:], lambda f: lower(trim(split_part(f, '=', 1))) = 'q'),
        lambda f: TRY_CAST(trim(split_part(f, '=', 2)) AS FLOAT)), lambda v: v IS NOT NULL)[1], 1), 0), 1) AS q FROM r),
      s AS (SELECT pub_seq, max(CASE WHEN {a} IS NOT NULL THEN {{'s': {a}, 'q': q}} END) AS a, max(CASE WHEN {b} IS NOT NULL THEN {{'s': {b}, 'q': q}} END) AS b FROM p GROUP BY pub_seq),
      k AS (SELECT pub_seq, CASE WHEN a.q > 0 THEN a END AS a, CASE WHEN b.q > 0 THEN b END AS b FROM s)
      SELECT x.pub_seq, CASE WHEN coalesce(trim(accept), '') = '' THEN '{default}' WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL THEN '{names[0]}' WHEN a IS NULL THEN '{names[1]}'
        WHEN b.q > a.q OR (b.q = a.q AND b.s > 0{' AND b.s >= a.s' if compare else ''}) THEN '{names[1]}' ELSE '{names[0]}' END AS representation FROM x LEFT JOIN k USING (pub_seq)"""


@R.add(_negotiation_sql(tuple(t for t, r in H.PYTHON_TYPES.items() if r == "html"), tuple(t for t, r in H.PYTHON_TYPES.items() if r == "json"), ("html", "json"), "html", True, True))
def f18_negotiate_python(spark: SparkSession, folder: str) -> DataFrame:
    return through_distinct(portable(spark, folder, _ACCEPTS), "accept", "representation", H.negotiate_python).select("pub_seq", "representation")


@R.add(_negotiation_sql(("application/json",), ("application/vnd.npm.install-v1+json",), ("full", "install-v1"), "full", False, False))
def f19_negotiate_npm(spark: SparkSession, folder: str) -> DataFrame:
    return through_distinct(portable(spark, folder, _ACCEPTS), "accept", "representation", H.negotiate_npm).select("pub_seq", "representation")


@R.add(f"""SELECT representation AS variant, CASE representation WHEN 'html' THEN '{H.UPSTREAM_ACCEPT["html"]}' WHEN 'json' THEN '{H.UPSTREAM_ACCEPT["json"]}' END AS upstream_accept, CAST(count(*) AS BIGINT) AS n
  FROM ({SQL["f18_negotiate_python"]}) GROUP BY 1, 2""")
def f20_upstream_accept(spark: SparkSession, folder: str) -> DataFrame:
    variants = f18_negotiate_python(spark, folder).groupBy(F.col("representation").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    return variants.select("variant", H.upstream_accept(F.col("variant")).alias("upstream_accept"), "n")


_FILES = "SELECT DISTINCT pub_seq, route AS name, CASE pub_seq % 4 WHEN 0 THEN '1.' || CAST(pub_seq AS STRING) WHEN 1 THEN '' WHEN 2 THEN 'a/b' ELSE '0.1.0' END AS version, coalesce(digest, '') || CASE pub_seq % 3 WHEN 0 THEN '.metadata' WHEN 1 THEN '.asc' ELSE '.whl' END AS path FROM {put_record}"


@R.add(f"""SELECT pub_seq, CASE WHEN path LIKE '%.metadata' THEN '.metadata' WHEN path LIKE '%.asc' THEN '.asc' ELSE '' END AS suffix, regexp_replace(path, '[.](metadata|asc)$', '') AS encoded,
  CASE WHEN version = '' OR name LIKE '%/%' OR version LIKE '%/%' THEN NULL ELSE name || '/' || name || '-' || version || '.crate' END AS crate FROM ({plain(_FILES)})""")
def f27_f28_package_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _FILES)
    return rows.select("pub_seq", *(c.alias(n) for n, c in H.python_file_suffix(F.col("path")).items()), H.crate_path(F.col("name"), F.col("version")).alias("crate"))


@R.add("""SELECT channel_id, '{"dl":"/channels/' || channel_id || '/proxy/cargo/crates","api":null,"auth-required":' || CAST(protected AS VARCHAR) || '}' AS document FROM channel_record""")
def f29_cargo_config(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "channel_record").select("channel_id", H.cargo_config(F.concat(F.lit("/channels/"), "channel_id"), F.col("protected")).alias("document"))


_HEADERS = "SELECT event_id, CASE event_type WHEN 'view' THEN 'prefetch' WHEN 'click' THEN 'Prefetch' END AS purpose, CASE user_id % 5 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN '+3' WHEN 2 THEN '-4' WHEN 3 THEN '99999999999999999999' ELSE 'x' END AS number FROM {events}"


@R.add(f"""SELECT event_id, coalesce(purpose = 'prefetch', false) AS prefetch, CASE WHEN regexp_full_match(number, '[+]?[0-9]+') AND TRY_CAST(ltrim(number, '+') AS UBIGINT) IS NOT NULL THEN CAST(least(TRY_CAST(ltrim(number, '+') AS UBIGINT), 9223372036854775807) AS BIGINT) END AS number FROM ({plain(_HEADERS)})""")
def f37_f41_header_numbers(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _HEADERS)
    return rows.select("event_id", F.coalesce(F.col("purpose") == "prefetch", F.lit(False)).alias("prefetch"), H.saturating(H.unsigned(F.col("number")).cast("decimal(38,0)")).alias("number"))


_ERRORS = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'digest_mismatch' WHEN 1 THEN 'too_large' WHEN 2 THEN 'channel_deleting' WHEN 3 THEN 'missing_channel' WHEN 4 THEN 'out_of_space' WHEN 5 THEN 'busy' ELSE 'unauthorized' END AS error, CASE WHEN user_id % 2 = 0 THEN true ELSE false END AS best_effort FROM {events}"


@R.add(f"""SELECT error, best_effort, CAST(CASE WHEN error = 'out_of_space' AND best_effort THEN 200 WHEN error = 'digest_mismatch' THEN 409 WHEN error = 'too_large' THEN 413 WHEN error IN ('channel_deleting', 'missing_channel') THEN 404
  WHEN error = 'out_of_space' THEN 507 ELSE 500 END AS INTEGER) AS write_status, CAST(CASE error WHEN 'unauthorized' THEN 401 ELSE 500 END AS INTEGER) AS channel_status, CAST(CASE error WHEN 'busy' THEN 429 ELSE 502 END AS INTEGER) AS proxy_status, CAST(count(*) AS BIGINT) AS n
  FROM ({plain(_ERRORS)}) GROUP BY ALL""")
def f38_error_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = portable(spark, folder, _ERRORS).groupBy("error", "best_effort").agg(F.count(F.lit(1)).alias("n"))
    error = F.col("error")
    write = F.when((error == "out_of_space") & F.col("best_effort"), 200).otherwise(H.lookup(error, H.WRITE_STATUS, 500))
    return rows.select("error", "best_effort", write.alias("write_status"), H.lookup(error, H.CHANNEL_STATUS, 500).alias("channel_status"), H.lookup(error, H.PROXY_STATUS, 502).alias("proxy_status"), "n")


@R.add("SELECT coalesce(sum(CASE WHEN content_len >= 0 THEN CAST(content_len AS HUGEINT) * 1000000000000 END) > 9223372036854775807, false) AS saturated, CAST(least(sum(CASE WHEN content_len >= 0 THEN CAST(content_len AS HUGEINT) * 1000000000000 END), 9223372036854775807) AS BIGINT) AS gauge FROM put_record")
def f40_saturated_gauge(spark: SparkSession, folder: str) -> DataFrame:
    huge = F.when(F.col("content_len") >= 0, F.col("content_len").cast("decimal(19,0)") * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(28,0)")
    total = table(spark, folder, "put_record").agg(F.sum(huge).alias("t"))
    return total.select(F.coalesce(F.col("t") > F.lit(str(2**63 - 1)).cast("decimal(38,0)"), F.lit(False)).alias("saturated"), H.saturating(F.col("t")).alias("gauge"))


_RESPONSES = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 301 WHEN 1 THEN 302 WHEN 2 THEN 303 WHEN 3 THEN 304 WHEN 4 THEN 307 WHEN 5 THEN 308 WHEN 6 THEN 200 ELSE 300 END AS status FROM {events}"


@R.add(f"SELECT status IN (301, 302, 303, 307, 308) AS redirect, CAST(count(*) AS BIGINT) AS n FROM ({plain(_RESPONSES)}) GROUP BY 1")
def proj_p12_redirects(spark: SparkSession, folder: str) -> DataFrame:
    return portable(spark, folder, _RESPONSES).groupBy(F.col("status").isin(*H.REDIRECTS).alias("redirect")).agg(F.count(F.lit(1)).alias("n"))


_SENT = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Connection' WHEN 1 THEN 'host' WHEN 2 THEN 'Accept' WHEN 3 THEN 'TE' WHEN 4 THEN 'content-length' ELSE 'Expect' END AS name, event_type AS value FROM {events}"


@R.add(f"""SELECT event_id, name, lower(name) NOT IN ({", ".join(f"'{h}'" for h in H.REQUEST_HOP_HEADERS)}) AS to_backend, lower(name) NOT IN ({", ".join(f"'{h}'" for h in H.RESPONSE_HOP_HEADERS)}) AS to_client FROM ({plain(_SENT)})""")
def proj_p9_hop_headers(spark: SparkSession, folder: str) -> DataFrame:
    headers = F.create_map("name", "value")
    kept = lambda dropped: F.size(H.kept_headers(headers, dropped)) > 0
    return portable(spark, folder, _SENT).select("event_id", "name", kept(H.REQUEST_HOP_HEADERS).alias("to_backend"), kept(H.RESPONSE_HOP_HEADERS).alias("to_client"))
