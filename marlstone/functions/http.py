"""Requests and responses: routes, byte ranges, negotiation, header rules and status codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers that end at each hop.
REQUEST_HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "expect")
RESPONSE_HOP_HEADERS = ("connection", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")
# Redirects that are followed.
REDIRECTS = (301, 302, 303, 307, 308)
# What each error is answered with.
CHANNEL_STATUS = {"not_found": 404, "unauthorized": 401, "deleting": 404, "default_channel": 409}
WRITE_STATUS = {"digest_mismatch": 409, "too_large": 413, "channel_deleting": 404, "missing_channel": 404, "out_of_space": 507}
PROXY_STATUS = {"busy": 429, "disallowed_origin": 403, "invalid_encoded_url": 502, "url": 502, "malformed": 502}
# Media types of package indexes, by representation.
PYTHON_TYPES = {
    "application/vnd.pypi.simple.v1+json": "json", "application/vnd.pypi.simple.latest+json": "json",
    "application/vnd.pypi.simple.v1+html": "html", "application/vnd.pypi.simple.latest+html": "html", "text/html": "html",
}
NPM_TYPES = {"application/vnd.npm.install-v1+json": "install-v1", "application/json": "full"}
UPSTREAM_ACCEPT = {
    "html": "application/vnd.pypi.simple.v1+html", "json": "application/vnd.pypi.simple.v1+json",
    "install-v1": "application/vnd.npm.install-v1+json", "full": "application/json",
}

U64_MAX = 2**64 - 1


def lookup(value: Column, table: dict, default=None) -> Column:
    """The table's entry for a value, else the default."""
    out = F.lit(default)
    for key, entry in reversed(table.items()):
        out = F.when(value == key, F.lit(entry)).otherwise(out)
    return out


def unsigned(text: Column) -> Column:
    """A decimal number below 2^64, also with a leading plus, as decimal(20,0); null for anything else."""
    digits = F.regexp_extract(text, r"\A\+?([0-9]+)\z", 1)
    bare = F.regexp_replace(digits, r"\A0+(?=.)", "")
    number = F.when((digits != "") & (F.length(bare) <= 20), bare).try_cast("decimal(38,0)")
    return F.when(number <= F.lit(str(U64_MAX)).cast("decimal(38,0)"), number.cast("decimal(20,0)"))


def byte_range(header: Column, length: Column) -> dict[str, Column]:
    """kind (full, partial, unsatisfiable), start and end (inclusive) of a Range value for a body of `length` bytes."""
    spec = F.substr(header, F.lit(7))
    applies = header.startswith("bytes=") & ~spec.contains(",") & spec.contains("-")
    left, right = F.regexp_extract(spec, r"(?s)\A([^-]*)-", 1), F.regexp_extract(spec, r"(?s)\A[^-]*-(.*)\z", 1)
    first, last, size = unsigned(left), unsigned(right), length.cast("decimal(20,0)")
    suffix, open_end = left == "", right == ""
    end = F.when(open_end, size - 1).otherwise(F.least(last, size - 1))
    kind = (
        F.when(~F.coalesce(applies, F.lit(False)), "full")
        .when(suffix & last.isNull(), "full")
        .when(suffix & ((last == 0) | (size == 0)), "unsatisfiable")
        .when(suffix, "partial")
        .when(first.isNull() | (~open_end & last.isNull()), "full")
        .when(~open_end & (last < first), "full")
        .when(first >= size, "unsatisfiable")
        .otherwise("partial")
    )
    begin = F.when(suffix, F.greatest(size - last, F.lit(0).cast("decimal(20,0)"))).otherwise(first)
    partial = kind == "partial"
    return {"kind": kind, "start": F.when(partial, begin.cast("bigint")), "end": F.when(partial, F.when(suffix, size - 1).otherwise(end).cast("bigint"))}


def accepts_zstd(header: Column) -> Column:
    """Whether an Accept-Encoding value names zstd, whatever its quality."""
    return F.coalesce(F.exists(F.split(header, ","), lambda x: F.lower(F.trim(F.split(x, ";")[0])) == "zstd"), F.lit(False))


def _ranges(accept: Column) -> Column:
    """type and quality of each media range, in order."""
    def parse(text: Column) -> Column:
        fields = F.split(text, ";")
        named = F.filter(F.slice(fields, F.lit(2), F.size(fields)), lambda f: F.lower(F.trim(F.split(f, "=", 2)[0])) == "q")
        values = F.filter(F.transform(named, lambda f: F.trim(F.get(F.split(f, "=", 2), 1)).try_cast("float")), lambda v: v.isNotNull())
        quality = F.coalesce(F.get(values, 0), F.lit(1.0).cast("float"))
        return F.struct(F.lower(F.trim(fields[0])).alias("type"), F.least(F.greatest(quality, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")).alias("quality"))

    return F.transform(F.split(accept, ","), parse)


def _best(ranges: Column, levels: dict[str, int]) -> Column:
    """(specificity, quality) of the best range for a representation: the most specific, then the greatest quality."""
    level = lambda r: lookup(r["type"], levels)
    scored = F.transform(F.filter(ranges, lambda r: level(r).isNotNull()), lambda r: F.struct(level(r).alias("specificity"), r["quality"].alias("quality")))
    best = F.array_max(scored)
    return F.when(best["quality"] > 0, best)


def negotiate_python(accept: Column) -> Column:
    """html or json for an Accept value; null where neither is acceptable. A missing or blank value gives html."""
    ranges = _ranges(accept)
    html = _best(ranges, {t: 2 for t, r in PYTHON_TYPES.items() if r == "html"} | {"application/*": 1, "text/*": 1, "*/*": 0})
    json = _best(ranges, {t: 2 for t, r in PYTHON_TYPES.items() if r == "json"} | {"application/*": 1, "*/*": 0})
    prefers = (json["quality"] > html["quality"]) | ((json["quality"] == html["quality"]) & (json["specificity"] > 0) & (json["specificity"] >= html["specificity"]))
    return (
        F.when(F.coalesce(F.trim(accept), F.lit("")) == "", "html")
        .when(html.isNull() & json.isNull(), None)
        .when(json.isNull() | (html.isNotNull() & ~prefers), "html")
        .otherwise("json")
    )


def negotiate_npm(accept: Column) -> Column:
    """install-v1 (abbreviated) or full; null where neither is acceptable. A missing or blank value gives full."""
    ranges = _ranges(accept)
    short = _best(ranges, {"application/vnd.npm.install-v1+json": 2, "application/*": 1, "*/*": 0})
    full = _best(ranges, {"application/json": 2, "application/*": 1, "*/*": 0})
    prefers = (short["quality"] > full["quality"]) | ((short["quality"] == full["quality"]) & (short["specificity"] > 0))
    return (
        F.when(F.coalesce(F.trim(accept), F.lit("")) == "", "full")
        .when(short.isNull() & full.isNull(), None)
        .when(short.isNull() | (full.isNotNull() & ~prefers), "full")
        .otherwise("install-v1")
    )


def upstream_accept(variant: Column) -> Column:
    """The Accept value for a representation; null for documents that aren't transformed."""
    return lookup(variant, UPSTREAM_ACCEPT)


def route(method: Column, path: Column, strip_channel: bool = False) -> dict[str, Column]:
    """kind, id and class of a request. strip_channel: the path may begin with /channels/<id>."""
    bare = F.regexp_replace(path, r"\A/+", "")
    if strip_channel:
        bare = F.regexp_replace(bare, r"\Achannels/[^/]*(?:/|\z)", "")
    # Patterns of routes with a meaning of their own.
    patterns = (
        ("reference", r"\Areferences/([^/]*)\z"),
        ("http-cache", r"\Abuild-cache/http/([^/]*)\z"),
        ("bazel-action", r"\Abuild-cache/bazel/ac/([^/]*)\z"),
        ("artifact", r"\Abuild-cache/bazel/cas/([^/]*)\z"),
        ("artifact", r"\Aartifacts/[^/]*/([^/]*)\z"),
    )
    proxied = bare.rlike(r"(?s)\Aproxy/[^/]*/.*\z")
    found = F.when(proxied, F.regexp_extract(bare, r"(?s)\Aproxy/([^/]*)/(.*)\z", 1)).otherwise("path")
    key = F.when(proxied, F.regexp_extract(bare, r"(?s)\Aproxy/([^/]*)/(.*)\z", 2)).otherwise(path)
    for kind, pattern in patterns:
        found, key = F.when(bare.rlike(pattern), kind).otherwise(found), F.when(bare.rlike(pattern), F.regexp_extract(bare, pattern, 1)).otherwise(key)
    cached = bare.startswith("build-cache/") & found.isin("artifact", "bazel-action", "http-cache")
    kind_of = F.when(cached & method.isin("GET", "HEAD"), "build_cache_read").when(cached & method.isin("PUT", "POST"), "build_cache_write").otherwise("passthrough")
    return {"kind": found, "id": key, "class": kind_of}


def degraded_status(kind: Column, empty_ring: Column) -> Column:
    """What a request is answered with when its owner can't be reached."""
    return F.when(kind == "build_cache_read", 404).when(kind == "build_cache_write", 200).when(empty_ring, 503).otherwise(502)


def kept_headers(headers: Column, dropped: tuple[str, ...]) -> Column:
    """A map of headers without those that end at a hop."""
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*dropped))


def python_file_suffix(path: Column) -> dict[str, Column]:
    """encoded and suffix: a trailing .metadata or .asc is no part of the encoded URL."""
    suffix = F.when(path.endswith(".metadata"), ".metadata").when(path.endswith(".asc"), ".asc").otherwise("")
    return {"encoded": F.substring(path, F.lit(1), F.length(path) - F.length(suffix)), "suffix": suffix}


def crate_path(name: Column, version: Column) -> Column:
    """{name}/{name}-{version}.crate; null (a bad request) where a part is empty or has a slash."""
    bad = (name == "") | (version == "") | name.contains("/") | version.contains("/")
    return F.when(~bad, F.concat(name, F.lit("/"), name, F.lit("-"), version, F.lit(".crate")))


def cargo_config(prefix: Column, protected: Column) -> Column:
    """The registry configuration document; api stays in it as null."""
    return F.to_json(F.struct(F.concat(prefix, F.lit("/proxy/cargo/crates")).alias("dl"), F.lit(None).cast("string").alias("api"), protected.alias("auth-required")), {"ignoreNullFields": "false"})


def saturating(number: Column) -> Column:
    """A decimal number as bigint, cut off at the greatest one; null stays null."""
    return F.when(number.isNotNull(), F.least(number, F.lit(str(2**63 - 1)).cast("decimal(38,0)"))).cast("bigint")
