"""Scalar functions against the cases of FIXTURES.md."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.functions import http as H
from marlstone.functions import identity as I
from marlstone.functions import rewriting as W
from marlstone.functions import spelling as S
from marlstone.operators.manifest import module_path
from marlstone.operators.ring import ring_owners, ring_points
from marlstone.functions.timing import backoff_after, next_backoff, refresh_bounds
from marlstone.settings import Settings

FIXTURES = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()
A = "0f7fe6f9a72d9298a0295e64c400b485b0a4118bcdcd7d100e9d9c1a1ea115c5"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vectors():
    """Routing vectors as the fixtures list them: kind, id, position, owner."""
    part = FIXTURES.split("### A1.")[1].split("### A2.")[0]
    digests = dict(re.findall(r"([AB]) = `([0-9a-f]{64})`", part))
    rows = re.findall(r"^\| ([a-z-]+) \| (\S+) \| ([0-9a-f]{16}) \| (\S+) \|$", part, re.MULTILINE)
    version = re.search(r"Version string `([^`]+)`", part)[1]
    stem, rest = re.search(r"Members: `([^`{]+)\{0,1,2\}([^`]+)`", part).groups()
    return version, [f"{stem}{i}{rest}" for i in range(3)], [(k, digests.get(i, i), p, o) for k, i, p, o in rows]


def test_routing_vectors(spark):
    version, members, rows = vectors()
    assert len(rows) == 8
    keys = spark.createDataFrame(rows, "kind string, id string, expected string, owner_stem string")
    keys = keys.withColumn("position", I.ring_position(I.routing_key(F.col("kind"), F.col("id"), version)))
    found = ring_owners(keys, spark.createDataFrame([(m,) for m in reversed(members + members[:1])], "member string")).collect()
    assert len(found) == 8
    for r in found:
        assert r["position"] == r["expected"]
        assert r["owner"].split(".")[0] == r["owner_stem"]


def test_routing_key_length_limit(spark):
    key = lambda n: one(spark, I.routing_key(F.lit("artifact"), F.repeat(F.lit("é"), n)))
    assert key(32_767) is not None  # 65,534 bytes
    assert key(32_768) is None


def test_empty_ring_owns_nothing(spark):
    keys = spark.createDataFrame([("0" * 16,), (None,)], "position string")
    assert [r["owner"] for r in ring_owners(keys, spark.createDataFrame([], "member string")).collect()] == [None, None]


def test_ring_balance(spark):
    members = spark.createDataFrame([(f"member-{i}",) for i in range(4)], "member string")
    assert ring_points(members).count() == 640
    keys = spark.range(12_000).select(F.concat(F.lit("output-"), "id").alias("id")).withColumn("position", I.ring_position(I.routing_key(F.lit("artifact"), F.col("id"))))
    before = {r["id"]: r["owner"] for r in ring_owners(keys, members).collect()}
    after = {r["id"]: r["owner"] for r in ring_owners(keys, members.filter("member <> 'member-2'")).collect()}
    moved = [k for k in before if before[k] != after[k]]
    assert all(before[k] == "member-2" for k in moved)
    assert 0.15 < len(moved) / len(before) < 0.35


@pytest.mark.parametrize(
    ("method", "path", "kind", "key", "route_class"),
    [
        ("GET", f"/artifacts/sha256/{A}", "artifact", A, "passthrough"),
        ("PUT", f"/build-cache/bazel/cas/{A}", "artifact", A, "build_cache_write"),
        ("HEAD", "/build-cache/http/some-key", "http-cache", "some-key", "build_cache_read"),
        ("PUT", "/build-cache/http/some-key", "http-cache", "some-key", "build_cache_write"),
        ("DELETE", "/build-cache/http/some-key", "http-cache", "some-key", "passthrough"),
        ("GET", f"/build-cache/bazel/ac/{A}", "bazel-action", A, "build_cache_read"),
        ("GET", "/references/latest", "reference", "latest", "passthrough"),
        ("GET", "/proxy/go/github.com/foo/@v/v1.0.0.zip", "go", "github.com/foo/@v/v1.0.0.zip", "passthrough"),
        ("GET", "/proxy/cargo/index/config.json", "cargo", "index/config.json", "passthrough"),
        ("GET", "/future/route", "path", "/future/route", "passthrough"),
        ("GET", "/proxy/go", "path", "/proxy/go", "passthrough"),
    ],
)
def test_routes(spark, method, path, kind, key, route_class):
    found = H.route(F.lit(method), F.lit(path))
    assert spark.range(1).select(*found.values()).first() == (kind, key, route_class)


@pytest.mark.parametrize(
    ("header", "size", "expected"),
    [
        ("bytes=2-5", 10, ("partial", 2, 5)), ("bytes=broken", 10, ("full", None, None)), ("items=0-1", 10, ("full", None, None)), ("bytes=18446744073709551616-", 10, ("full", None, None)),
        ("bytes=0-18446744073709551616", 10, ("full", None, None)), ("bytes=0-18446744073709551615", 10, ("partial", 0, 9)), ("bytes=0-1,4-5", 10, ("full", None, None)), ("bytes=5-4", 10, ("full", None, None)),
        ("bytes=20-30", 10, ("unsatisfiable", None, None)), ("bytes=-0", 10, ("unsatisfiable", None, None)), ("bytes=-3", 10, ("partial", 7, 9)), ("bytes=-30", 10, ("partial", 0, 9)), ("bytes=4-", 10, ("partial", 4, 9)),
        ("bytes=+2-5", 10, ("partial", 2, 5)), ("bytes=+-5", 10, ("full", None, None)), ("bytes=0-0", 0, ("unsatisfiable", None, None)), ("bytes=-1", 0, ("unsatisfiable", None, None)), ("bytes=-", 10, ("full", None, None)),
        (None, 10, ("full", None, None)), ("bytes=99999999999999999999-3", 10, ("full", None, None)), ("bytes=000000000000000000000002-5", 10, ("partial", 2, 5)),
    ],
)
def test_byte_ranges(spark, header, size, expected):
    found = H.byte_range(F.lit(header).cast("string"), F.lit(size))
    assert spark.range(1).select(*found.values()).first() == expected


@pytest.mark.parametrize(
    ("accept", "python", "npm"),
    [
        ("application/vnd.pypi.simple.v1+json;q=0.1, text/html;q=1", "html", None),
        ("application/vnd.pypi.simple.v1+json", "json", None), ("application/xml", None, None), (None, "html", "full"), (" ", "html", "full"), ("*/*", "html", "full"),
        ("application/*", "json", "install-v1"), ("application/json", None, "full"), ("application/vnd.npm.install-v1+json, application/json", None, "install-v1"),
        ("application/json;q=0, */*", "html", "install-v1"), ("text/html;q=x;q=0.2, application/vnd.pypi.simple.latest+json; Q=0.3", "json", None),
    ],
)
def test_negotiation(spark, accept, python, npm):
    a = F.lit(accept).cast("string")
    assert spark.range(1).select(H.negotiate_python(a), H.negotiate_npm(a)).first() == (python, npm)


def test_identities(spark):
    is_digest = lambda v: one(spark, I.is_digest(F.lit(v).cast("string")))
    assert is_digest(A)
    assert not any(map(is_digest, (A.upper(), "abcd", A + "\n", None)))
    assert one(spark, I.artifact_digest(F.lit("sha512"), F.lit(A))) is None
    assert one(spark, I.is_channel_id(F.lit(I.DEFAULT_CHANNEL)))
    assert not one(spark, I.is_channel_id(F.lit("01jhnpcd0wt4g8h1trmhv5ffmg")))
    name = lambda v: one(spark, I.is_reference_name(F.lit(v)))
    assert name("some-key_1.2~x")
    assert not any(map(name, ("", "has/a/slash", "x" * 513)))


def test_spelling(spark):
    for v in (A, A.upper(), f"  {A}\t", f"SHA256:{A}", f"\xa0sha256-{A.upper()}　", f"sha256/{A}\r\n"):
        assert one(spark, S.digest_hex(F.lit(v))) == A
    for v in (None, "", A[:-1], A + "0", f"sha512:{A}", f"sha256:sha256:{A}", f"sha256 {A}", A[:-1] + "g"):
        assert one(spark, S.digest_hex(F.lit(v).cast("string"))) is None
    assert one(spark, S.channel_key(F.lit("  01jhnp \n"))) == "01JHNP"
    assert one(spark, S.encoding_key(F.lit(" ZStd "))) == "zstd"
    assert one(spark, S.encoding_key(F.lit("  "))) is None


def test_key_lengths(spark):
    c, d = F.lit(I.DEFAULT_CHANNEL), F.lit(A)
    lengths = [one(spark, F.length(k)) // 2 for k in (I.artifact_key(c, d), I.eviction_key(c, F.lit(7), d), I.reference_key(c, F.lit("name")))]
    assert lengths == [58, 66, 30]
    back = I.decode_eviction_key(I.eviction_key(c, F.lit(7), d), c)
    assert spark.range(1).select(*back.values()).first() == (7, A)
    assert one(spark, I.decode_eviction_key(I.eviction_key(c, F.lit(7), d), F.lit("1" * 26))["digest"]) is None


def test_credentials(spark):
    found = lambda v: one(spark, I.credential(F.lit(v).cast("string")))
    assert found("Bearer abc") == "abc"
    assert found("Basic dXNlcjpwYTpzcw==") == "pa:ss"
    assert found("Basic dXNlcg==") is None
    assert found("Basic ***") is None
    assert found("token_x") == "token_x"
    assert found("Digest x") is None
    assert found(None) is None


def test_base64url(spark):
    text = "né" * 60 + "?>"
    encoded = one(spark, I.base64url(F.lit(text)))
    assert not set("+/=\r\n") & set(encoded)
    assert one(spark, F.decode(I.from_base64url(F.lit(encoded)), "UTF-8")) == text
    assert one(spark, I.from_base64url(F.lit("a*"))) is None


@pytest.mark.parametrize(
    ("text", "module"),
    [("// x\nmodule example.com/widget\ngo 1.22", "example.com/widget"), ('module "example.com/w" // c', "example.com/w"), ("go 1.22\n", None), ("modulefoo", "foo"), ("module\nmodule m", "m")],
)
def test_module_path(spark, text, module):
    assert one(spark, module_path(F.lit(text))) == module


ALLOWED = frozenset({"https://files.example:443"})


def test_rewrite_html():
    page = '<!-- <a href="/no">c</a> --><a href="/pkg.whl?x=1&amp;y=2#sha256=ab" data-provenance="https://files.example/p">f</a><a href=https://no.example/x>g</a><abbr href="/k">'
    out = W.rewrite_html("https://files.example/simple/p/", "/channels/c", True, page, ALLOWED)
    assert '<!-- <a href="/no">c</a> -->' in out
    assert out.count("/channels/c/proxy/python/files/") == 2
    assert "#sha256=ab" in out
    assert "https://no.example/x" in out
    assert '<abbr href="/k">' in out
    index = W.rewrite_html("https://files.example/simple/", "", False, '<a href="widget/">w</a><a href="/up/">u</a>', ALLOWED)
    assert index == '<a href="/proxy/python/simple/widget/">w</a><a href="/up/">u</a>'


def test_rewrite_json():
    document = '{"meta":{"k":[1]},"files":[{"url":"https://files.example/w#sha256=abc123","requires-python":">=3"},{"url":"https://no.example/x"}]}'
    out = W.rewrite_index_json("https://files.example/simple/w/", "", True, document, ALLOWED)
    assert '"requires-python":">=3"' in out
    assert "#sha256=abc123" in out
    assert "https://no.example/x" in out
    assert W.rewrite_index_json("https://files.example/", "", False, document, ALLOWED) == document
    assert W.rewrite_index_json("https://files.example/", "", True, "{", ALLOWED) is None
    npm = W.rewrite_tarballs("https://files.example/@s/n", "/p", '{"a":[{"tarball":"t.tgz#f"}],"tarball":{"tarball":"x"}}', ALLOWED)
    assert npm.startswith('{"a":[{"tarball":"/p/proxy/npm/-/tarball/')
    assert npm.endswith('"tarball":{"tarball":"x"}}')


def test_origins(spark):
    origin = lambda v: one(spark, W.url_origin(F.lit(v).cast("string")))
    assert origin("HTTPS://User:p@Files.Example/x") == "https://files.example:443"
    assert origin("http://a:81") == "http://a:81"
    assert origin("http://[::1]:8/x") == "http://[::1]:8"
    assert all(origin(v) is None for v in ("ftp://a/", "/x", "", None))


def test_settings():
    assert Settings().low == 2 << 30
    for bad in ({"low": 9 << 30}, {"extent": 0}, {"headroom": -1}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_refreshes(spark):
    assert [one(spark, c) for c in refresh_bounds(F.lit(1), 10, 100)] == [7_000, 9_000]
    assert [one(spark, c) for c in refresh_bounds(F.lit(500), 10, 100)] == [70_000, 90_000]
    assert one(spark, next_backoff(F.lit(40), 60)) == 60
    assert [one(spark, backoff_after(F.lit(n), 1, 60)) for n in (0, 1, 2, 6, 7, 10_000)] == [None, 1, 2, 32, 60, 60]
