"""Identities, keys and references of the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The channel that exists without being registered.
DEFAULT_CHANNEL = "0" * 26
#: Names the version of the routing key's form; part of what is hashed.
ROUTING_VERSION = "routing-v1"
#: Fixed value: points that each member has on the ring.
VIRTUAL_NODES = 160
#: Fixed value: the first characters of a token that comes without a scheme.
TOKEN_PREFIX = "token_"
#: Fixed value: what a manifest is stored under, before the digest of its label.
MANIFEST_PREFIX = "go-manifest-"


def body_digest(body: Column) -> Column:
    """SHA-256 of the logical bytes, in lower-case hex."""
    return F.sha2(body.cast("binary"), 256)


def is_digest(value: Column) -> Column:
    """Exactly 64 lower-case hex digits; null is not."""
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def artifact_digest(algorithm: Column, digest: Column) -> Column:
    """The digest of an artifact id, or null unless the algorithm is sha256 and the digest canonical."""
    return F.when((algorithm == "sha256") & is_digest(digest), digest)


def artifact_id(digest: Column) -> Column:
    return F.concat(F.lit("sha256:"), digest)


def is_channel_id(value: Column) -> Column:
    """A canonical ULID: 26 upper-case Crockford digits below 2^128."""
    return F.coalesce(value.rlike(r"\A[0-7][0-9A-HJKMNP-TV-Z]{25}\z"), F.lit(False))


# Fixed value: Crockford's digits.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _crockford(number: Column, digits: int) -> list[Column]:
    return [F.substring(F.lit(CROCKFORD), (F.shiftright(number, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(digits - 1, -1, -1)]


def channel_ulid(millis: Column, high: Column, low: Column) -> Column:
    """A ULID of its time and 80 random bits, given as two numbers below 2^40. The default channel's is no new one: null.

    What is random is an input, so that a plan that is run again makes the same ids.
    """
    made = F.concat(*_crockford(millis, 10), *_crockford(high, 8), *_crockford(low, 8))
    return F.nullif(made, F.lit(DEFAULT_CHANNEL))


#: Fixed value: stripes that writes of equal artifacts are kept apart by.
STRIPES = 512


def stripe(channel: Column, digest: Column) -> Column:
    """The stripe of an artifact: the same for equal ones, 0 to STRIPES - 1."""
    return F.pmod(F.xxhash64(channel, digest), F.lit(STRIPES)).cast("int")


def is_reference_name(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9._~-]{1,512}\z"), F.lit(False))


def _sized(part: Column, digits: int) -> Column:
    """A part with its length in bytes before it, big-endian in so many hex digits; null if the length doesn't fit."""
    size = F.octet_length(part)
    fits = size < (1 << (4 * digits)) if digits < 8 else F.lit(True)
    return F.when(fits, F.concat(F.unhex(F.lpad(F.hex(size.cast("bigint")), digits, "0")), F.encode(part, "UTF-8")))


def routing_key(kind: Column, key: Column, version: str = ROUTING_VERSION) -> Column:
    """Version, kind and id, each with a 16-bit length; null if a part is too long."""
    return F.concat(*(_sized(p, 4) for p in (F.lit(version), kind, key)))


def ring_position(data: Column) -> Column:
    """The first eight bytes of the SHA-256, as 16 hex digits whose order is that of the unsigned number."""
    return F.substring(F.sha2(data, 256), 1, 16)


def member_key(member: Column) -> Column:
    """A host name without trailing dots and in lower case."""
    return F.lower(F.regexp_replace(member, r"[.]+\z", ""))


def member_point(member: Column, node: Column) -> Column:
    """A member's point for one of its virtual nodes."""
    return ring_position(F.concat(F.encode(member, "UTF-8"), F.unhex(F.lpad(F.hex(node.cast("bigint")), 4, "0"))))


def manifest_key(label: Column) -> Column:
    return F.concat(F.lit(MANIFEST_PREFIX), F.sha2(label.cast("binary"), 256))


def proxy_reference(protocol: Column, url: Column, variant: Column) -> Column:
    """The reference of a proxied document: protocol, and a digest over the sized URL and the representation."""
    data = F.concat(_sized(url, 16), F.encode(variant, "UTF-8"))
    return F.concat(F.lit("proxy:"), protocol, F.lit(":"), F.sha2(data, 256))


def build_reference(kind: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("build"), kind, key)


def token_matches(candidate: Column, stored: Column) -> Column:
    """Whether the candidate's digest is the stored one; false where either is missing."""
    return F.coalesce(F.sha2(candidate.cast("binary"), 256) == stored, F.lit(False))


def credential(authorization: Column, prefix: str = TOKEN_PREFIX) -> Column:
    """The token of an Authorization value: after "Bearer ", the password of "Basic ", or a bare token."""
    decoded = F.try_to_binary(F.substr(authorization, F.lit(7)), F.lit("base64"))
    basic = F.regexp_extract(F.decode(decoded, "UTF-8"), r"(?s)\A[^:]*:(.*)\z", 1)
    has_colon = F.decode(decoded, "UTF-8").contains(":")
    return (
        F.when(authorization.startswith("Bearer "), F.substr(authorization, F.lit(8)))
        .when(authorization.startswith("Basic "), F.when(has_colon, basic))
        .when(authorization.startswith(prefix), authorization)
    )


def base64url(data: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.base64(data.cast("binary")), "+/=\r\n", "-_")


def from_base64url(text: Column) -> Column:
    """The bytes of URL-safe base64 without padding; null where it is none."""
    valid = text.rlike(r"\A[A-Za-z0-9_-]*\z") & (F.pmod(F.length(text), F.lit(4)) != 1)
    padded = F.rpad(F.translate(text, "-_", "+/"), ((F.length(text) + 3) / 4).cast("int") * 4, "=")
    return F.when(valid, F.try_to_binary(padded, F.lit("base64")))


def body_path(channel: Column, digest: Column) -> Column:
    """Where a body is stored: <channel>/sha256/aa/bb/<digest>."""
    return F.concat_ws("/", channel, F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def artifact_key(channel: Column, digest: Column) -> Column:
    """The 58-byte key of an artifact, in hex."""
    return F.concat(F.lower(F.hex(F.encode(channel, "UTF-8"))), digest)


def eviction_key(channel: Column, deadline: Column, digest: Column) -> Column:
    """The 66-byte key of a queue row, in hex; its order is that of channel, deadline and digest."""
    return F.concat(F.lower(F.hex(F.encode(channel, "UTF-8"))), F.lower(F.lpad(F.hex(deadline), 16, "0")), digest)


def reference_key(channel: Column, name: Column) -> Column:
    return F.lower(F.hex(F.encode(F.concat(channel, name), "UTF-8")))


def decode_eviction_key(key: Column, channel: Column) -> dict[str, Column]:
    """eligible_at and digest of a queue key of the channel; null where length or channel are wrong."""
    right = (F.octet_length(channel) == 26) & (F.length(key) == 132) & key.startswith(F.lower(F.hex(F.encode(channel, "UTF-8"))))
    return {
        "eligible_at": F.when(right, F.conv(F.substring(key, 53, 16), 16, 10).cast("bigint")),
        "digest": F.when(right, F.substring(key, 69, 64)),
    }
