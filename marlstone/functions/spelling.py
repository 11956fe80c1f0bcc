"""Canonical forms of digests, channel ids and labels that come in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode, as the inside of a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same for DuckDB's regular expressions.
SPACE_RE2 = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_DIGEST = rf"\A[{SPACE}]*(?:[sS][hH][aA]256[:/-])?([0-9a-fA-F]{{64}})[{SPACE}]*\z"


def digest_hex(col: Column) -> Column:
    """64 lower-case hex digits, or null where the value isn't a usable SHA-256 digest."""
    plain = F.when(col.rlike(r"\A[0-9a-f]{64}\z"), col)
    return F.coalesce(plain, F.lower(F.nullif(F.regexp_extract(col, _DIGEST, 1), F.lit(""))))


def digest_bytes(col: Column) -> Column:
    """The 32 bytes of a usable digest, else null: half the width of hex in a shuffle."""
    return F.unhex(digest_hex(col))


def stripped(col: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(col, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def channel_key(col: Column) -> Column:
    """A channel id in the canonical upper case; null stays null."""
    return F.upper(F.when(col.rlike(r"\A[0-9A-Za-z]*\z"), col).otherwise(stripped(col)))


def encoding_key(col: Column) -> Column:
    """A stored encoding in lower case without surrounding blanks; null and blank are null."""
    return F.nullif(F.lower(stripped(col)), F.lit(""))


def digest_sql(col: str) -> str:
    """digest_hex for DuckDB."""
    bare = f"lower(regexp_replace({col}, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+$', '', 'g'))"
    return f"nullif(regexp_extract({bare}, '^(?:sha256[:/-])?([0-9a-f]{{64}})$', 1), '')"


def channel_sql(col: str) -> str:
    """channel_key for DuckDB."""
    return f"upper(regexp_replace({col}, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+$', '', 'g'))"


def encoding_sql(col: str) -> str:
    """encoding_key for DuckDB."""
    return f"nullif(lower(regexp_replace({col}, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+$', '', 'g')), '')"
