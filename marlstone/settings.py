"""Settings of a catalog, and the bounds they must keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    # Defaults in bytes and seconds.
    max_body: int = 10 << 30
    expiry_seconds: int = 7 * 86_400
    freshness_seconds: int = 300
    proxy_permits: int = 64
    foreground_permits: int = 256
    extent: int = 64 << 20
    low: int = 2 << 30
    high: int = 8 << 30
    headroom: int = 1 << 30
    candidates: int = 256
    pass_bytes: int = 8 << 30
    orphan_limit: int = 4_096

    def __post_init__(self) -> None:
        for name in ("max_body", "expiry_seconds", "proxy_permits", "foreground_permits", "extent", "candidates", "pass_bytes", "orphan_limit"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.low < 0 or self.headroom < 0 or self.freshness_seconds < 0:
            raise ValueError("thresholds can't be negative")
        if self.high < self.low:
            raise ValueError("the upper threshold is below the lower one")


# Settings of a configuration table that must be positive, in the order in which they are looked at.
POSITIVE = ("max_upload_bytes", "default_expiry_seconds", "proxy_concurrency", "upstream_timeout_seconds", "foreground_concurrency", "reservation_extent_bytes", "bloom_bits", "reclaim_candidate_limit")
#: The place of the comparison of thresholds among them.
_THRESHOLDS_AT = 6


def first_error(upstream: Column, origin: Column) -> Column:
    """The first rule that a configuration (a row with POSITIVE, low_watermark_bytes and high_watermark_bytes) breaks, or null.

    upstream must be an absolute URL; origin, where given, one of http or https with a host.
    """
    rules = [(n, ~F.coalesce(F.col(n) > 0, F.lit(False))) for n in POSITIVE]
    rules.insert(_THRESHOLDS_AT, ("high_watermark_bytes", ~F.coalesce(F.col("high_watermark_bytes") >= F.col("low_watermark_bytes"), F.lit(False))))
    rules.append(("upstream", ~F.coalesce(upstream.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:\S*\z"), F.lit(False))))
    rules.append(("allowed_origin", origin.isNotNull() & ~F.coalesce(origin.rlike(r"(?i)\Ahttps?://(?:[^/?#@\s]*@)?[^/?#@:\s]+(?::[0-9]+)?(?:[/?#]\S*)?\z"), F.lit(False))))
    return F.coalesce(*(F.when(broken, n) for n, broken in rules))
