"""References to records that don't exist.

Skew-aware split: references are pre-aggregated by key and period, with map-side combine, which also shows the heavy
keys; heavy keys are checked against a broadcast of the live ones among them, so their rows are never shuffled one by
one; all other keys are brought together once, pre-aggregated there, and go through an anti-join in which no key is
large; the orphans of both are united. A group carries its row ids in chunks of bounded size, so that counts and
rows come from the same aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all reference rows on, less than one of thousands of tasks has; so there are at most
#: 10,000 heavy keys, which is what is broadcast.
HEAVY_SHARE = 1 / 10_000
#: Hash buckets whose row counts show where heavy keys can be, in bits.
BUCKET_BITS = 16
#: A group holds the row ids of one range, of 2^CHUNK_BITS numbers.
CHUNK_BITS = 12

#: Prefixes of removals' hashes that tell which publications can have one, in bits; so many numbers are broadcast at most.
PREFIX_BITS = 20

#: Stands for the deadline of references that name none.
UNTIMED = -(2**63)

_KEY = ("_channel", "_digest", "_timed", "_eligible")
_ARTIFACT = ("_channel", "_digest")
_FOREVER = 2**63 - 1


@dataclass(frozen=True)
class Live:
    """publications: _channel, _digest, _eligible, _created; removals: _channel, _digest, _removed; neither with null keys."""

    publications: DataFrame
    removals: DataFrame


def live_artifacts(artifacts: DataFrame, removals: DataFrame, channel, digest) -> Live:
    """What tells which artifacts are there; channel and digest give the canonical form of a column.

    A publication is gone once a removal of the same channel and digest isn't before its created_at; where
    either time is null nothing is known to be removed. Rows without a usable digest or channel are never live.
    """
    published = artifacts.select(
        channel(artifacts["channel_id"]).alias("_channel"), digest(artifacts["digest"]).alias("_digest"),
        F.col("eligible_at").alias("_eligible"), F.coalesce("created_at", F.lit(_FOREVER)).alias("_created"),
    )
    removed = removals.select(channel(removals["channel_id"]).alias("_channel"), digest(removals["digest"]).alias("_digest"), F.col("removed_at").alias("_removed"))
    named = F.col("_digest").isNotNull() & F.col("_channel").isNotNull()
    return Live(published.filter(named), removed.filter(named & F.col("_removed").isNotNull()))


def reference_rows(df: DataFrame, src: str, row_id: str, period: str, channel, digest, eligible: str | None = None) -> DataFrame:
    """The common form of a table of references; rows without a usable digest refer to nothing and are left out.

    With `eligible` the reference is to the artifact with just that deadline, else to any with its channel and digest.
    A time that is null or out of the calendar gives the period null.
    """
    day = F.expr(f"date_add(date'1970-01-01', cast((`{period}` - pmod(`{period}`, 86400)) div 86400 as int))")
    return df.select(
        F.lit(src).alias("_src"),
        df[row_id].cast("bigint").alias("_row"),
        channel(df["channel_id"]).alias("_channel"),
        digest(df["digest"]).alias("_digest"),
        F.lit(eligible is not None).alias("_timed"),
        (df[eligible].cast("bigint") if eligible else F.lit(UNTIMED)).alias("_eligible"),
        F.when(df[period].between(-(2**37), 2**37), day).alias("_period"),
    ).filter(F.col("_digest").isNotNull())


def _keyed() -> Column:
    """Whether a reference names an artifact at all: no part of its key is null."""
    return F.col("_channel").isNotNull() & F.col("_eligible").isNotNull()


def pre_aggregated(refs: DataFrame) -> DataFrame:
    """_src, the key, _period, _chunk, _rows: the distinct row ids by key, period and range of ids.

    A group has 2^CHUNK_BITS ids at most, however many rows a key has; rows without an id have groups with a single null.
    """
    chunk = F.shiftright("_row", CHUNK_BITS)
    return refs.groupBy("_src", *_KEY, "_period", chunk.alias("_chunk")).agg(F.collect_set("_row").alias("_ids")).select(
        "_src", *_KEY, "_period", F.when(F.col("_chunk").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.col("_ids")).alias("_rows"),
    )


def heavy_keys(refs: DataFrame, share: float = HEAVY_SHARE) -> tuple[list[tuple], bool]:
    """The keys with at least `share` of all rows, two rows at least: at most 1 / share of them, whatever the data; and whether
    any row's key has a null.

    One count by hash bucket (at most 2^BUCKET_BITS numbers) shows the only buckets that can hold a heavy key; keys and
    periods are counted in those alone.
    """
    bucket = F.when(_keyed(), F.shiftrightunsigned(F.xxhash64(*_KEY), 64 - BUCKET_BITS))
    counts = {r["_b"]: r["_n"] for r in refs.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    keyless = counts.pop(None, 0) > 0
    bound = max(2, ceil(share * sum(counts.values())))
    if not (full := [b for b, n in counts.items() if n >= bound]):  # at most 1 / share
        return [], keyless
    by_period = refs.filter(bucket.isin(full)).groupBy(*_KEY, "_period").agg(F.count(F.lit(1)).alias("_n"))
    found = by_period.groupBy(*_KEY).agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= bound).select(*_KEY).collect()
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in found], keyless


def _same(refs: DataFrame, keys: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    return refs.join(keys, list(names), how).select(*refs.columns)


def _gone(timed: bool, groups: DataFrame, live: Live) -> DataFrame:
    """The groups, all timed or all untimed, for whose key nothing is live.

    Publications are combined by the key that references name, and only the latest counts: it outlives the removals if
    any does. Timed groups meet the removals, which don't name a deadline, after they met their publication. Of those that have
    one, only the groups that share a hash prefix with some removal are brought together once more: the others are live.
    """
    names = (*_ARTIFACT, "_eligible") if timed else _ARTIFACT
    latest = live.publications.groupBy(*names).agg(F.max("_created").alias("_created"))
    removed = live.removals.groupBy(*_ARTIFACT).agg(F.max("_removed").alias("_removed"))
    met = groups.join(latest, list(names), "left")
    if timed:
        prefix = F.shiftrightunsigned(F.xxhash64(*_ARTIFACT), 64 - PREFIX_BITS).alias("_prefix")
        suspects = F.broadcast(live.removals.select(prefix).distinct().withColumn("_suspect", F.lit(True)))  # at most 2^PREFIX_BITS numbers
        marked = met.withColumn("_prefix", prefix).join(suspects, "_prefix", "left")
        met = marked.filter(F.col("_created").isNull() | F.col("_suspect"))
    found = met.join(removed, list(_ARTIFACT), "left")
    there = F.col("_created").isNotNull() & (F.col("_removed").isNull() | (F.col("_removed") < F.col("_created")))
    return found.filter(~there).select(*groups.columns)


def _of_either(groups: DataFrame, live: Live) -> DataFrame:
    timed, untimed = groups.filter("_timed"), groups.filter("not _timed")
    return _gone(True, timed, live).unionByName(_gone(False, untimed, live))


def orphan_groups(refs: DataFrame, live: Live, share: float = HEAVY_SHARE) -> DataFrame:
    """_src, _period, _rows of the groups of references (see pre_aggregated) whose key isn't live."""
    spark = refs.sparkSession
    heavy, keyless = heavy_keys(refs, share)
    light = refs.filter(_keyed())
    parts = [pre_aggregated(refs.filter(~_keyed()))] if keyless else []
    if heavy:
        hot = F.broadcast(spark.createDataFrame(heavy, light.select(*_KEY).schema))  # at most 1 / share rows
        artifact = F.broadcast(hot.select(*_ARTIFACT).distinct())
        among = Live(_same(live.publications, artifact, _ARTIFACT, "left_semi"), _same(live.removals, artifact, _ARTIFACT, "left_semi"))
        lost = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in _of_either(hot, among).collect()]  # at most 1 / share
        if lost:
            gone = F.broadcast(spark.createDataFrame(lost, hot.schema))
            parts.append(pre_aggregated(_same(light, gone, _KEY, "left_semi")))
        light = _same(light, hot, _KEY, "left_anti")
    # No key is large any more: each kind is brought together by the key of its join, and aggregated where it is.
    timed = pre_aggregated(light.filter("_timed").repartition(*_ARTIFACT, "_eligible"))
    untimed = pre_aggregated(light.filter("not _timed").repartition(*_ARTIFACT))
    parts += [_gone(True, timed, live), _gone(False, untimed, live)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("_src", "_period", "_rows")


def orphan_rows(groups: DataFrame) -> DataFrame:
    """src, row_id, period of the rows of orphan_groups.

    * Only the state given in `live` counts, whatever came first.
    * Each (src, row_id) is given once, however often it is stored, with its earliest period. Rows with a null row id
      are given once for each key and period.
    * A null channel, or a null deadline of a timed reference, is no artifact's: the row is an orphan.
    * An empty `live` makes every reference an orphan; empty `refs` give no rows.
    """
    rows = groups.select("_src", "_period", F.explode("_rows").alias("_row"))
    unnamed = F.when(F.col("_row").isNull(), F.monotonically_increasing_id())
    once = rows.withColumn("_unnamed", unnamed).groupBy("_src", "_row", "_unnamed").agg(F.min("_period").alias("_period"))
    return once.select(F.col("_src").alias("src"), F.col("_row").alias("row_id"), F.col("_period").alias("period"))


def orphan_counts(groups: DataFrame) -> DataFrame:
    """src, period, n_orphans: the rows of orphan_groups per table and day, from the sizes of the groups alone.

    Rows without a time have the period null. A row id that is stored repeatedly with the same key and period counts once.
    """
    sizes = groups.groupBy(F.col("_src").alias("src"), F.col("_period").alias("period"))
    return sizes.agg(F.sum(F.size("_rows")).cast("bigint").alias("n_orphans"))
