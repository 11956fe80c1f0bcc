"""Usage manifests: merging, ageing, what to fetch ahead, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.space import concurrency

# Limits of a manifest.
MAX_AGE = 14 * 86_400
MAX_ENTRIES = 32_768
VERSION = 1
#: Parts of a manifest that are cut to its limit before the whole is.
PARTS = 32
# Platform names of the toolchain.
OS_NAMES = {"macos": "darwin"}
ARCH_NAMES = {"x86_64": "amd64", "aarch64": "arm64", "x86": "386"}

SCHEMA = "struct<version:int, entries:map<string, struct<output:string, size:bigint, last_seen:bigint>>>"


def parse_manifests(df: DataFrame, document: str) -> DataFrame:
    """df with action, output, size, last_seen of each entry; documents that don't parse, or of another version, have none."""
    parsed = F.from_json(F.col(document), SCHEMA)
    good = F.when(parsed["version"] == VERSION, parsed["entries"])
    return df.select("*", F.explode(good).alias("action", "_e")).select(*df.columns, "action", "_e.*")


def top_by_recency(entries: DataFrame, by: list[str], limit: int, parts: int = PARTS) -> DataFrame:
    """The `limit` newest entries of each group; of equally old ones the greater action stays.

    Each of `parts` parts of a group, by a hash of the action, keeps its own newest first, so that no task sorts a whole group
    that holds a large share of all rows.
    """
    newest = [F.desc("last_seen"), F.desc("action")]
    some = entries.withColumn("_part", F.pmod(F.xxhash64("action"), F.lit(parts)))
    for keys in ([*by, "_part"], by):
        some = some.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter(F.col("_rank") <= limit)
    return some.drop("_rank", "_part")


def merge_manifests(stored: DataFrame, used: DataFrame, now: int, by: list[str], max_age: int = MAX_AGE, limit: int = MAX_ENTRIES) -> DataFrame:
    """by, action, output, size, last_seen: used entries at `now`, and stored ones that are neither replaced nor too old.

    An age of exactly max_age stays; an entry seen in the future has the age 0. The newest `limit` entries stay.
    """
    keys = [*by, "action"]
    columns = [*keys, "output", "size", "last_seen"]
    fresh = used.select(*keys, "output", "size").withColumn("last_seen", F.lit(now).cast("bigint"))
    aged = stored.filter(F.greatest(F.lit(now) - F.col("last_seen"), F.lit(0)) <= max_age).select(*columns)
    kept = aged.join(fresh.select(*keys), keys, "left_anti")
    return top_by_recency(kept.unionByName(fresh), by, limit).select(*columns)


def finalize_manifests(stored: DataFrame, used: DataFrame, now: int, by: list[str], max_age: int = MAX_AGE, limit: int = MAX_ENTRIES) -> DataFrame:
    """The manifests after their sessions: merged where anything was used, else untouched, so that nothing ages there."""
    touched = used.select(*by).distinct()
    columns = [*by, "action", "output", "size", "last_seen"]
    idle = stored.join(touched, by, "left_anti").select(*columns)
    return idle.unionByName(merge_manifests(stored.join(touched, by, "left_semi"), used, now, by, max_age, limit))


def prefetch_plan(entries: DataFrame, local: DataFrame, empty_digest: str) -> DataFrame:
    """output, size, action, state of each distinct output: local, wanted or dropped.

    Of several entries with one output that with the least action speaks for it. Empty outputs are local if their digest
    is that of nothing, else dropped; an output is local if a file of the same name and size is there.
    """
    one = entries.filter("output is not null").groupBy("output").agg(F.min(F.struct("action", "size")).alias("_e")).select("output", "_e.*")
    there = local.select(F.col("name").alias("output"), F.col("size").alias("_size")).distinct().withColumn("_there", F.lit(True))
    same = one.withColumn("_size", F.col("size")).join(there, ["output", "_size"], "left")
    state = F.when(F.col("size") == 0, F.when(F.col("output") == empty_digest, "local").otherwise("dropped")).when(F.col("_there"), "local").otherwise("wanted")
    return same.select("output", "size", "action", state.alias("state"))


def prefetch_summary(plan: DataFrame) -> DataFrame:
    """advertised, local, wanted, dropped, wanted_bytes of a prefetch plan."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    size = F.coalesce(F.sum(F.when(F.col("state") == "wanted", F.col("size"))), F.lit(0))
    return plan.agg(F.count(F.lit(1)).alias("advertised"), of("local"), of("wanted"), of("dropped"), size.alias("wanted_bytes"))


def prefetch_accounting(plan: DataFrame, downloads: DataFrame) -> DataFrame:
    """advertised, local, attempted, downloaded, missed, bytes, duration, peak_concurrency of one prefetch.

    downloads: output, size, outcome (published, local: published meanwhile by someone else, anything else: missed), start, stop.
    """
    of = lambda o: F.count_if(F.col("outcome") == o)
    size = F.coalesce(F.sum(F.when(F.col("outcome") == "published", F.col("size"))), F.lit(0)).cast("bigint")
    went = downloads.agg(
        F.count(F.lit(1)).alias("attempted"), of("published").alias("downloaded"), of("local").alias("_local"), size.alias("bytes"), (F.max("stop") - F.min("start")).alias("duration"),
    )
    asked = plan.agg(F.count(F.lit(1)).alias("advertised"), F.count_if(F.col("state") == "local").alias("_there"))
    peak = concurrency(downloads.withColumn("_all", F.lit(1)), "_all", "start", "stop").agg(F.coalesce(F.max("peak"), F.lit(0)).cast("bigint").alias("peak_concurrency"))
    one = asked.crossJoin(went).crossJoin(peak)  # one row each
    missed = F.col("attempted") - F.col("downloaded") - F.col("_local")
    return one.select("advertised", (F.col("_there") + F.col("_local")).alias("local"), "attempted", "downloaded", missed.alias("missed"), "bytes", "duration", "peak_concurrency")


def latest_used(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last use of each action: by, action, output, size."""
    return events.groupBy(*by, "action").agg(F.max(F.struct(order, "output", "size")).alias("_e")).select(*by, "action", "_e.output", "_e.size")


def module_path(go_mod: Column) -> Column:
    """The module that a go.mod names: the first line that begins with `module`, without comment and quotes."""
    lines = F.transform(F.split(go_mod, "\n"), lambda x: F.trim(F.regexp_replace(F.split(x, "//")[0], r"\s", " ")))
    named = F.transform(F.filter(lines, lambda x: x.startswith("module")), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r'\Amodule', '')), r'\A"+|"+\z', ""))
    return F.get(F.filter(named, lambda x: x != ""), 0)


def session_label(explicit: Column, module: Column, os: Column, arch: Column, folder: Column) -> Column:
    """An explicit label, else module and platform, else the working directory."""
    return F.coalesce(explicit, F.concat(module, F.lit(" "), os, F.lit("/"), arch), folder)


def platform(os: Column, arch: Column) -> dict[str, Column]:
    from marlstone.functions.http import lookup

    return {"os": F.coalesce(lookup(os, OS_NAMES), os), "arch": F.coalesce(lookup(arch, ARCH_NAMES), arch)}


def lookup_chain(asked: DataFrame, entries: DataFrame, local: DataFrame) -> DataFrame:
    """asked (action) with `source`: local where the manifest's output is on disk with its size, else manifest, else remote."""
    known = entries.groupBy("action").agg(F.max(F.struct("last_seen", "output", "size")).alias("_e")).select("action", "_e.output", "_e.size")
    there = local.select(F.col("name").alias("output"), "size").distinct().withColumn("_there", F.lit(True))
    joined = asked.join(known, "action", "left").join(there, ["output", "size"], "left")
    return joined.withColumn("source", F.when(F.col("_there"), "local").when(F.col("output").isNotNull(), "manifest").otherwise("remote")).drop("_there")
