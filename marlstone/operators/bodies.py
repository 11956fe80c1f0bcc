"""Bodies: staging of chunks, publication and its accounting, orphaned and dangling bodies, local files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.operators.tables import first_wins

#: Seconds that a temporary file is kept.
TEMPORARY_SECONDS = 3600


def assemble(chunks: DataFrame, upload: str = "upload_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """upload, content_len, digest of each upload's chunks in order of seq; a null chunk adds nothing.

    Chunks are folded into the digest as they come, in Arrow batches of one sorted partition: a body of any size is never held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, size, begun = None, None, 0, False
        for batch in batches:
            out = []
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or name != current:
                    if begun:
                        out.append((current, size, digest.hexdigest()))
                    current, digest, size, begun = name, hashlib.sha256(), 0, True
                if part:
                    digest.update(part)
                    size += len(part)
            yield table(out)
        if begun:
            yield table([(current, size, digest.hexdigest())])

    kind = chunks.schema[upload].dataType

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(columns[0], to_arrow_type(kind)), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=[upload, "content_len", "digest"])

    ordered = chunks.select(upload, seq, F.col(chunk).cast("binary").alias(chunk)).repartition(upload).sortWithinPartitions(upload, seq)
    return ordered.select(upload, chunk).mapInArrow(fold, f"`{upload}` {kind.simpleString()}, content_len bigint, digest string")


def staging(chunks: DataFrame, limit: int, extent: int, upload: str = "upload_id", seq: str = "seq", size: str = "size", declared: str = "declared") -> DataFrame:
    """upload, content_len, reserved, outcome (staged or too_large): a length within the limit reserves what was declared,
    or extents until it is covered."""
    total = chunks.groupBy(upload).agg(F.sum(size).alias("content_len"), F.max(declared).alias("_declared"))
    first = F.coalesce(F.least(F.col("_declared"), F.when(F.col("_declared").isNotNull(), F.lit(limit))), F.lit(extent))
    more = F.expr(f"(greatest(content_len - _first, 0) + {extent - 1}) div {extent} * {extent}")
    return total.withColumn("_first", first.cast("bigint")).select(
        upload, "content_len", F.when(F.col("content_len") <= limit, F.col("_first") + more).alias("reserved"),
        F.when(F.col("content_len") > limit, "too_large").otherwise("staged").alias("outcome"),
    )


def encoded(bodies: DataFrame, body: str = "body", encoding: str = "encoding", level: int = 3) -> DataFrame:
    """bodies with `stored` and `stored_len`: zstd-compressed where the encoding is `zstd`, as they are where it is `identity`;
    null for a null body or any other encoding. How long a compressed body is depends on the library.
    """
    return _coded(bodies, body, encoding, "stored", lambda zstd: zstd.ZstdCompressor(level=level).compress).withColumn("stored_len", F.octet_length("stored").cast("bigint"))


def decoded(bodies: DataFrame, stored: str = "stored", encoding: str = "encoding") -> DataFrame:
    """bodies with `content`, the logical bytes of what is stored; null as in encoded."""
    return _coded(bodies, stored, encoding, "content", lambda zstd: zstd.ZstdDecompressor().decompress)


def _coded(bodies: DataFrame, source: str, encoding: str, name: str, coder: Callable) -> DataFrame:
    @F.pandas_udf("binary")
    def code(body: pd.Series) -> pd.Series:
        import zstandard

        work = coder(zstandard)
        return pd.Series([None if b is None else work(bytes(b)) for b in body], dtype=object)

    zstd = F.when(F.col(encoding) == "zstd", F.col(source).cast("binary"))  # only those go to Python
    return bodies.withColumn(name, F.when(F.col(encoding) == "identity", F.col(source).cast("binary")).otherwise(code(zstd)))


def publish_bodies(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """uploads with `outcome`: mismatch where the declared digest isn't the body's, existing where the file is there, else created.

    uploads: channel_id, digest (of the body), declared, order; existing: channel_id, digest. Of several uploads of a
    new body the first creates it.
    """
    good = F.coalesce(F.col("declared") == F.col("digest"), F.lit(True))
    first = uploads.filter(good).groupBy("channel_id", "digest").agg(F.min("order").alias("_first"))
    there = existing.select("channel_id", "digest").distinct().withColumn("_there", F.lit(True))
    joined = uploads.join(first, ["channel_id", "digest"], "left").join(there, ["channel_id", "digest"], "left")
    outcome = F.when(~good, "mismatch").when(F.col("_there") | (F.col("order") > F.col("_first")), "existing").otherwise("created")
    return joined.withColumn("outcome", outcome).drop("_first", "_there")


def content_addressed(bodies: DataFrame, by: str, digest: str, size: str) -> DataFrame:
    """by, bodies, logical_bytes, distinct_bodies, stored_bytes: what deduplication by digest saves in each group."""
    each = bodies.groupBy(by, digest).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_bytes"), F.max(size).alias("_one"))
    return each.groupBy(by).agg(F.sum("_n").alias("bodies"), F.sum("_bytes").alias("logical_bytes"), F.count(F.lit(1)).alias("distinct_bodies"), F.sum("_one").alias("stored_bytes"))


def commit_artifacts(existing: DataFrame, uploads: DataFrame, channels: DataFrame, default_expiry: int) -> DataFrame:
    """The artifact rows that uploads add: the first upload of a channel and digest that isn't there, due after the channel's expiry.

    uploads: channel_id, digest, content_len, created_at, order; channels: channel_id, expiry_seconds (few rows, so the
    join is left to the planner).
    """
    fresh = uploads.join(existing.select("channel_id", "digest"), ["channel_id", "digest"], "left_anti")
    first = first_wins(fresh, ["channel_id", "digest"], "order")
    joined = first.join(channels.select("channel_id", "expiry_seconds"), "channel_id", "left")
    due = F.col("created_at") + F.coalesce("expiry_seconds", F.lit(default_expiry))
    return joined.select("channel_id", "digest", "content_len", "created_at", due.alias("eligible_at"))


def pruned_files(files: DataFrame, max_age: int, name: str = "name", age: str = "age_seconds") -> DataFrame:
    """files with `pruned`: temporary ones after an hour, others after max_age seconds, for which 0 keeps all."""
    temporary = F.col(name).startswith(".") & F.col(name).endswith(".tmp")
    old = F.lit(False) if max_age == 0 else F.col(age) > max_age
    return files.withColumn("pruned", F.when(temporary, F.col(age) > TEMPORARY_SECONDS).otherwise(old))


def parse_body_path(path: Column) -> dict[str, Column]:
    """channel_id and digest of a body's path; digest null where the name is no digest."""
    # Fixed value: the layout of body paths.
    pattern = r"(?:\A|/)([0-9A-Z]{26})/sha256/[0-9a-f]{2}/[0-9a-f]{2}/([0-9a-f]{64})\z"
    return {"channel_id": F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), "digest": F.nullif(F.regexp_extract(path, pattern, 2), F.lit(""))}


def orphan_bodies(files: DataFrame, artifacts: DataFrame, limit: int | None = None) -> DataFrame:
    """Files (channel_id, digest) that no artifact row names; with a limit only so many files are looked at, in order."""
    looked = files.filter("digest is not null")
    if limit is not None:  # the limit comes before the anti-join, so orphans behind it stay
        looked = looked.orderBy("channel_id", "digest").limit(limit)
    return looked.join(artifacts.select("channel_id", "digest"), ["channel_id", "digest"], "left_anti")


def locate(requests: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """requests with `outcome`: hit, miss, or healed where an artifact row has lost its body."""
    rows = artifacts.select("channel_id", "digest", F.col("content_len").alias("_len"), F.lit(True).alias("_row"))
    bodies = files.select("channel_id", "digest").distinct().withColumn("_body", F.lit(True))
    joined = requests.join(rows, ["channel_id", "digest"], "left").join(bodies, ["channel_id", "digest"], "left")
    outcome = F.when(F.col("_row").isNull(), "miss").when(F.col("_body").isNull(), "healed").otherwise("hit")
    return joined.withColumn("outcome", outcome).withColumn("bytes", F.when(outcome == "hit", F.col("_len"))).drop("_row", "_body", "_len")


def candidates(queue: DataFrame, limit: int) -> DataFrame:
    """The first `limit` queue rows of each channel, by deadline and digest."""
    ordered = Window.partitionBy("channel_id").orderBy("eligible_at", "digest")
    return queue.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= limit)


def pressure_outcome(route: Column, admitted: Column) -> Column:
    """stored where space was found; else durable routes fail, build caches report success without storing, proxies stream through."""
    durable, cache = route.isin("raw", "bazel-cas"), route.isin("http-cache", "bazel-ac")
    return F.when(admitted, "stored").when(durable, "insufficient_storage").when(cache, "bypassed").otherwise("streamed")
