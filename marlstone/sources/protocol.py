"""The build tool's line protocol: JSON requests, a put's body on the line behind it, and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "ID bigint, Command string, ActionID string, OutputID string, BodySize bigint"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, line of text files, each line numbered within its file.

    A file is a session's stream and isn't split, so that its order is known.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return whole.withColumn("seq", F.col("seq").cast("bigint"))


def parse_requests(lines: DataFrame, by: str = "file") -> DataFrame:
    """by, seq, id, command, action, output, size, body, error of the requests in lines (by, seq, line).

    Blank lines are skipped. A put with a size above 0 takes the next line that isn't blank as its body, a base64 JSON
    string. A line that is neither gives a row with `error`.
    """
    rows = lines.filter(F.trim(F.col("line")) != "")
    ordered = Window.partitionBy(by).orderBy("seq")
    parsed = rows.withColumn("_r", F.from_json("line", SCHEMA, {"mode": "PERMISSIVE"})).withColumn("_object", F.col("line").rlike(r"\A\s*\{"))
    puts = F.coalesce((F.col("_r.Command") == "put") & (F.col("_r.BodySize") > 0) & F.col("_object"), F.lit(False))
    paired = parsed.withColumn("_puts", puts).withColumn("_next", F.lead("line").over(ordered)).withColumn("_body_of", F.coalesce(F.lag("_puts").over(ordered), F.lit(False)))
    body = F.when(F.col("_puts"), F.try_to_binary(F.regexp_extract("_next", r'\A\s*"([A-Za-z0-9+/=]*)"\s*\z', 1), F.lit("base64")))
    error = F.when(~F.col("_object") | F.col("_r.Command").isNull(), "malformed").when(F.col("_puts") & (F.coalesce(F.octet_length(body), F.lit(-1)) != F.col("_r.BodySize")), "body")
    return paired.filter(~F.col("_body_of")).select(
        by, "seq", F.col("_r.ID").alias("id"), F.col("_r.Command").alias("command"), _hex("_r.ActionID").alias("action"), _hex("_r.OutputID").alias("output"),
        F.coalesce("_r.BodySize", F.lit(0)).alias("size"), body.alias("body"), error.alias("error"),
    )


def _hex(name: str) -> Column:
    return F.lower(F.hex(F.try_to_binary(F.col(name), F.lit("base64"))))


def response(fields: dict[str, Column]) -> Column:
    """A response line; null, false, zero and empty fields are left out."""
    shown = {n: F.when(c.cast("string").isin("", "0", "false"), None).otherwise(c) if n != "ID" else c for n, c in fields.items()}
    return F.to_json(F.struct(*(c.alias(n) for n, c in shown.items())))


def tampered(body: Column, etag: Column) -> Column:
    """Whether a body's digest differs from that which its quoted or bare ETag names; a missing ETag says nothing."""
    named = F.regexp_replace(etag, r'\A"|"\z', "")
    return F.coalesce(F.sha2(body.cast("binary"), 256) != named, F.lit(False))
