"""Queries of the training-data operators over the test tables, with SQL where SQL gives the same rows."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.spelling import SPACE_RE2, digest_bytes, digest_hex, digest_sql, encoding_key, encoding_sql
from marlstone.llm.frequent import frequent_values
from marlstone.llm.leaks import leaks
from marlstone.llm.packing import fill, pack, token_lengths
from marlstone.llm.quantiles import TUPLES, answers, merge_days, rank_summaries
from marlstone.llm.seen import Layout, derived_wrong, measured_wrong, seen_before, seen_seqs
from marlstone.llm.seen import answers as answers_of
from marlstone.llm.structure import COMMON, STATISTICS, statistics, structure
from marlstone.session import cut_lineage, shared_folder, spread
from marlstone.sources.tables import table

#: An output is frequent from one in so many manifest entries on.
FREQUENT_ONE_IN = 400
TOP = 100
#: Remainder bytes at which wrong answers are common enough to be measured.
MEASURED_WIDTHS = (1, 2, 4)
PERCENTILES = {"p01": 10, "p05": 50, "p25": 250, "p50": 500, "p75": 750, "p95": 950, "p99": 990}
DAY = 86_400
#: Tuples of the summaries whose answers are held against exact ranks.
CHECKED_TUPLES = 40
#: The public vocabulary that measures texts; executors read it from the same place.
VOCABULARY = os.environ.get("MARLSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Words of the blocks of documents that are looked for in items letter for letter.
VERBATIM_WORDS = 30
_JAVA_SPACE = " \\t\\n\\x0b\\f\\r"
#: A text with a smaller share of prose is none.
PROSE_LEAST = 0.5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "manifest_entry")
    return frequent_values(entries, digest_bytes(F.col("output")), one_in=FREQUENT_ONE_IN).select(F.lower(F.hex("value")).alias("output"))


def p1_top_outputs(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "manifest_entry")
    return frequent_values(entries, digest_hex(F.col("output")), k=TOP).withColumnRenamed("value", "output")


def _asked(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, Layout]:
    """Known digests go into filters that are saved; the records are asked of the saved ones."""
    path = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"
    return seen_before(table(spark, folder, "put_record"), digest_bytes(F.col("digest")), F.col("pub_seq"), table(spark, folder, "known_digest"), digest_bytes(F.col("digest")), path=path, **options)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    asked, _ = _asked(spark, folder)
    return seen_seqs(asked).select(F.col("seq").alias("pub_seq"))


def p2_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """For several widths of the stored remainder, wrong answers as derived and as measured over all records."""
    out = None
    for width in MEASURED_WIDTHS:
        asked, layout = _asked(spark, folder, width=width, keep=True)
        asked = cut_lineage(asked)
        wrong = measured_wrong(answers_of(asked), table(spark, folder, "put_record"), digest_bytes(F.col("digest")), F.col("pub_seq"), table(spark, folder, "known_digest"), digest_bytes(F.col("digest")))
        row = wrong.crossJoin(derived_wrong(asked, layout)).select(  # one row each
            F.lit(8 * width).alias("remainder_bits"), "n_answers", "n_seen", "n_wrong", F.col("derived").alias("derived_wrong"),
            (F.col("n_wrong") / F.col("n_answers")).alias("measured_rate"), (F.col("derived") / F.col("n_answers")).alias("derived_rate"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def p2_error_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the derived errors are the measured ones, six standard deviations of chance aside, and how many records were truly seen."""
    near = F.abs(F.col("n_wrong") - F.col("derived_wrong")) <= 6 * F.sqrt("derived_wrong") + 3
    return p2_error_rate(spark, folder).select("remainder_bits", "n_answers", (F.col("n_seen") - F.col("n_wrong")).alias("n_truly_seen"), near.alias("as_derived"))


_DAY_OF = f"(created_at - pmod(created_at, {DAY})) div {DAY}"
_METRICS = ("content_len", "stored_len")


def _summaries(spark: SparkSession, folder: str, tuples: int = TUPLES) -> DataFrame:
    return rank_summaries(table(spark, folder, "artifact_metadata"), encoding_key(F.col("encoding")), F.expr(_DAY_OF), {m: F.col(m) for m in _METRICS}, tuples)


def p3_day_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return answers(_summaries(spark, folder), ("label", "day", "metric"), PERCENTILES).withColumnRenamed("label", "encoding")


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The days' summaries combined to one for each encoding."""
    daily = cut_lineage(_summaries(spark, folder))
    return answers(merge_days(daily, ("label", "metric")), ("label", "metric"), PERCENTILES).withColumnRenamed("label", "encoding")


def _within(spark: SparkSession, folder: str, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n and within: whether the true rank of each percentile is off by no more than rank_error, and that by no more than stated."""
    value = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _METRICS)))
    rows = table(spark, folder, "artifact_metadata").select(encoding_key(F.col("encoding")).alias("label"), F.expr(_DAY_OF).alias("day"), value.alias("_m")).select("label", "day", "_m.*").filter("value >= 0")
    weighted = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), "value").agg(F.count(F.lit(1)).alias("weight"))
    same = reduce(Column.__and__, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys))
    joined = weighted.join(found, same)
    sums = [F.sum(F.when(F.col("value") < F.col(p), F.col("weight")).otherwise(0)).alias(f"_below_{p}") for p in PERCENTILES]
    sums += [F.sum(F.when(F.col("value") <= F.col(p), F.col("weight")).otherwise(0)).alias(f"_upto_{p}") for p in PERCENTILES]
    ranked = joined.groupBy(*keys, "n", "rank_error", "stated_error").agg(*sums)
    near = [F.expr(f"greatest(_below_{p} + 1 - greatest(1, (n * {m} + 999) div 1000), greatest(1, (n * {m} + 999) div 1000) - _upto_{p}) <= rank_error") for p, m in PERCENTILES.items()]
    good = reduce(Column.__and__, near) & (F.col("rank_error") <= F.col("stated_error"))
    return ranked.select(*keys, "n", good.alias("within")).withColumnRenamed("label", "encoding")


def p3_day_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    """Exact ranks of the answers of every encoding and day, from summaries so short that all are compressed."""
    keys = ("label", "day", "metric")
    return _within(spark, folder, answers(_summaries(spark, folder, CHECKED_TUPLES), keys, PERCENTILES, CHECKED_TUPLES), keys)


def p3_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    """The same for encodings, whose summaries are merged from those of the days."""
    keys = ("label", "metric")
    daily = cut_lineage(_summaries(spark, folder, CHECKED_TUPLES))
    return _within(spark, folder, answers(merge_days(daily, keys, CHECKED_TUPLES), keys, PERCENTILES, CHECKED_TUPLES), keys)


def p3_day_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """What the summaries hold exactly at any size."""
    return p3_day_percentiles(spark, folder).select("encoding", "day", "metric", "n", "smallest", "largest")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    # Written once: the plan and the items it places must agree, and texts are counted only once.
    lengths = cut_lineage(token_lengths(_texts(spark, folder), VOCABULARY))
    return pack(lengths, table(spark, folder, "container_spec"))


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece of each document with its container, for every capacity."""
    return _packed(spark, folder)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, and how many are needed at the very least."""
    filled = fill(_packed(spark, folder))
    return filled.withColumn("n_at_least", F.expr("(n_tokens + capacity_tokens - 1) div capacity_tokens"))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of each capacity: whether every piece is there once, no container is overfull, no text is cut needlessly, and the
    containers are within 1 % (and one) of what the tokens need at the very least.
    """
    lengths = cut_lineage(token_lengths(_texts(spark, folder), VOCABULARY))
    specs = table(spark, folder, "container_spec").select("spec_id", "capacity_tokens")
    packed = cut_lineage(pack(lengths, specs))
    each = packed.groupBy("spec_id", "capacity_tokens", "doc_id").agg(
        F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("distinct"), (F.max("piece") + 1).alias("numbered"),
    )
    whole = (F.col("held") == F.col("n_tokens")) & (F.col("pieces") == F.col("distinct")) & (F.col("pieces") == F.col("numbered"))
    uncut = F.col("pieces") == F.expr("(n_tokens + capacity_tokens - 1) div capacity_tokens")
    documents = each.join(lengths.filter("n_tokens > 0"), "doc_id", "right").groupBy("spec_id", "capacity_tokens")
    of_documents = documents.agg(F.count(F.lit(1)).alias("n_documents"), F.every(F.coalesce(whole, F.lit(False))).alias("whole"), F.every(F.coalesce(uncut, F.lit(False))).alias("cut_only_beyond"))
    containers = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("used"), F.first("capacity_tokens").alias("capacity"))
    least = F.ceil(F.sum("used") / F.first("capacity"))
    of_containers = containers.groupBy("spec_id").agg(F.every(F.col("used") <= F.col("capacity")).alias("capacity_kept"), (F.count(F.lit(1)) <= F.ceil(least * 1.01) + 1).alias("near_least"))
    return of_documents.join(of_containers, "spec_id").select("spec_id", "capacity_tokens", "n_documents", "whole", "cut_only_beyond", "capacity_kept", "near_least")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "eval_item"), _texts(spark, folder))


def p7_verbatim_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of all pairs in which one of the document's blocks of VERBATIM_WORDS words is in the item letter for letter, those that are found."""
    split = lambda c: F.split(c, f"[{_JAVA_SPACE}]+")
    gram = lambda at: F.array_join(F.slice("words", at, F.lit(VERBATIM_WORDS)), " ")
    items = table(spark, folder, "eval_item").select("item_id", split(F.col("text")).alias("words"))
    of_items = items.filter(F.size("words") >= VERBATIM_WORDS).select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - VERBATIM_WORDS + 1), gram)).alias("block"))
    texts = table(spark, folder, "documents").select("doc_id", split(F.col("text")).alias("words"))
    blocks = texts.filter(F.size("words") >= VERBATIM_WORDS).select(
        "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"size(words) div {VERBATIM_WORDS} - 1")), lambda i: gram(i * VERBATIM_WORDS + 1))).alias("block")
    )
    verbatim = blocks.join(of_items, "block").select("item_id", "doc_id").distinct()
    return verbatim.join(p7_found(spark, folder), ["item_id", "doc_id"], "left_semi")


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item that leaked, with the number of documents and sources it leaked into."""
    documents = table(spark, folder, "documents").select("doc_id", "source")
    found = p7_found(spark, folder).join(documents, "doc_id")
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("source").alias("n_sources"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    shaped = _texts(spark, folder).select("doc_id", structure("text").alias("shape"))
    return shaped.filter(F.col("shape.prose_share") < PROSE_LEAST).select("doc_id")


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Basic counts, the nearest profile and the share of prose of every document."""
    shaped = statistics(_texts(spark, folder)).select("doc_id", *STATISTICS, structure("text").alias("shape"))
    return shaped.select("doc_id", *STATISTICS, "shape.*")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The basic counts alone."""
    shares = {n: F.round(F.col(n), 9) for n in STATISTICS if n != "n_words"}
    return statistics(_texts(spark, folder)).withColumns(shares).select("doc_id", *STATISTICS)


QUERIES = {f.__name__: f for f in (p1_found, p1_top_outputs, p2_found, p2_error_rate, p2_error_check, p3_percentiles, p3_day_percentiles, p3_day_extremes, p3_rank_check, p3_day_rank_check, p6_packing, p6_fill, p6_check, p7_found, p7_verbatim_check, p7_leaked_items, p8_found, p8_quality, p8_statistics)}

_DIGEST = digest_sql("digest")
_LONG = f"""WITH long AS (
          SELECT {encoding_sql("encoding")} AS encoding, CAST(floor(created_at / {DAY}.0) AS BIGINT) AS day, 'content_len' AS metric, content_len AS v FROM artifact_metadata
          UNION ALL SELECT {encoding_sql("encoding")}, CAST(floor(created_at / {DAY}.0) AS BIGINT), 'stored_len', stored_len FROM artifact_metadata)"""

SQL = {
    "p1_found": f"""SELECT output FROM (SELECT {digest_sql("output")} AS output FROM manifest_entry) WHERE output IS NOT NULL GROUP BY output
        HAVING count(*) * {FREQUENT_ONE_IN} >= (SELECT count(*) FROM manifest_entry)""",
    "p1_top_outputs": f"""SELECT output, CAST(count(*) AS BIGINT) AS n FROM (SELECT {digest_sql("output")} AS output FROM manifest_entry)
        WHERE output IS NOT NULL GROUP BY output ORDER BY n DESC, output LIMIT {TOP}""",
    "p2_found": f"""WITH puts AS (SELECT DISTINCT pub_seq, {_DIGEST} AS d FROM put_record),
        known AS (SELECT DISTINCT {_DIGEST} AS d FROM known_digest),
        first AS (SELECT d, min(pub_seq) AS s FROM puts GROUP BY d)
        SELECT DISTINCT p.pub_seq FROM puts p JOIN first f USING (d) WHERE p.pub_seq > f.s OR p.d IN (SELECT d FROM known WHERE d IS NOT NULL)""",
    "p2_error_check": f"""WITH puts AS (SELECT DISTINCT pub_seq, {_DIGEST} AS d FROM put_record WHERE {_DIGEST} IS NOT NULL AND pub_seq IS NOT NULL),
        known AS (SELECT DISTINCT {_DIGEST} AS d FROM known_digest WHERE {_DIGEST} IS NOT NULL), first AS (SELECT d, min(pub_seq) AS s FROM puts GROUP BY d),
        a AS (SELECT p.pub_seq, bool_or(p.pub_seq > f.s OR k.d IS NOT NULL) AS seen FROM puts p JOIN first f USING (d) LEFT JOIN known k USING (d) GROUP BY 1)
        SELECT CAST(w AS INTEGER) AS remainder_bits, CAST(count(*) AS BIGINT) AS n_answers, CAST(count(*) FILTER (seen) AS BIGINT) AS n_truly_seen, TRUE AS as_derived
        FROM a, (VALUES {", ".join(f"({8 * w})" for w in MEASURED_WIDTHS)}) AS t(w) GROUP BY w""",
    "p3_day_rank_check": f"""{_LONG} SELECT encoding, day, metric, CAST(count(*) AS BIGINT) AS n, TRUE AS within FROM long WHERE v >= 0 GROUP BY 1, 2, 3""",
    "p3_rank_check": f"""{_LONG} SELECT encoding, metric, CAST(count(*) AS BIGINT) AS n, TRUE AS within FROM long WHERE v >= 0 GROUP BY 1, 2""",
    "p6_check": f"""SELECT spec_id, capacity_tokens, (SELECT CAST(count(*) AS BIGINT) FROM documents WHERE regexp_matches(text, '[^{SPACE_RE2}]')) AS n_documents, TRUE AS whole, TRUE AS cut_only_beyond,
        TRUE AS capacity_kept, TRUE AS near_least FROM container_spec""",
    "p3_day_extremes": f"""{_LONG} SELECT encoding, day, metric, CAST(count(*) AS BIGINT) AS n, min(v) AS smallest, max(v) AS largest FROM long WHERE v >= 0 GROUP BY ALL""",
    "p7_verbatim_check": f"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '[{_JAVA_SPACE}]+') AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT doc_id, array_to_string(w[i * {VERBATIM_WORDS} + 1 : i * {VERBATIM_WORDS} + {VERBATIM_WORDS}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) // {VERBATIM_WORDS})) AS i FROM d)),
        t AS (SELECT item_id, regexp_split_to_array(text, '[{_JAVA_SPACE}]+') AS w FROM eval_item WHERE text IS NOT NULL),
        g AS (SELECT item_id, array_to_string(w[i + 1 : i + {VERBATIM_WORDS}], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - {VERBATIM_WORDS - 1})) AS i FROM t WHERE len(w) >= {VERBATIM_WORDS}))
        SELECT DISTINCT item_id, doc_id FROM b JOIN g USING (g)""",
    "p8_statistics": f"""WITH t AS (
          SELECT doc_id, text, regexp_replace(text, '^[{_JAVA_SPACE}]+|[{_JAVA_SPACE}]+$', '', 'g') AS bare FROM documents
        ), w AS (
          SELECT *, CASE WHEN bare IS NULL THEN NULL WHEN bare = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(bare, '[{_JAVA_SPACE}]+') END AS words,
            length(regexp_replace(text, '[{_JAVA_SPACE}]+', '', 'g')) AS letters, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{M}}{_JAVA_SPACE}]+', '', 'g')) AS symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_JAVA_SPACE}]')) AS lines FROM t
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
          CASE WHEN len(words) > 0 THEN round(letters / CAST(len(words) AS DOUBLE), 9) END AS mean_word_length,
          CASE WHEN letters > 0 THEN round(symbols / CAST(letters AS DOUBLE), 9) END AS symbol_share,
          CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…]["''”’»)\\]]*[{_JAVA_SPACE}]*$'))) / CAST(len(lines) AS DOUBLE), 9) END AS ended_line_share,
          CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda x: list_contains([{", ".join(f"'{w}'" for w in COMMON)}],
            lower(regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))))) / CAST(len(words) AS DOUBLE), 9) END AS common_word_share
        FROM w""",
}
