"""Orphan references and per-key statistics: nulls, ties, repeats, empty tables, clashing names, heavy keys."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from marlstone.functions.spelling import channel_key, digest_hex
from marlstone.operators.orphans import heavy_keys, live_artifacts, orphan_counts, orphan_groups, orphan_rows, reference_rows
from marlstone.operators.weighted import PERCENTILES, key_statistics, keys_above_share, sliced, value_frequencies, value_histogram

ARTIFACTS = "channel_id string, digest string, eligible_at bigint, created_at bigint, _digest string"
REMOVALS = "channel_id string, digest string, removed_at bigint"
REFS = "ref_row bigint, channel_id string, digest string, updated_at bigint, eligible_at bigint, _row string"


def digest(n):
    return f"{n:064x}"


def orphans(spark, refs, artifacts, removals, timed=False, **options):
    live = live_artifacts(spark.createDataFrame(artifacts, ARTIFACTS), spark.createDataFrame(removals, REMOVALS), channel_key, digest_hex)
    rows = reference_rows(spark.createDataFrame(refs, REFS), "t", "ref_row", "updated_at", channel_key, digest_hex, eligible="eligible_at" if timed else None)
    return orphan_groups(rows, live, **options)


def test_orphans_against_brute_force(spark):
    rng = random.Random(4)
    for timed in (False, True):
        artifacts = [(rng.choice(["A", " a", "B", None]), digest(rng.randrange(30)), rng.choice([1, 2, None]), rng.choice([10, 20, None]), "x") for _ in range(60)]
        removals = [(rng.choice(["a", "B"]), digest(rng.randrange(30)).upper(), rng.choice([5, 15, 20, None])) for _ in range(20)]
        refs = [(i, rng.choice(["A", "B", None]), rng.choice([digest(7), digest(rng.randrange(40)), "bad", None]), rng.choice([None, 100, 90_000]), rng.choice([1, 2, None]), "y") for i in range(300)]
        refs += rng.sample(refs, 20)
        canonical = lambda c: c.strip().upper() if c else None
        gone = defaultdict(list)
        for c, d, t in removals:
            if t is not None:
                gone[canonical(c), d.lower()].append(t)
        live = {(canonical(c), d, e) for c, d, e, made, _ in artifacts if c and not any(made is not None and t >= made for t in gone[canonical(c), d])}
        expected = set()
        for row, c, d, _, e, _ in refs:
            if d is None or d == "bad":
                continue
            there = (c, d, e) in live if timed and e is not None else (not timed and any(x[:2] == (c, d) for x in live))
            if not there:
                expected.add(row)
        for share in (1 / 1000, 1 / 50, 1):  # nearly all keys heavy, some, and none
            groups = orphans(spark, refs, artifacts, removals, timed, share=share)
            found = orphan_rows(groups).collect()
            assert len(found) == len(expected)
            assert {r["row_id"] for r in found} == expected
            assert sum(r["n_orphans"] for r in orphan_counts(groups).collect()) == len(expected)


def test_heavy_keys_are_found(spark):
    refs = spark.createDataFrame([(i, "A", digest(1 if i < 50 else i), 0, 0, "") for i in range(100)], REFS)
    rows = reference_rows(refs, "t", "ref_row", "updated_at", channel_key, digest_hex)
    assert [k[1] for k in heavy_keys(rows, share=0.1)[0]] == [digest(1)]
    assert heavy_keys(rows, share=0.9) == ([], False)
    nameless = reference_rows(spark.createDataFrame([(1, None, digest(1), 0, 0, "")], REFS), "t", "ref_row", "updated_at", channel_key, digest_hex)
    assert heavy_keys(rows.unionByName(nameless), share=0.9) == ([], True)


def test_orphan_edge_cases(spark):
    assert orphan_rows(orphans(spark, [], [], [])).count() == orphan_counts(orphans(spark, [], [], [])).count() == 0
    groups = orphans(spark, [(1, "A", digest(1), 86_400, 0, ""), (None, "A", digest(1), -1, 0, ""), (None, "A", digest(1), -1, 0, ""), (2, "A", "?", 0, 0, ""), (3, "A", digest(2), 2**62, 0, "")], [], [])
    rows = {(r["row_id"], str(r["period"])) for r in orphan_rows(groups).collect()}
    assert rows == {(1, "1970-01-02"), (None, "1969-12-31"), (3, "None")}
    assert sum(r["n_orphans"] for r in orphan_counts(groups).collect()) == 3
    assert orphan_rows(orphans(spark, [(1, "A", digest(1), 0, 0, "")], [("a", digest(1), 5, 5, "")], [])).count() == 0


def expected_statistics(rows):
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    out = {}
    for k, values in by.items():
        valid = sorted(v for v in values if v is not None and v >= 0)
        n = len(valid)
        often = Counter(valid)
        mode = min(often, key=lambda v: (-often[v], v)) if valid else None
        ranks = {name: valid[max(1, -(-n * p // 1000)) - 1] if valid else None for name, p in PERCENTILES.items()}
        out[k] = (len(values), n, len(often), sum(valid) if valid else None, valid[0] if valid else None, valid[-1] if valid else None, mode, *ranks.values())
    return out


def test_statistics_against_brute_force(spark):
    rng = random.Random(5)
    draw = lambda: rng.choice([None, -1, 0, 1, 7, rng.randrange(300), rng.randrange(10**6), rng.randrange(2**62), 2**63 - 1])
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, ""]), draw()) for _ in range(4_000)] + [("only-null", None), ("negative", -5)]
    df = spark.createDataFrame([(k, v, "x", 0) for k, v in rows], "k string, v bigint, _value string, key bigint")
    found = key_statistics(df, F.col("k"), F.col("v"))
    expected = expected_statistics(rows)
    got = {r["key"]: tuple(int(x) if x is not None else None for x in r[1:]) for r in found.collect()}
    assert got == expected


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert key_statistics(df, F.col("k"), F.col("v")).count() == 0
    assert value_histogram(df, F.col("k"), F.col("v")).count() == 0


def test_slices_cut_close_values_of_a_hot_key(spark):
    rows = [("hot", 10**15 + i) for i in range(3_000)] + [("b", 1), (None, 5), (None, None)]
    freq = value_frequencies(spark.createDataFrame(rows, "k string, v bigint"), F.col("k"), F.col("v"))
    found = sliced(freq, 12).orderBy("_key", "_value").collect()
    numbers = [r["_slice"] for r in found]
    assert numbers == sorted(numbers)
    assert max(Counter(numbers).values()) < 1_000
    only = key_statistics(spark.createDataFrame(rows, "k string, v bigint"), F.col("k"), F.col("v"), {}, ("n_rows",))
    assert {tuple(r) for r in only.collect()} == {("hot", 3_000), ("b", 1), (None, 2)}


def test_keys_above_share(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] + [(None, 1)] * 6, "k string, v bigint")
    stats = key_statistics(df, F.col("k"), F.col("v"))
    assert {r["key"] for r in keys_above_share(stats, 10, 4).collect()} == {"a"}
    assert {r["key"] for r in keys_above_share(stats, 10, 10).collect()} == {"a", "b"}


def test_histogram(spark):
    df = spark.createDataFrame([("a", v) for v in (None, -1, 0, 1, 2, 3, 4)], "k string, v bigint")
    assert {(r["bucket"], r["n"]) for r in value_histogram(df, F.col("k"), F.col("v")).collect()} == {(-1, 2), (0, 1), (1, 1), (2, 2), (3, 1)}
