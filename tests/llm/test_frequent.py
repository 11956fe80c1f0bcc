import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm.frequent import GROUPS, frequent_values, next_bits, refine


def frame(spark, values):
    return spark.createDataFrame([(v, "x", 1) for v in values], "v string, value string, n bigint")


def top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("sizes", [(16, GROUPS), (2, 16), (1, 4), (3, 200)])
def test_against_counting(spark, sizes):
    rng = random.Random(1)
    values = [rng.choice([None, "hot", f"w{rng.randrange(9)}", f"r{rng.randrange(3_000)}", ""]) for _ in range(6_000)]
    df = frame(spark, values)
    for k in (1, 5, 40):
        assert sorted((tuple(r) for r in frequent_values(df, F.col("v"), k=k, first_bits=sizes[0], groups=sizes[1]).collect()), key=lambda x: (-x[1], x[0])) == top(values, k)
    for one_in in (1, 4, 100, 10**6):
        expected = {v: n for v, n in top(values, None) if n * one_in >= len(values)}
        assert dict(tuple(r) for r in frequent_values(df, F.col("v"), one_in=one_in, first_bits=sizes[0], groups=sizes[1]).collect()) == expected


def test_flat_and_tied(spark):
    values = [f"v{i:03}" for i in range(200)]
    found = frequent_values(frame(spark, values), F.col("v"), k=3).collect()
    assert [tuple(r) for r in sorted(found)] == [("v000", 1), ("v001", 1), ("v002", 1)]


def test_passes_keep_within_their_groups(spark):
    for kept in (1, 3, 400, 65_536, GROUPS // 2):
        for bits in (16, 21, 40):
            assert kept << (next_bits(bits, kept) - bits) <= GROUPS
    values = ["hot"] * 50 + ["warm"] * 40 + [f"r{i}" for i in range(2_000)]
    df = frame(spark, values)
    left = refine(df, F.col("v"), k=2, first_bits=3, groups=64)
    assert left.bound == 40
    assert left.bits > 6
    assert left.rows.select("_value").distinct().count() < 64
    assert dict(tuple(r) for r in frequent_values(df, F.col("v"), k=2, first_bits=3, groups=64).collect()) == {"hot": 50, "warm": 40}


def test_more_asked_than_there_are(spark):
    values = [f"v{i % 50}" for i in range(500)]
    assert dict(tuple(r) for r in frequent_values(frame(spark, values), F.col("v"), k=60).collect()) == dict(top(values, 60))


def test_nothing(spark):
    assert frequent_values(frame(spark, []), F.col("v"), k=3).count() == 0
    assert frequent_values(frame(spark, [None, None]), F.col("v"), one_in=2).count() == 0
    with pytest.raises(ValueError):
        frequent_values(frame(spark, []), F.col("v"))
