from functools import reduce

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm.quantiles import RankSummary, answers, merge_days, rank_summaries, rounds_ahead, stated_error

VALUES = st.lists(st.integers(0, 200), min_size=1, max_size=200)
PERCENTILES = {"p01": 10, "p50": 500, "p99": 990}


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=6), st.integers(4, 30))
def test_rank_error_is_kept(parts, tuples):
    whole = reduce(RankSummary.merge, [RankSummary.exact(np.sort(np.array(p))).compress(tuples) for p in parts]).compress(tuples)
    values = np.sort(np.concatenate([np.array(p) for p in parts]))
    assert whole.n == len(values)
    assert (whole.values[0], whole.values[-1]) == (values[0], values[-1])
    assert len(whole.values) <= tuples
    for permille in (1, 250, 500, 999, 1000):
        rank, found = max(1, (len(values) * permille + 999) // 1000), whole.at([permille])[0]
        low, high = np.searchsorted(values, found, "left") + 1, np.searchsorted(values, found, "right")
        assert max(0, low - rank, rank - high) <= whole.error <= stated_error(whole.n, whole.rounds, tuples)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "e string, day bigint, v bigint, n bigint, label string")


def exact(values, permille):
    values = sorted(values)
    return values[max(1, (len(values) * permille + 999) // 1000) - 1]


def test_exact_while_small_and_days_combine(spark):
    rng = np.random.default_rng(3)
    rows = [([None, "a", "b"][rng.integers(3)], [None, 1, 2][rng.integers(3)], [None, -1, 0, int(rng.integers(1_000))][rng.integers(4)]) for _ in range(900)]
    daily = rank_summaries(frame(spark, rows).repartition(7), F.col("e"), F.col("day"), {"m": F.col("v")})
    found = {(r["label"], r["day"]): r for r in answers(daily, ("label", "day", "metric"), PERCENTILES).collect()}
    kept = {}
    for e, day, v in rows:
        if v is not None and v >= 0:
            kept.setdefault((e, day), []).append(v)
    assert set(found) == set(kept)
    for key, values in kept.items():
        r = found[key]
        assert (r["n"], r["smallest"], r["largest"], r["rank_error"]) == (len(values), min(values), max(values), 0)
        assert all(r[name] == exact(values, p) for name, p in PERCENTILES.items())
    combined = {r["label"]: r for r in answers(merge_days(daily, ("label", "metric")), ("label", "metric"), PERCENTILES).collect()}
    for label in (None, "a", "b"):
        values = [v for (e, _), vs in kept.items() if e == label for v in vs]
        assert combined[label]["n"] == len(values)
        assert combined[label]["p50"] == exact(values, 500)


def test_stated_error_holds(spark, monkeypatch):
    monkeypatch.setattr("marlstone.llm.quantiles.BUFFER", 500)
    values = np.random.default_rng(4).lognormal(8, 2, 20_000).astype(int).tolist()
    rows = frame(spark, [("a", 0, v) for v in values]).repartition(40)
    summaries = rank_summaries(rows, F.col("e"), F.col("day"), {"m": F.col("v")}, tuples=100)
    found = answers(summaries, ("label", "day", "metric"), PERCENTILES, tuples=100).first()
    values = np.sort(values)
    ahead = rounds_ahead(40, 600, buffer=500)
    assert summaries.first()["rounds"] <= ahead
    assert 0 < found["rank_error"] <= found["stated_error"] <= stated_error(len(values), ahead, 100) < 0.1 * len(values)
    assert found["error_share"] == found["rank_error"] / len(values)
    for name, p in PERCENTILES.items():
        rank = (len(values) * p + 999) // 1000
        low, high = np.searchsorted(values, found[name], "left") + 1, np.searchsorted(values, found[name], "right")
        assert max(0, low - rank, rank - high) <= found["rank_error"]


def test_equal_partitions_and_far_days_are_merged_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr("marlstone.llm.quantiles.FAN_IN", 2)
    rows = [("a", day, v) for day in (-5, 0, 3, 4_000, None) for v in range(50)]
    daily = rank_summaries(frame(spark, rows).repartition(9), F.col("e"), F.col("day"), {"m": F.col("v")}, tuples=20)
    whole = answers(merge_days(daily, ("label", "metric"), tuples=20), ("label", "metric"), PERCENTILES, tuples=20).first()
    assert (whole["n"], whole["smallest"], whole["largest"]) == (250, 0, 49)
    assert abs(whole["p50"] - 24) * 5 <= whole["rank_error"] + 5 <= whole["stated_error"] + 5


def test_nothing(spark):
    for rows in ([], [("a", 1, None), ("a", 1, -5)]):
        assert rank_summaries(frame(spark, rows), F.col("e"), F.col("day"), {"m": F.col("v")}).count() == 0
