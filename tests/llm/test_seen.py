import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm.seen import Layout, QuotientFilter, answered, answers, ask, build_filters, derived_wrong, false_rate, filters_after, measured_wrong, save_filters, seen_before, seen_seqs
from marlstone.session import cut_lineage


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 20), st.integers(1, 9), st.data())
def test_filter_is_a_set_of_fingerprints(bits, q, data):
    top = (1 << bits) - 1
    draw = lambda: np.unique(np.array(data.draw(st.lists(st.integers(0, top), max_size=300)), np.uint64))
    a, b = draw(), draw()
    fa, fb = QuotientFilter.build(a, bits, q), QuotientFilter.build(b, bits)
    assert (fa.fingerprints() == a).all()
    merged = fa.merge(fb)
    assert (merged.fingerprints() == np.union1d(a, b)).all()
    asked = np.array(data.draw(st.lists(st.integers(0, top), max_size=50)), np.uint64)
    assert (merged.contains(asked) == np.isin(asked, np.union1d(a, b))).all()
    assert merged.contains(a).all()


def test_runs_beyond_the_last_slot():
    f = np.array([(15 << 8) | i for i in range(20)], np.uint64)
    filled = QuotientFilter.build(f, 12, 4)
    assert filled.contains(f).all()
    assert not filled.contains(np.array([(15 << 8) | 99, 3], np.uint64)).any()


def test_lengths_must_agree():
    with pytest.raises(ValueError, match="length"):
        QuotientFilter.build(np.array([1], np.uint64), 12).merge(QuotientFilter.build(np.array([1], np.uint64), 13))


def test_layouts_fit_the_hash_at_any_size():
    for keys in (1, 10**6, 10**10, 10**12):
        layout = Layout.of(keys)
        assert layout.bits < 64
        assert layout.bits - QuotientFilter.quotient_bits(keys / layout.n_shards) == 32
    assert Layout.of(10**10).n_shards == 1 << 15
    with pytest.raises(ValueError, match="more bits"):
        Layout.of(10**10, width=6)


def test_derived_error_at_many_shards():
    """2^15 shards as 10^10 keys have them, though of few keys each: what is derived is what happens in 2,000 of them."""
    rng = np.random.default_rng(7)
    layout, keys = Layout(1 << 15, QuotientFilter.quotient_bits(120) + 8), 120
    wrong = 0
    for _ in range(2_000):
        fp = rng.integers(0, 1 << 63, keys, np.uint64) * np.uint64(2) >> np.uint64(64 - layout.bits)  # all keys are new
        wrong += int(answered(np.arange(keys), fp, [], layout.bits).sum())
    derived = 2_000 * sum(false_rate(i, layout.bits) for i in range(keys))
    assert derived > 50
    assert abs(wrong - derived) < 6 * derived**0.5


PUTS = "seq bigint, k string, seen boolean, fp string"


def expected(rows, known):
    seen, out = set(known), {}
    for seq in sorted({s for s, k in rows if s is not None and k is not None}):
        keys = {k for s, k in rows if s == seq and k is not None}
        out[seq] = bool(keys & seen)
        seen |= keys
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, None, "x") for r in rows], PUTS).repartition(parts)


@pytest.mark.parametrize("shard_rows", [400_000, 40])
def test_against_a_set(spark, shard_rows, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), f"k{rng.integers(0, 300)}" if rng.random() < 0.6 else "hot") for i in rng.permutation(1_500)]
    rows += [rows[i] for i in range(0, 1_500, 7)] + [(None, "k1"), (5_000, None), (-3, "early"), (6_000, "early")]
    known = ["k1", "k2", None, "k2"]
    monkeypatch.setattr("marlstone.llm.seen.BLOCK", 64)
    asked, _ = seen_before(frame(spark, rows), F.col("k"), F.col("seq"), spark.createDataFrame([(k,) for k in known], "k string"), F.col("k"), shard_rows=shard_rows)
    found = answers(asked).collect()
    truly = expected(rows, {k for k in known if k})
    assert len(found) == len(truly)
    assert {r["seq"]: r["seen"] for r in found} == truly
    assert sorted(r["seq"] for r in seen_seqs(asked).collect()) == sorted(s for s, seen in truly.items() if seen)


def test_runs_from_saved_filters_equal_one_run(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, f"k{rng.integers(0, 400)}") for i in range(900)]
    known = spark.createDataFrame([("k1",), ("k2",)], "k string")
    layout = Layout.of(900, shard_rows=100)
    filters = save_filters(build_filters(known, F.col("k"), layout), str(tmp_path / "run0"))
    found, sizes = {}, [sum(r["n"] for r in filters.collect())]
    for run, part in enumerate((rows[:300], rows[300:310], rows[310:]), 1):
        asked = cut_lineage(ask(filters, frame(spark, part, 3), F.col("k"), F.col("seq"), layout))
        found |= {r["seq"]: r["seen"] for r in answers(asked).collect()}
        filters = save_filters(filters_after(asked), str(tmp_path / f"run{run}"))
        sizes.append(sum(r["n"] for r in filters.collect()))
    assert found == expected(rows, {"k1", "k2"})
    assert sizes[0] == 2
    assert sizes[-1] == len({k for _, k in rows} | {"k1", "k2"})
    assert all(r["q"] >= 4 and len(r["remainders"]) for r in filters.collect())


def test_wrong_answers_are_measured(spark):
    df = spark.range(4_000).select(F.col("id").alias("seq"), F.concat(F.lit("k"), "id").alias("k"))
    none = spark.createDataFrame([], "k string")
    asked, layout = seen_before(df, F.col("k"), F.col("seq"), none, F.col("k"), width=1, shard_rows=1_000, keep=True)
    asked = cut_lineage(asked)
    measured = measured_wrong(answers(asked), df, F.col("k"), F.col("seq"), none, F.col("k")).first()
    derived = derived_wrong(asked, layout).first()["derived"]
    assert measured["n_answers"] == 4_000
    assert measured["n_wrong"] == measured["n_seen"]
    assert abs(measured["n_wrong"] - derived) < 6 * derived**0.5 + 3
    assert false_rate(1 << 20, 53) < 1.3e-10


def test_nothing(spark):
    empty = spark.createDataFrame([], "seq bigint, k string")
    for known in (None, spark.createDataFrame([("a",)], "k string")):
        asked, layout = seen_before(empty, F.col("k"), F.col("seq"), known, F.col("k"), keep=True)
        assert answers(asked).count() == 0
        assert derived_wrong(asked, layout).first()["derived"] == 0
        assert filters_after(asked).count() == (known is not None)
