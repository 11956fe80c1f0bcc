"""Operators against the cases of FIXTURES.md, and against sequential models on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import bodies as B
from marlstone.operators import health as E
from marlstone.operators import maintenance as M
from marlstone.operators import manifest as N
from marlstone.operators import metrics as X
from marlstone.operators import proxy as Y
from marlstone.operators import ring as G
from marlstone.operators import space as S
from marlstone.operators import tables as T
from marlstone.sources import protocol as P

QUEUE = "channel_id string, eligible_at bigint, digest string, stored_len bigint"
ARTIFACTS = "channel_id string, digest string, eligible_at bigint, stored_len bigint"
CHANNELS = "channel_id string, expiry_seconds bigint, state string"
KEYS = "channel_id string, digest string"


def model_pass(queue, artifacts, channels, recent, mode, now, cursor, candidates, budget):
    """A pass as it goes in sequence."""
    active = sorted(c for c, _, state in channels if state == "active")
    expiry = {c: e for c, e, _ in channels}
    if not active:
        return []
    turn = cursor % len(active)
    out, spent = [], 0
    for c in active[turn:] + active[:turn]:
        for row in sorted(r for r in queue if r[0] == c):
            if len(out) >= candidates or spent >= budget:
                return out
            _, due, d, _ = row  # the queue's length plays no part
            if mode == M.NORMAL and due > now:
                break
            if mode == M.NORMAL and (c, d) in recent:
                out.append((c, d, due, "requeue", now + expiry[c]))
            elif artifacts.get((c, d), (None, 0))[0] == due:
                out.append((c, d, due, "evict", None))
                spent += artifacts[c, d][1] or 0
            else:
                out.append((c, d, due, "stale", None))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_maintenance_against_model(spark, seed):
    rng = random.Random(seed)
    channels = [(f"c{i}", rng.randrange(1, 50), rng.choice(["active", "active", "deleting"])) for i in range(5)]
    queue = list({(f"c{rng.randrange(6)}", rng.randrange(20), f"d{rng.randrange(9)}"): rng.randrange(9) for _ in range(40)}.items())
    queue = [(*k, v) for k, v in queue]
    artifacts = {(c, d): (due if rng.random() < 0.7 else due + 1, rng.choice([None, rng.randrange(9)])) for c, due, d, _ in queue if rng.random() < 0.8}
    recent = {(c, d) for c, _, d, _ in queue if rng.random() < 0.3}
    for mode in (M.NORMAL, M.RECLAIMING):
        args = (mode, rng.randrange(25), rng.randrange(9), rng.randrange(1, 20), rng.randrange(1, 40))
        expected = model_pass(queue, artifacts, channels, recent, *args)
        plan = M.maintenance_plan(
            spark.createDataFrame(queue, QUEUE), spark.createDataFrame([(*k, *v) for k, v in artifacts.items()], ARTIFACTS), spark.createDataFrame(channels, CHANNELS),
            spark.createDataFrame(sorted(recent) or [("-", "-")], KEYS), *args,
        )
        assert [(r["channel_id"], r["digest"], r["eligible_at"], r["action"], r["new_eligible_at"]) for r in plan.orderBy("seq").collect()] == expected


def test_plan_is_applied(spark):
    queue = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", 5), ("a", 3, "z", 5), ("a", 4, "s", 5)], QUEUE)
    rows = spark.createDataFrame([("a", "x", 1, 7), ("a", "y", 2, 6), ("a", "z", 9, 5), ("a", "s", 50, 5)], ARTIFACTS)
    used = spark.createDataFrame([("a", "y"), ("a", "s")], KEYS)
    plan = M.maintenance_plan(queue, rows, spark.createDataFrame([("a", 100, "active")], CHANNELS), used, M.NORMAL, 10, 0, 10, 100)
    after_queue, after_rows = M.apply_plan(plan, queue, rows)
    # y moves with the artifact's length; s, which is stale, stays where it is
    assert {tuple(r) for r in after_queue.collect()} == {("a", 110, "y", 6), ("a", 4, "s", 5)}
    assert {tuple(r) for r in after_rows.collect()} == {("a", "y", 110, 6), ("a", "z", 9, 5), ("a", "s", 50, 5)}
    assert M.pass_summary(plan).first().asDict() == {"reclaimed": 1, "reclaimed_bytes": 7, "requeued": 2, "stale": 1}


def test_requeue_replaces_and_makes_rows(spark):
    queue = spark.createDataFrame([("a", 1, "x", 5), ("a", 9, "x", 4), ("a", 2, "z", 1)], QUEUE)
    rows = spark.createDataFrame([("a", "x", 1, 7), ("a", "y", 3, None), ("a", "z", 5, 1)], ARTIFACTS)
    moves = spark.createDataFrame([("a", "x", 1, 9), ("a", "y", 3, 8), ("a", "z", 2, 6), ("a", "w", 1, 2)], "channel_id string, digest string, eligible_at bigint, new_eligible_at bigint")
    after_queue, after_rows = M.requeue(queue, rows, moves)
    assert {tuple(r) for r in after_queue.collect()} == {("a", 9, "x", 7), ("a", 8, "y", None), ("a", 2, "z", 1)}
    assert {tuple(r) for r in after_rows.collect()} == {("a", "x", 9, 7), ("a", "y", 8, None), ("a", "z", 5, 1)}


def test_ledger_cases(spark):
    cases = {
        1: [("observe", 100), ("reserve", 60), ("reserve", 40), ("reserve", 1), ("commit", 60), ("reserve", 1)],
        2: [("fail", None), ("reserve", 1), ("reserve", 0)],
        3: [("observe", 100), ("reserve", 10), ("fail", None), ("reserve", 1), ("observe", 100), ("reserve", 1)],
    }
    rows = [(k, i, op, b) for k, ops in cases.items() for i, (op, b) in enumerate(ops)]
    found = S.ledger(spark.createDataFrame(rows, "replica bigint, seq bigint, op string, bytes bigint")).orderBy("replica", "seq").collect()
    ok = {k: [r["ok"] for r in found if r["replica"] == k] for k in cases}
    assert ok == {1: [True, True, True, False, True, False], 2: [True, False, True], 3: [True, True, True, False, True, True]}
    last = [r for r in found if r["replica"] == 1][-1]
    assert (last["reserved"], last["committed_since"]) == (40, 60)


def test_hysteresis(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([100, 5, 15, 25, 15, 9])], "r bigint, seq bigint, available bigint")
    assert [r["mode"] for r in S.hysteresis(rows, "r", "seq", 10, 20).orderBy("seq").collect()] == ["normal", "reclaiming", "reclaiming", "normal", "normal", "reclaiming"]
    with pytest.raises(ValueError):
        S.hysteresis(rows, "r", "seq", 20, 10)


@pytest.mark.parametrize("slices", [1, 3, 1_024])
def test_running_aggregates(spark, slices):
    from marlstone.operators.running import running_last, running_sums

    rng = random.Random(slices)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i * 7 - 300, rng.choice([None, 1, 5, -2]), "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint, _slice_of string")
    total, last, expected = {}, {}, {}
    for k, seq, v, _ in rows:
        total[k] = total.get(k, 0) + (v or 0)
        last[k] = v if v is not None else last.get(k)
        expected[seq] = (total[k], last[k])
    sums = {r["seq"]: r["t"] for r in running_sums(df, ["k"], "seq", {"t": F.col("v")}, slices).collect()}
    lasts = {r["seq"]: r["v"] for r in running_last(df, ["k"], "seq", {"v": F.col("v")}, slices).collect()}
    assert {s: (sums[s], lasts[s]) for s in sums} == expected
    assert running_sums(df.limit(0), ["k"], "seq", {"t": F.col("v")}).count() == 0


def test_staging_extents(spark):
    chunks = spark.createDataFrame([("u", i, s, None) for i, s in enumerate([3, 4, 5])] + [("v", 0, 9, 9), ("w", 0, 99, None)], "upload_id string, seq bigint, size bigint, declared bigint")
    found = {r["upload_id"]: (r["content_len"], r["reserved"], r["outcome"]) for r in B.staging(chunks, 50, 4).collect()}
    assert found == {"u": (12, 12, "staged"), "v": (9, 9, "staged"), "w": (99, None, "too_large")}


def test_publication_outcomes(spark):
    sent = spark.createDataFrame([("c", "d", "d", 1), ("c", "d", "d", 2), ("c", "e", "x", 3), ("c", "f", None, 4)], "channel_id string, digest string, declared string, order bigint")
    found = B.publish_bodies(sent, spark.createDataFrame([("c", "f")], KEYS)).orderBy("order")
    assert [r["outcome"] for r in found.collect()] == ["created", "existing", "mismatch", "existing"]


def test_pruning(spark):
    day = 86_400
    files = spark.createDataFrame([("a", 14 * day + 60), ("b", 14 * day - 60), (".old.tmp", 3_660), (".new.tmp", 5)], "name string, age_seconds bigint")
    pruned = lambda age: {r["name"] for r in B.pruned_files(files, age).filter("pruned").collect()}
    assert pruned(14 * day) == {"a", ".old.tmp"}
    assert pruned(0) == {".old.tmp"}


def test_orphan_limit_comes_first(spark):
    files = spark.createDataFrame([("c", x) for x in "abcd"], KEYS)
    rows = spark.createDataFrame([("c", "a"), ("c", "b")], KEYS)
    assert {r["digest"] for r in B.orphan_bodies(files, rows).collect()} == {"c", "d"}
    assert B.orphan_bodies(files, rows, limit=2).count() == 0


def test_manifest_case(spark):
    now = 3 * N.MAX_AGE
    stored = spark.createDataFrame([("m", "kept", "aa", 1, now - 60), ("m", "updated", "bb", 1, now - 60), ("m", "stale", "cc", 1, now - N.MAX_AGE - 1), ("m", "edge", "ff", 1, now - N.MAX_AGE), ("m", "future", "gg", 1, now + 9)], "label string, action string, output string, size bigint, last_seen bigint")
    used = spark.createDataFrame([("m", "updated", "dd", 7), ("m", "new", "ee", 9)], "label string, action string, output string, size bigint")
    found = {tuple(r)[1:] for r in N.merge_manifests(stored, used, now, ["label"]).collect()}
    assert found == {("kept", "aa", 1, now - 60), ("updated", "dd", 7, now), ("new", "ee", 9, now), ("edge", "ff", 1, now - N.MAX_AGE), ("future", "gg", 1, now + 9)}
    capped = N.merge_manifests(stored, used, now, ["label"], limit=2)
    assert {r["action"] for r in capped.collect()} == {"future", "updated"}


def test_prefetch_plan(spark):
    empty = "e3"
    entries = spark.createDataFrame([("b", "o", 5), ("a", "o", 5), ("z", empty, 0), ("y", "q", 0), ("l", "here", 3), ("m", "size", 3), ("n", None, 1)], "action string, output string, size bigint")
    local = spark.createDataFrame([("here", 3), ("size", 4)], "name string, size bigint")
    found = {(r["output"], r["action"], r["state"]) for r in N.prefetch_plan(entries, local, empty).collect()}
    assert found == {("o", "a", "wanted"), (empty, "z", "local"), ("q", "y", "dropped"), ("here", "l", "local"), ("size", "m", "wanted")}


def health(events, limit, retry):
    state, out = E.Health(), []
    for seq, now, event in events:
        out.append((seq, state.apply(event, now, limit, retry), state.next_retry))
    return out


def test_ejection_cases(spark):
    def run(events, limit, retry):
        df = spark.createDataFrame([("m", i, now, e) for i, (now, e) in enumerate(events)], "member string, seq bigint, now bigint, event string")
        return [(r["ejected"], r["next_retry"]) for r in E.ejections(df, limit, retry).orderBy("seq").collect()]

    assert run([(100, "fail"), (100, "fail")], 2, 30) == [(False, None), (True, 130)]
    assert [e for e, _ in run([(0, "fail"), (29, "look"), (30, "look"), (31, "fail")], 1, 30)] == [True, True, False, True]
    assert [e for e, _ in run([(0, "fail"), (0, "fail"), (0, "success"), (0, "fail"), (0, "fail")], 3, 30)] == [False] * 5


def test_streaming_ejections_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "member string, seq bigint, now bigint, event string"
    rows = [(f"m{rng.randrange(4)}", i, i * 5, rng.choice(["fail", "fail", "success", "look"])) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = E.streaming_ejections(stream, 2, 30).writeStream.format("memory").queryName("ejected").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {tuple(r) for r in spark.sql("select * from ejected").collect()}
    assert streamed == {tuple(r) for r in E.ejections(spark.createDataFrame(rows, schema), 2, 30).collect()}


def test_streaming_passes(spark, tmp_path):
    from marlstone.streaming.maintenance import run_passes

    spark.createDataFrame([("a", 1, "x", 5), ("a", 9, "y", 5)], QUEUE).write.parquet(str(tmp_path / "q"))
    seen = {}
    query = run_passes(spark.readStream.schema(QUEUE).parquet(str(tmp_path / "q")), lambda rows, number: seen.update({number: rows.filter("eligible_at <= 5").count()}), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    assert seen == {0: 1}


def test_bursts():
    from marlstone.streaming.maintenance import BACKOFF, run_burst

    def burst(reclaimed, modes, stop_after=99):
        passes, waits = iter(reclaimed), []
        left = iter(modes)
        n = run_burst(lambda: next(passes), lambda: next(left), waits.append, lambda: len(waits) >= stop_after)
        return n, waits

    assert burst([3], [False]) == (1, [])
    assert burst([3, 2, 0, 1], [True, True, True, False]) == (4, [BACKOFF])
    assert burst([0, 0, 0], [True, True, True], stop_after=2) == (3, [BACKOFF, BACKOFF])


def test_large_rings(spark):
    members = spark.range(40).select(F.concat(F.lit("m"), "id").alias("member"))
    keys = spark.range(500).select("id", F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("position"))
    points = sorted((r["point"], r["member"]) for r in G.ring_points(members, 30).collect())
    for r in G.ring_owners(keys, members, 30).collect():
        assert r["owner"] == next((m for p, m in points if p >= r["position"]), points[0][1])
    with pytest.raises(ValueError, match="more than 39"):
        G.ring_owners(keys, members, 30, most=39)


def test_streaming_counters(spark, tmp_path):
    from datetime import datetime

    from marlstone.streaming.metrics import windowed_counters

    schema = "ts timestamp, event_type string, value double"
    at = lambda h: datetime(2024, 1, 1, h)
    spark.createDataFrame([(at(1), "a", 1.0), (at(1), "a", 2.0), (at(9), "b", 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = windowed_counters(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["kind"], r["n"], r["total"]) for r in spark.sql("select * from counted").collect()] == [("a", 2, 3.0)]


def test_membership(spark):
    snapshot = spark.createDataFrame([("a", "1", 2), ("a", "0", 1), ("b", "2", 3)], "member string, address string, ordinal bigint")
    old = spark.createDataFrame([("a", 2, 130), ("gone", 1, None)], "member string, failures bigint, next_retry bigint")
    assert {tuple(r) for r in G.refreshed_members(snapshot, old).collect()} == {("a", "0", 2, 130), ("b", "2", 0, None)}
    targets = spark.createDataFrame([("a", 80), ("b", 81), ("c", 82)], "member string, port bigint")
    ips = spark.createDataFrame([("a", "10.0.0.10"), ("a", "10.0.0.9"), ("a", "fd00::1")], "member string, ip string")
    known = spark.createDataFrame([("b", "10.1.1.1")], "member string, ip string")
    assert {tuple(r) for r in G.resolved_targets(targets, ips, known).collect()} == {("a", "10.0.0.9:80"), ("b", "10.1.1.1:81")}


def test_flights_and_revalidation(spark):
    asked = spark.createDataFrame([("k", i, t, ok) for i, (t, ok) in enumerate([(0, False), (1, True), (2, True), (300, True), (301, True)])], "key string, id bigint, at bigint, ok boolean")
    assert [r["fetched"] for r in Y.flights(asked, 300).orderBy("id").collect()] == [True, True, False, False, True]
    rows = spark.createDataFrame(
        [(100, 50, True, None, True), (500, 50, True, 304, True), (500, None, None, 304, True), (500, 50, True, 200, True), (500, 50, False, 200, False), (500, 50, True, 404, True), (5, 50, True, None, True)],
        "now bigint, updated_at bigint, has_body boolean, status int, admitted boolean",
    )
    assert [r["decision"] for r in Y.revalidation(rows, 300).collect()] == ["cached", "rebound", "unavailable", "republished", "uncached", "passthrough", "cached"]


def test_redirects(spark):
    responses = spark.createDataFrame([("a", 302, "b"), ("b", 301, "c"), ("c", 200, None), ("loop", 302, "loop"), ("x", 304, None)], "url string, status int, location string")
    asked = spark.createDataFrame([(i, u) for i, u in enumerate(["a", "loop", "x", "none"])], "request bigint, url string")
    assert [tuple(r)[1:] for r in Y.follow_redirects(asked, responses).orderBy("request").collect()] == [("c", 200, 2), ("loop", 302, 5), ("x", 304, 0), ("none", None, 0)]


def test_protocol(spark, tmp_path):
    lines = ['{"ID":1,"Command":"get","ActionID":"AAE="}', "", '{"ID":2,"Command":"put","ActionID":"AAE=","OutputID":"Ag==","BodySize":3}', "", '"YWJj"', "oops", '{"ID":3,"Command":"put","BodySize":2}', '"YWJj"', '{"ID":4,"Command":"close"}']
    (tmp_path / "s.txt").write_text("\n".join(lines))
    found = P.parse_requests(P.read_lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r["id"], r["command"], r["action"], bytes(r["body"]) if r["body"] else None, r["error"]) for r in found] == [
        (1, "get", "0001", None, None), (2, "put", "0001", b"abc", None), (None, None, None, None, "malformed"), (3, "put", None, b"abc", "body"), (4, "close", None, None, None),
    ]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c")], "k bigint, v string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(T.insert_absent(old, new, ["k"])) == {(1, "a"), (2, "b"), (3, "c")}
    assert rows(T.upsert(old, new, ["k"])) == {(1, "a"), (2, "x"), (3, "c")}
    assert rows(T.without(old, new, ["k"])) == {(1, "a")}
    assert rows(T.patch(old, new, ["k"], "v")) == {(1, "a"), (2, "x")}
    marker = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert T.verify_store_format(marker(), "1") == "1"
    assert T.verify_store_format(marker("1"), "1") == "1"
    for bad in (marker("2"), marker("1", "1")):
        with pytest.raises(ValueError):
            T.verify_store_format(bad, "1")


def test_metrics(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 99.0), ("a", None)], "k string, v double")
    assert {(r["le"], r["n"]) for r in X.histogram(df, ["k"], "v", (0.5, 1.0)).collect()} == {("0.5", 1), ("1", 2), ("+Inf", 3)}
    spans = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(0, 5), (1, 3), (3, 4), (5, 6)])], "group bigint, id bigint, start bigint, end bigint")
    assert S.concurrency(spans, "group", "start", "end").first().asDict() == {"group": 1, "peak": 2, "spans": 4}
    assert [r["admitted"] for r in S.admissions(spans, 1).orderBy("id").collect()] == [True, False, False, True]
    exported = X.exposition(spark.createDataFrame([("n", "gauge", 'b="2"', 3), ("n", "gauge", 'b="1"', 4)], "name string, kind string, labels string, value bigint"))
    assert exported.first()["text"] == '# TYPE n gauge\nn{b="1"} 4\nn{b="2"} 3'


LOG = "seq bigint, event string, amount bigint, status int, completed boolean, free bigint, reserved bigint, committed bigint"


def test_metrics_of_nothing_and_of_one(spark):
    none = {(r["name"], r["labels"]): r["value"] for r in X.replica_metrics(spark.createDataFrame([], LOG), 7).collect()}
    assert len(none) == 19
    assert {n for n, v in none.items() if v} == {("foreground_concurrency_limit", "")}
    rows = [(1, "prefetch", 0, None, None, 0, 0, 0), (2, "prefetch_response", 0, 404, None, 0, 0, 0), (3, "prefetch_end", 9, None, False, 0, 0, 0), (5, "space", 0, None, None, 1, 2, 3), (4, "space", 0, None, None, 7, 7, 7)]
    found = {(r["name"], r["labels"]): r["value"] for r in X.replica_metrics(spark.createDataFrame(rows, LOG), 7).collect()}
    assert found["foreground_concurrency_limit", ""] == 7
    assert found["prefetch_responses_total", 'outcome="miss"'] == found["prefetch_transfers_total", 'outcome="cancelled"'] == 1
    assert ("prefetch_responses_total", 'outcome="hit"') not in found
    assert (found["prefetch_in_flight", ""], found["prefetch_response_bytes_total", ""]) == (0, 9)
    assert (found["free_observed_bytes", ""], found["committed_since_bytes", ""]) == (1, 3)


def test_assembling(spark):
    import hashlib

    big = [("a", i, bytes([i % 251]) * 1_000) for i in range(300)]
    chunks = spark.createDataFrame([*big, ("b", 0, b""), ("c", 1, b"y"), ("c", 0, b"x"), ("d", 0, None), (None, 0, b"n")], "upload_id string, seq int, chunk binary").repartition(5)
    found = {r["upload_id"]: (r["content_len"], r["digest"]) for r in B.assemble(chunks).collect()}
    whole = {"a": b"".join(c for _, _, c in big), "b": b"", "c": b"xy", "d": b"", None: b"n"}
    assert found == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in whole.items()}
    assert B.assemble(chunks.limit(0)).count() == 0


def test_readiness(spark):
    rows = [(1, "metadata", 1, True), (1, "files", 1, True), (1, "space", 1, False), (1, "space", 2, True), (2, "metadata", 1, False), (3, "metadata", 1, True)]
    checks = spark.createDataFrame(rows, "replica bigint, part string, seq bigint, good boolean")
    assert {tuple(r) for r in E.readiness(checks).collect()} == {(1, True, None), (2, False, "metadata"), (3, False, "files")}


def test_through_distinct(spark):
    from marlstone.operators.dictionary import through_distinct

    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), ("b", 4)], "v string, _value bigint").withColumnRenamed("_value", "n")
    found = {r["n"]: r["x"] for r in through_distinct(df, "v", "x", lambda c: F.coalesce(F.upper(c), F.lit("none"))).collect()}
    assert found == {1: "A", 2: "none", 3: "A", 4: "B"}


def test_idle_manifests_do_not_age(spark):
    now = 3 * N.MAX_AGE
    stored = spark.createDataFrame([("idle", "a", "o", 1, 0), ("busy", "a", "o", 1, 0)], "label string, action string, output string, size bigint, last_seen bigint")
    used = spark.createDataFrame([("busy", "b", "p", 2)], "label string, action string, output string, size bigint")
    assert {tuple(r) for r in N.finalize_manifests(stored, used, now, ["label"]).collect()} == {("idle", "a", "o", 1, 0), ("busy", "b", "p", 2, now)}


def test_body_paths(spark):
    found = B.parse_body_path(F.lit("/data/" + "0" * 26 + "/sha256/aa/bb/" + "a" * 64))
    assert spark.range(1).select(*found.values()).first() == ("0" * 26, "a" * 64)
    assert spark.range(1).select(*B.parse_body_path(F.lit("x/y")).values()).first() == (None, None)


def test_retry_summary_has_every_user(spark):
    from oracle import SMALL

    from marlstone.plans.maintenance import QUERIES

    users = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
    assert QUERIES["a8_a10_retry_summary"](spark, SMALL).first()["members"] == users


def test_encoded_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), (None, None)], "k string, v bigint")
    T.encode_records(rows, 2).write.parquet(str(tmp_path / "records"))
    stored = spark.read.parquet(str(tmp_path / "records"))
    assert {tuple(r) for r in T.decode_records(stored, 2).collect()} == {("a", 1, 2, None), (None, None, 2, None)}
    assert {r["record_error"] for r in T.decode_records(stored, 1).collect()} == {"version"}
    with pytest.raises(ValueError, match="schema_version"):
        T.encode_records(stored, 2)


def test_bodies_in_either_encoding(spark):
    rows = [(1, b"a" * 10_000, "zstd"), (2, b"abc", "identity"), (3, None, "zstd"), (4, b"x", None), (5, b"", "zstd"), (6, b"", "identity")]
    stored = B.encoded(spark.createDataFrame(rows, "id int, body binary, encoding string"))
    found = {r["id"]: r for r in B.decoded(stored).collect()}
    assert {i: r["content"] and bytes(r["content"]) for i, r in found.items()} == {1: b"a" * 10_000, 2: b"abc", 3: None, 4: None, 5: b"", 6: b""}
    assert found[1]["stored_len"] < 100
    assert (found[2]["stored_len"], found[3]["stored_len"], found[6]["stored_len"]) == (3, None, 0)


def test_bounded_schedule(spark):
    tasks = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 1, 1, 9, 2])] + [(2, 0, 4)], "group bigint, id bigint, took bigint")
    found = S.bounded_schedule(tasks, 2)
    assert [(r["start"], r["stop"]) for r in found.filter("group = 1").orderBy("id").collect()] == [(0, 5), (0, 1), (1, 2), (2, 11), (5, 7)]
    assert S.concurrency(found, "group", "start", "stop").agg(F.max("peak")).first()[0] == 2


def test_resolved_answers(spark):
    rows = [(1, "found", ["a"], 9), (2, "empty", None, None), (3, "empty", ["x"], 7), (4, "failed", ["y"], 1), (5, None, None, None), (6, "found", None, 3)]
    found = {r["id"]: (r["records"], r["ttl"], r["failed"]) for r in Y.resolved(spark.createDataFrame(rows, "id int, status string, records array<string>, ttl int")).collect()}
    assert found == {1: (["a"], 9, False), 2: ([], 5, False), 3: ([], 7, False), 4: (None, None, True), 5: (None, None, True), 6: ([], 3, False)}
