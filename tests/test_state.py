"""State machines: goldens, batch against stream, and a file-based source."""

import json

import pytest

from cairn.streaming import state as S

PLAN = json.dumps([[0, [1]], [2, [2]], [4, [3]], [6, [4]]])


def play(state, order):
    return S.fence(state, {"kind": "play", "order": order})


def provide(state, sample):
    return S.fence(state, {"kind": "provide", "sample": sample})[0]


@pytest.mark.parametrize(("order", "want"), [(0, [1, 2]), (3, [2, 3]), (5, [3, 4]), (100, [4])])
def test_required(order, want):
    assert S.required([0, 2, 4, 6], [[1], [2], [3], [4]], order) == want


def test_hysteresis():
    state = S.fence({}, {"kind": "plan", "plan": PLAN})[0]
    state = provide(provide(state, 1), 2)
    state, out = play(state, 0)
    assert out["ready"]
    state, out = play(state, 2)
    assert not out["ready"] and out["stalled"]
    state = provide(state, 3)
    state, out = play(state, 2)
    assert not out["ready"]
    state, out = play(provide(state, 4), 2)
    assert out["ready"] and not out["stalled"]


def test_empty_requirement_keeps_a_stall():
    assert play({}, 5)[1] == {"ready": True, "stalled": False}
    assert play({"stalled": True}, 5)[1] == {"ready": True, "stalled": True}


def test_first_checkpoint_is_needed_before_it():
    state = S.fence({}, {"kind": "plan", "plan": "[[5, [9]]]"})[0]
    assert not play(state, 0)[1]["ready"]
    assert play(provide(state, 9), 0)[1]["ready"]


def test_bucket_and_records():
    assert S.token_bucket({}, {"at": 0.0, "n": 10})[1]["allowed"] and not S.token_bucket({}, {"at": 0.0, "n": 513})[1]["allowed"]
    state = {}
    for seq, valid in ((1, True), (5, True), (3, True), (9, False), (5, True)):
        state, _ = S.newest_sequence(state, {"seq": seq, "value": str(seq), "valid": valid})
    assert state == {"seq": 5, "value": "5"}


def test_cache_limits():
    state = {}
    for i, item in enumerate("abca"):
        state, out = S.ttl_cache(state, {"at": float(i), "item": item}, entries=2)
    assert not out["hit"] and set(state) == {"c", "a"}
    assert not S.ttl_cache(state, {"at": 500.0, "item": "a"})[1]["hit"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 300), ("a", 2, 300), ("b", 1, 600), ("a", 3, 10), ("b", 9, 512), ("a", 4, 400)]
    frame = lambda part: spark.createDataFrame([(k, float(t), n) for k, t, n in part], "key string, at double, n int")
    schema = "key string, at double, allowed boolean"
    want = {tuple(r) for r in S.replay(frame(rows), S.token_bucket, "key", ["at"], schema).collect()}
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame(rows[:3]).coalesce(1).write.mode("append").parquet(src)
    for part in (None, rows[3:]):
        if part:
            frame(part).coalesce(1).write.mode("append").parquet(src)
        stream = S.stream(spark.readStream.schema("key string, at double, n int").parquet(src), S.token_bucket, "key", ["at"], schema)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_gossip(spark):
    lines = ['{"name": "n", "seq": 3, "value": "c", "valid": true}', "bad", '{"name": "", "seq": 1}', '{"seq": 2}']
    assert [r["seq"] for r in S.gossip(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == [3]


def test_buckets_of_a_bounded_number_of_peers():
    """Against one bucket for each peer that is thrown away when it is the least recently used."""
    from collections import OrderedDict

    state, plain = {}, OrderedDict()
    for i in range(600):
        row = {"peer": f"p{i * i % 11}", "at": i * 0.05, "n": 90 + i % 150}
        state, out = S.bounded_buckets(state, row, peers=4)
        tokens, at = plain.pop(row["peer"], (S.BURST, row["at"]))
        tokens = min(S.BURST, tokens + (row["at"] - at) * S.RATE)
        allowed = tokens >= row["n"]
        plain[row["peer"]] = (tokens - row["n"] if allowed else tokens, row["at"])
        if len(plain) > 4:
            plain.popitem(last=False)
        assert out == {"allowed": allowed, "known": len(plain)} and list(state) == list(plain)


def test_places_are_refused_at_once():
    state, ends = {}, []
    for i in range(300):
        at, until = i * 1.0, i + 1.0 + i * 7 % 13
        state, out = S.slots_held(state, {"at": at, "until": until}, 3)
        ends = [e for e in ends if e > at]
        admitted = len(ends) < 3
        ends += [until] * admitted
        assert out == {"admitted": admitted, "open": len(ends)}


def test_reads_ahead_in_sequence_only():
    state, fetched = {}, []
    for first, last in [(0, 0), (1, 1), (2, 16), (40, 41), (42, 42), (57, 58), (10, 11), (17, 17), (95, 99)]:
        state, out = S.page_cache(state, {"first": first, "last": last, "end": 99})
        fetched.append((out["fetched"], out["upto"]))
    assert fetched == [(1, 0), (16, 16), (0, -1), (2, 41), (16, 57), (1, 58), (0, -1), (1, 17), (5, 99)]
    assert S.page_cache({"have": list(range(90)), "last_end": 89}, {"first": 90, "last": 90, "end": 99})[1] == {"fetched": 10, "upto": 99}


def test_samples_wait_for_their_player():
    state, applied = {}, []
    for kind, sample in [("provide", 4), ("provide", 2), ("init", None), ("provide", 9)]:
        state, out = S.player(state, {"kind": kind, "sample": sample})
        applied.append(json.loads(out["applied"]))
    assert applied == [[], [], [4, 2], [9]]
    assert S.player({}, {"kind": "init"})[1] == {"applied": "[]"}
