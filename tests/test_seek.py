"""Pattern readers by hand, and seek tables against a plain walk over the events."""

import random
import struct

import pytest

from cairn.functions import modules as M
from cairn.functions import patterns as P


def mod_with(cells: dict[tuple[int, int, int], tuple[int, int, int, int]], patterns: int) -> bytes:
    """cells: (pattern, row, channel) to sample, period, command, parameter."""
    data = bytearray(M.build_mod("seek", [(64, 1), (96, 2), (128, 3)], patterns))
    for (pattern, row, channel), (sample, period, command, value) in cells.items():
        at = 1084 + 1024 * pattern + (row * 4 + channel) * 4
        data[at : at + 4] = bytes([sample & 0xF0 | period >> 8, period & 255, (sample & 15) << 4 | command, value])
    return bytes(data)


def s3m_with(body: bytes) -> bytes:
    head = bytearray(0x60)
    head[0x2C:0x30] = b"SCRM"
    struct.pack_into("<HHH", head, 0x20, 2, 1, 1)
    head[0x31], head[0x32] = 5, 120
    data = bytes(head) + bytes([0, 255]) + struct.pack("<HH", 0, 7)
    return data.ljust(7 * 16, b"\0") + struct.pack("<H", len(body)) + body


def test_s3m_events():
    song = P.song_of(s3m_with(bytes([32 | 128 | 3, 0x45, 2, 1, 4, 0, 32, 254, 0, 128, 20, 64, 0])))
    assert (song.speed, song.tempo, song.orders) == (5, 120, [(0, 0)])
    assert song.patterns[0] == (64, [(0, 3, 1, True, False, 4, 0), (1, 0, -1, False, True, 0, 0), (1, 0, -1, False, False, 0, 64)])


def xm_with() -> bytes:
    head = bytearray(b"Extended Module: ".ljust(60, b" "))
    head += struct.pack("<IHHHHHHHH", 276, 1, 0, 1, 1, 1, 0, 4, 100) + bytes(256)
    cells = bytes([0x83, 50, 1, 49, 1, 0, 15, 3, 0x81, 97, 0x98, 15, 140])
    pattern = struct.pack("<IBHH", 9, 0, 4, len(cells)) + cells
    inst = bytearray(263)
    struct.pack_into("<I", inst, 0, 263)
    inst[27:33] = struct.pack("<HI", 2, 40)
    inst[33 + 49] = 1  # note 50 plays the second sample
    samples = [bytearray(40), bytearray(40)]
    for s, n in zip(samples, (10, 20), strict=True):
        struct.pack_into("<I", s, 0, n)
    return bytes(head) + pattern + bytes(inst) + b"".join(map(bytes, samples)) + bytes(30)


def test_xm_events():
    song = P.song_of(xm_with())
    assert (song.speed, song.tempo, song.orders) == (4, 100, [(0, 0)])
    assert song.patterns[0] == (4, [(0, 0, 1, True, False, 0, 0), (1, 0, 0, True, False, 3, 0), (2, 0, -1, False, True, 0, 0), (3, 0, -1, False, False, 0, 140)])
    assert [(s.slot, s.length) for s in M.sample_slots(xm_with())] == [(1, 10), (2, 20)]


def walk(data: bytes, most: int):
    song, offset = P.song_of(data), {s.slot - 1: s.offset for s in M.sample_slots(data)}
    steps = [song.patterns.get(p, (64, [])) for _, p in song.orders]
    starts, t, speed, tempo = [], 0.0, song.speed, song.tempo
    for (order, _), (rows, events) in zip(song.orders, steps, strict=True):
        starts.append((order, round(t, 6)))
        for row in range(rows):
            for e in events:
                if e[0] == row:
                    speed, tempo = e[5] or speed, e[6] or tempo
            t += speed * 2.5 / tempo
    stride, points = max(1, -(-len(steps) // most)), []
    for point in range(0, len(steps), stride):
        held, latch, need = {}, {}, set()
        for _, events in steps[:point]:
            for _, c, s, note, off, _, _ in events:
                if off:
                    held.pop(c, None)
                latch[c] = s if s >= 0 else latch.get(c, -1)
                if note and latch[c] >= 0:
                    held[c] = latch[c]
        need |= set(held.values())
        for _, events in steps[point : point + stride]:
            for _, c, s, note, _, _, _ in events:
                latch[c] = s if s >= 0 else latch.get(c, -1)
                if note:
                    need.add(latch[c])
        points.append((song.orders[point][0], sorted(offset[s] for s in need if s in offset)))
    return starts, points


@pytest.mark.parametrize("most", [512, 3])
def test_tables(spark, most):
    from cairn.operators import seek
    from cairn.sources import modules as S

    r, files = random.Random(8), []
    for i in range(4):
        cells = {}
        for _ in range(r.choice([0, 5, 40])):
            cells[r.randrange(7), r.randrange(64), r.randrange(4)] = (r.choice([0, 0, 1, 2, 3]), r.choice([0, 428]), r.choice([0, 15]), r.choice([3, 6, 40, 125]))
        files.append((f"m{i}", mod_with(cells, 7)))
    files.append(("bad", b"nothing"))
    frame = spark.createDataFrame(files, "source string, bytes binary")
    events, offsets = S.events(frame), S.sample_offsets(frame)
    starts = {(x["source"], x["order"], round(x["seconds"], 6)) for x in seek.order_starts(events).collect()}
    points = {(x["source"], x["order"], tuple(x["offsets"])) for x in seek.checkpoints(events, offsets, most=most).collect()}
    want_starts, want_points = set(), set()
    for name, data in files[:-1]:
        a, b = walk(data, most)
        want_starts |= {(name, *x) for x in a}
        want_points |= {(name, o, tuple(n)) for o, n in b}
    assert starts == want_starts and points == want_points
    assert {x["source"] for x in seek.first_segment(events, offsets).collect()} <= {n for n, _ in files}


def test_checkpoints_deal_events_once(spark):
    """Events go through one shuffle, by key, and offsets through another, whatever the steps between."""
    from cairn.operators import seek

    rows = [("a", p, 10 * p, 0, 0, 0, p % 2, True, False) for p in range(5)] + [("b", 0, 7, 0, 0, None, None, False, False)]
    events = spark.createDataFrame(rows, "source string, place int, order int, row int, seq int, channel int, sample int, note boolean, off boolean")
    offsets = spark.createDataFrame([("a", 0, 100), ("a", 1, 200), ("a", 1, 200), ("a", 1, 50), ("c", 0, 1)], "source string, sample int, offset bigint")
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = seek.checkpoints(events, offsets, most=2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 2
        # Spans of three places: both samples start in the first, and in the second; b has no event.
        assert {(r["source"], r["order"], tuple(r["offsets"])) for r in found.collect()} == {("a", 0, (50, 100, 200)), ("a", 30, (50, 100, 200)), ("b", 7, ())}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
