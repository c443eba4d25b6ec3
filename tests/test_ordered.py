"""Machines over rows that come in any order against their batch twins, with the state that is left."""

import random

import pytest

from cairn.streaming import ordered as O
from cairn.streaming import state as S

MACHINES = {
    "bucket": (O.Bucket(rate=1.0, burst=9.0), "n int", "allowed boolean"),
    "cache": (O.Cache(ttl=40.0), "item string", "hit boolean"),
    "newest": (O.Newest(), "seq long, value string, valid boolean", "taken boolean, held_seq long, held_value string"),
    "slots": (O.Slots(cap=2), "until long", "admitted boolean, open int"),
    "fence": (O.Fence(plan=((0, (1,)), (2, (2,)), (4, (3,)), (6, (4,)))), "kind string, sample long, order long", "ready boolean, stalled boolean"),
}
SCHEMA = "k string, t timestamp, number long, n int, item string, seq long, value string, valid boolean, until long, kind string, sample long, order long"


def _rows(n, seed=1):
    import datetime

    r, base, out = random.Random(seed), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc), []
    for i in range(n):
        at = i * 5 + r.randrange(8)
        ms = 1704067200000 + at * 1000
        out.append((r.choice("ab"), base + datetime.timedelta(seconds=at), i, r.randrange(12), r.choice("xyz"), r.randrange(30), f"v{i}", r.random() < 0.8, ms + r.randrange(20_000), r.choice(["play", "provide"]), r.randrange(1, 5), r.randrange(8)))
    return out


@pytest.mark.parametrize("name", list(MACHINES))
def test_batch_twin_equals_the_plain_step(spark, name):
    """Against the steps over one dictionary a key."""
    machine, fields, outputs = MACHINES[name]
    rows = _rows(300)
    got = {r["number"]: r for r in O.in_order(spark.createDataFrame(rows, SCHEMA).repartition(5), machine, "k", "t", "number", fields, outputs).collect()}
    assert len(got) == 300
    names, states = [c.split()[0] for c in SCHEMA.split(", ")], {}
    plan = '[[0, [1]], [2, [2]], [4, [3]], [6, [4]]]'
    steps = {
        "bucket": lambda s, r: S.token_bucket(s, r, 1.0, 9.0), "cache": lambda s, r: S.ttl_cache(s, r, 40.0), "newest": S.newest_sequence,
        "slots": lambda s, r: S.slots_held(s, {**r, "at": r["at"] * 1000 + 1704067200000}, 2), "fence": S.fence,
    }
    for values in sorted(rows, key=lambda r: (r[1], r[2])):
        row = dict(zip(names, values, strict=True))
        row["at"] = row["t"].timestamp() - 1704067200
        if name == "fence" and row["k"] not in states:
            states[row["k"]] = S.fence({}, {"kind": "plan", "plan": plan})[0]
        states[row["k"]], out = steps[name](states.get(row["k"], {}), row)
        assert {c: got[row["number"]][c] for c in out} == out


@pytest.mark.parametrize("name", ["cache", "fence"])
def test_rows_in_any_order_give_the_rows_of_the_batch(spark, tmp_path, name):
    """Dealt over micro-batches with up to 100 seconds of delay; a last row moves the watermark on. What waits afterwards is that row alone."""
    import datetime

    machine, fields, outputs = MACHINES[name]
    rows = _rows(60, 2)
    r = random.Random(3)
    late = sorted(rows, key=lambda x: x[1].timestamp() + r.uniform(0, 90))
    end = [("end", rows[-1][1] + datetime.timedelta(hours=1), 999, *rows[0][3:])]
    want = {tuple(x) for x in O.in_order(spark.createDataFrame(rows, SCHEMA), machine, "k", "t", "number", fields, outputs).collect()}
    src = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    out = O.stream_in_order(spark.readStream.schema(SCHEMA).parquet(src), machine, "k", "t", "number", fields, outputs, "100 seconds")
    q = out.writeStream.format("memory").queryName(f"ordered_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for part in (late[:20], late[20:40], late[40:], end):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        q.processAllAvailable()
        got = [tuple(x) for x in spark.table(f"ordered_{name}").collect()]
    finally:
        q.stop()
    assert (len(got), set(got) - want, want - set(got)) == (60, set(), set())
    left = lambda state: spark.read.format("statestore").option("stateVarName", state).load(str(tmp_path / "cp")).count()
    assert left("waiting") == 1
    assert left("used") == 0 if name == "cache" else left("have") <= 8
