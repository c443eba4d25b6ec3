"""Packed postings against plain counting."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairn.functions import postings as P


def _rows():
    random.seed(1)
    words = lambda letters, n: [random.choice(letters) * random.randrange(1, 6) for _ in range(random.randrange(n))]
    return [(i, words("abcdé", 30), None if random.random() < 0.1 else words("ab", 3)) for i in random.sample(range(-500, 5000), 300)]


def _flat(rows):
    return Counter((w, i, c, len(x) + len(y or []), tuple(k for k, z in enumerate(t) if z == w)) for i, x, y in rows for c, t in (("x", x), ("y", y or [])) for w in set(t))


def _unpacked(packed):
    t = packed.filter(pa.compute.equal(packed["kind"], P.POSTING)).select(["term", "at", "each", "positions"]).combine_chunks()
    return pa.Table.from_batches(list(P.unpack(iter(t.to_batches()), ("x", "y"))), P.POSTINGS)


def _counted(table):
    return Counter((r["term"], r["id"], r["column"], r["d"], tuple(r["positions"])) for r in table.to_pylist())


@pytest.mark.parametrize("run", [7, 50, 1_000_000])
def test_packed_postings_and_sums(monkeypatch, run):
    monkeypatch.setattr(P, "RUN_TOKENS", run)
    monkeypatch.setattr(P, "PACKED", 3)
    rows = _rows()
    lists = [pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (1, 2)]
    batches = pa.table([pa.array([r[0] for r in rows]), *lists], names=["id", "x", "y"]).to_batches(100)
    made = pa.Table.from_batches(list(P.pack(iter(batches), 64, 4)), P.SCHEMA)
    flat = _unpacked(made)
    assert _counted(flat) == _flat(rows)
    again = pa.Table.from_batches(list(P.repack(iter(flat.to_batches(70)), ("x", "y"))), P.SCHEMA)
    assert _counted(_unpacked(again)) == _flat(rows)
    cells, heads, total = {}, Counter(), [0, 0]
    for i, x, y in rows:
        both = x + (y or [])
        heads.update({w[:k] for w in both for k in range(1, 5) if len(w) >= k})
        total = [total[0] + 1, total[1] + len(both)]
        for w, n in Counter(both).items():
            r, f, d = cells.get((w, i // 64), (0, 0, 10**9))
            cells[w, i // 64] = (r + 1, max(f, n), min(d, len(both)))
    got, found, sums = {}, Counter(), [0, 0]
    for r in made.to_pylist():
        if r["kind"] == P.CELL:
            n, f, d = got.get((r["term"], r["at"]), (0, 0, 10**9))
            got[r["term"], r["at"]] = (n + r["rows"], max(f, r["f"]), min(d, r["d"]))
        elif r["kind"] == P.HEAD:
            found[r["term"]] += r["rows"]
        elif r["kind"] == P.TOTAL:
            sums = [sums[0] + r["rows"], sums[1] + r["f"]]
    assert got == cells and found == heads and sums == total


def test_numbers_of_any_size():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62])
    assert (P.of_bytes(P.to_bytes(v)[0])[0] == v).all()


def test_a_posting_takes_few_bytes():
    """What a shuffle by term carries: a few bytes for each posting, where a row for each one took about fifty."""
    lists = pa.array([[f"w{k}" for k in range(50)] * 2 for _ in range(1000)], pa.list_(pa.string()))
    made = pa.Table.from_batches(list(P.pack(iter(pa.table([pa.array(range(1000)), lists], names=["id", "t"]).to_batches()), 1024, 4)), P.SCHEMA)
    sizes = sum(len(r["each"]) + len(r["positions"]) for r in made.to_pylist() if r["kind"] == P.POSTING)
    assert sizes < 8 * 50_000
