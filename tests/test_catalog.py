"""Catalogue upkeep, block stores, byte ranges, peers and lists by hand."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import binary as B
from cairn.functions import strings as S
from cairn.operators import blocks as K
from cairn.operators import catalog as C
from cairn.operators import intervals as I
from cairn.operators import lists as Li
from cairn.operators import peers as P
from cairn.operators import sessions as Z
from cairn.operators import signal as G
from cairn.operators import timeline as T
from cairn.sources import documents as D
from cairn.sources import store as ST


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_insert_numbers_on(spark):
    known = spark.createDataFrame([(4, "b"), (7, "a")], "id long, source string")
    rows = spark.createDataFrame([(None, s) for s in "zcabxy"], "id long, source string")
    got = {(r["source"], r["id"]) for r in C.insert_new(known, rows).collect()}
    assert got == {("b", 4), ("a", 7), ("c", 8), ("x", 9), ("y", 10), ("z", 11)}


def test_meta(spark):
    m = spark.createDataFrame([("mod",), ("mod",), ("it",)], "format string")
    meta = C.meta_table(m)
    assert {r["key"]: r["value"] for r in meta.collect()} == {"total": "3", "format_counts": '[{"format":"mod","count":2},{"format":"it","count":1}]'}
    bad = C.upsert_meta(meta, spark.createDataFrame([("format_counts", "{oops")], "key string, value string"))
    assert C.read_format_counts(bad).count() == 0 and bad.count() == 2
    assert C.bounded_count(m, 1).first()["n"] == 2


def test_store(spark):
    files = spark.createDataFrame([(1, b"abcdefgh"), (2, b"abcdxy"), (3, b"")], "id long, bytes binary")
    chunks = K.chunk_blocks(files, 4)
    store = K.put(spark.createDataFrame([], "cid string, bytes binary"), chunks)
    assert store.count() == 3 and K.put(store, chunks).count() == 3
    assert {(r["id"], bytes(r["bytes"])) for r in K.reassemble(chunks.select("id", "ord", "cid"), store).collect()} == {(1, b"abcdefgh"), (2, b"abcdxy")}
    ranges = spark.createDataFrame([(1, 2, 4), (1, 6, 100), (2, 0, 1), (2, 50, 3)], "id long, offset long, length long")
    assert {(r["id"], bytes(r["data"])) for r in K.read_ranges(chunks, ranges).collect()} == {(1, b"cdef"), (1, b"gh"), (2, b"a")}
    assert K.dedup_stats(chunks.limit(0)).first()["saved"] == 0.0


def test_ranged_file(spark):
    data = bytes((i * 7 + 3) % 256 for i in range(102400))
    chunks = K.chunk_blocks(spark.createDataFrame([(1, data)], "id long, bytes binary"), 16384)
    asked = [(0, 4096), (16384, 100), (16000, 1024), (99000, 2000), (50000, 16384), (102000, 2000)]
    got = K.read_ranges(chunks, spark.createDataFrame([(1, *a) for a in asked], "id long, offset long, length long"))
    assert {(r["offset"], bytes(r["data"])) for r in got.collect()} == {(o, data[o : o + n]) for o, n in asked}


def test_runs(spark):
    rows = spark.createDataFrame([(1, [2, 3, 1, 0], b"abc"), (2, [], b""), (3, None, b"x"), (4, [1, 1], None), (5, [0, 2, 0, 0, 9, 1], b"xy")], "k int, p array<int>, c binary")
    got = {r["k"]: r["expanded"] and bytes(r["expanded"]) for r in K.expand_runs(rows, "p", "c", "k").collect()}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {1: b"ab\0\0\0c", 2: b"", 3: b"", 4: None, 5: b"\0\0xy\0"}


def test_many_runs_take_seconds(spark):
    """100,000 pairs in one module."""
    import time

    data = bytes(range(1, 251)) * 1200
    pairs = [x for i in range(100_000) for x in (3, i % 3)]
    rows = spark.createDataFrame([(1, pairs, data)], "k int, p array<int>, c binary")
    began = time.time()
    got = bytes(K.expand_runs(rows, "p", "c", "k").first()["expanded"])
    assert got == b"".join(data[3 * i : 3 * i + 3] + bytes(i % 3) for i in range(100_000)) and time.time() - began < 60


def test_spans(spark):
    rows = spark.createDataFrame([("a", -5, 3), ("a", 3, 5), ("a", 8, 8), ("a", 9, 99), ("b", 1, 2)], "k string, start long, stop long").withColumn("size", F.lit(20))
    merged = I.merge_spans(rows, "k", "size")
    assert {tuple(r) for r in merged.collect()} == {("a", 0, 5), ("a", 9, 20), ("b", 1, 2)}
    files = spark.createDataFrame([("a", 20), ("b", 20), ("c", 20)], "k string, size long")
    assert {tuple(r) for r in I.complement(merged, files, "k", "size").collect()} == {("a", 0, 0, 5), ("a", 5, 9, 11), ("b", 0, 1, 1), ("b", 2, 20, 0), ("c", 0, 20, 0)}


def test_required_goldens(spark):
    plans = {"p": [(0, [3, 1]), (4, [5]), (8, [9])], "q": [(2, [4]), (5, [6])], "r": [(0, [1]), (4, [5]), (8, [9]), (12, [13])]}
    c = spark.createDataFrame([(m, o, s) for m, p in plans.items() for o, s in p], "module string, order long, samples array<bigint>")
    asked = [("p", 0, [1, 3, 5]), ("q", 0, [4]), ("none", 0, []), *(("r", x, n) for x, n in ((0, [1, 5]), (4, [5, 9]), (5, [5, 9]), (8, [9, 13]), (12, [13]), (100, [13])))]
    got = T.required_at(spark.createDataFrame([(m, x) for m, x, _ in asked], "module string, x long"), c)
    assert {(r["module"], r["x"], tuple(r["need"])) for r in got.collect()} == {(m, x, tuple(n)) for m, x, n in asked}
    starts = spark.createDataFrame([("s", 0, 0.0), ("s", 4, 1.5), ("s", 8, 3.0)], "module string, order long, seconds double").withColumn("o", F.col("order"))
    points = spark.createDataFrame([("s", x) for x in (0.0, 1.4, 1.5, 2.9, 3.0, 999.0)], "module string, x double")
    assert [r["o"] for r in T.asof(points, starts, "module", "x", "seconds", ["o"]).orderBy("x").collect()] == [0, 0, 4, 4, 8, 8]


@pytest.mark.parametrize(("have", "want"), [([], 0.0), ([1, 2], 10.0), ([1, 2, 3], 20.0), ([1, 2, 3, 4], 40.0)])
def test_playable(spark, have, want):
    c = spark.createDataFrame([("m", o, [s]) for o, s in ((0, 1), (2, 2), (4, 3), (6, 4))], "module string, order long, samples array<bigint>")
    starts = spark.createDataFrame([("m", o, o * 5.0) for o in (0, 2, 4, 6)], "module string, order long, seconds double")
    resident = spark.createDataFrame([("m", s) for s in have], "module string, sample long")
    got = T.playable_seconds(c, resident, starts, spark.createDataFrame([("m", 40.0)], "module string, duration double"))
    # A checkpoint plays when its own sample and the next one's are there: the edge is the first that fails.
    assert got.first()["seconds"] == want


def test_need_key(spark):
    rows = spark.createDataFrame([([2, 8], 3), ([2, 8], 9), (None, 3)], "o array<int>, p int")
    assert [r[0] for r in rows.select(T.need_key(F.col("o"), F.col("p"))).collect()] == [5, 1_000_000_001, (1 << 63) - 1]


def test_lists(spark):
    q = F.array(*map(F.lit, "abc"))
    assert list(one(spark, Li.insert_at(q, 1, F.lit("x")), Li.remove_at(q, 2), Li.swap(q, 0, 2), Li.swap(q, 0, 9))) == [["a", "x", "b", "c"], ["a", "b"], ["c", "b", "a"], ["a", "b", "c"]]
    assert list(one(spark, *(Li.index_after_remove(F.lit(i), F.lit(r), F.lit(3)) for i, r in ((2, 0), (1, 1), (2, 2))))) == [1, 1, 1]


def test_similarity(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    none = F.array().cast("array<double>")
    assert list(one(spark, G.similarity(a(1, 2), a(1, 2, 9)), G.similarity(a(0, 0), a(0, 0)), G.similarity(a(0), a(1)), G.similarity(none, a(1)), G.similarity(a(1), a(-5)), G.largest_gap(a(1, 5), a(2, 9)))) == [1.0, 1.0, 0.0, 0.0, 0.0, 4.0]
    pairs = spark.createDataFrame([(1, [0.0, 0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 0.0, 0.0])], "k int, a array<double>, b array<double>")
    assert G.best_lag(pairs, "k", "a", "b", 3).first()["lag"] == -2


def test_scalars(spark):
    lit = F.lit
    assert list(one(spark, S.percent_label(lit(1), lit(3)), S.percent_label(lit(1), lit(0)), S.percent_encoded(lit("a b~é/")), S.truthy(lit(" YES ")), S.truthy(lit("off"), True), S.truthy(lit("?"), True), S.reachable_label(lit(None).cast("boolean")))) == ["33.3%", "—", "a%20b~%C3%A9%2F", True, False, True, "checking"]
    data = lit(bytes([200, 1, 2, 3, 65, 0, 66])).cast("binary")
    assert list(one(spark, B.u32le(data, 0), B.byte_at(data, 99), B.s8(B.byte_at(data, 0)), B.without_flag(lit(13).cast("long"), 4), B.printable(data, 4, 3), B.row_seconds(lit(6), lit(125)))) == [200 + 256 + 2 * 65536 + 3 * 16777216, None, -56, 9, "A", 0.12]


def test_sources(spark):
    pins = spark.createDataFrame([(1, '["x"]'), (2, '{"y": 2}'), (3, "bad")], "id int, v string")
    assert {tuple(r) for r in D.load_pinset(pins, "v").collect()} == {(1, "x", 0), (2, "y", 2)}
    files = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "path string, modified int")
    assert [r["path"] for r in ST.rotated(files, 2).collect()] == ["a"]
    assert Z.shuffled(spark.range(50), "id", 1, 5).collect() == Z.shuffled(spark.range(50).repartition(7), "id", 1, 5).collect()
    assert Z.numbered(spark.range(100).repartition(5), "id").where("_r <> id").count() == 0


def test_requested_addresses_are_of_version_0_or_1(spark):
    """A word in the letters of base 32 is no address: the first byte of version 1 is 1, so its text begins with ba and one of e to h."""
    good = ["bafkrei" + "a" * 52, "bafybei" + "2" * 52, "baguqee" + "q" * 52, "Qm" + "Y" * 44]
    rows = spark.createDataFrame([(["bad222222", "bad7654321", *good, "b234567abc", "baeaaaaa", "Qm0", "bafkreiLATE"],)], "c array<string>")
    assert rows.select(P.requested(F.col("c"))).first()[0] == good
    assert rows.select(P.requested(F.col("c"), 3)).first()[0] == good[:1]


def test_spans_that_are_equal_once_held_make_one(spark):
    """(284, 353) and (284, 407) are both (284, 350): neither joins the span before them."""
    rows = spark.createDataFrame([("a", 7, 136), ("a", 108, 141), ("a", 195, 258), ("a", 284, 353), ("a", 284, 407)], "k string, start long, stop long").withColumn("size", F.lit(350))
    assert {tuple(r) for r in I.merge_spans(rows, "k", "size").collect()} == {("a", 7, 141), ("a", 195, 258), ("a", 284, 350)}


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_a_walk_over_a_store_with_repeated_blocks(spark, monkeypatch, most):
    """Blocks that come twice are looked up once, by few hashes or with the whole store; each reference comes once."""
    import hashlib

    from cairn.operators import manifest as MF

    monkeypatch.setattr(MF, "MOST_HASHES", most)
    text = '{"v":2,"format":"x","skeletonChunks":["a","b"],"skeletonLayout":[2,0],"index":{"samples":[],"plan":[]}}'
    root = hashlib.sha256(text.encode()).hexdigest()
    store = spark.createDataFrame([(root, text.encode()), (root, text.encode()), ("a", b"1"), ("a", b"1"), ("z", b"2")], "cid string, bytes binary")
    got = MF.walk(spark.createDataFrame([(1, root)], "id long, root string"), store)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, root), (1, 1, 1, "a"), (1, 2, 1, "b")]
