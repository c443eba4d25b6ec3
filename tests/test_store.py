"""The stored catalogue, manifests and sinks by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairn.operators import fts
from cairn.operators import intervals as I
from cairn.operators import manifest as MF
from cairn.sources import store as ST


@pytest.fixture
def modules(spark):
    rows = [(i, f"s{i}", f"f{i}.mod", "mod" if i % 2 else "it", f"Tïtle {i}", f"root{i}") for i in range(1, 8)]
    return spark.createDataFrame(rows, "id long, source string, filename string, format string, title string, root_cid string")


def test_schema_is_held(spark, modules, tmp_path):
    folder = f"file://{tmp_path}/c"
    ST.write_catalog(modules, folder)
    assert ST.read(spark, folder, "modules").schema.fieldNames() == ST.MODULES.fieldNames()
    assert ST.read(spark, folder, "modules").where("duration IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="root_cid is null"):
        ST.conform(modules.withColumn("root_cid", F.lit(None).cast("string"))).collect()


def test_append_and_search(spark, modules, tmp_path):
    folder = f"file://{tmp_path}/c"
    ST.write_catalog(modules.where("id < 4"), folder)
    ST.append(modules.where("id > 2").drop("id"), folder)
    rows = ST.read(spark, folder, "modules")
    assert sorted((r["id"], r["source"]) for r in rows.collect()) == [(i, f"s{i}") for i in range(1, 8)]
    index = fts.open_index(spark, folder)
    assert index.rows == 7 and index.columns == ST.SEARCHED
    assert [r["id"] for r in fts.search(index, "title:title + 6").collect()] == [6]
    assert ST.total_of(ST.read(spark, folder, "meta"), rows) == 7


def test_a_snapshot_that_differs_is_refused(spark, modules, tmp_path, monkeypatch):
    folder, root = f"file://{tmp_path}/c", f"file://{tmp_path}/r"
    ST.write_catalog(modules, folder)
    assert ST.latest(spark, root, "x") is None
    first = ST.publish(spark, folder, root, "x").first()
    second = ST.publish(spark, folder, root, "x").first()
    assert (first["version"], second["version"]) == (1, 2) and ST.latest(spark, root, "x") == second["path"]
    sums = iter(range(100))
    monkeypatch.setattr(ST, "checksum", lambda rows: str(next(sums)))
    with pytest.raises(OSError, match="differs"):
        ST.publish(spark, folder, root, "x")
    assert ST.latest(spark, root, "x") == second["path"] and len(list((tmp_path / "r" / "snapshots").iterdir())) == 2


def test_one_segment_is_published_as_it_lies(spark, modules, tmp_path, monkeypatch):
    """A snapshot of one segment sorts nothing anew and has the same bytes; several segments, and folders that only Spark can open, are merged."""
    folder, root, merge, merged = f"file://{tmp_path}/c", f"file://{tmp_path}/r", ST._merge, []
    monkeypatch.setattr(ST, "_merge", lambda *a: merged.append(1) or merge(*a))
    ST.write_catalog(modules.where("id < 6"), folder)
    path = ST.publish(spark, folder, root, "x").first()["path"]
    files = lambda p: sorted((f.parent.parent.name, f.name, f.read_bytes()) for f in p.glob("*/*/part-*"))
    assert not merged and len(files(tmp_path / "c")) > 5 and files(tmp_path / "c") == files(tmp_path / "r/snapshots" / path.rpartition("/")[2])
    assert not list(tmp_path.glob("r/snapshots/*/*/*/.part*"))
    assert [r["id"] for r in fts.search(fts.open_index(spark, path), "title:title + 5").collect()] == [5]
    with monkeypatch.context() as m:
        m.setattr(ST, "readable", lambda *_: False)
        other = ST.publish(spark, folder, root, "x").first()
    assert len(merged) == 1 and other["checksums"] == ST.publish(spark, folder, root, "x").first()["checksums"]
    monkeypatch.setattr(ST, "compact", lambda *_: None)
    ST.append(modules.where("id > 5").drop("id"), folder)
    assert ST.read(spark, ST.publish(spark, folder, root, "x").first()["path"], "modules").count() == modules.count() and len(merged) == 2


def test_checksums_are_the_rows_and_the_exact_sum_of_their_hashes(spark):
    rows = spark.range(5000).select("id", F.array("id", -F.col("id")).alias("a"))
    total = sum(r[0] for r in rows.select(F.xxhash64("id", "a")).collect())
    assert ST.checksum(rows) == f"5000:{total}" and ST.checksum(rows.limit(0)) == "0:0"


def test_states_are_kept_and_damage_gives_what_was_before(spark, tmp_path):
    folder = f"file://{tmp_path}/held"
    assert ST.load_state(spark, folder, ST.HELD).count() == 0
    held = spark.createDataFrame([("a", True), ("b", False)], ST.HELD)
    ST.save_state(held, folder)
    assert sorted(map(tuple, ST.load_state(spark, folder, ST.HELD).collect())) == [("a", True), ("b", False)]
    marks = spark.createDataFrame([("b", True), ("c", False), ("a", False)], ST.HELD)
    ST.save_state(ST.merge_held(ST.load_state(spark, folder, ST.HELD), marks), folder)
    assert sorted(map(tuple, ST.load_state(spark, folder, ST.HELD).collect())) == [("a", True), ("b", True), ("c", False)]
    newest = json.loads(sorted((tmp_path / "held/log").glob("*.json"))[-1].read_text())["part"]
    for f in (tmp_path / "held" / newest).glob("*"):
        f.write_bytes(b"torn") if f.suffix == ".parquet" else f.unlink()
    for f in (tmp_path / "held" / newest).glob(".*.crc"):
        f.unlink()
    assert sorted(map(tuple, ST.load_state(spark, folder, ST.HELD).collect())) == [("a", True), ("b", False)]
    for f in (tmp_path / "held/log").glob("*.json"):
        f.write_text("{torn")
    for f in (tmp_path / "held/log").glob(".*.crc"):
        f.unlink()
    assert ST.load_state(spark, folder, ST.HELD).count() == 0
    pins = f"file://{tmp_path}/pins"
    ST.save_state(spark.createDataFrame([("module", "x"), ("catalog", "y")], ST.PINS), pins)
    assert {tuple(r) for r in ST.load_state(spark, pins, ST.PINS).collect()} == {("module", "x"), ("catalog", "y")}


def test_gauges_and_records(spark, tmp_path):
    lines = spark.createDataFrame([('{"Peers": 3.7}',)], "s string").select(ST.gauge_lines(F.col("s")).alias("text"))
    assert "cairn_peers 3\n" in lines.first()["text"] and "cairn_pins 0\n" in lines.first()["text"]
    for _ in range(2):
        ST.write_gauges(lines, f"file://{tmp_path}/g")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["g"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"n": 1}\n{"n": 2}\n')
    taken = []
    rows = spark.readStream.schema("n long").json(f"file://{tmp_path}/in")
    ST.record_sink(rows, lambda df, _: taken.extend(r["n"] for r in df.collect()), f"file://{tmp_path}/ck").awaitTermination(60)
    assert sorted(taken) == [1, 2]


def _module(spark, spill):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    pieces = [b"head", b"mid", b"pcm\xff\x00", b"more"]
    blocks = spark.createDataFrame([(sha(p), p) for p in pieces], "cid string, bytes binary")
    head = spark.createDataFrame([(1, "it", [sha(b"head"), sha(b"mid")], [1, 3, 1, 2], [0, 5])], "id long, format string, skeletonChunks array<string>, skeletonLayout array<int>, plan array<long>")
    sounds = spark.createDataFrame([(1, 0, 9, 1, 8, 1, sha(b"more")), (1, 0, 9, 1, 8, 0, sha(b"pcm\xff\x00"))], "id long, index int, frames long, channels int, bit_depth int, ord int, cid string")
    made = MF.manifests(head, MF.sample_rows(sounds), "id", spill)
    return made, blocks.unionByName(MF.manifest_blocks(made))


@pytest.mark.parametrize("spill", [10, 100_000])
def test_manifest_there_and_back(spark, spill):
    made, blocks = _module(spark, spill)
    row = made.first()
    assert row["spilled"] == (spill == 10) and ("indexRoot" in json.loads(row["manifest"])) == row["spilled"]
    skeletons, samples = MF.fetch(made.select("id", "root"), blocks)
    got = skeletons.first()
    assert bytes(got["skeleton"]) == b"head\0\0\0mid\0\0" and got["plan"] == [0, 5]
    assert [(r["index"], r["frames"], bytes(r["pcm"])) for r in samples.collect()] == [(0, 9, b"pcm\xff\x00more")]


def test_damaged_blocks_and_other_roots_are_refused(spark):
    made, blocks = _module(spark, 10)
    torn = blocks.withColumn("bytes", F.when(F.col("bytes") == F.lit(b"mid"), F.lit(b"mix")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="damaged block"):
        MF.fetch(made.select("id", "root"), torn)[0].collect()
    other = blocks.limit(1).select(F.lit(1).cast("long").alias("id"), F.col("cid").alias("root"))
    with pytest.raises(ValueError, match="version 2"):
        MF.fetch(other, blocks)


def _with(blocks, text, new):
    """The blocks, one of them with other bytes under its address."""
    return blocks.withColumn("bytes", F.when(F.col("bytes").cast("string").startswith(text), F.replace(F.col("bytes").cast("string"), F.lit(text), F.lit(new)).cast("binary")).otherwise(F.col("bytes")))


def test_manifests_and_indexes_are_checked_and_must_be_there(spark):
    """Every block is read by its address: JSON that was changed is refused, and what isn't there is no shorter result."""
    made, blocks = _module(spark, 10)
    roots = made.select("id", "root")
    for text, new in (('{"v":2', '{"v": 2'), ('{"samples"', '{ "samples"')):
        with pytest.raises(Exception, match="damaged block"):
            MF.fetch(roots, _with(blocks, text, new))
        with pytest.raises(Exception, match="missing block"):
            MF.fetch(roots, blocks.where(~F.col("bytes").cast("string").startswith(text)))
    with pytest.raises(Exception, match="missing block"):
        MF.fetch(roots, blocks.where(F.col("bytes") != F.lit(b"more")))[1].collect()
    with pytest.raises(Exception, match="missing block"):
        MF.fetch(roots, blocks.where(F.col("bytes") != F.lit(b"mid")))[0].collect()


def test_a_block_that_is_there_twice_is_read_once_from_sound_bytes(spark):
    made, blocks = _module(spark, 10)
    store = _with(_with(blocks, "more", "less"), '{"v":2', '{"v":3').unionByName(blocks).unionByName(blocks)
    skeletons, samples = MF.fetch(made.select("id", "root"), store)
    assert bytes(skeletons.first()["skeleton"]) == b"head\0\0\0mid\0\0"
    assert [bytes(r["pcm"]) for r in samples.collect()] == [b"pcm\xff\x00more"]


@pytest.mark.parametrize("layout", [None, []])
def test_a_skeleton_without_a_recipe_is_all_its_pieces(spark, layout):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    text = json.dumps({"v": 2, "format": "it", "skeletonChunks": [sha(b"head"), sha(b"mid")], "index": {"samples": [], "plan": [1]}} | ({} if layout is None else {"skeletonLayout": layout})).encode()
    blocks = spark.createDataFrame([(sha(b), b) for b in (b"head", b"mid", text)], "cid string, bytes binary")
    skeletons, samples = MF.fetch(spark.createDataFrame([(1, sha(text))], "id long, root string"), blocks)
    assert bytes(skeletons.first()["skeleton"]) == b"headmid" and samples.count() == 0


@pytest.mark.parametrize("most", [1, 300])
def test_blocks_by_ranges_of_addresses_are_whole(spark, tmp_path, monkeypatch, most):
    """Ranges part a store: each block is there once, every piece is found, and texts of manifests don't stay."""
    monkeypatch.setattr(MF, "MOST_BLOCKS", most)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    pieces = [f"piece {i % 290}".encode() for i in range(600)]
    rows = [(i // 20, i % 20 // 4, 9, 1, 8, i % 4, sha(p)) for i, p in enumerate(pieces)]
    samples = MF.sample_rows(spark.createDataFrame(rows, "id long, index int, frames long, channels int, bit_depth int, ord int, cid string"))
    heads = spark.createDataFrame([(i, "it", [sha(pieces[i])], [1, i], [i]) for i in range(30)], "id long, format string, skeletonChunks array<string>, skeletonLayout array<int>, plan array<long>")
    made = MF.manifests(heads, samples, "id", 10)
    store = MF.put_blocks(MF.manifest_blocks(made).unionByName(spark.createDataFrame([(sha(p), p) for p in pieces], "cid string, bytes binary")), 600, f"file://{tmp_path}/blocks")
    assert len(MF.address_ranges(600)) == (MF.RANGES if most == 1 else 2) and store.count() == store.select("cid").distinct().count() == 290 + 60
    before = set(tmp_path.parent.rglob("texts-*"))
    skeletons, sounds = MF.fetch(made.select("id", "root"), store)
    assert set(tmp_path.parent.rglob("texts-*")) == before
    assert {r["id"]: bytes(r["skeleton"]) for r in skeletons.collect()} == {i: pieces[i] + bytes(i) for i in range(30)}
    assert {(r["id"], r["index"]): bytes(r["pcm"]) for r in sounds.collect()} == {(i, k): b"".join(pieces[20 * i + 4 * k : 20 * i + 4 * k + 4]) for i in range(30) for k in range(5)}
    with pytest.raises(Exception, match="no address"):
        MF.put_blocks(spark.createDataFrame([("x", b"x")], "cid string, bytes binary"), 1, f"file://{tmp_path}/other")


def test_greedy_over_many_keys(spark):
    rows = [(k, (i * 7919 + k) % 500, (i * 7919 + k) % 500 + i % 40) for k in range(20) for i in range(60)]
    want = set()
    for k in range(20):
        end = 0
        for a, b in sorted((a, b) for q, a, b in rows if q == k):
            if a >= end:
                want.add((k, a, b))
                end = b
    frame = spark.createDataFrame(rows, "k long, start long, stop long")
    assert {tuple(r) for r in I.greedy(frame, "k").collect()} == want
