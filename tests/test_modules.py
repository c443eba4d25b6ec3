"""Module readers, chunking and search syntax against goldens and round trips."""

import hashlib
import io
import math
import random
import sqlite3
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions import chunking as C
from cairn.functions import modules as M
from cairn.plans import match


def _bytes(n):
    x, out = 1, bytearray()
    for _ in range(n):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(x >> 16 & 255)
    return bytes(out)


def test_chunk_goldens():
    data = _bytes(200000)
    assert C.gear()[0] == 0x42D0D7C4
    assert C.cut_lengths(data) == [17752, 18552, 23560, 19041, 17562, 24209, 14749, 17149, 20373, 12740, 14313]
    small = C.cut_lengths(data, C.SMALL)
    assert len(small) == 86 and small[:10] == [2257, 2135, 2414, 2127, 2342, 2302, 2611, 2829, 1627, 2062]
    assert C.cut_lengths(b"") == [] and C.cut_lengths(b"x" * 100) == [100]


def _walked(data, sizes):
    """Chunk lengths by the rule, a byte at a time: the sum starts after the least length, and more bits must be zero before the average one."""
    out = []
    while data:
        total, end = 0, min(len(data), sizes[2])
        for i in range(sizes[0], end):
            total = (total * 2 + int(C.gear()[data[i]])) % 2**32
            if total % 2 ** (int(math.log2(sizes[1])) + (2 if i < sizes[1] else -2)) == 0:
                end = i + 1
                break
        out.append(end)
        data = data[end:]
    return out


@given(st.binary(max_size=3000), st.sampled_from([(1, 4, 9), (2, 16, 200), (40, 64, 130), (5, 256, 300), (512, 2048, 8192)]))
@settings(max_examples=60, deadline=None)
def test_cuts_equal_a_plain_walk(data, sizes):
    assert C.cut_lengths(data, sizes) == _walked(data, sizes)


@pytest.mark.parametrize("sizes", [C.DEFAULT, C.SMALL, (64, 1 << 18, 1 << 20), (0, 64, 512)])
def test_cuts_of_many_strings_together(sizes, monkeypatch):
    """Several strings in one buffer are cut as each alone; real bytes and generated ones."""
    monkeypatch.setattr(C, "RUN_BYTES", 150_000)
    with open(C.__file__, "rb") as f:
        raws = [_bytes(70_000), b"", f.read() * 3, b"x" * 30_000, _bytes(1000)[500:], random.Random(1).randbytes(90_000)]
    assert [(r, n) for r, n in C.cut_runs(iter(raws), sizes)] == [(r, _walked(r, sizes)) for r in raws]


def test_chunking_speed():
    """Far above the 20 MB a second that a core should do."""
    import time

    data = random.Random(2).randbytes(8 << 20)
    began = time.process_time()
    C.cut_lengths(data, C.SMALL)
    assert len(data) / 1e6 / (time.process_time() - began) > 20


@given(st.binary(max_size=5000), st.integers(1, 200))
@settings(max_examples=40, deadline=None)
def test_chunks_add_up(data, least):
    lengths = C.cut_lengths(data, (least, 4 * least, 8 * least))
    assert sum(lengths) == len(data) and all(least <= n <= 8 * least for n in lengths[:-1])


WAVES = {(2048, 1): "be3ced13f37a7fa0", (1500, 9): "ccb563513a630f35", (900, 17): "f17510a246816f4f", (2200, 33): "ad53022682f1c8a5", (1024, 41): "25bc6b10fdc7a66c", (1200, 55): "6e633a1726f9c338"}


@pytest.mark.parametrize("key", list(WAVES))
def test_wave(key):
    assert hashlib.sha256(M.wave(*key)).hexdigest().startswith(WAVES[key])


def test_fixtures_round_trip():
    a = M.build_mod("a", [(2048, 1), (1500, 9), (900, 17)], 2)
    b = M.build_mod("b", [(2048, 1), (2200, 33), (1024, 41)])
    i = M.build_it("it", [(1200, 55), (2048, 1)])
    assert [len(x) for x in (a, b, i)] == [7580, 7380, 3610]
    assert [M.detect(x) for x in (a, b, i)] == ["mod", "mod", "it"]
    shared = set()
    for data in (a, b, i):
        regions = M.sample_regions(data)
        pieces = M.skeleton(data, regions)
        assert b"".join(p + data[o : o + n] for p, (o, n) in zip(pieces, [*regions, (0, 0)], strict=True)) == data
        shared.add(hashlib.sha256(next(data[o : o + n] for o, n in regions if n == 2048)).hexdigest())
    assert len(shared) == 1
    assert M.title_of(a) == "a" and M.title_of(i) == "it"
    blank = M.blank_samples(i, M.sample_slots(i))
    assert len(blank) == len(i) and all(not any(blank[o : o + n]) for o, n in M.sample_regions(i))


def test_cut_and_odd_files():
    a = M.build_mod("a", [(2048, 1), (1500, 9)])
    assert [s.length for s in M.sample_slots(a[:-100])] == [2048, 1400]
    assert M.detect(b"") is None and M.sample_slots(b"nothing") == [] and M.sample_regions(b"MO3 ") is None
    assert [M.mod_channels(t) for t in ("M.K.", "6CHN", "9CHN", "12CH", "16CN", "TDZ3", "????")] == [4, 6, 9, 12, 16, 3, 0]


def test_packed_span():
    data = b"\x03\x00abc\x02\x00xy"
    assert M.packed_span(data, 0, 0x8000 + 1, 8, 1) == 9
    assert M.packed_span(data, 0, 3 * 0x8000, 8, 1) == -1


def test_it_pattern_memory():
    # Row 0 sets mask, note and instrument of channel 0; row 1 repeats both by memory bits.
    body = bytes([129, 3, 60, 1, 0, 129, 48, 0])
    data = len(body).to_bytes(2, "little") + b"\x02\x00" + bytes(4) + body
    assert M.it_pattern(data, 0) == (2, [(0, 0, 60, 1, None, None), (1, 0, 60, 1, None, None)])


def test_scan(spark):
    from cairn.sources.modules import payloads, scan_corpus, slots

    inner, outer = io.BytesIO(), io.BytesIO()
    mod = M.build_mod("t", [(64, 3)])
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("t.mod", mod)
        z.writestr("t.TXT", "x")
        z.writestr("dir/", "")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("t.mod.zip", inner.getvalue())
        z.writestr("bad.mod.zip", b"not a zip")
        z.writestr("t.xm.zip", inner.getvalue())
    files = spark.createDataFrame([("/r/a.zip", outer.getvalue()), ("/r/b.zip", b"junk")], "path string, content binary")
    found = scan_corpus(files, "/r", ("mod",))
    assert [(r["source"], bytes(r["bytes"])) for r in found.collect()] == [("a.zip!t.mod.zip!t.mod", mod)]
    assert slots(found).select("slot", "length").collect() == [(1, 64)]
    assert payloads(found).first()["cid"] == hashlib.sha256(M.wave(64, 3)).hexdigest()


def test_syntax_errors():
    for bad in ('"open', "a:b*", "title:", "(a*"):
        with pytest.raises(SyntaxError):
            match.parse(bad, ("title", "comment"))
    assert match.parse("  ", ("title",)) is None


ROWS = [(1, "space debris", "a tune by bob"), (2, "", "space deb and more space"), (3, "deb space", "x"), (4, "alpha beta", "gamma delta alpha"), (5, "zeta", "alpha x x gamma"), (6, "alpha", "nothing"), (7, "Café del Mar", "naïve caf\u0065\u0301 straße"), (8, "cafe\u0301", "東京 tower"), (9, "delta", "alpha gamma x delta y zeta")]
SEARCHES = [
    "space", "space deb", "space-deb", '"space deb"', "alpha* NOT gamma*", "title:alpha*", '"alpha" OR "zeta"', "NEAR(alpha gamma, 2) OR \"zzz\"", "^space*", "alpha + beta*", "(alpha* OR zeta*) AND gamma*", "... alpha",
    "NEAR(\"alpha\" gamma delta, 3)", "NEAR(\"gamma\" delta alpha, 0)", "NEAR(\"x\" delta zeta, 2)", "NEAR(gamma \"x delta\" alpha, 1)", "NEAR(\"gamma delta\" alpha zeta, 5) OR title:zeta*", "cafe", "CAFÉ*", "straße*", "nai", "東京*", "title:(cafe* OR space*)", "^\"café\"",
]


@pytest.mark.parametrize("text", SEARCHES)
def test_search_like_fts5(text, spark, tmp_path_factory):
    """Matches, order and rank as SQLite's index gives them."""
    from pyspark.sql import functions as F

    from cairn.operators import fts

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, comment, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, title, comment) VALUES (?, ?, ?)", ROWS)
    query = text if match.is_explicit(text) else " ".join(f'"{w}"*' for w in text.split())
    want = con.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ? ORDER BY bm25(f), rowid", (query,)).fetchall()
    if not FOLDER:
        FOLDER.append(f"file://{tmp_path_factory.mktemp('index')}/a")
        rows, columns = spark.createDataFrame(ROWS, "id long, title string, comment string"), {"title": F.col("title"), "comment": F.col("comment")}
        fts.write_index(rows.where("id < 5"), columns, FOLDER[0])
        fts.append_index(rows.where("id >= 5"), columns, FOLDER[0])
    index = fts.open_index(spark, FOLDER[0])
    assert (index.rows, index.columns) == (len(ROWS), ("title", "comment"))
    got = fts.search(index, text).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in want)
    if "NEAR" not in text and "NOT" not in text:
        assert {r["id"]: pytest.approx(r["score"], abs=2e-6) for r in got} == dict(want)


FOLDER = []


def test_search_reads_its_terms_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairn.operators import fts

    rows = spark.range(2000).select("id", F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" common")).alias("t"))
    fts.write_index(rows, {"t": F.col("t")}, f"file://{tmp_path}/i")
    index = fts.open_index(spark, f"file://{tmp_path}/i")
    tree = match.parse("w77 common", ("t",))
    plan = fts.matching(index, tree)[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [Or(StringStartsWith(term,w77),StringStartsWith(term,common))]" in plan
    assert fts.search(index, "w77 common", 500, most=5000).count() == 11 and fts.search(index, " ").count() == 0


def test_modules_are_built_by_all_tasks(spark, sf):
    """The parts' file is one task's share to read; what is built of it isn't."""
    from cairn.queries import formats

    assert formats._built(spark, sf, formats._mod).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() == 1


def test_waves_are_by_rule():
    for length, seed in ((0, 1), (1, 7), (130, 12345), (5000, 99)):
        assert M.wave(length, seed) == bytes((((i * (3 + seed % 5)) % 256 - 128) + seed * 7 + (i >> 3) * 11) & 255 for i in range(length))
