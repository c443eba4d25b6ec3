"""Archives of archives read by ranges: partitions inside one archive, torn parts, formats, limits."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn.sources import archives as A


def _zip(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def _noise(n, seed):
    return random.Random(seed).randbytes(n)


@pytest.fixture
def folder(tmp_path):
    big = [(f"m{i:03d}.{'xm' if i % 4 else 'mod'}.zip", _zip([(f"m{i}.mod", _noise(3000, i)), ("m.INFO", b"x"), ("d/", b"")])) for i in range(60)]
    (tmp_path / "big.zip").write_bytes(_zip(big, zipfile.ZIP_STORED))
    os.makedirs(tmp_path / "sub/.hid")
    (tmp_path / "sub/Two.ZIP").write_bytes(b"prefix" + _zip([("a.it.zip", _zip([("a.it", b"one"), ("b.IT", b"two")])), ("none.zip", b"PK no archive"), ("plain.txt", b"t"), ("noext.zip", _zip([("noext", b"n")]))]))
    (tmp_path / "sub/.hid/x.zip").write_bytes(_zip([("h.mod.zip", _zip([("h", b"h")]))]))
    (tmp_path / ".x.zip").write_bytes(_zip([("h.mod.zip", _zip([("h", b"h")]))]))
    (tmp_path / "torn.zip").write_bytes(_zip(big[:3])[:-30])
    (tmp_path / "empty.zip").write_bytes(b"")
    return tmp_path


def _want():
    return {f"big.zip!m{i:03d}.{'xm' if i % 4 else 'mod'}.zip!m{i}.mod": _noise(3000, i) for i in range(60)} | {"sub/Two.ZIP!a.it.zip!a.it": b"one", "sub/Two.ZIP!a.it.zip!b.IT": b"two", "sub/Two.ZIP!noext.zip!noext": b"n"}


def test_all_modules_and_several_tasks_for_one_archive(spark, folder):
    found = A.corpus(spark, str(folder), part_bytes=16 << 10).withColumn("task", F.spark_partition_id()).collect()
    assert {r["source"]: bytes(r["bytes"]) for r in found} == _want() and len(found) == 63
    assert len({r["task"] for r in found if r["source"].startswith("big.zip")}) >= 4


def test_directories_are_a_table(spark, folder):
    got = {(r["path"], r["name"]): r for r in A.zip_entries(spark, str(folder), group=1).collect()}
    assert len(got) == 64 and {p for p, _ in got} == {"big.zip", "sub/Two.ZIP"}
    assert got["big.zip", "m001.xm.zip"]["method"] == 0 and got["sub/Two.ZIP", "a.it.zip"]["packed"] > 0


def test_formats_and_limits(spark, folder):
    assert {r["source"] for r in A.corpus(spark, str(folder), ("mod", "noext")).collect()} == {s for s in _want() if ".mod.zip" in s or "noext" in s}
    order = sorted(_want())
    for n in (1, 25, 62, 500):
        assert sorted(r["source"] for r in A.corpus(spark, str(folder), limit=n).collect()) == order[:n]


def test_limits_when_archives_hold_little(spark, tmp_path):
    """Inner archives with side files only: more of them are taken until there is enough."""
    (tmp_path / "a.zip").write_bytes(_zip([(f"m{i:02d}.mod.zip", _zip([("x.txt", b"")] if i < 20 else [("x.mod", b"%d" % i)])) for i in range(40)]))
    assert [r["source"] for r in A.corpus(spark, str(tmp_path), limit=3).orderBy("source").collect()] == [f"a.zip!m{i}.mod.zip!x.mod" for i in (20, 21, 22)]


def test_a_torn_entry_costs_that_entry(spark, folder):
    raw = bytearray((folder / "big.zip").read_bytes())
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        infos = z.infolist()
    raw[infos[10].header_offset : infos[10].header_offset + 4] = b"XXXX"  # a header
    at = infos[20].header_offset + 400
    raw[at] ^= 0xFF  # data of another
    (folder / "big.zip").write_bytes(bytes(raw))
    got = {r["source"] for r in A.corpus(spark, str(folder)).collect()}
    assert got == {s for s in _want() if "!m010." not in s and "!m020." not in s}


def test_no_archives(spark, tmp_path):
    assert A.corpus(spark, str(tmp_path)).count() == 0 and A.corpus(spark, str(tmp_path), limit=5).count() == 0


def test_unpacking():
    import bz2
    import zlib

    data = b"abc" * 100
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    assert A.unpacked(packed, 8, 300, zlib.crc32(data)) == data == A.unpacked(data, 0, 300, zlib.crc32(data)) == A.unpacked(bz2.compress(data), 12, 300, zlib.crc32(data))
    assert A.unpacked(packed, 8, 299, zlib.crc32(data)) is None and A.unpacked(packed, 8, 300, 1) is None and A.unpacked(packed[:5], 8, 300, zlib.crc32(data)) is None and A.unpacked(data, 99, 300, zlib.crc32(data)) is None
