"""Archives of archives as a source: central directories first, then only the ranges that are wanted.

`zip_entries` is a data source that lists the entries of all zips under a folder; a task reads the directory at the end of each of its
archives and nothing else. Formats and limits are filters on that table. What is left is dealt into tasks by packed bytes, in runs
of neighbours inside an archive, so that an archive of any size is read by many tasks, a few megabytes at a time. An
entry that can't be read costs that entry, an archive without a directory that archive.
"""

from __future__ import annotations

import bz2
import io
import struct
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.strings import SIDECARS
from .folders import qualified, written

ENTRIES = "path string, entry long, name string, offset long, packed long, size long, method int, crc long, locked boolean"
#: Archives whose directories one task reads; packed bytes that one task unpacks; bytes of one read, and of the modules that are handed on together.
GROUP, PART_BYTES, READ_BYTES = 64, 32 << 20, 8 << 20
_LOCAL = struct.Struct("<4s5H3I2H")


@dataclass
class _Group(InputPartition):
    paths: tuple[str, ...]


class _EntryReader(DataSourceReader):
    def __init__(self, root: str, group: int):
        self.root, self.group = root, group

    def partitions(self) -> list[InputPartition]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        infos = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        below = [i.path[len(base) :].strip("/") for i in infos if i.type == pafs.FileType.File]
        found = sorted(p for p in below if p.lower().endswith(".zip") and not any(x.startswith(".") for x in p.split("/")))
        return [_Group(tuple(found[i : i + self.group])) for i in range(0, len(found), self.group)] or [_Group(())]

    def read(self, partition: _Group):
        fs, base = pafs.FileSystem.from_uri(self.root)
        for path in partition.paths:
            try:
                with fs.open_input_file(f"{base}/{path}") as f, zipfile.ZipFile(f) as archive:
                    infos = archive.infolist()
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                continue  # no directory
            rows = [(path, i, z.filename, z.header_offset, z.compress_size, z.file_size, z.compress_type, z.CRC, bool(z.flag_bits & 1)) for i, z in enumerate(infos)]
            for at in range(0, len(rows), 10_000):
                yield from rows[at : at + 10_000]


class ZipEntries(DataSource):
    """spark.read.format("zip_entries").load(folder): a row for each entry of each zip below the folder, hidden files and folders left out."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options["path"], int(self.options.get("group", GROUP)))


def zip_entries(spark: SparkSession, root: str, group: int = GROUP) -> DataFrame:
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").option("group", group).load(qualified(spark, root))


def unpacked(raw: bytes, method: int, size: int, crc: int) -> bytes | None:
    """The bytes of an entry; none if they aren't what the directory says."""
    try:
        out = raw if method == zipfile.ZIP_STORED else zlib.decompress(raw, -15) if method == zipfile.ZIP_DEFLATED else bz2.decompress(raw) if method == zipfile.ZIP_BZIP2 else None
    except (zlib.error, OSError, ValueError):
        return None
    return out if out is not None and len(out) == size and zlib.crc32(out) == crc else None


def _read_run(f, run: list[tuple]) -> list[bytes | None]:
    """The unpacked entries of neighbours (offset, packed, size, method, crc), by one read where they lie close."""
    first = run[0][0]
    # A local header is 30 bytes, a name and extra fields; their lengths are only known there.
    until = max(o + p for o, p, *_ in run) + _LOCAL.size + 1024
    held = f.read_at(until - first, first)
    out = []
    for offset, packed, size, method, crc in run:
        head = held[offset - first : offset - first + _LOCAL.size]
        if len(head) < _LOCAL.size or head[:4] != b"PK\x03\x04":
            out.append(None)
            continue
        *_, name, extra = _LOCAL.unpack(head)
        start = offset - first + _LOCAL.size + name + extra
        raw = held[start : start + packed]
        if len(raw) < packed:  # long extra fields
            raw = f.read_at(packed, first + start)
        out.append(unpacked(raw, method, size, crc))
    return out


def modules_of(inner: bytes) -> list[tuple[str, bytes]]:
    """name and bytes of the modules in an inner archive; side files and unreadable entries are left out."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(inner))
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return []
    out = []
    for info in archive.infolist():
        _, dot, kind = info.filename.lower().rpartition(".")
        if info.filename.endswith("/") or dot and kind in SIDECARS.split("|"):
            continue
        try:
            out.append((info.filename, archive.read(info)))
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, ValueError, OSError, zlib.error, EOFError):
            continue
    return out


def dealt(entries: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The entries (a written table) in partitions of about part_bytes of packed data, neighbours together and in order."""
    total = entries.agg(F.sum("packed")).first()[0] or 0
    before = F.sum("packed").over(W.partitionBy("path").orderBy("offset", "entry").rowsBetween(W.unboundedPreceding, 0)) - F.col("packed")
    parts = entries.withColumn("_part", F.floor(before / part_bytes))
    return parts.repartition(max(1, -(-total // part_bytes)), "path", "_part").sortWithinPartitions("path", "_part", "offset", "entry").drop("_part")


def _modules(root: str):
    """Tasks' work: entries in order to source, name and bytes."""

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        opened, file = None, None
        rows, held = [], 0

        def out():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["source", "name", "bytes"])

        for batch in batches:
            path, name, *facts = (batch.column(c).to_pylist() for c in ("path", "name", "offset", "packed", "size", "method", "crc"))
            facts = list(zip(*facts, strict=True))
            at = 0
            while at < len(facts):
                end = at + 1
                while end < len(facts) and path[end] == path[at] and facts[end][0] + facts[end][1] - facts[at][0] <= READ_BYTES:
                    end += 1
                if path[at] != opened:
                    opened, file = path[at], fs.open_input_file(f"{base}/{path[at]}")
                for k, inner in zip(range(at, end), _read_run(file, facts[at:end]), strict=True):
                    for module, raw in modules_of(inner) if inner is not None else ():
                        rows.append((f"{path[k]}!{name[k]}!{module}", module, raw))
                        held += len(raw)
                    if held >= READ_BYTES:
                        yield out()
                        rows, held = [], 0
                at = end
        if rows:
            yield out()

    return read


def corpus(spark: SparkSession, root: str, formats: tuple[str, ...] = (), limit: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """source, name and bytes of every module in the archives of archives below a folder.

    formats are taken from the inner archives' names, before anything is unpacked. A limit other than 0 gives the first modules by
    source: the inner archives are taken in order, as many as are asked for and twice as many as long as they hold too few.
    """
    name = F.lower("name")
    inner = zip_entries(spark, root).where(name.endswith(".zip") & ~F.col("locked"))
    if formats:
        inner = inner.where(F.substring_index(F.left(name, F.length(name) - 4), ".", -1).isin(*formats))
    table, full = written(inner, "entries"), qualified(spark, root)
    unpack = lambda entries: dealt(entries, part_bytes).mapInArrow(_modules(full), "source string, name string, bytes binary")
    if not limit:
        return unpack(table)
    heads, count = table.count(), limit
    while True:
        some = written(unpack(written(table.orderBy(F.concat_ws("!", "path", "name", F.lit("")), "entry").limit(count), "first-entries")).orderBy("source").limit(limit), "first-modules")
        if count >= heads or some.count() >= limit:
            return some
        count *= 2
