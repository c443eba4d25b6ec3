"""Modules as a source: nested archives, sniffing, samples, regions and chunks as DataFrames."""

from __future__ import annotations

import hashlib
import io
import zipfile
from dataclasses import astuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import chunking, modules, patterns
from ..functions.strings import SIDECARS


def sniff(data: Column) -> Column:
    """The format by marks, as an expression; null for unknown bytes."""
    n, head = F.length(data), B.tag(data, 0)
    mark = B.tag(data, 1080)
    known = mark.isin(*modules.MARKS) | mark.rlike("^(" + "|".join(modules.PATTERNS) + ")$")
    zero = mark.rlike(r"^(0CHN|00CH|00CN|TDZ0)$")
    return (
        F.when((n >= 4) & (B.tag(data, 0, 3) == "MO3"), "mo3")
        .when((n >= 4) & (head == "tpm."), "mptm")
        .when((n >= 0x2C) & (head == "IMPM"), F.when(B.u16le(data, 0x28).between(0x0889, 0x0FFF), "mptm").otherwise("it"))
        .when((n >= 0x30) & (B.tag(data, 0x2C) == "SCRM"), "s3m")
        .when((n >= 17) & (head == "Exte"), "xm")
        .when((n >= 1084) & known & ~zero, "mod")
    )


def list_zips(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all zips under a folder in order of path, hidden ones left out; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower(name).endswith(".zip") & ~name.startswith(".")).orderBy("path")


def outer_zips(spark: SparkSession, root: str) -> DataFrame:
    """path and content of all zips under a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower(name).endswith(".zip") & ~name.startswith(".")).select("path", F.col("content"))


def _open(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError):
        return None


def _entry(archive: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        return archive.read(name)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, ValueError, OSError):
        return None


def modules_in(path: str, data: bytes, formats: tuple[str, ...] = ()):
    """source, name and bytes of the modules in an archive of archives; unreadable parts are skipped."""
    outer = _open(data)
    for inner_name in outer.namelist() if outer else ():
        low = inner_name.lower()
        if not low.endswith(".zip"):
            continue
        if formats and low[:-4].rpartition(".")[2] not in formats:
            continue  # by the inner name, before anything is unpacked
        inner = _open(_entry(outer, inner_name) or b"")
        for name in inner.namelist() if inner else ():
            _, dot, kind = name.lower().rpartition(".")
            if name.endswith("/") or dot and kind in SIDECARS.split("|"):
                continue
            raw = _entry(inner, name)
            if raw is not None:
                yield f"{path}!{inner_name}!{name}", name, raw


def scan_corpus(zips: DataFrame, root: str = "", formats: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """source, name and bytes of every module; zips has path and content, and a task goes through its archives one by one.

    A limit other than 0 ends the scan there: the first ones by source.
    """

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py().removeprefix(root).lstrip("/")
                rows = list(modules_in(path, batch.column(1)[i].as_py(), formats))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["source", "name", "bytes"])

    found = zips.select("path", "content").mapInArrow(scan, "source string, name string, bytes binary")
    return found.orderBy("source").limit(limit) if limit else found


def lab_files(spark: SparkSession, root: str, kinds: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """path, length and content of plain files under a folder, smallest first; kinds are extensions, hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    name = F.substring_index("path", "/", -1)
    found = files.where(~name.startswith("."))
    found = found.where(F.lower(F.substring_index(name, ".", -1)).isin(*kinds)) if kinds else found
    found = found.orderBy("length", "path")
    return found.limit(most) if most else found


def database_size(header: Column) -> Column:
    """Bytes of a database file by its first 100: page size (1 stands for 65536) times pages; null for other files."""
    page = B.u16be(header, 16)
    pages = B.u16be(header, 28) * 65536 + B.u16be(header, 30)
    return F.when((F.length(header) >= 100) & (F.substring(header, 1, 16) == F.lit(b"SQLite format 3\0")), F.when(page == 1, 65536).otherwise(page) * pages)


def _exploded(files: DataFrame, key: str, data: str, schema: str, make) -> DataFrame:
    """One row for each that make(bytes) gives, with the key before it."""
    kind = files.schema[key].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):

        for batch in batches:
            owner, rows = [], []
            for i, raw in enumerate(batch.column(1)):
                got = make(raw.as_py() or b"")
                owner += [i] * len(got)
                rows += got
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, *names])

    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]
    return files.select(key, data).mapInArrow(run, f"{key} {kind}, {schema}")


def slots(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    return _exploded(files, key, data, "slot int, offset long, length long, bits int, channels int, compressed boolean, header long, packed long", lambda b: [astuple(s) for s in modules.sample_slots(b)])


def regions(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    return _exploded(files, key, data, "offset long, length long", lambda b: modules.sample_regions(b) or [])


def payloads(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    """Raw samples with their address: ord, offset, length, cid."""
    return _exploded(files, key, data, "ord int, offset long, length long, cid string", lambda b: [(i, o, n, hashlib.sha256(b[o : o + n]).hexdigest()) for i, (o, n) in enumerate(modules.sample_regions(b) or [])])


def content_chunks(files: DataFrame, sizes: tuple[int, int, int] = chunking.DEFAULT, key: str = "source", data: str = "bytes") -> DataFrame:
    """Content-defined chunks: ord, off, len, cid. Files without bytes have none."""

    def cut(batches):
        for batch in batches:
            raws = (batch.column(1)[i].as_py() or b"" for i in range(batch.num_rows))
            many, lengths, cids = [], [], []
            for raw, own in chunking.cut_runs(raws, sizes):
                view, at = memoryview(raw), 0
                for n in own:
                    cids.append(hashlib.sha256(view[at : at + n]).hexdigest())
                    at += n
                many.append(len(own))
                lengths += own
            many, lengths = np.asarray(many, np.int64), np.asarray(lengths, np.int64)
            ends, first = np.cumsum(lengths), np.cumsum(many) - many
            owner = np.repeat(np.arange(len(many)), many)
            before = np.concatenate(([0], ends))[first]
            columns = [batch.column(0).take(pa.array(owner)), pa.array((np.arange(len(owner)) - first[owner]).astype(np.int32)), pa.array(ends - lengths - before[owner]), pa.array(lengths), pa.array(cids, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "ord", "off", "len", "cid"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, data).mapInArrow(cut, f"{key} {kind}, ord int, off long, len long, cid string")


def it_reports(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    """Header counts and the share of sample data, in percent, of IT files."""
    schema = "orders int, instruments int, samples int, patterns int, compressed int, wide int, data_bytes long"
    found = _exploded(files, key, data, schema, lambda b: [r] if (r := modules.it_report(b)) else [])
    return found.join(files.select(key, F.length(data).cast("long").alias("size")), key).withColumn("percent", F.round(100 * F.col("data_bytes") / F.col("size"), 1))


def packed_spans(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    """packed: bytes of a compressed sample that fills the file, by frames and bits columns in front of it."""
    return _exploded(files, key, data, "packed long", lambda b: [(modules.packed_span(b[5:], 0, int.from_bytes(b[:4], "little"), b[4], 1),)])


def metadata(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    """format, title and number of samples of each module; a format is null where the bytes are no module."""

    def read(data: bytes):
        fmt = modules.detect(data)
        return [(fmt, modules.title_of(data, fmt), len(modules.sample_slots(data, fmt)))]

    return _exploded(files, key, data, "format string, title string, num_samples int", read)


def events(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    """What each played order does, as operators.seek takes it."""
    schema = "place int, order int, rows int, speed0 int, tempo0 int, seq int, row int, channel int, sample int, note boolean, off boolean, speed int, tempo int"
    return _exploded(files, key, data, schema, lambda b: list(patterns.played(b)))


def sample_offsets(files: DataFrame, key: str = "source", data: str = "bytes") -> DataFrame:
    """sample (from 0) and offset of every sample that has bytes."""
    return _exploded(files, key, data, "sample int, offset long", lambda b: [(s.slot - 1, s.offset) for s in modules.READERS.get(modules.detect(b) or "mo3")(modules.Bytes(b))])
