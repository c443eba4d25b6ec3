"""Media columns: content-addressed images in tar shards, read back by byte ranges.

A text becomes the samples of an 8-bit grey image of fixed width, stored as PNG (lossless).
Payloads are digested first; one document of each digest is its holder, and the task that reads the
holder writes the image to a tar shard in the shared folder, so a payload has one place over the whole table. The member's
name is the digest, and every row carries digest, shard, offset and length. Metadata columns come from range reads of the
image header alone; features come from the whole stored bytes, read back and decoded once for each digest. Reading
is dealt by shard and place in it, in parts of `READ_BYTES` of media, each in the order of the file.

A shard is written under a name of its attempt and renamed when whole; its bytes depend on
its rows and their order alone, so a task that runs again leaves the same file if docs is a written table. The index is a written
table; a lost executor costs only the tasks that it ran.

Defined cases: null and empty texts give one row of 576 fill bytes; equal texts give equal values;
repeated rows stay rows (an image that equal rows of one document bring to several tasks is stored by each; all rows name the first place);
an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import qualified
from .common import Work, batch_texts, join_side, shared_dir, strings

#: Samples of an image row, and what fills the last one up.
WIDTH, FILL = 576, b"\xff"
#: Bytes after which a task starts a new shard.
SHARD_BYTES = 128 << 20
#: Bytes of media that a task reads back on average.
READ_BYTES = 16 << 20
PNG = b"\x89PNG\r\n\x1a\n"
#: Signature, length, type and the 13 header bytes: all that metadata needs.
HEADER_BYTES = 29
_LEVEL = 6


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The samples of a text and its own length in bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + FILL * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of WIDTH columns."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(grid), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = grid
    head = struct.pack(">IIBBBBB", WIDTH, len(grid), 8, 0, 0, 0, 0)
    return PNG + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), _LEVEL)) + _part(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from the first HEADER_BYTES."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    """The samples of an image that encode_png made; checksums are verified."""
    at, packed, (width, height, depth) = 8, [], png_header(media[:HEADER_BYTES])
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * depth // 8 + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and 16 histogram shares of the samples, in per mille; then 64 bits, cells of an 8 x 8 grid above the mean."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    counts = np.bincount(x, minlength=256)
    square = int((counts * np.arange(256, dtype=np.int64) ** 2).sum())
    deviation = int((square * n - total * total) ** 0.5 * 1000 / n)
    shares = (counts.reshape(16, 16).sum(1) * 1000 // n).tolist()
    rows = x.reshape(-1, WIDTH)
    bands = np.add.reduceat(rows.reshape(len(rows), 8, WIDTH // 8).sum(2, dtype=np.int64), np.arange(8) * len(rows) // 8, axis=0)
    sizes = np.maximum(1, np.diff(np.append(np.arange(8) * len(rows) // 8, len(rows))))[:, None] * (WIDTH // 8)
    bits = (bands * n > total * sizes).reshape(-1)
    return f"{total * 1000 // n}:{deviation}:{','.join(map(str, shares))}:{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


class _Shard:
    """A tar file in the making."""

    def __init__(self, fs, folder: str, name: str):
        self.fs, self.target, self.temp = fs, f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.at = fs.open_output_stream(self.temp), 0

    def add(self, name: str, data: bytes) -> int:
        """Where the data start."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % 512))
        start = self.at + len(head)
        self.at = start + len(data) + -len(data) % 512
        return start

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()
        self.fs.move(self.temp, self.target)


def payload_digest(text: Column) -> Column:
    """SHA-256 of the samples of a text, without Python."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    fill = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("FF"), fill.cast("int")))), 256)


def write_media(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, work: Work | None = None) -> tuple[DataFrame, DataFrame]:
    """Store every distinct payload; the written index (doc_id, n_bytes, digest) and the written places (digest, shard, offset, length)."""
    spark = docs.sparkSession
    work = work or Work(spark, "media-work")
    folder = qualified(spark, folder) if folder else shared_dir(spark, "media")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    docs = docs.select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    index = work.write(docs.select("doc_id", n_bytes.alias("n_bytes"), payload_digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("_hash")), "index")
    # The holder of a digest: the least document by id and text (copies differ in what they are padded with, or in id).
    holders = index.groupBy("digest").agg(F.min(F.struct(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "_hash")).alias("h")).select(F.col("h.doc_id").alias("_id"), F.col("h._hash").alias("_hash"))
    side = join_side(work.write(holders.distinct(), "holders"), 64)
    held = docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi").select("text")

    def store(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        part, count, shard, seen = TaskContext.get().partitionId(), 0, None, set()
        for batch in batches:
            rows = []
            for text in strings(batch_texts(batch)):
                payload, _ = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest in seen:
                    continue
                if shard is not None and shard.at >= shard_bytes:
                    shard.close()
                    shard, seen = None, set()
                if shard is None:
                    shard, count = _Shard(fs, path, f"{part:06d}-{count:04d}.tar"), count + 1
                seen.add(digest)
                media = encode_png(payload)
                rows.append((digest, f"{folder}/{shard.target.rpartition('/')[2]}", shard.add(f"{digest}.png", media), len(media)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    written = work.write(held.mapInArrow(store, "digest string, shard string, offset long, length long"), "stored")
    return index.drop("_hash"), work.write(canonical(written), "places")


class _Reader:
    """Range reads; the last shard stays open."""

    def __init__(self):
        self.name, self.file = "", io.BytesIO()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            fs, path = pafs.FileSystem.from_uri(shard)
            self.name, self.file = shard, fs.open_input_file(path)
        return self.file.read_at(length, offset) if length else b""


def dealt_reads(places: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """The places (a written table) in partitions of about read_bytes of media, each in the order of its shards."""
    total = places.agg(F.sum("length")).first()[0] or 0
    dealt = places.repartition(max(1, -(-total // read_bytes)), "shard", F.floor(F.col("offset") / (read_bytes // 4)))
    return dealt.sortWithinPartitions("shard", "offset")


def read_headers(index: DataFrame) -> DataFrame:
    """The index with width, height and bit_depth; only HEADER_BYTES of each member are read."""
    names = ["width", "height", "bit_depth"]

    def look(batches):
        reader = _Reader()
        for batch in batches:
            shard, offset = batch.column("shard").to_pylist(), batch.column("offset").to_pylist()
            heads = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(shard, offset, strict=True)]
            columns = [pa.array([h[i] for h in heads], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    from pyspark.sql import types as T

    return index.mapInArrow(look, T.StructType([*index.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def read_features(index: DataFrame) -> DataFrame:
    """The index with what the stored bytes say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    from pyspark.sql import types as T

    added = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def look(batches):
        reader = _Reader()
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                media = reader.read(shard, offset, length)
                payload = decode_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64() if isinstance(k, T.LongType) else pa.string()) for c, (_, k) in zip(columns, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(n for n, _ in added)])

    return index.mapInArrow(look, T.StructType([*index.schema.fields, *(T.StructField(n, k) for n, k in added)]))


def canonical(written: DataFrame) -> DataFrame:
    """One place for each digest over all shards (the first by shard and offset): digest, shard, offset, length."""
    return written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store all texts, then one row for each with its place, metadata and features."""
    work = Work(docs.sparkSession, "media-work")
    index, places = write_media(docs, folder, shard_bytes, work)
    facts = work.write(read_features(read_headers(dealt_reads(places))), "features")
    work.drop("holders", "stored", "places")
    return index.join(facts, "digest").select("doc_id", *(c for c in index.columns if c != "doc_id"), *(c for c in facts.columns if c != "digest"))
