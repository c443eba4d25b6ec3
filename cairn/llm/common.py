"""What the corpus operators share: shared folders, text batches and 64-bit hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete, work_folder

#: A-Z to a-z and nothing else, in SQL and in bytes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space of the text contracts: blank and the controls from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of text that are worked on at once in numpy; a longer single text is taken whole.
CHUNK_BYTES = 1 << 19
#: Bytes of the rows a broadcast may hold; beyond, operators shuffle instead.
BROADCAST_BYTES = 64 << 20


def _glibc(name: str, *args: int) -> None:
    with contextlib.suppress(OSError, AttributeError):  # other systems do without
        getattr(ctypes.CDLL(None), name)(*args)


# Python workers live as long as their executor: large buffers go back to the system when freed
# (mallopt: from this size on by mmap), and what a batch took does so after it (give_back).
pa.set_memory_pool(pa.system_memory_pool())
_glibc("mallopt", -3, 1 << 20)


def give_back() -> None:
    """Return free memory of this process to the system."""
    _glibc("malloc_trim", 0)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, by its full name, which the driver and all executors see.

    Where the session has no such setting (tests in local mode), a folder of this process is used.
    """
    return work_folder(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in a shared folder and read it back: it is computed once, and its lineage is cut."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Work:
    """Written tables of one run of an operator, in a shared folder of its own; they can go when nothing needs them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths, self.count = spark, shared_dir(spark, name), {}, 0

    def write(self, df: DataFrame, name: str, drop: list[str] = ()) -> DataFrame:
        """df as a written table, read back: computed once, its lineage cut. Tables of the names in drop go after that."""
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        df.write.parquet(path)
        self.drop(*drop)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; no later plan may read them."""
        for path in [p for n in names for p in self.paths.pop(n, [])]:
            delete(self.spark, path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(n for n in list(self.paths) if n not in names))


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, a materialized table, has few enough rows of row_bytes each for a broadcast."""
    return df.count() * row_bytes <= limit


def join_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit) else df


def merged_ranges(facts: DataFrame, column: str) -> DataFrame:
    """facts with the ranges of a column (an array of two integers each, start and end, sorted by start) joined where they overlap or touch."""

    def merge(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            lists = batch.column(at)
            flat, ends = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            row = np.searchsorted(ends, np.arange(len(flat)), side="right")
            a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten())
            shift = row * (int(b.max()) + 2 if len(b) else 1)  # rows lie one after another
            reach = np.maximum.accumulate(b + shift)
            first = np.flatnonzero(np.append(True, a[1:] + shift[1:] > reach[:-1])) if len(a) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(a)) - 1
            parts = [pa.array(x, flat.type.field(i).type) for i, x in enumerate((a[first], (reach - shift)[last] if len(a) else a))]
            made = pa.StructArray.from_arrays(parts, fields=[flat.type.field(i) for i in range(2)])
            offsets = np.searchsorted(row[first], np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), made) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return facts.mapInArrow(merge, facts.schema)


def by_document(docs: DataFrame, facts: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs (with doc_id and _text_hash) left-joined with facts (a written table of _id and _hash, one row for each document).

    The texts stay where they are if the facts' counted bytes fit a broadcast; beyond, both sides are shuffled.
    """
    size = facts.agg(F.sum(row_bytes)).first()[0] or 0
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    return docs.join(F.broadcast(facts) if size <= limit else facts, same, "left")


def join_skewed(rows: DataFrame, side: DataFrame, keys: list[str], hot: Column, row_bytes: int = 64, salts: int = 32, limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with side (a written table, a row for each key) where some keys, those that are hot, have very many rows.

    Hot keys go by broadcast if few enough, else to so many copies that rows are dealt over; only the rest is shuffled by key alone.
    """
    many, rest = side.where(hot), side.where(~hot)
    if fits_broadcast(many, row_bytes, limit):
        many, on = F.broadcast(many), keys
    else:
        many, on = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"]
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    found = rows.join(many, on).drop("_salt")
    return found.unionByName(rows.join(many.select(*on), on, "left_anti").drop("_salt").join(rest, keys))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(column: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fold_column(col):
    """The column with A-Z in lower case; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts as UTF-8 of about limit bytes together, each with the index of its first text; null is empty.

    Only one run at a time is copied out of the Arrow array.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        after = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, [raw or b"" for raw in texts.slice(first, after - first).cast(pa.binary()).to_pylist()]
        first = after
    give_back()


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a line feed after each text, and where each text starts (with the end as the last entry)."""
    starts = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=starts[1:])
    return np.frombuffer(b"\n".join([*raws, b""]), np.uint8), starts


def word_table(separators: str | bytes) -> np.ndarray:
    """For each byte whether it belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators.encode("latin-1") if isinstance(separators, str) else separators)] = False
    return table


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit with probability near one half."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as longer buffers come."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * CHUNK_BYTES)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    x = np.full(size, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    return _Powers.of(n)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over random byte values; entry i covers the first i bytes."""
    up, _ = _Powers.of(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up, out=out[1:], dtype=np.uint64)
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, whatever its place."""
    _, down = _Powers.of(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts])


def words_of(raws: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends, word hashes and the first word's index of each text (the end as the last entry)."""
    data, texts = joined(raws)
    starts, ends = runs(table[data])
    return data, starts, ends, span_hashes(prefix_hashes(data), starts, ends), np.searchsorted(starts, texts)


def batch_texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of an Arrow record batch."""
    return batch.column(batch.schema.get_field_index(column))


def strings(texts: pa.Array, rows: int = 64) -> Iterator[str | None]:
    """The texts one by one, copied a few at a time."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()
    give_back()


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Wanted:
    """Which 64-bit keys count in a batch: a broadcast sorted array, or each document's own list (fourth column)."""

    def __init__(self, shared=None):
        self.shared = shared

    def of(self, batch, at: int, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A mask over keys; owner is each key's text in the chunk that starts at row `at` of the batch."""
        if self.shared is not None:
            return _member(keys, self.shared.value)
        out = np.zeros(len(keys), bool)
        for i in np.unique(owner).tolist():
            own = batch.column(3)[at + i].values
            if own is not None and len(own):
                mine = owner == i
                out[mine] = _member(keys[mine], np.sort(own.to_numpy(zero_copy_only=False).view(np.uint64)))
        return out


def with_wanted(docs: DataFrame, keys: DataFrame, placed: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, Wanted]:
    """docs (doc_id, text, text_hash) and the test for the wanted keys (column key).

    Up to limit bytes the keys are broadcast. Beyond, `placed` (doc_id, text_hash and key of every
    occurrence) is joined with them by shuffle, and each document that has any comes with its own list.
    """
    if keys.count() * 8 <= limit:
        rows = keys.select("key").toLocalIterator()
        return docs, Wanted(docs.sparkSession.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in rows), np.int64).view(np.uint64))))
    own = placed.join(keys.select("key"), "key").groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))
    own = own.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text", "text_hash", "keys"), Wanted()
