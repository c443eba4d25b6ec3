"""Content-addressed blocks: chunking, verification, ordered reassembly, byte ranges and duplicate statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import digest, fixed_chunks
from .intervals import prefix_offsets


def chunk_blocks(files: DataFrame, size: int, key: str = "id", data: str = "bytes") -> DataFrame:
    """One row for each fixed-size chunk: key, ord, off, len, cid, bytes."""
    each = files.select(key, F.explode(fixed_chunks(F.col(data), size)).alias("c"))
    return each.select(key, "c.ord", "c.off", F.length("c.bytes").alias("len"), digest(F.col("c.bytes")).alias("cid"), F.col("c.bytes").alias("bytes"))


def put(store: DataFrame, blocks: DataFrame) -> DataFrame:
    """The store (cid, bytes) with new blocks, each address once."""
    return store.unionByName(blocks.select("cid", "bytes").dropDuplicates(["cid"]).join(store, "cid", "left_anti"))


def mismatched(blocks: DataFrame, cid: str = "cid", data: str = "bytes") -> DataFrame:
    """Blocks whose bytes have another digest than their address."""
    return blocks.where(digest(F.col(data)) != F.col(cid))


def missing(wanted: DataFrame, store: DataFrame, cid: str = "cid") -> DataFrame:
    """Wanted rows whose address the store doesn't have."""
    return wanted.join(store.select(F.col("cid").alias("_have")).distinct(), F.col(cid) == F.col("_have"), "left_anti")


def reassemble(edges: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """key and bytes from an ordered chunk list (key, ord, cid) and a block store; repeated addresses are read once each."""
    parts = edges.join(store.select("cid", F.col("bytes").alias("_bytes")).dropDuplicates(["cid"]), "cid")
    return joined_bytes(parts, [key], "ord", "_bytes")


def read_ranges(chunks: DataFrame, ranges: DataFrame, key: str = "id") -> DataFrame:
    """Bytes of [offset, offset + length) of each file from its chunks (key, off, len, bytes); short at the end of the file.

    Ranges join on the file, and only chunks that overlap pass.
    """
    over = (F.col("off") < F.col("offset") + F.col("length")) & (F.col("off") + F.col("len") > F.col("offset"))
    lo = F.greatest(F.col("offset") - F.col("off"), F.lit(0))
    hi = F.least(F.col("offset") + F.col("length") - F.col("off"), F.col("len"))
    cut = chunks.join(ranges, key).where(over).select(key, "offset", "length", "off", F.substring("bytes", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("bytes"))
    return joined_bytes(cut, [key, "offset", "length"], "off").withColumnRenamed("bytes", "data")


def zero_bytes(count: Column) -> Column:
    """So many zero bytes."""
    return F.lpad(F.lit("").cast("binary"), count.cast("int"), F.lit(b"\x00"))


def joined_bytes(pieces: DataFrame, keys: list[str], order: str, data: str = "bytes") -> DataFrame:
    """keys and bytes: the pieces of each key one after another, by one ordered aggregate."""
    return pieces.groupBy(*keys).agg(F.expr(f"listagg({data}) WITHIN GROUP (ORDER BY {order})").alias("bytes"))


def expand_runs(rows: DataFrame, pairs: str, content: str, key: str) -> DataFrame:
    """Content with zero bytes put back: pairs are [content bytes, zeros, content bytes, zeros, ...]; key tells rows apart.

    Pairs become rows, a running sum gives each piece its place in the content, and pieces and zeros are put together by one ordered
    aggregate; every byte is copied a fixed number of times, however many pairs there are.
    """
    n = F.col(pairs)
    count = (F.size(n) / 2).cast("int")
    cut = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)), lambda i: F.struct(n[2 * i].alias("n"), n[2 * i + 1].alias("z")))
    each = rows.select(key, F.posexplode(cut).alias("_i", "_c")).select(key, "_i", F.col("_c.n").alias("_n"), F.col("_c.z").alias("_z"))
    placed = prefix_offsets(each, key, ["_i"], "_n").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "offset", "_n", "_z"))).alias("_cuts"))
    piece = lambda c: F.concat(F.substring(F.col(content), (c["offset"] + 1).cast("int"), c["_n"]), zero_bytes(c["_z"]))
    pieces = rows.select(key, content).join(placed, key).select(key, F.posexplode(F.transform("_cuts", piece)).alias("_i", "bytes"))
    made = joined_bytes(pieces, [key], "_i").withColumnRenamed("bytes", "expanded")
    out = rows.join(made, key, "left")
    return out.withColumn("expanded", F.when(F.col(content).isNotNull(), F.coalesce("expanded", F.lit(b""))))


def dedup_stats(blocks: DataFrame, cid: str = "cid", size: str = "len") -> DataFrame:
    """Total and unique pieces and bytes, and the share that repeats (0 where there is nothing)."""
    each = blocks.groupBy(cid).agg(F.count(F.lit(1)).alias("n"), F.first(size).cast("long").alias("b"))
    out = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.count(F.lit(1)).alias("unique_pieces"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"),
        F.coalesce(F.sum(F.col("n") * F.col("b")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("b"), F.lit(0)).alias("unique_bytes"),
    )
    return out.withColumn("saved", F.when(F.col("bytes") == 0, 0.0).otherwise(F.round(1 - F.col("unique_bytes") / F.col("bytes"), 6)))


def most_reused(blocks: DataFrame, k: int = 12, cid: str = "cid", size: str = "len") -> DataFrame:
    each = blocks.groupBy(cid).agg(F.count(F.lit(1)).alias("n"), F.first(size).cast("long").alias("bytes"))
    return each.orderBy(F.col("n").desc(), F.col("bytes").desc(), F.col(cid)).limit(k)


def pooled_stats(blocks: DataFrame, pool: str, cid: str = "cid", size: str = "len") -> DataFrame:
    """Total and unique pieces and bytes of each pool."""
    each = blocks.groupBy(pool, cid).agg(F.count(F.lit(1)).alias("n"), F.first(size).cast("long").alias("b"))
    return each.groupBy(pool).agg(F.sum("n").alias("pieces"), F.count(F.lit(1)).alias("unique_pieces"), F.sum(F.col("n") * F.col("b")).alias("bytes"), F.sum("b").alias("unique_bytes"))


def new_leaves(touched: DataFrame, known: DataFrame, cid: str = "cid", links: str = "links") -> DataFrame:
    """Addresses of touched nodes without links that aren't known yet, each once."""
    return touched.where(F.col(links) == 0).select(cid).distinct().join(known.select(cid), cid, "left_anti")


def group_hash(data: Column) -> Column:
    """16 hex digits for grouping equal content; an address needs `digest`."""
    return F.lower(F.lpad(F.hex(F.xxhash64(data)), 16, "0"))
