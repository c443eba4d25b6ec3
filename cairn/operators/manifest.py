"""Manifests of modules: what a player fetches, as rows, addresses and back.

A module is a skeleton (structure pieces with runs of zeros between them) and samples (each a list of chunk addresses).
The manifest is a text whose digest is the module's root; where it is too long, the index (samples and plan) is a block of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binary import digest
from ..sources.folders import delete, work_folder, written
from ..sources.folders import store as put
from .blocks import joined_bytes, zero_bytes
from .intervals import prefix_offsets

VERSION = 2
#: Characters of a manifest from which the index is spilled.
SPILL = 262144
#: Hashes of addresses that are sent to all tasks: 64 MiB of them, at 16 bytes each.
MOST_HASHES = 1 << 22
#: Blocks that go through the shuffle at a time, and ranges of addresses that follow one another at most where there are more.
MOST_BLOCKS, RANGES = 1_000_000, 4
SAMPLES = "array<struct<index:int,frames:bigint,channels:int,bitDepth:int,chunks:array<string>>>"
INDEX = f"struct<samples:{SAMPLES},plan:array<bigint>>"
MANIFEST = f"struct<v:int,format:string,skeletonChunks:array<string>,skeletonLayout:array<int>,index:{INDEX},indexRoot:string>"
#: A manifest or an index, as far as it refers to blocks.
BLOCK = f"struct<skeletonChunks:array<string>,index:{INDEX},indexRoot:string,samples:{SAMPLES}>"


def sample_rows(chunks: DataFrame, key: str = "id") -> DataFrame:
    """A row for each sample: its index, frames, channels, bit depth and chunk addresses in order (chunks has key, index, frames, channels, bit_depth, ord, cid)."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "cid"))), lambda x: x["cid"])
    return chunks.groupBy(key, "index").agg(F.first("frames").alias("frames"), F.first("channels").alias("channels"), F.first("bit_depth").alias("bitDepth"), parts.alias("chunks"))


def manifests(skeletons: DataFrame, samples: DataFrame, key: str = "id", spill: int = SPILL) -> DataFrame:
    """key, root, manifest, spilled, and index (the spilled block's text, else null).

    skeletons has key, format, skeletonChunks, skeletonLayout and plan; samples come from sample_rows. A module without samples has none.
    """
    table = F.sort_array(F.collect_list(F.struct(*(F.col(c) for c in ("index", "frames", "channels", "bitDepth", "chunks")))))
    listed = samples.groupBy(key).agg(table.alias("samples"))
    both = skeletons.join(listed, key, "left").withColumn("samples", F.coalesce("samples", F.array().cast(SAMPLES)))
    index = F.struct("samples", "plan")
    head = [F.lit(VERSION).alias("v"), F.col("format"), F.col("skeletonChunks"), F.col("skeletonLayout")]
    inline = F.to_json(F.struct(*head, index.alias("index")))
    both = both.withColumn("_inline", inline).withColumn("_index", F.to_json(index)).withColumn("spilled", F.length("_inline") > spill)
    apart = F.to_json(F.struct(*head, digest(F.col("_index").cast("binary")).alias("indexRoot")))
    both = both.withColumn("manifest", F.when(F.col("spilled"), apart).otherwise(F.col("_inline")))
    return both.select(key, digest(F.col("manifest").cast("binary")).alias("root"), "manifest", "spilled", F.when(F.col("spilled"), F.col("_index")).alias("index"))


def manifest_blocks(made: DataFrame) -> DataFrame:
    """The blocks (cid, bytes) of manifests and spilled indexes; texts that repeat are there more than once."""
    texts = made.select(F.explode(F.array_compact(F.array("manifest", "index"))).alias("text"))
    return texts.select(digest(F.col("text").cast("binary")).alias("cid"), F.col("text").cast("binary").alias("bytes"))


def _looked_up(refs: DataFrame, store: DataFrame) -> DataFrame:
    """The blocks (cid, bytes) that refs (written, with cid) may name: others are left out before the store is shuffled.

    Hashes of the addresses are sent to all tasks where they are few (they were counted); else the whole store is looked up. Either way blocks are then
    joined by their addresses.
    """
    if refs.count() <= MOST_HASHES:
        store = store.join(F.broadcast(refs.select(F.xxhash64("cid").alias("_h")).distinct()), F.xxhash64("cid") == F.col("_h"), "left_semi")
    return store.select("cid", "bytes")


def address_ranges(n: int) -> list[Column]:
    """Tests of cid that part n blocks by the first digit of their addresses."""
    many = max(1, min(RANGES, -(-n // MOST_BLOCKS)))
    starts, cid = [f"{16 * i // many:x}" for i in range(1, many)], F.col("cid")
    return [(cid >= a if a else F.lit(True)) & (cid < b if b else F.lit(True)) for a, b in zip([None, *starts], [*starts, None], strict=True)]


def _address() -> Column:
    """The bytes of an address as `digest` writes it, which are half as long in the shuffle; null for any other text."""
    return F.when(F.col("cid").rlike("^[0-9a-f]{64}$"), F.unhex("cid"))


def put_blocks(blocks: DataFrame, n: int, path: str) -> DataFrame:
    """A store of about n blocks (cid, bytes) with each address once, written to path. What isn't an address is refused."""
    at = F.coalesce(_address(), F.raise_error(F.concat(F.lit("no address: "), F.col("cid"))).cast("binary"))
    for some in address_ranges(n):
        each = blocks.where(some).groupBy(at.alias("_at")).agg(F.first("bytes").alias("bytes"))
        put(each.select(F.lower(F.hex("_at")).alias("cid"), "bytes"), path, "append")
    return blocks.sparkSession.read.schema("cid string, bytes binary").parquet(path)


def _read(refs: DataFrame, store: DataFrame, path: str, few: bool = True) -> DataFrame:
    """refs (of a written table, with cid) and the bytes of their blocks, written to path without cid. A block that the store may have more than once is read once,
    from bytes that fit its address; one that it has only with other bytes fails, and so does one that it doesn't have.

    few says that refs may name few blocks of the store, see `_looked_up`.
    """
    refs = refs.withColumn("cid", F.coalesce("cid", F.lit("")))
    sound = F.when(digest(F.col("bytes")) == F.col("cid"), F.col("bytes"))
    fails = F.raise_error(F.concat(F.when(F.col("_have"), "damaged block ").otherwise("missing block "), F.col("cid"))).cast("binary")
    for some in address_ranges(refs.count()):
        named, there = refs.where(some), store.where(some)
        there = _looked_up(named, there) if few else there
        have = there.groupBy(_address().alias("_at")).agg(F.first(sound, ignorenulls=True).alias("_sound"), F.first(F.lit(True)).alias("_have"))
        found = named.withColumn("_at", _address()).join(have, "_at", "left").withColumn("bytes", F.when(F.col("_sound").isNotNull(), F.col("_sound")).otherwise(fails))
        put(found.select(*(c for c in refs.columns if c != "cid"), "bytes"), path, "append")
    return refs.sparkSession.read.schema(refs.drop("cid").withColumn("bytes", F.lit(b"")).schema).parquet(path)


def _parsed(refs: DataFrame, store: DataFrame, kind: str, path: str) -> DataFrame:
    """refs with _value, the JSON of their blocks, which are written to path; only blocks that are referred to are read as text."""
    return _read(refs, store, path).withColumn("_value", F.from_json(F.col("bytes").cast("string"), kind)).drop("bytes")


def fetch_indexes(roots: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """key, m (format, skeletonChunks, skeletonLayout) and index of roots (key, root) from a block store (cid, bytes), written.

    A manifest of another version is refused here. Texts of manifests and indexes go when the result is whole.
    """
    spark, own = store.sparkSession, work_folder(store.sparkSession, "texts")
    try:
        read = _parsed(written(roots.select(key, F.col("root").alias("cid")), "roots"), store, MANIFEST, f"{own}/manifests").withColumnRenamed("_value", "m")
        if not read.where(~F.col("m.v").eqNullSafe(F.lit(VERSION))).isEmpty():
            raise ValueError(f"not all roots are manifests of version {VERSION}")
        apart = _parsed(read.where("m.indexRoot IS NOT NULL").select(key, F.col("m.indexRoot").alias("cid")), store, INDEX, f"{own}/indexes").withColumnRenamed("_value", "_apart")
        kept = F.struct("m.format", "m.skeletonChunks", "m.skeletonLayout").alias("m")
        return written(read.join(apart, key, "left").select(key, kept, F.coalesce("m.index", "_apart").alias("index")), "indexes")
    finally:
        delete(spark, own)


def fetch_samples(read: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """(key, index, frames, channels, bitDepth, pcm) of what `fetch_indexes` gave. Pieces lie in a work table; the store isn't read any more."""
    flat = read.select(key, F.explode("index.samples").alias("s")).select(key, "s.*")
    refs = flat.select(key, "index", F.posexplode("chunks").alias("ord", "cid"))
    pieces = _read(refs, store, work_folder(store.sparkSession, "pieces"), few=False)
    sounds = flat.drop("chunks").join(joined_bytes(pieces, [key, "index"], "ord").withColumnRenamed("bytes", "pcm"), [key, "index"], "left")
    return sounds.select(key, "index", "frames", "channels", "bitDepth", F.coalesce("pcm", F.lit(b"")).alias("pcm"))


def fetch(roots: DataFrame, store: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(key, format, skeleton, plan) and (key, index, frames, channels, bitDepth, pcm) of roots (key, root) from a block store (cid, bytes).

    A manifest of another version is refused here; every block, manifests and indexes too, is checked against its address when it is read. The store is looked up
    by address: for manifests, for indexes of their own, for pieces of skeletons and for samples.
    """
    read = fetch_indexes(roots, store, key)
    return fetch_skeletons(read, store, key), fetch_samples(read, store, key)


def fetch_skeletons(read: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """(key, format, skeleton, plan) of what `fetch_indexes` gave: pieces by their number, and each run of zeros before the piece that follows it.

    The recipe is [pieces, zeros, pieces, zeros, ...]; pieces that it doesn't count are read and left out. Without a recipe all pieces follow one another.
    """
    layout = F.col("m.skeletonLayout")
    count = (F.size(layout) / 2).cast("int")
    steps = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)), lambda i: F.struct(layout[2 * i].alias("n"), layout[2 * i + 1].alias("z")))
    runs = read.select(key, F.posexplode(steps).alias("i", "c")).select(key, "i", F.col("c.n").alias("n"), F.col("c.z").alias("z"))
    runs = prefix_offsets(runs, key, ["i"], "n").select(key, (F.col("offset") + F.col("n")).alias("ord"), F.lit(0).alias("piece"), "i", zero_bytes(F.col("z")).alias("bytes"))
    counted = F.aggregate(F.filter(layout, lambda _, i: i % 2 == 0), F.lit(0).cast("long"), lambda t, x: t + x)
    counted = F.when(F.coalesce(F.size(layout), F.lit(0)) <= 0, F.size("m.skeletonChunks")).otherwise(counted)
    refs = read.select(key, counted.alias("_counted"), F.posexplode("m.skeletonChunks").alias("ord", "cid"))
    kept = F.substring(F.col("bytes"), F.lit(1), F.when(F.col("ord") < F.col("_counted"), F.length("bytes")).otherwise(F.lit(0)))
    pieces = _read(refs, store, work_folder(store.sparkSession, "pieces")).select(key, F.col("ord").cast("long").alias("ord"), F.lit(1).alias("piece"), F.lit(0).alias("i"), kept.alias("bytes"))
    made = joined_bytes(runs.unionByName(pieces).withColumn("_place", F.struct("ord", "piece", "i")), [key], "_place").withColumnRenamed("bytes", "skeleton")
    out = read.join(made, key, "left")
    return out.select(key, F.col("m.format").alias("format"), F.coalesce("skeleton", F.lit(b"")).alias("skeleton"), F.col("index.plan").alias("plan"))


def links_of(text: Column) -> Column:
    """What a block that is a manifest or an index refers to, in order: cid, and whether that block has references of its own."""
    m = F.from_json(text, BLOCK)
    leaves = lambda cids: F.transform(F.coalesce(cids, F.array().cast("array<string>")), lambda c: F.struct(c.alias("cid"), F.lit(False).alias("inner")))
    root = F.when(m["indexRoot"].isNotNull(), F.array(F.struct(m["indexRoot"].alias("cid"), F.lit(True).alias("inner")))).otherwise(leaves(F.lit(None).cast("array<string>")))
    return F.concat(leaves(m["skeletonChunks"]), root, leaves(F.flatten(m["index"]["samples"]["chunks"])), leaves(F.flatten(m["samples"]["chunks"])))


def walk(roots: DataFrame, store: DataFrame, key: str = "id", links=links_of) -> DataFrame:
    """key, place, level and cid of every reference of the graphs below roots (key, root), in the order of a walk downwards; repeats stay.

    Frontier by frontier: blocks that have references of their own are looked up by address and read, all others are only named. A frontier is written before the
    next one is made of it. A block that the store doesn't have fails; the store may have a block more than once.
    """
    frontier = written(roots.select(key, F.lit(0).alias("level"), F.array().cast("array<int>").alias("path"), F.col("root").alias("cid"), F.lit(True).alias("inner")), "frontier")
    found = frontier
    while not frontier.isEmpty():
        inner = frontier.where("inner")
        read = inner.join(_looked_up(inner, store).dropDuplicates(["cid"]).select("cid", F.col("bytes").cast("string").alias("_text")), "cid", "left")
        text = F.when(F.col("_text").isNotNull(), F.col("_text")).otherwise(F.raise_error(F.concat(F.lit("missing block "), F.col("cid"))).cast("string"))
        below = read.select(key, F.col("level") + 1, "path", F.posexplode(links(text)).alias("_i", "_l")).toDF(key, "level", "path", "_i", "_l")
        frontier = written(below.select(key, "level", F.concat("path", F.array("_i")).alias("path"), "_l.cid", "_l.inner"), "frontier")
        found = found.unionByName(frontier)
    place = F.row_number().over(W.partitionBy(key).orderBy("path")) - 1
    return found.select(key, place.alias("place"), "level", "cid")
