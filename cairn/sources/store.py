"""The stored catalogue: declared schema, tables in a folder, verified snapshots, rotation and small state files.

A catalogue folder has segments and a log of commits (`commits`) that says which of them it holds. A segment has modules
(range-partitioned and sorted by id, so a lookup reads one row group), the search index over them and their counts by format; meta (precomputed
aggregates) is folded from the segments' counts. An append writes one segment of new rows and reads no more of the others than their
sources; segments of like size are merged, so that there are about as many as the number of rows has bits. A snapshot is a
merged copy under its own name; the log of its name has it only after the copy was read back and compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog, fts
from . import commits
from .folders import copy, delete, readable, work_folder
from .folders import store as put

_long, _text = T.LongType(), T.StringType()
MODULES = T.StructType([
    T.StructField("id", _long, False), T.StructField("source", _text, False), T.StructField("filename", _text, False), T.StructField("format", _text, False), T.StructField("title", _text),
    T.StructField("duration", T.DoubleType()), T.StructField("channels", _long), T.StructField("num_samples", _long), T.StructField("num_instruments", _long), T.StructField("num_subsongs", _long),
    T.StructField("root_cid", _text, False), T.StructField("num_blocks", _long), T.StructField("size_bytes", _long), T.StructField("instruments", _text), T.StructField("comment", _text), T.StructField("ingested_at", _long),
])
META = T.StructType([T.StructField("key", _text, False), T.StructField("value", _text, False)])
POINTERS = T.StructType([T.StructField("name", _text), T.StructField("version", _long), T.StructField("path", _text), T.StructField("checksums", T.MapType(_text, _text))])
COUNTS = T.StructType([T.StructField("format", _text), T.StructField("count", _long)])
SEARCHED = ("title", "filename", "instruments", "comment")
TABLES = ("modules", "meta", "postings", "totals")
#: What a segment has.
STORED = ("modules", "counts", *fts.INDEX_TABLES)

#: The lowest 22 bits.
LOW = (1 << 22) - 1

_made: dict[tuple, str] = {}


def stored_once(spark: SparkSession, key: tuple, name: str, build: Callable[[str], None]) -> str:
    """The folder that build filled for this key; it is filled once in an application."""
    key = (spark.sparkContext.applicationId, name, *key)
    if key not in _made:
        folder = work_folder(spark, name)
        build(folder)
        _made[key] = folder
    return _made[key]


def conform(rows: DataFrame, schema: T.StructType = MODULES) -> DataFrame:
    """rows with the declared columns and types; columns that aren't there are null, and a null where none may be is refused."""
    have = set(rows.columns)
    columns = []
    for f in schema:
        c = (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
        columns.append((c if f.nullable else F.coalesce(c, F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType))).alias(f.name))
    return rows.select(*columns)


def searched_columns() -> dict[str, Column]:
    return {c: F.col(c) for c in SEARCHED}


def _write_segment(rows: DataFrame, folder: str) -> dict:
    """A segment of rows (conforming, with ids) and what the log says of it."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    put(rows.repartitionByRange("id").sortWithinPartitions("id"), f"{folder}/modules/{name}")
    modules = spark.read.schema(MODULES).parquet(f"{folder}/modules/{name}")
    put(catalog.format_counts(modules).coalesce(1), f"{folder}/counts/{name}")
    fts.write_segment(modules.select("id", *SEARCHED), searched_columns(), folder, name)
    facts = modules.agg(F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(0))).first()
    return {"name": name, "rows": facts[0], "last_id": facts[1]}


def _drop_segment(spark: SparkSession, folder: str, segment: dict) -> None:
    for t in STORED:
        delete(spark, f"{folder}/{t}/{segment['name']}")


def write_catalog(rows: DataFrame, folder: str) -> None:
    """A new catalogue of these rows; refused where there is one."""
    spark = rows.sparkSession
    if commits.versions(spark, folder):
        raise FileExistsError(f"{folder} has a catalogue")
    segment = _write_segment(conform(rows), folder)
    if not commits.commit(spark, folder, 1, {"segments": [segment]}):
        _drop_segment(spark, folder, segment)
        raise FileExistsError(f"{folder} has a catalogue")


def _tables(spark: SparkSession, folder: str, segments: list[dict]) -> dict[str, DataFrame]:
    paths = lambda t: [f"{folder}/{t}/{s['name']}" for s in segments]
    own = {"modules": spark.read.schema(MODULES).parquet(*paths("modules")), "counts": spark.read.schema(COUNTS).parquet(*paths("counts"))}
    return own | fts.segment_tables(spark, folder, [s["name"] for s in segments])


def read(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a catalogue as of a version, or of the newest one. meta is made of the counts of all segments."""
    entry = commits.last(spark, folder)[1] if version is None else commits.entry(spark, folder, version)
    tables = _tables(spark, folder, entry["segments"])
    if table == "meta":
        return catalog.meta_of_counts(tables["counts"].groupBy("format").agg(F.sum("count").alias("count")))
    return tables[table]


def append(rows: DataFrame, folder: str) -> None:
    """Add rows of new sources as a segment. If another writer was first, sources and ids are looked at again."""
    spark = rows.sparkSession
    rows = conform(rows.withColumn("id", F.lit(0)))

    def change(entry: dict):
        known = _tables(spark, folder, entry["segments"])["modules"].select("source")
        last = max((s["last_id"] for s in entry["segments"]), default=0)
        new = catalog.insert_new(rows.limit(0), rows.join(known, "source", "left_anti")).withColumn("id", F.col("id") + last)
        segment = _write_segment(conform(new), folder)
        if not segment["rows"]:
            _drop_segment(spark, folder, segment)
            return None, lambda: None
        return {"segments": [*entry["segments"], segment]}, lambda: _drop_segment(spark, folder, segment)

    commits.transact(spark, folder, change)
    compact(spark, folder)


def compact(spark: SparkSession, folder: str) -> None:
    """Merge the newest segments as long as the one before isn't twice as large: their number stays about the logarithm of the rows.

    Rows don't change. If another writer commits meanwhile, the merge is given up; a later one makes up for it. Merged segments stay for readers of older versions, see `vacuum`.
    """
    while True:
        version, entry = commits.last(spark, folder)
        segments = entry["segments"]
        many = 1
        while many < len(segments) and segments[-many - 1]["rows"] < 2 * sum(s["rows"] for s in segments[-many:]):
            many += 1
        if many == 1:
            return
        merged = _merge(spark, folder, folder, segments[-many:])
        if not commits.commit(spark, folder, version + 1, {"segments": [*segments[:-many], merged]}):
            _drop_segment(spark, folder, merged)
            return


def _merge(spark: SparkSession, folder: str, target: str, segments: list[dict]) -> dict:
    """One segment, in the folder target, of several."""
    name, tables = uuid.uuid4().hex, _tables(spark, folder, segments)
    put(tables["modules"].repartitionByRange("id").sortWithinPartitions("id"), f"{target}/modules/{name}")
    put(tables["counts"].groupBy("format").agg(F.sum("count").alias("count")).coalesce(1), f"{target}/counts/{name}")
    fts.merge_segments(tables, target, name)
    return {"name": name, "rows": sum(s["rows"] for s in segments), "last_id": max(s["last_id"] for s in segments)}


def _copied(spark: SparkSession, folder: str, target: str, segment: dict) -> dict:
    """The segment, in the folder target: its files are sorted and indexed as a merge would leave them."""
    name = uuid.uuid4().hex
    copy(spark, [(f"{folder}/{t}/{segment['name']}", f"{target}/{t}/{name}") for t in STORED])
    return segment | {"name": name}


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete segments that none of the newest `keep` versions holds, those of writers that died included; no writer may be at work."""
    listed = lambda entry: {f"{t}/{s['name']}" for s in entry["segments"] for t in STORED}
    return commits.sweep(spark, folder, keep, listed, list(STORED))


def checksum(rows: DataFrame) -> str:
    """Rows and the sum of their hashes, whatever their order; equal tables have equal ones.

    A hash is summed in three parts, as long numbers that 2^41 rows don't fill.
    """
    parts = rows.select(F.xxhash64(*rows.columns).alias("h")).select(F.shiftright("h", 44).alias("a"), F.shiftrightunsigned("h", 22).bitwiseAND(F.lit(LOW)).alias("b"), F.col("h").bitwiseAND(F.lit(LOW)).alias("c"))
    n, *sums = parts.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(x), F.lit(0)) for x in "abc")).first()
    return f"{n}:{(sums[0] << 44) + (sums[1] << 22) + sums[2]}"


def publish(spark: SparkSession, folder: str, root: str, name: str) -> DataFrame:
    """Copy a catalogue to a snapshot, read it back, and give the name's next version to it; a copy that differs is deleted and refused.

    A catalogue of one segment is copied file by file, several are merged.

    Two publishers get two versions: each takes the first that is free when its copy is whole.
    """
    path, sums = f"{root}/snapshots/{name}-{uuid.uuid4().hex}", {}
    _, entry = commits.last(spark, folder)
    try:
        alone = len(entry["segments"]) == 1 and readable(spark, folder) and readable(spark, path)
        merged = _copied(spark, folder, path, entry["segments"][0]) if alone else _merge(spark, folder, path, entry["segments"])
        commits.commit(spark, path, 1, {"segments": [merged]})
        for t in ("modules", "meta", "postings"):
            sums[t] = checksum(read(spark, path, t))
            if sums[t] != checksum(_tables(spark, folder, entry["segments"])[t] if t != "meta" else catalog.meta_of_counts(_tables(spark, folder, entry["segments"])["counts"].groupBy("format").agg(F.sum("count").alias("count")))):
                raise OSError(f"snapshot of {t} differs from the table")
        row = commits.transact(spark, f"{root}/names/{name}", lambda old: ({"name": name, "version": old.get("version", 0) + 1, "path": path, "checksums": sums}, lambda: None))
    except BaseException:
        delete(spark, path)
        raise
    return spark.createDataFrame([(name, row["version"], path, sums)], POINTERS)


def read_pointers(spark: SparkSession, root: str) -> DataFrame:
    """All versions of all names."""
    found = [commits.entry(spark, f"{root}/names/{n}", v) for n in commits.names(spark, f"{root}/names") for v in commits.versions(spark, f"{root}/names/{n}")]
    return spark.createDataFrame([(e["name"], e["version"], e["path"], e["checksums"]) for e in found], POINTERS)


def latest(spark: SparkSession, root: str, name: str) -> str | None:
    """The folder of a name's newest snapshot."""
    return commits.last(spark, f"{root}/names/{name}")[1].get("path")


def total_of(meta: DataFrame, modules: DataFrame) -> int:
    """The precomputed total: 0 if it is no number, a count of the table if it isn't there."""
    row = meta.where("key = 'total'").select(F.coalesce(F.expr("try_cast(value as bigint)"), F.lit(0))).collect()
    return row[0][0] if row else modules.count()


# Small states.

HELD, PINS = "root string, complete boolean", "kind string, cid string"
#: Earlier states that an entry names.
KEPT_STATES = 3


def merge_held(held: DataFrame, marks: DataFrame) -> DataFrame:
    """root and complete: what is held, with new marks; a complete root stays complete."""
    return held.unionByName(marks).groupBy("root").agg(F.bool_or("complete").alias("complete"))


def save_state(rows: DataFrame, folder: str) -> None:
    """Keep rows (held roots, names, pin sets) as the newest state of a folder; readers have the old one until the new one is whole."""
    spark, part = rows.sparkSession, f"parts/{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{part}")
    commits.transact(spark, folder, lambda old: ({"part": part, "before": [p for p in [old.get("part"), *old.get("before", [])] if p][:KEPT_STATES]}, lambda: delete(spark, f"{folder}/{part}")))


def load_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest state that can be read: an older one where files are damaged or gone, no rows where there is none."""
    for version in reversed(commits.versions(spark, folder)):
        try:
            entry = commits.entry(spark, folder, version)
            rows = spark.read.schema(schema).parquet(f"{folder}/{entry['part']}")
            rows.write.format("noop").mode("overwrite").save()  # every file is read once before it is trusted
        except (ValueError, KeyError, PySparkException, Py4JError):
            continue
        return rows
    return spark.createDataFrame([], schema)


def load_flags(text: Column) -> Column:
    """A map of flags from JSON; empty where the text is none."""
    return F.coalesce(F.from_json(text, "map<string,boolean>"), F.create_map().cast("map<string,boolean>"))


def load_queue(text: Column, item: str = "struct<id:bigint,title:string>") -> Column:
    """items and index of a stored play list: nothing is current after loading; no list where the text is none."""
    items = F.from_json(text, f"struct<items:array<{item}>>")["items"]
    return F.struct(F.coalesce(items, F.array().cast(f"array<{item}>")).alias("items"), F.lit(-1).alias("index"))


def save_queue(items: Column) -> Column:
    return F.to_json(F.struct(items.alias("items")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """One text for one value: fields in order of their names, nulls written out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def rotated(files: DataFrame, keep: int, newest: str = "modified", key: str = "path") -> DataFrame:
    """The files that a rotation deletes: all but the newest."""
    return files.orderBy(F.col(newest).desc(), F.col(key)).offset(keep)


GAUGES = {"Peers": ("peers", "connected peers"), "CatalogPeers": ("catalog_peers", "peers on the catalogue topic"), "Pins": ("pins", "pinned roots")}


def gauge_lines(status: Column, prefix: str = "cairn") -> Column:
    """The lines of a gauge file for a status in JSON: up is 0 alone where the status isn't an object, missing counts are 0."""
    fields = F.from_json(status, "struct<" + ",".join(f"{k}:double" for k in GAUGES) + ">")
    ok = F.get_json_object(status, "$").startswith("{")
    line = lambda name, text, value: F.concat(F.lit(f"# HELP {prefix}_{name} {text}\n# TYPE {prefix}_{name} gauge\n{prefix}_{name} "), value, F.lit("\n"))
    up = line("up", "1 if the node answered", F.when(ok, "1").otherwise("0"))
    rest = [line(n, t, F.floor(F.coalesce(fields[k], F.lit(0.0))).cast("string")) for k, (n, t) in GAUGES.items()]
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(up, *rest)).otherwise(line("up", "1 if the node answered", F.lit("0")))


def write_gauges(rows: DataFrame, path: str) -> None:
    """Write the one text of rows (column text) under a temporary name and rename it when whole."""
    spark, temp = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    rows.select("text").coalesce(1).write.text(temp)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm.Path(path)):
        fs.delete(jvm.Path(path), True)
    fs.rename(jvm.Path(temp), jvm.Path(path))


def record_sink(rows: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a stream that gives each micro-batch to take; every is the pause between polls, none for all that is there."""
    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def kept_snapshot(rows: DataFrame, by: str, order: list[str], ok: Column, columns: list[str]) -> DataFrame:
    """What a poller shows after each poll: the values of the last poll that went well."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    held = F.last(F.when(ok, F.struct(*columns)), ignorenulls=True).over(w)
    return rows.withColumn("_held", held).select(*(c for c in rows.columns if c not in columns), *(F.col(f"_held.{c}").alias(c) for c in columns))
