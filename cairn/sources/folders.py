"""Folders that the driver and all executors see, under one full name for Spark and for other readers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of the file system that Spark resolves it against."""
    target = _path(spark, path)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    scheme, _, rest = full.partition(":")
    return full if rest.startswith("//") else f"{scheme}://{rest}"


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset in local mode (tests), one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(_path(spark, tempfile.mkdtemp(prefix="cairn-")).toUri().getPath())
        full = spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).makeQualified(_path(spark, _own[0]))
        root = full.toString()
    return qualified(spark, root).rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """The full name of a new folder; nothing is created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = _path(spark, path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of what is written inside go when each write ends; else they lie until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def store(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows as Parquet, with a smaller codec than the default one, and leave no shuffle files behind."""
    with cleaned(rows.sparkSession):
        rows.write.option("compression", "zstd").mode(mode).parquet(path)


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in a new shared folder, read back: computed once, its lineage cut."""
    path = work_folder(rows.sparkSession, name)
    store(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def readable(spark: SparkSession, path: str) -> bool:
    """Whether Python workers can open files below this path by its full name; Spark may know file systems that they don't."""
    try:
        pafs.FileSystem.from_uri(qualified(spark, path))
    except (OSError, ValueError):
        return False
    return True


def copy(spark: SparkSession, folders: list[tuple[str, str]]) -> None:
    """Copy the data files of folders to new ones, as they are, by all tasks; a file gets its name when it is whole, so a repeated task leaves the same files."""
    found = []
    for source, target in folders:
        at = _path(spark, source)
        for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getLen(), f.getPath().getName(), qualified(spark, source), qualified(spark, target)))
    # Dealt by size: partitions are runs of the list.
    found.sort(reverse=True)
    many = min(len(found), spark.sparkContext.defaultParallelism)
    dealt = [f"{source}/{name}\t{target}/{name}" for i in range(many) for _, name, source, target in found[i::many]]

    def run(batches):
        for batch in batches:
            for pair in batch.column(0).to_pylist():
                source, target = pair.split("\t")
                fs, a = pafs.FileSystem.from_uri(source)
                to, b = pafs.FileSystem.from_uri(target)
                folder, _, name = b.rpartition("/")
                temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
                to.create_dir(folder, recursive=True)
                pafs.copy_files(a, temp, source_filesystem=fs, destination_filesystem=to)
                to.move(temp, b)
            yield batch

    if dealt:
        spark.createDataFrame([(x,) for x in dealt], "pair string").mapInArrow(run, "pair string").write.format("noop").mode("overwrite").save()
