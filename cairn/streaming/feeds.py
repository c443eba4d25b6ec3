"""Feeds as streams: polled snapshots and gossip as a data source with offsets, and a sink that has each batch once.

`gossip_feed` reads a folder in which publishers leave files of messages, one JSON text a line. Its offset is the name of the last file it
has read: names grow with time (a publisher takes the next number), so a file is read once, a restarted query goes on where its checkpoint says, and a torn
file (still under a hidden name) isn't there. `keep_batches` writes each batch beside its number and says so in a log of commits: a batch that comes again
after a failure finds its number there and is left out.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import commits
from ..sources.folders import delete, qualified


#: Files that one task reads.
FILES = 100


@dataclass
class _Files(InputPartition):
    names: tuple[str, ...]


class _FeedReader(DataSourceStreamReader):
    """Messages of new files: the driver lists names, tasks read the files."""

    def __init__(self, root: str, files: int):
        self.root, self.files = root, files

    def _names(self) -> list[str]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        infos = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted(i.base_name for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith("."))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [n for n in self._names() if start["after"] < n <= end["after"]]
        return [_Files(tuple(new[i : i + self.files])) for i in range(0, len(new), self.files)]

    def read(self, partition: _Files):
        fs, base = pafs.FileSystem.from_uri(self.root)
        for name in partition.names:
            with fs.open_input_stream(f"{base}/{name}") as f:
                for k, line in enumerate(f.read().decode("utf-8", "replace").splitlines()):
                    yield name, k, line


class GossipFeed(DataSource):
    """spark.readStream.format("gossip_feed").load(folder): file, line and value (the text) of every message."""

    @classmethod
    def name(cls) -> str:
        return "gossip_feed"

    def schema(self) -> str:
        return "file string, line int, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedReader(self.options["path"], int(self.options.get("files", FILES)))


def gossip_feed(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    spark.dataSource.register(GossipFeed)
    return spark.readStream.format("gossip_feed").option("files", files).load(qualified(spark, folder))


def publish_messages(spark: SparkSession, folder: str, messages: list[dict | str]) -> str:
    """Leave messages as the next file of a feed; of two publishers one takes each number. The file's name."""
    text = "".join(f"{m if isinstance(m, str) else json.dumps(m)}\n" for m in messages)
    while True:
        last = max((int(n.partition(".")[0]) for n in commits.names(spark, folder) if n.partition(".")[0].isdigit()), default=0)
        name = f"{last + 1:012d}.jsonl"
        if commits.claim(spark, f"{folder}/{name}", text):
            return name


def keep_batches(rows: DataFrame, folder: str, checkpoint: str, every: str | None = None, written=None):
    """Start a stream whose batches become a table (read_batches), each once however often it is delivered.

    written is called with the number of a batch between its files and its commit, for tests.
    """
    spark = rows.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        _, entry = commits.last(spark, folder)
        if number <= entry.get("batch", -1):
            return
        name = f"batches/{number:012d}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{folder}/{name}")
        if written is not None:
            written(number)

        def change(old: dict):
            if number <= old.get("batch", -1):
                delete(spark, f"{folder}/{name}")
                return None, lambda: None
            return {"batch": number, "parts": [*old.get("parts", []), name]}, lambda: None

        commits.transact(spark, folder, change)

    writer = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a stream's sink has kept."""
    parts = commits.last(spark, folder)[1].get("parts", [])
    return spark.read.schema(schema).parquet(*(f"{folder}/{p}" for p in parts)) if parts else spark.createDataFrame([], schema)
