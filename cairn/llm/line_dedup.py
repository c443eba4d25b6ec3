"""Line dedup on Spark's own functions: range-partitioned line hashes, secondary sort, keep bitmaps.

Lines become 128-bit hashes with their document and position. The hashes are range-partitioned
(with a salt of the document, so that one very frequent line is spread over many tasks), sorted by
document and position inside each range, and read as a stream that lets only the first
`min_docs` documents of a line through. What passes is at most `min_docs` rows a line and part and is
ranked once more without the salt. The result is a run-length bitmap for each document; texts
are never sorted or grouped, and not shuffled where the bitmaps are few enough for a broadcast.

Defined cases: a null or empty text is one empty line; a repeated row of a document counts once; a
null doc_id is one more document; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, Work, by_document, fold_column, join_side

#: Parts over which the documents of one line hash are dealt, at least; as many as there are shuffle partitions.
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _mark(df: DataFrame) -> DataFrame:
    """df with a hash of its text, as doc_id alone may repeat."""
    return df.withColumn("_text_hash", F.xxhash64("text"))


def line_occurrences(docs: DataFrame, min_key_chars: int = 1) -> DataFrame:
    """One row for each line whose key has enough characters: doc_id, _text_hash, pos and the key's two hashes."""
    key = fold_column(F.btrim("line", F.lit(SPACE)))
    return (
        _mark(docs.select("doc_id", "text"))
        .select("doc_id", "_text_hash", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("key", key)
        .where(F.char_length("key") >= min_key_chars)
        .select("doc_id", "_text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), F.col("key")).alias("h2"))
    )


def first_occurrences(occurrences: DataFrame, count: int) -> DataFrame:
    """The first `count` documents (and positions in them) of every line hash, in document order, with their rank."""
    salts = max(SALTS, int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = occurrences.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
    ranged = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    order = [F.col("doc_id").asc_nulls_first()]
    few = ranged.withColumn("_rank", F.dense_rank().over(W.partitionBy("h1", "h2", "salt").orderBy(*order))).where(F.col("_rank") <= count)
    few = few.groupBy("h1", "h2", "doc_id").agg(F.min("pos").alias("pos"))
    return few.withColumn("rank", F.dense_rank().over(W.partitionBy("h1", "h2").orderBy(*order))).where(F.col("rank") <= count)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, broadcast_bytes: int | None = None, work: Work | None = None) -> DataFrame:
    """doc_id, _text_hash and `drops`, the run-length form of the bitmap: runs of lines that go, in order.

    Documents that lose no line have no row. A line goes from every document if its key is in min_docs documents.
    """
    work = work or Work(docs.sparkSession, "lines")
    occurrences = work.write(line_occurrences(docs, min_key_chars), "lines")
    frequent = work.write(first_occurrences(occurrences, min_docs).where(F.col("rank") == min_docs).select("h1", "h2").distinct(), "frequent-lines")
    side = join_side(frequent, 48) if broadcast_bytes is None else join_side(frequent, 48, broadcast_bytes)
    gone = occurrences.join(side, ["h1", "h2"], "left_semi").select("doc_id", "_text_hash", "pos").distinct()
    island = F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "_text_hash").orderBy("pos"))
    spans = gone.withColumn("_island", island).groupBy("doc_id", "_text_hash", "_island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return spans.groupBy("doc_id", "_text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("drops"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, text without the frequent lines, and drops (null where nothing goes)."""
    work = Work(docs.sparkSession, "lines")
    drops = work.write(keep_bitmaps(docs, min_docs, min_key_chars, work=work).withColumnsRenamed({"doc_id": "_id", "_text_hash": "_hash"}), "bitmaps", drop=["lines", "frequent-lines"])
    both = by_document(_mark(docs.select("doc_id", "text")), drops, 64 + 40 * F.size("drops"), broadcast_bytes)
    lines = _lines(F.col("text"))
    # The bitmap, read out once: what lies between two runs stays, what follows the last one has no entry.
    before = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at("drops", i)["last"] + 1)
    flags = F.flatten(F.transform("drops", lambda r, i: F.concat(F.array_repeat(F.lit(True), r["first"] - before(i)), F.array_repeat(F.lit(False), r["last"] - r["first"] + 1))))
    stays = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("stays")), lambda z: F.coalesce(z["stays"], F.lit(True)))
    dropped = F.aggregate("drops", F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1).cast("long"))
    return both.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays["line"], "\n")).alias("text"),
        "drops",
    )
