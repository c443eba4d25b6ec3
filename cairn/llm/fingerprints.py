"""Document fingerprints on Spark's own functions: bottom-k sketches of word shingles.

A sketch holds the k least 64-bit hashes of a text's distinct shingles of five words, in order; with fewer than k it is the whole set and
every estimate from it is exact. Sketches of parts merge to the sketch of the whole (`merged`, `merge_groups`), and two sketches estimate
resemblance and containment over all hashes up to the least of the bounds of the two, a uniform sample of the
union; the k-th hash tells how many distinct shingles there are.

Every text is also compared with an edited copy of itself, whose last third comes from the next document. "Next" is a place in an
order of the whole table: keys alone (hashes of id and text) are numbered over written ranges, each gets its predecessor's key by place, and
a text sends that predecessor the characters asked for and its sketch. Texts are shuffled once, by key, and a third of each as a prefix.

Defined cases: a null text is empty; a text without words has an empty sketch; one with fewer than five words has its whole sequence as one shingle;
words are runs of other characters than blanks, A-Z in lower case; two empty sketches are alike to 1, an empty and another one to 0; documents of one id
go on by the hash of their text, those without id come last; of equal rows each is followed by the next equal one, the last by the next document;
a single document is followed by itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import SPACE, Work, fold_column, join_side

SHINGLE, SIZE = 5, 128
_BLANKS = r"[\x20\x09-\x0D]+"
_NONE = "array<bigint>"


def word_hashes(text: Column) -> Column:
    """The hash of each word, in order."""
    held = F.btrim(fold_column(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(held != "", F.transform(F.split(held, _BLANKS, -1), lambda w: F.xxhash64(w))).otherwise(F.array().cast(_NONE))


def shingle_hashes(words: Column, length: int = SHINGLE) -> Column:
    """The hash of each run of so many words; of all words if there are fewer. words is a column of the table, not an expression: it is read for each run."""
    run = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(length)))
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast(_NONE))
    return F.when(F.size(words) >= length, F.transform(F.sequence(F.lit(0), F.size(words) - length), run)).otherwise(whole)


def bottom(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def with_sketches(df: DataFrame, texts: dict[str, str], size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """df with a sketch column for each text column (new name: text column)."""
    words = {f"_words_{k}": word_hashes(F.col(t)) for k, t in texts.items()}
    made = df.withColumns(words)
    return made.withColumns({k: bottom(shingle_hashes(F.col(f"_words_{k}"), shingle), size) for k in texts}).drop(*words)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of what two sketches hold together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_groups(sketches: DataFrame, by: list[str], column: str, size: int = SIZE) -> DataFrame:
    """by and column: the merged sketch of each group; every task sends the `size` least hashes of a group at most."""
    each = sketches.select(*by, F.explode_outer(column).alias("_h")).distinct()
    least = each.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_rank") <= size)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def _bound(sketch: Column, size: int) -> Column:
    """The greatest hash up to which a sketch is complete; null if it is complete altogether."""
    return F.when(F.size(sketch) >= size, F.get(sketch, F.lit(size - 1)))


def _shared(a: Column, b: Column, size: int) -> tuple[Column, Column]:
    """The bound of a pair, and what both have up to it."""
    top = F.coalesce(F.least(_bound(a, size), _bound(b, size)), F.lit(2**63 - 1))
    return top, F.size(F.filter(F.array_intersect(a, b), lambda x: x <= top))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Shared shingles among those of either, 0 to 1."""
    top, both = _shared(a, b, size)
    either = F.size(F.filter(F.array_union(a, b), lambda x: x <= top))
    return F.when(either > 0, both / either).otherwise(1.0)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Shared shingles among those of a, 0 to 1."""
    top, both = _shared(a, b, size)
    own = F.size(F.filter(a, lambda x: x <= top))
    return F.when(own > 0, both / own).otherwise(1.0)


def distinct_shingles(sketch: Column, size: int = SIZE) -> Column:
    """How many distinct shingles there are: counted if the sketch is complete, else from the share of all hashes up to its greatest."""
    share = (F.get(sketch, F.lit(size - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) / share)


def as_text(sketch: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _followed(docs: DataFrame, work: Work) -> DataFrame:
    """_k1, _k2 (a row's key), copies, and for the document before it: its key (_p1, _p2) and the characters it takes."""
    keys = docs.groupBy("_k1", "_k2").agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    placed = work.write(numbered(keys, F.col("doc_id").desc_nulls_last(), "_k1", "_k2", name="place"), "places")
    count = placed.count()
    before = placed.select(F.pmod(F.col("place") + 1, F.lit(max(1, count))).alias("place"), F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), F.floor(F.col("n") / 3).cast("int").alias("takes"))
    return work.write(placed.select("place", "_k1", "_k2", "copies").join(before, "place").drop("place"), "followed", drop=["places"])


def with_edits(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text, edited, next_sketch: each row with its edited text and the sketch of the next document."""
    spark = docs.sparkSession
    work = Work(spark, "fingerprints")
    id_ = [F.isnull("doc_id"), F.col("doc_id")]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"_k1": F.xxhash64(*id_, "text"), "_k2": F.xxhash64(F.lit(0x5EED), *id_, "text")})
    followed = _followed(docs, work)
    both = docs.join(join_side(followed, 64), ["_k1", "_k2"])
    repeated = not followed.where("copies > 1").isEmpty()
    if repeated:  # equal rows: one for all of them
        both = both.where("copies = 1").unionByName(both.where("copies > 1").dropDuplicates(["_k1", "_k2"]))
    gives = with_sketches(both.select("_p1", "_p2", F.left("text", F.col("takes")).alias("head"), "text"), {"next_sketch": "text"}, size).drop("text")
    rows = both.select("_k1", "_k2", "doc_id", "text", "copies").join(gives, (F.col("_k1") == F.col("_p1")) & (F.col("_k2") == F.col("_p2")))
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - third), "head")
    out = rows.select("doc_id", "text", edited.alias("edited"), "next_sketch", F.lit(1).cast("long").alias("times"))
    if repeated:
        own = F.concat(F.left("text", F.char_length("text") - third), F.left("text", third))
        again = with_sketches(both.where("copies > 1").select("doc_id", "text", own.alias("edited"), (F.col("copies") - 1).alias("times")), {"next_sketch": "text"}, size)
        out = out.unionByName(again)
    return out


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_share, shingles."""
    made = with_sketches(with_edits(docs, size), {"own": "text", "other": "edited"}, size)
    out = made.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), size).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch"), size).alias("near_next"),
        containment(F.col("own"), F.col("other"), size).alias("kept_share"), distinct_shingles(F.col("own"), size).alias("shingles"), "times",
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
