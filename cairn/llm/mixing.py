"""Mixing sources to target weights on Spark's own functions.

Targets follow from the sources' sizes by water-filling under a cap. Each source's documents form
a stream of words in the order of a hash, cut in blocks of equal length. A source gives all of its blocks for each
whole epoch of its target, and of one more epoch as many as the rest asks, drawn by a permutation of its block numbers;
the last block drawn is cut, so that the words taken are the target to the word. That makes the source's exact quota of blocks.
A tree splits the quotas over the output shards: at each node the left half's share of every source is drawn from the
multivariate hypergeometric law, so quotas add up exactly at every level. A source's drawn blocks are permuted once more
and dealt to the shards by these shares; a word is taken if its block is dealt. A shard orders its slices by a
hash. `mix_documents` writes its rows by shard in that order, and a shard has the words of the blocks that it is dealt.

Positions in a stream come from two levels, so that no task sorts a whole source: a document's bucket
is the head of its hash, buckets are summed with partial aggregation, and only inside a
bucket documents are ranked. Blocks are numbered a bounded run of them at a time.

Defined cases: a null text has no words and is taken zero times; a null source is a source of its own,
last in order; equal rows of one document lie side by side in the stream and each has its own place;
an empty table gives an empty table; other columns are kept by `mix_documents` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Work, fresh, join_side, named

#: Weights of the sources in order, repeating; no source gives more than CAP times its own words.
WEIGHTS, CAP = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block (longer where the mix would have more than MAX_BLOCKS, the limit of the generator of the hypergeometric
#: law), rows that a bucket of a source's stream holds on average, and blocks that are numbered at once.
BLOCK_WORDS, MAX_BLOCKS, BUCKET_ROWS, RUN_BLOCKS = 4096, 900_000_000, 2000, 4096
#: One number for each source comes to the driver; beyond so many sources it is refused loudly. The tree has at most
#: MAX_CELLS leaves by sources there: many sources are dealt to fewer shards.
MAX_SOURCES, MAX_CELLS, MAX_SHARDS = 1_000_000, 2_000_000, 4096
#: Rounds of the permutation of block numbers.
ROUNDS = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Each source's share of all words by weight, none above cap times its size, the excess reshared by weight."""
    targets = [0.0] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        rest -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def splitting_tree(quotas: list[int], shards: int, seed: int = 7):
    """Yield (shard, source, blocks) where a shard has blocks of a source; blocks of a source add up to its quota, those of shards differ by one at most."""
    stack = [(np.asarray(quotas, np.int64), 0, shards)]
    while stack:
        part, first, count = stack.pop()
        if count == 1:
            has = np.flatnonzero(part)
            yield from ((first, i, n) for i, n in zip(has.tolist(), part[has].tolist(), strict=True))
            continue
        left = count // 2
        got = np.random.default_rng([seed, first, count]).multivariate_hypergeometric(part, int(part.sum()) * left // count, method="marginals") if len(part) else part
        stack += [(part - got, first + left, count - left), (got, first, left)]


def _number(*parts: Column) -> Column:
    """60 bits of a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long")


def permuted(number: Column, count: Column, salt: Column, rounds: int = ROUNDS) -> Column:
    """A permutation of the numbers below count (swap or not, by a hash of the greater one of two numbers that add up to a drawn key)."""

    def swap(x: Column, k: Column) -> Column:
        y = F.pmod(F.pmod(_number(salt, k), count) - x, count)
        return F.when(F.pmod(_number(salt, k, F.greatest(x, y)), F.lit(2)) == 0, x).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), number.cast("long"), swap)


def permuted_number(number: int, count: int, salt: str, rounds: int = ROUNDS) -> int:
    """`permuted` for one number on the driver."""
    of = lambda *parts: int(hashlib.md5("|".join([salt, *map(str, parts)]).encode()).hexdigest()[:15], 16)
    x = number
    for k in range(1, rounds + 1):
        y = (of(k) % count - x) % count
        x = x if of(k, max(x, y)) % 2 == 0 else y
    return x


def drawn_blocks(size: int, rest: int, block_words: int, salt: str) -> tuple[int, int]:
    """How many blocks of a source of so many words make up the rest, by permuted number, and the words of the last one that are taken."""
    if not rest:
        return 0, 0
    blocks = -(-size // block_words)
    short_at, missing = permuted_number(blocks - 1, blocks, salt), blocks * block_words - size  # the stream's last block may be short
    count = -(-rest // block_words)
    if short_at < count and count * block_words - missing < rest:
        count += 1
    return count, rest - (count - 1) * block_words + (missing if short_at < count - 1 else 0)


def _salt(seed: int, kind: str, source: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(kind), F.coalesce(source, F.lit("")))


def _runs(df: DataFrame, until: Column) -> DataFrame:
    """df with a row for each number below until, as column i; long runs are dealt over tasks."""
    parts = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((until - 1) / RUN_BLOCKS)))).where(until > 0)
    parts = parts.repartition("_run", parts.columns[0])
    return parts.withColumn("i", F.explode(F.sequence(F.col("_run") * RUN_BLOCKS, F.least((F.col("_run") + 1) * RUN_BLOCKS, until) - 1))).drop("_run")


def dealt_blocks(sources: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """A row for each block in the mix: s, block, epoch, shard, and stop, the words of the block that are taken.

    sources has s, blocks, full, drawn, last and quota, block_words; cuts has cut_source, shard, lo, hi.
    """
    every = _runs(sources.select("s", "blocks", "full", "drawn", "last", "quota", "block_words"), F.col("blocks"))
    at = permuted(F.col("i"), F.col("blocks"), _salt(seed, "draw", F.col("s")))
    every = every.withColumn("at", F.when(F.col("drawn") > 0, at).otherwise(0))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("at") < F.col("drawn"), 0).otherwise(1))
    every = every.withColumn("epoch", F.explode(F.when((F.col("full") > 0) | (F.col("at") < F.col("drawn")), epochs)))
    whole = F.col("epoch") < F.col("full")
    number = F.col("epoch") * F.col("blocks") + F.when(whole, F.col("i")).otherwise(F.col("at"))
    stop = F.when(~whole & (F.col("at") == F.col("drawn") - 1), F.col("last")).otherwise(F.col("block_words"))
    ids = every.select("s", F.col("i").alias("block"), "epoch", stop.cast("long").alias("stop"), permuted(number, F.col("quota"), _salt(seed, "deal", F.col("s"))).alias("dealt"))
    # The tree's shares as runs of dealt numbers, a row for each.
    places = _runs(cuts.withColumn("many", F.col("hi") - F.col("lo") + 1), F.col("many")).select("cut_source", "shard", (F.col("lo") + F.col("i")).alias("place"))
    return ids.join(places, F.col("s").eqNullSafe(F.col("cut_source")) & (F.col("dealt") == F.col("place"))).select("s", "block", "epoch", "shard", "stop")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 7, block_words: int = BLOCK_WORDS, shards: int | None = None) -> DataFrame:
    """One row for each slice of a document in the mix, and one with shard null for a block of a document that isn't dealt.

    doc_id, source, text_hash, size, source_size, target, at (the document's place in its source's stream), block, epoch, start and stop
    (words of the document, stop exclusive), taken (stop - start), shard, and place, the order inside the shard.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "mix-plan")
    sized = work.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("source").asc_nulls_last())
    rows = per.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    sizes = [r["source_size"] for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], cap)
    block_words = max(block_words, -(-sum(math.ceil(t) for t in targets) // MAX_BLOCKS))
    facts, quotas = [], []
    for r, size, target in zip(rows, sizes, targets, strict=True):
        words = math.floor(target + 0.5)
        full = int(min(words // size, cap)) if size else 0
        blocks = -(-size // block_words)
        drawn, last = drawn_blocks(size, words - full * size, block_words, f"{seed}|draw|{r['source'] or ''}")
        quotas.append(full * blocks + drawn)
        facts.append((r["source"], size, target, full, blocks, drawn, last, quotas[-1], block_words, max(1, math.ceil(r["rows"] / BUCKET_ROWS))))
    shards = shards or max(1, min(MAX_SHARDS, sum(quotas) // 64, MAX_CELLS // max(1, len(rows))))
    cuts, ends = [], [0] * len(rows)
    for shard, i, n in splitting_tree(quotas, shards, seed):
        cuts.append((rows[i]["source"], shard, ends[i], ends[i] + n - 1))
        ends[i] += n
    sources = spark.createDataFrame(facts, "s string, source_size long, target double, full long, blocks long, drawn long, last long, quota long, block_words long, buckets long")
    cuts = spark.createDataFrame(cuts, "cut_source string, shard int, lo long, hi long")
    dealt = work.write(dealt_blocks(sources, cuts, seed), "dealt")
    small = sum(100 + len(r["source"] or "") for r in rows) <= BROADCAST_BYTES
    facts = sources.select("s", "source_size", "target", "buckets", "block_words")
    both = sized.join(F.broadcast(facts) if small else facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    both = both.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    both = both.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.col("buckets")))
    sums = both.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    heads = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    placed = both.join(heads, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("at", F.col("before") + inside)
    first, last = F.floor(F.col("at") / F.col("block_words")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block_words"))
    slices = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(first))))
    names = {"block": "dealt_block", "stop": "dealt_stop"}
    own = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("block") == F.col("dealt_block")) & (F.col("size") > 0)
    out = slices.join(dealt.withColumnsRenamed(names), own, "left")
    begin = F.col("block") * F.col("block_words")
    start = F.greatest(F.lit(0).cast("long"), begin - F.col("at"))
    stop = F.greatest(start, F.least(F.col("size"), begin + F.coalesce("dealt_stop", F.lit(0).cast("long")) - F.col("at")))
    out = out.withColumn("start", start).withColumn("stop", stop)
    place = F.xxhash64(F.lit(seed), "key", "block", "epoch")
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "at", "block", "epoch", "start", "stop", (F.col("stop") - F.col("start")).alias("taken"), "shard", place.alias("place"))


def mix_totals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words that the mix takes of each row, repeats counted."""
    plan = mix_plan(docs, **options)
    # Rows without words share their places; every row of words has its own.
    each = plan.groupBy("doc_id", "source", "text_hash", "size", "source_size", "target", "at").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    copies = F.when(F.col("size") == 0, F.col("rows")).otherwise(F.lit(1).cast("long"))
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _stretches(plan: DataFrame) -> DataFrame:
    """Slices that follow one another in a document, epoch and shard as one: the document's keys, at, epoch, shard, start, stop, and place of the first slice."""
    keys = ["doc_id", "source", "text_hash", "size", "at", "epoch", "shard"]
    w = W.partitionBy(*keys).orderBy("start")
    begins = F.coalesce(F.lag("stop").over(w) != F.col("start"), F.lit(True))
    runs = plan.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("start", "place"))["place"].alias("place")).drop("_run")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each stretch of a document's words that the tree deals to a shard, in every epoch.

    A document all of whose blocks go to one shard comes whole, as it is; of others the words of the dealt blocks come, each stretch in the shard of its
    blocks, with the blanks before its words. Rows of a shard lie in one partition, in the order of place; their words are those of the shard's blocks, to the word. n_chars,
    where docs has it, is the length of the text that comes.
    """
    work, keys = Work(docs.sparkSession, "mix"), ["doc_id", "source", "text_hash", "size"]
    plan = mix_plan(docs, **options).where(F.col("taken") > 0).select(*keys, "at", "epoch", "shard", "start", "stop", "place")
    names = {c: fresh(docs, f"_{c}") for c in (*keys, "at", "epoch", "shard", "start", "stop", "place")}
    takes = work.write(_stretches(plan).withColumnsRenamed(names), "mix")
    id_, source_, hash_, size_ = (names[c] for c in keys)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_)) & (F.xxhash64("text") == F.col(hash_))
    own = [names[c] for c in keys[:3]]
    # Of equal rows one stands for all.
    repeated = work.write(takes.groupBy(*own).agg(F.min(names["at"]).alias("_low"), F.max(names["at"]).alias("_high")).where("_low <> _high").select(*own), "repeated")
    if not repeated.isEmpty():
        many = join_side(repeated, 128)
        docs_ = docs.join(many, same, "left_anti").unionByName(docs.join(many, same).dropDuplicates(own).select(*docs.columns))
    else:
        docs_ = docs
    size = takes.agg(F.sum(F.lit(96) + F.octet_length(F.coalesce(F.col(source_), F.lit(""))))).first()[0] or 0
    out = docs_.join(F.broadcast(takes) if size <= BROADCAST_BYTES else takes, same)
    out = out.repartition(names["shard"]).sortWithinPartitions(names["shard"], names["place"], id_, hash_, names["start"])
    start, stop = F.col(names["start"]), F.col(names["stop"])
    # Pieces are words, each with the blanks before it; blanks at the end go with the last word.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    until = F.when(stop == F.col(size_), F.size(pieces)).otherwise(stop.cast("int"))
    part = F.array_join(F.slice(pieces, (start + 1).cast("int"), until - start.cast("int")), "")
    text = F.when((start == 0) & (stop == F.col(size_)), F.col("text")).otherwise(part)
    columns = [text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else named(c) for c in docs.columns]
    return out.select(*columns)
