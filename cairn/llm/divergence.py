"""Source divergence audit: which sources of a language use which terms more than the others do, in exact integers.

Two passes over the texts, two shuffles of counts. The first pass counts for each term of a language in how many documents it is, in a
count-min sketch a task: cells only ever grow, so the merged estimate is never below the truth, and what stays below the least number of documents
there cannot be a kept term. Sketches go as blocks of saturating bytes and are merged block by block, in two levels; what comes to the
driver and is broadcast is one bit a cell (enough or not). The second pass counts occurrences and documents of the terms that are left,
exactly, inside each task first; only these counts are shuffled, by (lang, source, term), and then by (lang, term), which
gives each language's kept terms.

Pairs of sources are compared over the terms that both have: a join by (lang, term) of sparse rows, each pair of sources once. All other
terms of a source have the same share in the other one, so they need the source's histogram of shares only, against one number of each other source;
terms that neither has count by their number. A term of many sources is joined in blocks of sources, so that no task makes all of its pairs.

Defined cases: null text, lang and source are empty strings; every row is a document, repeated or not; texts without terms still make
their group; a language without kept terms gives pairs of value 0 and no terms; an empty table gives an empty table; other columns are ignored. Terms of
one task are told apart by 64-bit hashes; sums are longs, enough for 9e15 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FOLD, Work, batch_texts, join_side, mixed, text_chunks, word_table, words_of

MIN_DOCS, TOP = 3, 200
#: Cells of one row of the sketch: so many a document, a power of two between these bounds; beyond, it lets more terms pass, and results stay as they are.
CELLS_PER_DOC, LEAST_CELLS, MOST_CELLS, DEPTH = 16, 1 << 16, 1 << 26, 3
#: Cells that travel together, parts in which the sketches of one block are merged first, bytes of text worked on at once, rows of counts that a task holds.
BLOCK_CELLS, MERGE_PARTS, RUN_BYTES, HELD_ROWS = 4096, 32, 1 << 20, 600_000
#: Sources of a term that are paired in one task.
BLOCK_SOURCES = 64

_LETTERS = word_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Run:
    """The terms of some texts: their hashes and first bytes, and for each (text, term) how often it occurs."""

    def __init__(self, raws: list[bytes]):
        self.data, starts, ends, hashes, firsts = words_of([r.translate(FOLD) for r in raws], _LETTERS)
        self.hashes, at, term = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[at], ends[at]
        doc = np.repeat(np.arange(len(raws), dtype=np.int64), np.diff(firsts))
        many = max(1, len(self.hashes))
        both, self.count = np.unique(doc * many + term, return_counts=True)
        self.doc, self.term = both // many, both % many

    def keys(self, salts: np.ndarray) -> np.ndarray:
        """The key of each (text, term) in the sketch; salts are of the texts' languages."""
        return mixed(self.hashes[self.term] ^ salts[self.doc])

    def strings(self, terms: np.ndarray) -> pa.Array:
        sizes = self.ends[terms] - self.starts[terms]
        offsets = np.zeros(len(terms) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        places = np.arange(int(offsets[-1])) + np.repeat(self.starts[terms] - offsets[:-1], sizes)
        return pa.StringArray.from_buffers(len(terms), pa.py_buffer(offsets), pa.py_buffer(self.data[places].tobytes()))


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each key in a row of the sketch; width is a power of two."""
    return ((keys * np.uint64(_ODD[row % 4]) + np.uint64(row)) >> np.uint64(65 - width.bit_length())).astype(np.int64)


def add_documents(sketch: np.ndarray, keys: np.ndarray) -> None:
    """Count each key once more in every row of the sketch; cells stay at 255 when they are there."""
    for row in range(len(sketch)):
        at, n = np.unique(_cells(keys, row, sketch.shape[1]), return_counts=True)
        sketch[row, at] = np.minimum(255, sketch[row, at] + n)


def possible(bits: np.ndarray, keys: np.ndarray, width: int, depth: int) -> np.ndarray:
    """A mask of the keys whose cells all have enough documents."""
    ok = np.ones(len(keys), bool)
    for row in range(depth):
        at = _cells(keys, row, width) + row * width
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def sketch_width(documents: int) -> int:
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_DOC * documents).bit_length()))


def document_bits(docs: DataFrame, min_docs: int, width: int, depth: int = DEPTH) -> np.ndarray:
    """One bit a cell of the merged sketch of docs (_lang a hash of the language, text): whether min_docs documents or more are counted there."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255")

    def count(batches):
        sketch = np.zeros((depth, width), np.uint8)
        for batch in batches:
            salts = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for first, raws in text_chunks(batch_texts(batch), RUN_BYTES):
                add_documents(sketch, _Run(raws).keys(salts[first : first + len(raws)]))
        blocks = sketch.reshape(-1, BLOCK_CELLS)
        used, part = np.flatnonzero(blocks.any(1)), TaskContext.get().partitionId() % MERGE_PARTS
        for at in range(0, len(used), 512):
            some = used[at : at + 512]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), part, np.int32)), pa.array([blocks[i].tobytes() for i in some.tolist()], pa.binary())], names=["block", "part", "cells"])

    def merge(last: bool):
        def work(batches):
            now, total = None, None

            def out():
                cells = np.packbits(total >= min_docs) if last else np.minimum(total, 255).astype(np.uint8)
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "part", "cells"])

            for batch in batches:
                for block, part, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    key = (block, 0 if last else part)
                    if key != now:
                        if now is not None:
                            yield out()
                        now, total = key, np.zeros(BLOCK_CELLS, np.int64)
                    total += np.frombuffer(cells, np.uint8)
            if now is not None:
                yield out()

        return work

    schema = "block int, part int, cells binary"
    each = docs.select("_lang", "text").mapInArrow(count, schema)
    some = each.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(merge(False), schema)
    merged = some.repartition("block").sortWithinPartitions("block").mapInArrow(merge(True), schema)
    bits = np.zeros(depth * width // 8, np.uint8).reshape(-1, BLOCK_CELLS // 8)
    for row in merged.select("block", "cells").toLocalIterator():  # a bit a cell: 25 MB at most
        bits[row["block"]] = np.frombuffer(row["cells"], np.uint8)
    return bits.reshape(-1)


class _Counts:
    """Counts of (group, term), folded whenever there are many."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, key: np.ndarray, group: np.ndarray, docs: np.ndarray, n: np.ndarray, terms: pa.Array) -> None:
        self.parts.append((key, group, docs, n, terms))
        self.rows += len(key)

    def fold(self) -> tuple:
        key, group, docs, n = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        terms = pa.concat_arrays([p[4] for p in self.parts])
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        docs, n = (np.bincount(back, x, len(key)).astype(np.int64) for x in (docs, n))
        self.parts, self.rows = [(key, group[at], docs, n, terms.take(pa.array(at)))], len(key)
        return self.parts[0]


def term_counts(docs: DataFrame, bits: np.ndarray, width: int, depth: int = DEPTH) -> DataFrame:
    """lang, source, term, docs, n: rows of each task, for the terms that the sketch lets pass. docs has _lang, _group (hashes), lang, source, text."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        counts, names, known = _Counts(), [], {}

        def rows():
            _, group, many, n, terms = counts.fold()
            counts.parts, counts.rows = [], 0
            langs, sources = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group)) for i in range(2))
            for at in range(0, len(terms), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(at, 50_000) for x in (langs, sources, terms, pa.array(many), pa.array(n))], names=["lang", "source", "term", "docs", "n"])

        for batch in batches:
            lang, group = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            of = np.array([known.setdefault(x, len(known)) for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.int64)
            names = list(known)
            for first, raws in text_chunks(batch_texts(batch), RUN_BYTES):
                run = _Run(raws)
                mine = slice(first, first + len(raws))
                ok = possible(shared.value, run.keys(lang[mine]), width, depth)
                doc, term, n = run.doc[ok], run.term[ok], run.count[ok]
                many = max(1, len(run.hashes))
                both, at, back = np.unique(of[mine][doc] * many + term, return_index=True, return_inverse=True)
                key = mixed(run.hashes[both % many] ^ group[mine][doc[at]])
                counts.add(key, both // many, np.bincount(back, minlength=len(both)), np.bincount(back, n, len(both)).astype(np.int64), run.strings(both % many))
                if counts.rows > 2 * HELD_ROWS:
                    counts.fold()
                    if counts.rows > HELD_ROWS:
                        yield from rows()
        if counts.rows:
            yield from rows()

    return docs.select("_lang", "_group", "lang", "source", "text").mapInArrow(count, "lang string, source string, term string, docs long, n long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(1e9 * n / total) without a number over 1000 times the total."""
    total = F.greatest(total, F.lit(1).cast("long"))
    out, rest = F.lit(1).cast("long"), n
    for scale in (1_000_000, 1_000, 1):
        out = out + _div(rest * 1000, total) * scale
        rest = (rest * 1000) % total
    return out


def _far(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def kept_terms(docs: DataFrame, work: Work, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Written tables: kept (lang, source, term, n, lang_n, sources) and groups (lang, source, at, n, terms, v, lang_n); at numbers the sources of a language."""
    text, lang, source = (F.coalesce(c, F.lit("")) for c in ("text", "lang", "source"))
    docs = docs.select(text.alias("text"), lang.alias("lang"), source.alias("source"))
    rows = work.write(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), "rows")
    width = sketch_width(rows.agg(F.sum("rows")).first()[0] or 0)
    hashed = docs.withColumns({"_lang": F.xxhash64("lang"), "_group": F.xxhash64("lang", "source")})
    raw = term_counts(hashed, document_bits(hashed, min_docs, width), width)
    counts = work.write(raw.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "counts")
    w = W.partitionBy("lang", "term")
    every = counts.select("lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("_docs"), F.count(F.lit(1)).over(w).alias("sources"), F.min("source").over(w).alias("_first"))
    kept = work.write(every.where(F.col("_docs") >= min_docs).withColumn("head", F.col("source") == F.col("_first")).drop("_docs", "_first"), "kept", drop=["counts"])
    own = work.write(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"), F.sum(F.col("head").cast("long")).alias("heads")), "own")
    langs = own.groupBy("lang").agg(F.sum("heads").alias("v"), F.sum("n").alias("lang_n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = rows.join(own.drop("heads"), ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(zero(c) for c in ("n", "terms", "v", "lang_n")))
    groups = groups.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    return kept, work.write(groups.withColumn("p0", _share(F.lit(1).cast("long"), F.col("n") + F.col("v"))), "groups")


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(join_side(groups, 128), keys)


def _meetings(scored: DataFrame) -> DataFrame:
    """lang, a, b, x, n: over the terms that both sources have, how much more their distance is than what `_singles` and terms of neither count, and their number."""
    block = F.floor(F.col("at") / BLOCK_SOURCES).cast("int")
    wide = F.col("sources") > BLOCK_SOURCES
    side = scored.select("lang", "term", "at", "p", "p0", F.when(wide, block).otherwise(0).alias("block"), "sources")
    a = side.select("lang", "term", "block", F.col("at").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    b = side.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block")))).select("lang", "term", "block", F.col("at").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    pairs = a.join(b, ["lang", "term", "block"]).where("a < b")
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    sums = pairs.groupBy("lang", "a", "b").agg(
        F.sum(_far(pa_, pb) - _far(pa_, zb) - _far(za, pb)).alias("there"), F.sum(_far(pb, pa_) - _far(pb, za) - _far(zb, pa_)).alias("back"), F.count(F.lit(1)).alias("n")
    )
    ways = F.explode(F.array(F.struct("a", "b", F.col("there").alias("x")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("x"))))
    return sums.select("lang", "n", ways.alias("w")).select("lang", "w.a", "w.b", "w.x", "n")


def _singles(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, x, n (0): the terms of one source against the share of an absent term in another one, both ways, by the source's distinct shares."""
    shares = scored.groupBy("lang", "at", "p").agg(F.count(F.lit(1)).alias("many"))
    others = groups.select("lang", F.col("at").alias("b"), F.col("p0").alias("zb"))
    pairs = _with_groups(shares, others, ["lang"]).where("at <> b")
    sums = pairs.groupBy("lang", "at", "b").agg(F.sum(F.col("many") * _far(F.col("p"), F.col("zb"))).alias("there"), F.sum(F.col("many") * _far(F.col("zb"), F.col("p"))).alias("back"))
    ways = F.explode(F.array(F.struct(F.col("at").alias("a"), "b", F.col("there").alias("x")), F.struct(F.col("b").alias("a"), F.col("at").alias("b"), F.col("back").alias("x"))))
    return sums.select("lang", ways.alias("w")).select("lang", "w.a", "w.b", "w.x", F.lit(0).cast("long").alias("n"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    work = Work(docs.sparkSession, "divergence")
    kept, groups = kept_terms(docs, work, min_docs)
    facts = groups.select("lang", "source", "at", "p0", (F.col("n") + F.col("v")).alias("_own"), (F.col("lang_n") + F.col("v")).alias("_all"))
    scored = _with_groups(kept, facts, ["lang", "source"])
    scored = scored.withColumns({"p": _share(F.col("n") + 1, F.col("_own")), "q": _share(F.col("lang_n") + 1, F.col("_all"))})
    scored = work.write(scored.select("lang", "source", "at", "term", "sources", "p", "q", "p0"), "scored", drop=["kept"])
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms = ranked(scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)
    parts = work.write(_meetings(scored).unionByName(_singles(scored, groups)), "parts")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("x").alias("x"), F.sum("n").alias("both"))
    a = groups.select("lang", F.col("at").alias("a"), "source", F.col("terms").alias("ta"), F.col("p0").alias("za"), "v")
    b = groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item"), F.col("terms").alias("tb"), F.col("p0").alias("zb"))
    pairs = _with_groups(a, b, ["lang"]).where("a <> b").join(sums, ["lang", "a", "b"], "left")
    none = F.col("v") - F.col("ta") - F.col("tb") + F.coalesce("both", F.lit(0))
    value = F.when(F.col("v") > 0, F.coalesce("x", F.lit(0)) + none * _far(F.col("za"), F.col("zb"))).otherwise(0).cast("long")
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))
    return pairs.select(*columns).unionByName(terms.select(*columns))
