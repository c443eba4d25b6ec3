"""Substring dedup over sliding spans of consecutive sentences.

A text is cut in sentences; one that is long is cut after so many words, or, with a cut window, where
the words themselves say so: at the least word hash of every window of words inside the sentence. Those cuts fall
at the same words wherever a passage lies in its sentence. From every sentence
a span runs over the next sentences until it has enough words (and at least two sentences), and to every
sentence one runs over those before, so that a repeated passage is covered up to both ends. Spans
are hashed (128 bits) over their words; those whose hash occurs more than once are joined, and
all sentences that a span other than the first occurrence covers are removed. The first is the
one with the least document, then text, then position, over the whole corpus.

A first pass counts 64-bit span keys alone, combined before the shuffle, so a frequent span costs
a row for each task. Keys that repeat reach a second pass by broadcast where their counted size is
bounded and by a shuffle join elsewhere; only the spans that have one are written and joined
by all 128 bits, frequent ones apart from the others, without dealing their rows by key. Texts aren't shuffled
where the ranges that go are few enough for a broadcast.

Defined cases: null and empty texts have no sentences; a text with fewer words than a span is never
touched; repeated rows of a document (same id and text) are one occurrence and get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, FOLD, SPACE, Wanted, Work, batch_texts, by_document, join_skewed, merged_ranges, mixed, runs, text_chunks, with_wanted, word_table, words_of

#: Words that a span has at least, sentences that it has at least, and words after which a sentence is cut.
SPAN_WORDS, SPAN_SENTENCES, SENTENCE_WORDS = 24, 2, 12
#: Words of a window of which the least hash begins a piece of a long sentence; no piece is longer.
CUT_WINDOW = 6
#: Rows from which a span is joined as a frequent one, apart from the others.
HOT_ROWS = 2000
_WORDS = word_table(SPACE)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_STEP = np.uint64(0xA0761D6478BD642F)


def _least_of_windows(values: np.ndarray, place: np.ndarray, after: np.ndarray, window: int) -> np.ndarray:
    """Which values are the least (the last of equals) of a window inside their sentence; place and after count its words on either side."""
    left, right = np.ones(len(values), bool), np.ones(len(values), bool)
    reach = np.ones(len(values), np.int64)
    for d in range(1, window):
        left &= place >= d
        left[d:] &= values[:-d] >= values[d:]
        right &= after >= d
        right[:-d] &= values[d:] > values[:-d]
        reach += left
        reach += right
    return reach >= window


def sentences(raws: list[bytes], sentence_words: int = SENTENCE_WORDS, cut_window: int = CUT_WINDOW) -> tuple[np.ndarray, ...]:
    """For all texts: word hashes, first word of each sentence, first sentence of each text, and bytes where words start and end.

    Sentences of more than sentence_words words are cut at the least hash of every cut_window words, so at the same words wherever a passage starts; every so many words from their start if that is 0.
    Both firsts have the end as the last entry; bytes count from the start of the joined texts.
    """
    data, starts, ends, words, firsts = words_of([r.translate(FOLD) for r in raws], _WORDS)
    n = len(starts)
    if not n:
        return words, np.zeros(1, np.int64), np.zeros(len(raws) + 1, np.int64), starts, ends
    begins = np.zeros(n, bool)
    begins[firsts[:-1][firsts[:-1] < n]] = True
    begins[1:] |= _ENDS[data[ends[:-1] - 1]]
    lines = np.cumsum(data == 10)
    begins[1:] |= lines[starts[1:]] > lines[starts[:-1]]
    at = np.flatnonzero(begins)
    many = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, many)
    if cut_window:
        size = np.repeat(many, many)
        long = np.flatnonzero(size > sentence_words)
        begins[long] |= _least_of_windows(mixed(words[long]), place[long], size[long] - 1 - place[long], cut_window)
    else:
        begins |= (place % sentence_words == 0) & (place > 0)
    at = np.flatnonzero(begins)
    return words, np.append(at, n), np.searchsorted(at, firsts), starts, ends


def spans(raws: list[bytes], span_words: int = SPAN_WORDS, span_sentences: int = SPAN_SENTENCES, cut_window: int = CUT_WINDOW) -> tuple[np.ndarray, ...]:
    """text, first sentence, sentences and two hashes of every span, sentences counted from each text's own start."""
    words, at, firsts, _, _ = sentences(raws, cut_window=cut_window)
    count = len(at) - 1
    none = np.zeros(0, np.int64)
    if count == 0:
        return none, none, none, none, none
    owner = np.searchsorted(firsts, np.arange(count), side="right") - 1
    places = np.arange(count)
    last = np.maximum(np.searchsorted(at, at[:-1] + span_words), places + span_sentences)  # first border with enough words
    head = np.minimum(np.searchsorted(at, at[1:] - span_words, side="right") - 1, places + 1 - span_sentences)  # last border that leaves enough
    on, back = last <= firsts[1:][owner], head >= firsts[:-1][owner]
    both = np.unique(np.concatenate((places[on] * (count + 1) + last[on], head[back] * (count + 1) + places[back] + 1)))
    first, last = both // (count + 1), both % (count + 1)
    owner = owner[first]
    a, b = at[first], at[last]
    hashes = []
    for salt in (0x1F83D9AB, 0x5BE0CD19):
        values = mixed(words + np.uint64(salt))
        up = np.cumprod(np.full(len(words) + 1, _STEP, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.full(len(words) + 1, pow(int(_STEP), -1, 1 << 64), np.uint64), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
        hashes.append(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64))
    return owner, first - firsts[owner], last - first, hashes[0], hashes[1]


def _span_keys(docs: DataFrame, span_words: int, span_sentences: int, cut_window: int, with_place: bool = False) -> DataFrame:
    """The first hash of every span of every text, with document and text hash where asked."""

    def scan(batches):
        for batch in batches:
            for at, raws in text_chunks(batch_texts(batch)):
                owner, _, _, h1, _ = spans(raws, span_words, span_sentences, cut_window)
                if with_place:
                    take = pa.array(owner + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(h1)], names=["doc_id", "text_hash", "key"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(h1)], names=["key"])

    return docs.mapInArrow(scan, "doc_id long, text_hash long, key long" if with_place else "key long")


def _repeated_spans(docs: DataFrame, wanted: Wanted, span_words: int, span_sentences: int, cut_window: int) -> DataFrame:
    """doc_id, text_hash, first, many, h1 and h2 of the spans whose first hash is wanted."""

    def scan(batches):
        for batch in batches:
            for at, raws in text_chunks(batch_texts(batch)):
                owner, first, many, h1, h2 = spans(raws, span_words, span_sentences, cut_window)
                use = np.flatnonzero(wanted.of(batch, at, owner, h1.view(np.uint64)))
                take = pa.array(owner[use] + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(first[use], pa.int32()), pa.array(many[use], pa.int32()), pa.array(h1[use]), pa.array(h2[use])],
                    names=["doc_id", "text_hash", "first", "many", "h1", "h2"],
                )

    return docs.mapInArrow(scan, "doc_id long, text_hash long, first int, many int, h1 long, h2 long")


def covered_sentences(docs: DataFrame, span_words: int = SPAN_WORDS, span_sentences: int = SPAN_SENTENCES, broadcast_bytes: int = BROADCAST_BYTES, cut_window: int = CUT_WINDOW, work: Work | None = None) -> DataFrame:
    """doc_id, text_hash and gone: runs (first, end) of sentences under a repeated span that isn't the first of its kind."""
    work = work or Work(docs.sparkSession, "sentences")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    again = work.write(_span_keys(docs, span_words, span_sentences, cut_window).groupBy("key").count().where("count > 1").select("key"), "repeated-spans")
    chosen, wanted = with_wanted(docs, again, _span_keys(docs, span_words, span_sentences, cut_window, True), broadcast_bytes)
    table = work.write(_repeated_spans(chosen, wanted, span_words, span_sentences, cut_window), "spans")
    place = F.struct("doc_id", "text_hash", "first")
    # A repeated row brings its spans twice at the same place: more than one place makes a repeat.
    seen = table.groupBy("h1", "h2").agg(F.min(place).alias("head"), F.max(place).alias("tail"), F.count(F.lit(1)).alias("times")).where(F.col("head") != F.col("tail")).select("h1", "h2", "head", "times")
    later = join_skewed(table, work.write(seen, "seen"), ["h1", "h2"], F.col("times") > HOT_ROWS, limit=broadcast_bytes).where(~place.eqNullSafe(F.col("head")))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", (F.col("first") + F.col("many")).alias("end")))).alias("gone"))


def remove_repeats(docs: DataFrame, span_words: int = SPAN_WORDS, span_sentences: int = SPAN_SENTENCES, cut_window: int = CUT_WINDOW) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_words_removed, text (what stays, byte for byte) for every row of docs."""
    docs, work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Work(docs.sparkSession, "sentences")
    gone = covered_sentences(docs, span_words, span_sentences, cut_window=cut_window, work=work).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    gone = work.write(merged_ranges(gone, "gone"), "gone", drop=["repeated-spans", "spans", "seen"])
    both = by_document(docs.withColumn("_text_hash", F.xxhash64("text")), gone, 64 + 40 * F.size("gone"))

    def cut(batches):
        for batch in batches:
            texts, ranges = batch_texts(batch), batch.column(2).to_pylist()
            rows = []
            for at, raws in text_chunks(texts):
                _, begin, firsts, starts, _ = sentences(raws, cut_window=cut_window)
                offset = 0
                for i, raw in enumerate(raws):
                    n, own = int(firsts[i + 1] - firsts[i]), ranges[at + i]
                    if not own:
                        rows.append((n, 0, 0, raw.decode("utf-8", "replace") if texts[at + i].is_valid else None))
                    else:
                        mask = np.zeros(n, bool)
                        for r in own:
                            mask[r["first"] : r["end"]] = True
                        words = np.diff(begin[firsts[i] : firsts[i + 1] + 1])
                        border = np.append(starts[begin[firsts[i] : firsts[i + 1]]] - offset, len(raw))
                        border[0] = 0  # what stands before the first sentence goes with it
                        a, b = runs(~mask)
                        kept = b"".join(raw[border[s] : border[e]] for s, e in zip(a.tolist(), b.tolist(), strict=True))
                        rows.append((n, int(mask.sum()), int(words[mask].sum()), kept.decode("utf-8", "replace")))
                    offset += len(raw) + 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_sentences", "n_removed", "n_words_removed", "text"])

    return both.select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, n_words_removed long, text string")
