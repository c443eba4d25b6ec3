"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Each benchmark item gives windows of `window` consecutive words; an item of fewer words is one
window. Windows of equal length form a class with three tables: the block shift table says for
a pair of words how far the scan may jump, the suffix-hash buckets hold the windows whose last
pair has shift zero, and a direct comparison of the words confirms an occurrence. Texts are
cut in lanes of equal length that advance together in numpy, each by its own shifts.

The benchmark comes to the driver in blocks of a bounded number of windows, never whole. One
block is broadcast; where there are more, the blocks are written in the shared folder and each
task goes through them one by one, so memory stays bounded and no document is shuffled.

Defined cases: a null or empty text has no words and no hits; a text or item of separators only
too; an item without id marks hits but isn't counted; equal item ids count once; empty tables give
empty or clean results; other columns of the documents are kept by `decontaminate` and ignored by
`find_contamination`, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, batch_texts, mixed, shared_dir, text_chunks, word_table, words_of

#: Bytes that separate words: ASCII other than letters and digits, after A-Z became a-z.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WINDOW = 10
#: Windows in a block of the benchmark, at most (a single longer item is a block of its own).
BLOCK_WINDOWS = 200_000
#: Words of a text that a lane covers, and bits of the block shift table, which grows with the windows.
LANE_WORDS, LEAST_BITS, MOST_BITS = 256, 16, 24
#: Bytes of texts that go through all blocks of a large benchmark together; each block is read once for them.
HELD_BYTES = 64 << 20
_WORD_BYTES = word_table(SEPARATORS)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def words_in(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    raw = _fold(text)
    data, starts, ends, _, _ = words_of([raw], _WORD_BYTES)
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class WindowClass:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int, windows: dict[bytes, set[int]]):
        self.length, self.block = length, min(2, length)
        self.texts = sorted(windows)
        self.items = [sorted(windows[t]) for t in self.texts]
        raws = [t + b"\n" for t in self.texts]
        _, _, _, hashes, _ = words_of(raws, _WORD_BYTES)
        grid = hashes.reshape(len(self.texts), length)
        blocks = self.blocks(grid[:, :-1], grid[:, 1:]) if self.block == 2 else mixed(grid)
        # Room for eight times the blocks: most word pairs of a text then jump as far as they may.
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(8 * blocks.size - 1).bit_length()))
        slots = self.slot(blocks)
        longest = length - self.block + 1
        self.shift = np.full(1 << self.bits, longest, np.uint8 if longest < 256 else np.int64)
        for j in range(blocks.shape[1]):
            np.minimum.at(self.shift, slots[:, j], blocks.shape[1] - 1 - j)
        last = slots[:, -1]
        order = np.argsort(last, kind="stable")
        self.last, self.bucket, self.prefix = last[order], order, grid[:, 0].copy()

    @staticmethod
    def blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(a * _STEP + b)

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def occurrences(self, raw_of, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int]]:
        """(index of the first word, window) of all occurrences that lie in one text each."""
        m = self.length
        lo, hi = firsts[:-1] + m - 1, firsts[1:]
        lanes = np.maximum(0, -(-(hi - lo) // LANE_WORDS))
        if not lanes.sum():
            return []
        owner = np.repeat(np.arange(len(lanes)), lanes)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = lo[owner] + step * LANE_WORDS
        stop = np.minimum(at + LANE_WORDS, hi[owner])
        found_at, found_slot = [], []
        while len(at):
            block = self.blocks(words[at - 1], words[at]) if self.block == 2 else mixed(words[at])
            slot = self.slot(block)
            jump = self.shift[slot].astype(np.int64)
            zero = jump == 0
            if zero.any():
                found_at.append(at[zero])
                found_slot.append(slot[zero])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found_at:
            return []
        ends, slots = np.concatenate(found_at), np.concatenate(found_slot)
        head = np.searchsorted(self.last, slots)
        sizes = np.searchsorted(self.last, slots, side="right") - head
        begin = np.repeat(ends - m + 1, sizes)
        which = self.bucket[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(head, sizes)]
        like = words[begin] == self.prefix[which]
        return [(b, w) for b, w in zip(begin[like].tolist(), which[like].tolist(), strict=True) if raw_of(b, m) == self.texts[w]]


class Windows:
    """All windows of a block of the benchmark, by length."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        by_length: dict[int, dict[bytes, set[int]]] = {}
        self.ids: list[str | None] = []
        for n, (item, text) in enumerate(items):
            self.ids.append(None if item is None else str(item))
            words = words_in(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(b" ".join(words[i : i + m]), set()).add(n)
        self.classes = [WindowClass(m, w) for m, w in sorted(by_length.items())]

    def search(self, raws: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]], tuple]:
        """For each text: number of words, hit spans in words (from its own start), ids found; and the words' places."""
        data, starts, ends, hashes, firsts = words_of(raws, _WORD_BYTES)
        flat = data.tobytes()
        raw_of = lambda b, m: b" ".join(flat[s:e] for s, e in zip(starts[b : b + m].tolist(), ends[b : b + m].tolist(), strict=True))
        spans: list[list[tuple[int, int]]] = [[] for _ in raws]
        found: list[set[str]] = [set() for _ in raws]
        for kind in self.classes:
            hits = kind.occurrences(raw_of, hashes, firsts)
            texts = np.searchsorted(firsts, [b for b, _ in hits], side="right") - 1
            for (b, w), t in zip(hits, texts.tolist(), strict=True):
                spans[t].append((b - int(firsts[t]), b - int(firsts[t]) + kind.length))
                found[t].update(x for n in kind.items[w] if (x := self.ids[n]) is not None)
        return np.diff(firsts).tolist(), spans, found, (starts, ends, firsts)


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside at least one span."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WINDOWS) -> Iterator[Windows]:
    """Tables over the whole benchmark, a block of items at a time."""
    held: list[tuple[int | None, str | None]] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words_in(row["text"]))
        if held and size + n > limit:
            yield Windows(held, window)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    yield Windows(held, window)


def _store(path: str, tables: Windows) -> None:
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(pickle.dumps(tables))


def _load(path: str) -> Windows:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        return pickle.loads(f.read())


def _tables(benchmark: DataFrame, window: int, limit: int):
    """A function that gives a task the blocks one by one, and the bytes of texts to hold for them."""
    spark = benchmark.sparkSession
    blocks, first, paths = benchmark_blocks(benchmark, window, limit), None, []
    folder = shared_dir(spark, "benchmark")
    for i, tables in enumerate(blocks):
        if i == 0:
            first = tables
            continue
        if i == 1:
            _store(f"{folder}/0", first)
            paths.append(f"{folder}/0")
        _store(f"{folder}/{i}", tables)
        paths.append(f"{folder}/{i}")
    if not paths:
        one = spark.sparkContext.broadcast(first)
        return (lambda: iter([one.value])), 0
    return (lambda: map(_load, paths)), HELD_BYTES


def _scan(texts: pa.Array, blocks) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    n_words, spans, found = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for tables in blocks():
        for first, raws in text_chunks(texts):
            n, s, f, _ = tables.search([r.translate(FOLD) for r in raws])
            for i in range(len(raws)):
                n_words[first + i] = n[i]
                spans[first + i] += s[i]
                found[first + i] |= f[i]
    return n_words, spans, found


def _together(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold so many bytes; as they come for 0."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (sorted as strings)."""
    blocks, held = _tables(benchmark, window, block_windows)

    def scan(batches):
        for batch in _together(batches, held):
            n_words, spans, found = _scan(batch_texts(batch), blocks)
            items = [sorted(f) for f in found]
            hit = [covered(s) for s in spans]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without any occurrence of a window, with all their columns and in place (nothing is shuffled)."""
    blocks, held = _tables(benchmark, window, block_windows)

    def scan(batches):
        for batch in _together(batches, held):
            _, spans, _ = _scan(batch_texts(batch), blocks)
            yield batch.filter(pa.array([not s for s in spans], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
