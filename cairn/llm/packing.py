"""Token-ID output: best-fit-decreasing packing of whole documents into fixed-length rows of ids.

Each task tokenizes its partition's texts, cuts those longer than a row into pieces without loss,
and packs pieces in decreasing length into the fullest row that still has room. A segment tree
over capacities finds that row in a logarithmic number of steps. Files in the shared folder hold a
packed id matrix, cumulative segment lengths and position resets; the returned table has a
row for each packed row, with its documents in order.

Nothing is shuffled. A window of pieces is packed at a time, so memory is bounded whatever a
partition's size; a window has a thousand rows, of which only the last few aren't full. Files are written under
a name of the attempt and renamed when whole, and depend on the partition's rows and their order alone: docs should be a written
table, whose partitions come again as they were when a task is repeated.

Defined cases: null and empty texts give no tokens and an `empty` row lists their documents; a text
longer than a row is cut in pieces that keep their order by `piece`; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources.folders import qualified
from .common import batch_texts, give_back, joined, mixed, prefix_hashes, shared_dir, span_hashes, text_chunks

#: Ids in a packed row, rows' worth of ids packed at once, and the id that fills a row's end.
ROW, WINDOW_ROWS, PAD = 2048, 1024, 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pieces whose ids a worker remembers; beyond, it forgets them all and starts again.
REMEMBERED = 500_000
#: Bytes of text whose pieces are looked up together.
RUN_BYTES = 1 << 19

_KIND = np.ones(256, np.uint8)  # 0 blank, 1 letters, digits and all beyond ASCII, 2 the rest
_KIND[32] = 0
_KIND[[b for b in range(128) if b != 32 and not chr(b).isalnum()]] = 2


def pieces_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, starts and ends of the pieces that are encoded alone, and each text's first piece (the end as the last entry).

    A piece is a run of one kind of bytes, with the blank before it. Pieces of a text cover it without gaps.
    """
    data, texts = joined(raws)
    kind = _KIND[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = kind[1:] != kind[:-1]
    word = np.flatnonzero(begins[1:-1] & (kind[:-1] == 0)) + 1  # after blanks: the last blank goes along
    begins[word], begins[word - 1] = False, True
    begins[texts[:-1]] = True
    begins[texts[1:] - 1] = True  # the line feed between texts is nobody's
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    own = np.ones(len(starts), bool)
    own[np.searchsorted(starts, texts[1:] - 1)] = False
    starts, ends = starts[own], ends[own]
    return data, starts, ends, np.searchsorted(starts, texts)


class Tokenizer:
    """Ids of texts for a file of byte-level BPE ranks; ids decode to the texts' bytes.

    Each distinct piece of a run of texts is looked up once. Known pieces are remembered up to a number, in arrays sorted by
    hash; length and first bytes must agree too.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        self.encoding = tiktoken.Encoding("cairn", pat_str=r" ?[^ ]+| +", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.keys, self.marks, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.table = np.zeros(0, np.uint16)

    def _learn(self, keys: np.ndarray, marks: np.ndarray, raws: list[bytes]) -> None:
        made = [self.encoding.encode_ordinary(raw.decode("utf-8")) for raw in raws]
        size = np.fromiter(map(len, made), np.int32, len(made))
        at = np.cumsum(size, dtype=np.int64) - size + len(self.table)
        self.table = np.concatenate((self.table, np.fromiter((i for ids in made for i in ids), np.uint16, int(size.sum()))))
        place = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("marks", marks), ("at", at), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), place, new))

    def _known(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces are, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.marks[at] == marks)

    def ids(self, raws: list[bytes]) -> list[np.ndarray]:
        data, starts, ends, firsts = pieces_of(raws)
        if not len(starts):
            return [np.zeros(0, np.uint16)] * len(raws)
        flat = data.tobytes() + bytes(8)
        eight = np.ndarray(len(data), "<u8", flat, strides=(1,))
        length = ends - starts
        # Up to seven bytes and the length: the whole of a short piece.
        marks = eight[starts] & ((np.uint64(1) << (np.minimum(length, 7) * 8).astype(np.uint64)) - np.uint64(1)) | np.minimum(length, 255).astype(np.uint64) << np.uint64(56)
        hashes = mixed(span_hashes(prefix_hashes(data), starts, ends) ^ marks)
        hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        own, a, b = marks[first], starts[first], ends[first]
        at, known = self._known(hashes, own)
        new = np.flatnonzero(~known)
        if len(self.keys) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(hashes))
        if len(new):
            self._learn(hashes[new], own[new], [flat[x:y] for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)])
            at, known = self._known(hashes, own)
        if not known.all() or (marks != own[back]).any():  # two pieces of one hash: no memory for this run
            return [np.asarray(self.encoding.encode_ordinary(raw.decode("utf-8")), np.uint16) for raw in raws] if len(raws) == 1 else [x for raw in raws for x in self.ids([raw])]
        count = self.size[at][back].astype(np.int64)
        stops = np.cumsum(count)
        out = self.table[np.arange(stops[-1]) + np.repeat(self.at[at][back] - (stops - count), count)]
        borders = np.concatenate(([0], stops))[firsts]
        return [out[x:y] for x, y in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class CapacityTree:
    """How many open rows have each remaining capacity, for the least capacity that is large enough."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, need: int) -> int:
        """The least capacity of at least need that some row has, or -1."""
        node, count = need + self.size, self.count
        if count[node]:
            return need
        while node > 1:  # climb until a right neighbour has rows, then go down on the left
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Indices of the lengths by packed row."""
    tree, rows, open_ = CapacityTree(row), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        capacity = tree.least(n)
        if capacity < 0:
            capacity, at = row, len(rows)
            rows.append([])
        else:
            at = open_[capacity].pop()
            tree.add(capacity, -1)
        rows[at].append(i)
        if capacity > n:
            open_.setdefault(capacity - n, []).append(at)
            tree.add(capacity - n, 1)
    return rows


def _save(fs, path: str, array: np.ndarray) -> None:
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        np.lib.format.write_array(out, array, allow_pickle=False)
    fs.move(temp, path)


SCHEMA = "file string, row int, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, lengths array<int>, ids_sha256 string, empty boolean"


def pack_tokens(docs: DataFrame, folder: str | None = None, row: int = ROW, window_rows: int = WINDOW_ROWS, vocabulary: str = VOCABULARY, pad: int = PAD) -> DataFrame:
    """Tokenize and pack all texts; a row for each packed row.

    file (a prefix: .ids.npy is the matrix of 16-bit ids, .cu.npy the cumulative segment lengths over
    the file, .resets.npy the places in the matrix, row by row, where positions start again at 0),
    row, n_tokens, n_segments, doc_ids and pieces (by segment), lengths, ids_sha256 (of the ids as little-endian 16-bit), empty.
    """
    folder = qualified(docs.sparkSession, folder) if folder else shared_dir(docs.sparkSession, "tokens")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def emit(fs, path, name, held):
        rows = best_fit_decreasing([len(ids) for _, _, ids in held], row)
        matrix = np.full((len(rows), row), pad, np.uint16)
        sums, resets, out = [0], [], []
        for r, members in enumerate(rows):
            at = 0
            for i in members:
                ids = held[i][2]
                matrix[r, at : at + len(ids)] = ids
                resets.append(r * row + at)
                at += len(ids)
                sums.append(sums[-1] + len(ids))
            out.append((f"{folder}/{name}", r, at, len(members), [held[i][0] for i in members], [held[i][1] for i in members], [len(held[i][2]) for i in members], hashlib.sha256(matrix[r, :at].astype("<u2").tobytes()).hexdigest(), False))
        _save(fs, f"{path}/{name}.ids.npy", matrix)
        _save(fs, f"{path}/{name}.cu.npy", np.asarray(sums, np.int64))
        _save(fs, f"{path}/{name}.resets.npy", np.asarray(resets, np.int64))
        return _rows(out)

    def pack(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            empty, docs_ = [], batch.column(0)
            for first, raws in text_chunks(batch_texts(batch), RUN_BYTES):
                for doc, ids in zip(docs_.slice(first, len(raws)).to_pylist(), tokenizer(vocabulary).ids(raws), strict=True):
                    if not len(ids):
                        empty.append(doc)
                    for piece, at in enumerate(range(0, len(ids), row)):
                        held.append((doc, piece, ids[at : at + row].copy()))
                        size += len(held[-1][2])
                        if size >= window_rows * row:
                            yield emit(fs, path, f"{part:06d}-{count:05d}", held)
                            held, size, count = [], 0, count + 1
            if empty:
                yield _rows([(None, None, 0, 0, empty, None, None, None, True)])
        if held:
            yield emit(fs, path, f"{part:06d}-{count:05d}", held)
        tokenizer(vocabulary).forget()  # the worker may do other work next
        give_back()

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


_ARROW = pa.schema([("file", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("empty", pa.bool_())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_packed(file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id matrix, cumulative segment lengths and position resets of a file prefix."""
    fs, path = pafs.FileSystem.from_uri(file)
    out = []
    for kind in ("ids", "cu", "resets"):
        with fs.open_input_file(f"{path}.{kind}.npy") as f:
            out.append(np.lib.format.read_array(f, allow_pickle=False))
    return tuple(out)
