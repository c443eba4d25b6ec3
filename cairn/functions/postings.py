"""Postings of a run of rows at a time, over Arrow: few wide rows for the shuffle by term in place of one for each posting.

A packed row has a term, the first id (at), and two runs of numbers of seven bits a byte: what each posting has (the id less the one before, the column's number,
how many positions, the row's tokens), and all positions (the first of each posting as it is, then differences).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are packed at a time, postings of a packed row, and rows of a batch that goes out.
RUN_TOKENS, PACKED, OUT_ROWS = 1_000_000, 4096, 200_000
#: What is packed: postings, and sums over the rows of a run: of cells, of beginnings of words, of everything.
POSTING, CELL, HEAD, TOTAL = 0, 1, 2, 3
PACKED_ROWS = "kind tinyint, term string, at long, each binary, positions binary, rows long, f long, d int"
SCHEMA = pa.schema([("kind", pa.int8()), ("term", pa.string()), ("at", pa.int64()), ("each", pa.binary()), ("positions", pa.binary()), ("rows", pa.int64()), ("f", pa.int64()), ("d", pa.int32())])
POSTINGS = pa.schema([("term", pa.string()), ("id", pa.int64()), ("column", pa.string()), ("d", pa.int32()), ("positions", pa.list_(pa.int32()))])


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (from 0 on) as bytes of seven bits, and where each one ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out, starts = np.zeros(ends[-1] if len(v) else 0, np.uint8), ends - size
    for k in range(size.max(initial=0)):
        has = size > k
        out[starts[has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def of_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of `to_bytes`, and where each one ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size, out = ends - starts, np.zeros(len(ends), np.int64)
    for k in range(size.max(initial=0)):
        has = size > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << 7 * k
    return out, ends


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _offsets(firsts: np.ndarray, n: int) -> np.ndarray:
    return np.append(firsts, n)


def _binary(data: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array of the numbers between cuts."""
    at = np.concatenate([[0], ends])[cuts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def _batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    have = {"kind": pa.array(np.full(n, kind, np.int8)), **columns}
    return pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def _packed(term: np.ndarray, words: pa.Array, id_: np.ndarray, column: np.ndarray, n: np.ndarray, d: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """Packed rows of postings that come by term, then id; n is how many positions each has."""
    starts = _firsts(term)
    lengths = np.diff(_offsets(starts, len(term)))
    firsts = np.flatnonzero((np.arange(len(term)) - np.repeat(starts, lengths)) % PACKED == 0)
    cuts = _offsets(firsts, len(term))
    step = np.diff(id_, prepend=id_[:1])
    step[firsts] = 0
    each, ends = to_bytes(np.stack([step, column, n, d], axis=1).reshape(-1))
    begins = np.cumsum(n) - n
    gaps = np.diff(positions, prepend=positions[:1])
    gaps[begins] = positions[begins]
    runs, run_ends = to_bytes(gaps)
    return _batch(POSTING, len(firsts), term=words.take(pa.array(term[firsts])), at=pa.array(id_[firsts]), each=_binary(each, ends, cuts * 4), positions=_binary(runs, run_ends, np.append(begins, len(positions))[cuts]))


def _facts(words: pa.Array, code: np.ndarray, row: np.ndarray, f: np.ndarray, ids: np.ndarray, d: np.ndarray, cell_ids: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Sums over a run of rows: of each term and cell, of each beginning of words, of everything; code and row have each pair of a term and a row once."""
    cell = ids // cell_ids
    at = _firsts(code, cell[row])
    if len(at):
        yield _batch(CELL, len(at), term=words.take(pa.array(code[at])), at=pa.array(cell[row[at]]), rows=pa.array(np.diff(_offsets(at, len(code)))), f=pa.array(np.maximum.reduceat(f, at)), d=pa.array(np.minimum.reduceat(d[row], at)))
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for k in range(1, prefix + 1):
        heads = pc.utf8_slice_codeunits(words, 0, k).dictionary_encode()
        has = size[code] >= k
        pairs = np.unique(heads.indices.to_numpy(zero_copy_only=False)[code[has]].astype(np.int64) * len(ids) + row[has]) // max(1, len(ids))
        which, many = np.unique(pairs, return_counts=True)
        if len(which):
            yield _batch(HEAD, len(which), term=heads.dictionary.take(pa.array(which)), rows=pa.array(many))
    yield _batch(TOTAL, 1, rows=pa.array([len(ids)]), f=pa.array([int(d.sum())]))


def _run(ids: np.ndarray, lists: list[pa.ListArray], cell_ids: int, prefix: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(ids, kind="stable")
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    d, place = sum(sizes)[order], np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    row = np.concatenate([np.repeat(place, s) for s in sizes])
    column = np.concatenate([np.full(s.sum(), k, np.int64) for k, s in enumerate(sizes)])
    position = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
    tokens = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]).dictionary_encode()
    words, ids = tokens.dictionary, ids[order]
    code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.lexsort((column, row, code))  # stable: positions stay in order
    code, row, column, position = code[by], row[by], column[by], position[by]
    at = _firsts(code, row, column)
    n = np.diff(_offsets(at, len(code)))
    if len(at):
        yield _packed(code[at], words, ids[row[at]], column[at], n, d[row[at]], position)
    code, row = code[at], row[at]
    whole = _firsts(code, row)
    yield from _facts(words, code[whole], row[whole], np.add.reduceat(n, whole) if len(whole) else n, ids, d, cell_ids, prefix)


def pack(batches: Iterator[pa.RecordBatch], cell_ids: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Packed postings and sums of rows of an id and lists of tokens, a run of rows at a time."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.columns[1:]
        many = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + RUN_TOKENS, "right")))
            yield from _run(ids[at:to], [x.slice(at, to - at) for x in lists], cell_ids, prefix)
            at = to


def repack(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Packed rows of postings as they are stored: a row for each run of one term in order of id."""
    names = pa.array(columns, pa.string())
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(0).dictionary_encode()
        code, id_ = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()
        column = pc.index_in(batch.column(2), names).to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.lexsort((column, id_, code))
        batch = batch.take(pa.array(by))
        n = pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False).astype(np.int64)
        yield _packed(code[by], words.dictionary, id_[by], column[by], n, batch.column(3).to_numpy(), batch.column(4).flatten().to_numpy().astype(np.int64))


def unpack(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Postings of packed rows (term, at, each, positions), in their order."""
    names = pa.array(columns, pa.string())
    joined = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint8)
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            each, ends = of_bytes(joined(batch.column(2)))
            each = each.reshape(-1, 4)
            # Packed rows end where their bytes end.
            last = np.searchsorted(ends, np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)), "left") + 1
            many = np.diff(last // 4, prepend=0)
            firsts = np.cumsum(many) - many
            total = np.cumsum(each[:, 0])
            id_ = total - np.repeat(total[firsts] - batch.column(1).to_numpy(), many)
            n = each[:, 2]
            begins = np.cumsum(n) - n
            gaps, _ = of_bytes(joined(batch.column(3)))
            sums = np.cumsum(gaps)
            positions = sums - np.repeat(sums[begins] - gaps[begins], n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(gaps)).astype(np.int32)), pa.array(positions.astype(np.int32)))
            made = [batch.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(id_), names.take(pa.array(each[:, 1])), pa.array(each[:, 3].astype(np.int32)), lists]
            out = pa.RecordBatch.from_arrays(made, schema=POSTINGS)
            yield from (out.slice(i, OUT_ROWS) for i in range(0, out.num_rows, OUT_ROWS))
