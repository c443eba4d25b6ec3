"""Suffix-array dedup: bytes under strings of fixed length that also start elsewhere are removed.

Suffix arrays are built by two-stage sorting: only suffixes that are smaller than their successors
are sorted directly, the others are induced by scanning the buckets of the first byte from left to
right; then common prefixes of neighbours are computed. Orders and prefixes matter to the
depth of `width` bytes only, as longer agreement has no consequence.

One array of the whole corpus would be one sort of all its bytes. Instead windows of `width` bytes are dealt to arrays by
content: the anchor of a window is the gram of least hash in it, so equal windows have equal
anchors at equal places. Anchors that occur once end there. For the others the run of windows with that anchor
is cut out with its bytes (a context); equal contexts are one with a count, and the contexts of one
anchor come together in one suffix array, several anchors to an array. Hence each window is
sorted in exactly one place, together with every window that it could equal.

Anchors with more than `hot` distinct contexts would make an array of unbounded size: their windows are
counted by hash instead, combined before the shuffle. Anchors that repeat reach the tasks by broadcast if their counted
size is bounded, else through a shuffle join by document.

Defined cases: null and empty texts are 0 bytes; texts shorter than `width` lose nothing; a repeated
row is another place, so all of its windows repeat; documents without id are kept apart by
their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Wanted, Work, batch_texts, by_document, join_side, join_skewed, joined, materialize, merged_ranges, mixed, powers, prefix_hashes, runs, span_hashes, strings, text_chunks, with_wanted

#: Bytes of a window, and bytes of the grams that anchor it.
WIDTH, GRAM = 200, 32
#: Bytes of contexts in a suffix array (one anchor's contexts may exceed it), and contexts from which an anchor is hot.
ARRAY_BYTES, HOT = 1 << 20, 16000
#: Rows from which a context is joined as a frequent one, apart from the others.
HOT_ROWS = 2000
#: Contexts that a task remembers to have sent on.
SEEN = 200_000
#: Ends a context; it is no byte of UTF-8.
_END = 255


def type_b(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than its successor; the last one is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # last place of each run but the last
    up = text[change] < text[change + 1]
    sizes = np.diff(np.concatenate(([-1], change, [n - 1])))
    return np.repeat(np.append(up, False), sizes)


def _eights(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as a number that sorts like them; zeros follow the end."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(text)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _down(n: int) -> np.ndarray:
    return powers(n + 1)[1]


def _direct(text: np.ndarray, eights: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their suffixes, to the given depth; those equal to it stay in any order."""
    if len(places) < 2:
        return places
    n = len(text)
    prefix = prefix_hashes(text)
    hashes = span_hashes(prefix, places, np.minimum(places + depth, n))
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    final = places[first].astype(np.int64)  # one place for each distinct string
    names = np.arange(len(final))
    order = np.argsort(eights[final], kind="stable")
    names, key = order, eights[final[order]]
    border = np.append(True, key[1:] != key[:-1])
    slots = np.arange(len(final))
    at = np.full(len(final), 8)
    while True:
        open_ = ~(border & np.append(border[1:], True))
        slots, at, head = slots[open_], at[open_], border[open_]
        current = names[slots]
        keep = at < depth
        if not keep.all():
            slots, at, head, current = slots[keep], at[keep], head[keep], current[keep]
        if not len(slots):
            break
        begins = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        where = final[current]
        for skip in (64, 32, 16, 8):  # over what all of a group have in common
            here = np.minimum(where + at, n)
            h = prefix[np.minimum(here + skip, n)] - prefix[here]
            h *= _down(n)[here]
            same = np.logical_and.reduceat(h == h[begins][group], begins)[group]
            at = at + skip * same
        here = where + at
        key = np.where(here < n, eights[np.minimum(here, n - 1)], np.uint64(0))
        order = np.lexsort((key, group))
        current, key, at, sorted_group = current[order], key[order], at[order] + 8, group[order]
        names[slots] = current
        border = np.append(True, (sorted_group[1:] != sorted_group[:-1]) | (key[1:] != key[:-1]))
    rank = np.empty(len(names), np.int64)
    rank[names] = np.arange(len(names))
    return places[np.argsort(rank[back], kind="stable")]


def with_sources(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes and those from which they are induced: up to the next one that is sorted directly."""
    n = len(small)
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False) & ~small)  # the last of a run is induced
    stops = np.append(np.flatnonzero(small), n - 1)
    upto = stops[np.minimum(np.searchsorted(stops, ends), len(stops) - 1)]
    steps = np.bincount(ends, minlength=n + 1) - np.bincount(upto + 1, minlength=n + 1)[: n + 1]
    return wanted | (np.cumsum(steps)[:n] > 0)


def suffix_array(text: np.ndarray, depth: int = WIDTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of a byte array in order (to the given depth), by two-stage sorting.

    Where a mask of wanted suffixes is given, only they and what they are induced from are sorted and returned.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    small = type_b(text)
    needed = np.ones(n, bool) if wanted is None else with_sources(small, wanted)
    direct = _direct(text, _eights(text), np.flatnonzero(small & needed), depth)
    sizes = np.bincount(text[needed], minlength=256)
    large = ~small & needed
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(int(ends[-1]), -1, np.int64)
    of_b = np.bincount(text[direct], minlength=256) if len(direct) else np.zeros(256, np.int64)
    b_from = ends - of_b  # in a bucket, suffixes larger than their successors come first
    if len(direct):
        first = text[direct]
        sa[np.arange(len(direct)) - np.repeat(np.cumsum(of_b) - of_b, of_b) + np.repeat(b_from, of_b)] = direct[np.argsort(first, kind="stable")]
    head = heads.copy()
    if needed[n - 1]:
        sa[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1

    def induce(part: np.ndarray) -> None:
        before = part[part > 0] - 1
        before = before[large[before]]
        if not len(before):
            return
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        edge = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        count = np.diff(np.append(edge, len(byte)))
        kinds = byte[edge]
        sa[np.arange(len(byte)) - np.repeat(edge, count) + np.repeat(head[kinds], count)] = before
        head[kinds] += count

    for c in np.flatnonzero(sizes).tolist():
        done = heads[c]
        while done < head[c]:  # suffixes of this bucket may induce others of it
            upto = head[c]
            induce(sa[done:upto])
            done = upto
        induce(sa[b_from[c] : ends[c]])
    return sa


def neighbours_agree(text: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each place in the order but the first, whether it has `width` bytes in common with the one before."""
    eights = _eights(text)
    good = np.arange(1, len(order))
    for at in range(0, width, 8):
        step = min(at, width - 8)
        good = good[eights[order[good] + step] == eights[order[good - 1] + step]]
        if not len(good):
            break
    out = np.zeros(len(order), bool)
    out[good] = True
    return out[1:]


def repeated_starts(contexts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each context whether each of its windows also starts elsewhere among the contexts, by suffix array."""
    text = np.frombuffer(b"".join(c + bytes([_END]) for c in contexts), np.uint8)
    counts = np.asarray([len(c) - width + 1 for c in contexts])
    begins = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contexts])))[:-1]
    owner = np.repeat(np.arange(len(contexts)), counts)
    windows = np.zeros(len(text), bool)
    windows[np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)] = True
    sa = suffix_array(text, width, windows)
    sa = sa[windows[sa]]
    same = neighbours_agree(text, sa, width)
    found = np.zeros(len(text), bool)
    found[sa[1:][same]] = True
    found[sa[:-1][same]] = True
    return [found[b : b + n] for b, n in zip(begins.tolist(), counts.tolist(), strict=True)]


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : len(x) - have + 1]) if have < w else out


def _sliding_place(x: np.ndarray, w: int) -> np.ndarray:
    """The first place of the least of each w consecutive values."""
    have, out = 1, np.arange(len(x))
    pick = lambda a, b: np.where(x[b] < x[a], b, a)
    while 2 * have <= w:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - w + 1], out[w - have : len(x) - have + 1]) if have < w else out


def anchor_runs(keys: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor's place, first window and windows of each run, for the gram hashes of one text with a window at least."""
    w = width - gram + 1
    low = _sliding_least(keys, w)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    end = np.append(first[1:], len(low))
    place = np.empty(len(first), np.int64)
    for a in range(0, len(first), 4096):
        part = first[a : a + 4096]
        grid = keys[part[:, None] + np.arange(w)] == low[part][:, None]
        place[a : a + 4096] = part + grid.argmax(1)
    if (place < end - 1).any():  # the same gram again within reach: go by places
        at = _sliding_place(keys, w)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        return at[first], first, np.diff(np.append(first, len(at)))
    return place, first, end - first


def _each_anchor(raws: list[bytes], width: int, gram: int):
    """data, running hashes; then text, place in data, first window, windows and key of every anchor of every text."""
    data, starts = joined(raws)
    prefix = prefix_hashes(data)
    out = []
    if len(data) > gram:
        at = np.arange(len(data) - gram + 1)
        keys = span_hashes(prefix, at, at + gram)
        for i, raw in enumerate(raws):
            if len(raw) >= width:
                s = int(starts[i])
                place, first, many = anchor_runs(keys[s : s + len(raw) - gram + 1], width, gram)
                out.append((np.full(len(place), i), place + s, first + s, many, keys[place + s]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    return data, starts, prefix, columns


def _anchor_keys(docs: DataFrame, width: int, gram: int, with_place: bool = False) -> DataFrame:
    """The key of every anchor, with document and text hash where asked."""

    def scan(batches):
        for batch in batches:
            for at, raws in text_chunks(batch_texts(batch)):
                _, _, _, (owner, _, _, _, keys) = _each_anchor(raws, width, gram)
                key = pa.array(keys.view(np.int64))
                if with_place:
                    take = pa.array(owner + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), key], names=["doc_id", "text_hash", "key"])
                else:
                    yield pa.RecordBatch.from_arrays([key], names=["key"])

    return docs.mapInArrow(scan, "doc_id long, text_hash long, key long" if with_place else "key long")


def _contexts(docs: DataFrame, wanted: Wanted, width: int, gram: int) -> DataFrame:
    """doc_id, text_hash, key, c1, c2 (hashes of the context), start (first window), many (windows), context (null if the task had it before)."""

    def scan(batches):
        seen: set[int] = set()
        for batch in batches:
            for at, raws in text_chunks(batch_texts(batch)):
                data, starts, prefix, (owner, _, first, many, keys) = _each_anchor(raws, width, gram)
                use = np.flatnonzero(wanted.of(batch, at, owner, keys))
                owner, first, many, keys = owner[use], first[use], many[use], keys[use]
                ends = first + many + width - 1
                c1 = span_hashes(prefix, first, ends)
                c2 = mixed(span_hashes(prefix, first, (first + ends) // 2) ^ (many.astype(np.uint64) << np.uint64(48))) if len(first) else c1
                flat = data.tobytes()
                new = np.zeros(len(c1), bool)
                new[np.unique(c1, return_index=True)[1]] = True
                new &= np.fromiter((c not in seen for c in c1.tolist()), bool, len(c1))
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(c1[new].tolist())
                bytes_ = [flat[a:b] if n else None for a, b, n in zip(first.tolist(), ends.tolist(), new.tolist(), strict=True)]
                take = pa.array(owner + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(keys.view(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(first - starts[owner], pa.int64()), pa.array(many, pa.int32()), pa.array(bytes_, pa.binary())],
                    names=["doc_id", "text_hash", "key", "c1", "c2", "start", "many", "context"],
                )

    return docs.mapInArrow(scan, "doc_id long, text_hash long, key long, c1 long, c2 long, start long, many int, context binary")


_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _sort_contexts(contexts: DataFrame, width: int, array_bytes: int) -> DataFrame:
    """c1, c2 and runs (lo, hi) of repeated windows of each distinct context (key, c1, c2, context; a task sends one once)."""

    def solve(held):
        found = repeated_starts([c for _, _, c in held], width)
        rows = [(a, b, [{"lo": s, "hi": e} for s, e in zip(*(x.tolist() for x in runs(f)), strict=True)]) for (a, b, _), f in zip(held, found, strict=True) if f.any()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], _RUNS)], names=["c1", "c2", "runs"])

    def scan(batches):
        held, size, group, last = [], 0, {}, None
        for batch in batches:
            for key, c1, c2, context in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != last:
                    if len(group) > 1 or any(len(c) > width for c in group.values()):  # one window alone has no other to equal
                        held += [(*k, c) for k, c in group.items()]
                        size += sum(map(len, group.values()))
                    group, last = {}, key
                    if size >= array_bytes:
                        yield solve(held)
                        held, size = [], 0
                group[c1, c2] = context
        held += [(*k, c) for k, c in group.items()]
        if held:
            yield solve(held)

    # All contexts of a key in one task, those of one key side by side.
    dealt = contexts.select("key", "c1", "c2", "context").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(scan, "c1 long, c2 long, runs array<struct<lo: int, hi: int>>")


def _hot_windows(docs: DataFrame, hot: DataFrame, width: int, gram: int, limit: int) -> DataFrame:
    """doc_id, text_hash, lo, hi of repeated windows whose anchor is hot, by counting 128-bit hashes."""
    docs, wanted = with_wanted(docs, hot, _anchor_keys(docs, width, gram, True), limit)

    def scan(batches):
        for batch in batches:
            for at, raws in text_chunks(batch_texts(batch)):
                _, starts, prefix, (owner, _, first, many, keys) = _each_anchor(raws, width, gram)
                use = np.flatnonzero(wanted.of(batch, at, owner, keys))
                owner, first, many = owner[use], first[use], many[use]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                owner = np.repeat(owner, many)
                h1 = span_hashes(prefix, place, place + width)
                h2 = mixed(span_hashes(prefix, place, place + width // 2) + np.uint64(77))
                take = pa.array(owner + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(place - starts[owner], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "text_hash", "at", "h1", "h2"])

    rows = materialize(docs.mapInArrow(scan, "doc_id long, text_hash long, at long, h1 long, h2 long"), "hot-windows")
    again = rows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return rows.join(again, ["h1", "h2"], "left_semi").select("doc_id", "text_hash", F.col("at").alias("lo"), (F.col("at") + width).alias("hi"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, array_bytes: int = ARRAY_BYTES, broadcast_bytes: int = BROADCAST_BYTES, work: Work | None = None) -> DataFrame:
    """doc_id, text_hash and spans: byte ranges (lo, hi), sorted and perhaps overlapping, under repeated windows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    work = work or Work(docs.sparkSession, "suffixes")
    keys = work.write(_anchor_keys(docs, width, gram).groupBy("key").count().where("count > 1"), "anchors")
    chosen, wanted = with_wanted(docs, keys, _anchor_keys(docs, width, gram, True), broadcast_bytes)
    places = work.write(_contexts(chosen, wanted, width, gram), "contexts")
    # A context seen more than once repeats as a whole.
    times = places.groupBy("c1", "c2", "many").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    whole = times.select("c1", "c2", F.array(F.struct(F.lit(0).alias("lo"), F.col("many").alias("hi"))).alias("runs"), "times")
    contexts, many = places.where(F.col("context").isNotNull()), None
    often = keys.where(F.col("count") > hot).select("key")
    if not often.isEmpty():
        # Hot keys are few (each stands for more than `hot` rows); their contexts are combined before they meet.
        many = places.select("key", "c1", "c2").join(join_side(often, 16, broadcast_bytes), "key").distinct().groupBy("key").count()
        many = work.write(many.where(F.col("count") > hot).select("key"), "hot-anchors")
        if not many.isEmpty():
            contexts = contexts.join(join_side(many, 16, broadcast_bytes), "key", "left_anti")
    part = _sort_contexts(contexts, width, array_bytes)
    facts = whole.union(part.withColumn("times", F.lit(1).cast("long"))).groupBy("c1", "c2").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.max("times").alias("times"))
    found = join_skewed(places.select("doc_id", "text_hash", "c1", "c2", "start"), work.write(facts, "facts"), ["c1", "c2"], F.col("times") > HOT_ROWS, 256, limit=broadcast_bytes)
    found = found.select("doc_id", "text_hash", "start", F.explode("runs").alias("r"))
    spans = found.select("doc_id", "text_hash", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") - 1 + width).alias("hi"))
    if many is not None and not many.isEmpty():
        spans = spans.union(_hot_windows(docs, many, width, gram, broadcast_bytes))
    return spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) for every row of docs."""
    work = Work(docs.sparkSession, "suffixes")
    spans = repeated_spans(docs, width, work=work, **options).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    spans = work.write(merged_ranges(spans, "spans"), "repeats")
    work.drop_all_but("repeats")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text_hash"))
    both = by_document(own, spans, 64 + 40 * F.size("spans")).select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            rows = []
            for text, ranges in zip(strings(batch_texts(batch)), batch.column(2), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if not ranges.is_valid:
                    rows.append((len(raw), 0, 0, raw))
                    continue
                gone = np.zeros(len(raw), bool)
                at = ranges.values
                for lo, hi in zip(at.field(0).to_pylist(), at.field(1).to_pylist(), strict=True):
                    gone[lo:hi] = True
                rows.append((len(raw), int(gone.sum()), len(runs(gone)[0]), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
