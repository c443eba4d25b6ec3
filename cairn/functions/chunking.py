"""Content-defined chunking: cuts follow the bytes, so equal stretches give equal chunks.

The rolling value of a place is a sum of table entries of the bytes up to it, each doubled once for every place it lies back, in so many bits
as the cut rule looks at. An entry so many places back has left these bits: the value of all places of a buffer is a windowed sum, which doubling steps
give for whole arrays. A chunk starts its own sum after its least length; the part of the sum from before that place is
taken off where it still reaches. Places whose value has enough zero bits are found by mask, and only they are looked at when chunks are chosen.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

#: Least, average and largest chunk, and those of duplicate studies.
DEFAULT, SMALL = (8192, 16384, 65536), (512, 2048, 8192)
#: Fixed values of the generator of the gear table.
SEED, MULTIPLIER, INCREMENT = 0x9E3779B9, 1664525, 1013904223
#: Bytes that are worked on together; a longer one is taken whole.
RUN_BYTES = 4 << 20


@functools.lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 successive values of the generator."""
    value, out = SEED, np.zeros(256, np.uint32)
    for i in range(256):
        value = (value * MULTIPLIER + INCREMENT) % 2**32
        out[i] = value
    return out


def _zero_bits(average: int) -> tuple[int, int]:
    """Low bits that are zero at a cut before the average length, and at one from there on."""
    exponent = average.bit_length() - 1
    return exponent + 2, exponent - 2


def rolling(data: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits (more may be right) of each place's value over all bytes up to it."""
    kind = np.uint16 if bits <= 16 else np.uint32
    x, reach = gear().astype(kind)[data], 1
    while reach < bits:
        longer = x.copy()
        longer[reach:] += x[:-reach] << kind(reach)
        x, reach = longer, 2 * reach
    return x


class Chunker:
    """Cuts of byte strings that lie one after another in a buffer."""

    def __init__(self, data: np.ndarray, sizes: tuple[int, int, int] = DEFAULT):
        self.least, self.average, self.most = sizes
        self.strict, self.loose = _zero_bits(self.average)
        self.values = rolling(data, self.strict)
        few = np.flatnonzero(self.values & self.values.dtype.type(2**self.loose - 1) == 0)
        self.few = few.tolist()
        self.fewer = few[self.values[few] & self.values.dtype.type(2**self.strict - 1) == 0].tolist()

    def _own_sum(self, start: int, end: int, middle: int) -> int | None:
        """The first cut where the sum of a chunk that starts there doesn't fill the window yet."""
        end = min(end, start + self.strict - 1)
        if end <= start:
            return None
        value = self.values[start:end].astype(np.int64)
        if start:
            value -= int(self.values[start - 1]) << np.arange(1, end - start + 1)
        bits = np.where(np.arange(start, end) < middle, self.strict, self.loose)
        found = np.flatnonzero(value & ((1 << bits) - 1) == 0)
        return start + int(found[0]) + 1 if len(found) else None

    def next_cut(self, at: int, stop: int) -> int:
        """Where the chunk that begins at a place ends."""
        start, middle, end = at + self.least, at + self.average, min(at + self.most, stop)
        if start >= end:
            return end
        if (cut := self._own_sum(start, end, middle)) is not None:
            return cut
        full = start + self.strict - 1
        for places, low, high in ((self.fewer, full, min(middle, end)), (self.few, max(full, middle), end)):
            k = bisect_left(places, low)
            if k < len(places) and places[k] < high:
                return places[k] + 1
        return end

    def lengths(self, start: int, stop: int) -> list[int]:
        out = []
        while start < stop:
            cut = self.next_cut(start, stop)
            out.append(cut - start)
            start = cut
        return out


def cut_runs(raws: Iterator[bytes], sizes: tuple[int, int, int] = DEFAULT) -> Iterator[tuple[bytes, list[int]]]:
    """Each byte string with its chunk lengths; some are worked on together."""
    held, size = [], 0

    def out():
        chunker, at = Chunker(np.frombuffer(b"".join(held), np.uint8), sizes), 0
        for raw in held:
            yield raw, chunker.lengths(at, at + len(raw))
            at += len(raw)

    for raw in raws:
        held.append(raw)
        size += len(raw)
        if size >= RUN_BYTES:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def cut_lengths(data: bytes, sizes: tuple[int, int, int] = DEFAULT) -> list[int]:
    """Chunk lengths; they add up to the data's."""
    return Chunker(np.frombuffer(data, np.uint8), sizes).lengths(0, len(data))
