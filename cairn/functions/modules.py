"""Readers of tracker module bytes: format, sample slots, regions, titles and events, in plain Python.

The layouts are public formats. Each reader takes bytes and gives rows; the Spark side runs them over
Arrow batches. What lies outside a file is skipped or cut, never an error.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass

#: Four-letter marks of MOD files by channels; other marks follow the patterns below.
MARKS = {"M.K.": 4, "M!K!": 4, "FLT4": 4, "4CHN": 4, "6CHN": 6, "FLT8": 8, "8CHN": 8, "OCTA": 8, "CD81": 8}
PATTERNS = (r"(\d)CHN", r"(\d\d)CH", r"(\d\d)CN", r"TDZ(\d)")


@dataclass
class Slot:
    """A sample of a module: slot counts from 1, length is of decoded bytes."""

    slot: int
    offset: int
    length: int
    bits: int = 8
    channels: int = 1
    compressed: bool = False
    header: int | None = None
    packed: int | None = None


class Bytes:
    """Little- and big-endian reads; beyond the end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)

    def u8(self, at: int) -> int:
        return self.data[at] if 0 <= at < self.n else 0

    def le16(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + 2], "little") if at >= 0 else self.u8(at) | self.u8(at + 1) << 8

    def be16(self, at: int) -> int:
        return self.u8(at) << 8 | self.u8(at + 1)

    def le32(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + 4], "little") if at >= 0 else self.le16(at) | self.le16(at + 2) << 16

    def mark(self, at: int) -> str:
        return self.data[at : at + 4].decode("latin-1")


def mod_channels(mark: str) -> int:
    """Channels by a MOD mark; 0 for marks of no known kind."""
    if mark in MARKS:
        return MARKS[mark]
    for pattern in PATTERNS:
        if m := re.fullmatch(pattern, mark):
            return int(m[1])
    return 0


def detect(data: bytes) -> str | None:
    b = Bytes(data)
    if b.n >= 4 and data[:3] == b"MO3":
        return "mo3"
    if b.n >= 4 and data[:4] == b"tpm.":
        return "mptm"
    if b.n >= 0x2C and data[:4] == b"IMPM":
        return "mptm" if 0x0889 <= b.le16(0x28) <= 0x0FFF else "it"
    if b.n >= 0x30 and b.mark(0x2C) == "SCRM":
        return "s3m"
    if b.n >= 17 and data[:4] == b"Exte":
        return "xm"
    return "mod" if b.n >= 1084 and mod_channels(b.mark(1080)) else None


#: A MOD's record of a sample, as far as its length is asked for.
_LENGTHS = struct.Struct(">22xH6x")


def _mod(b: Bytes):
    channels = mod_channels(b.mark(1080)) if b.n >= 1084 else 0
    if channels:
        at = 1084 + (max(b.data[952:1080]) + 1) * 256 * channels
        for i, (words,) in enumerate(_LENGTHS.iter_unpack(b.data[20:950])):
            size = words * 2
            if size > 2:
                yield Slot(i + 1, at, min(size, b.n - at))
                at += size
                if at > b.n:
                    return


def packed_span(data: bytes, at: int, frames: int, bits: int, channels: int) -> int:
    """Bytes of a compressed IT sample, by its chain of length-prefixed blocks; -1 if it runs out of the file."""
    b, place = Bytes(data), at
    blocks = channels * -(-frames // (0x4000 if bits == 16 else 0x8000))
    for _ in range(blocks):
        if place + 2 > b.n:
            return -1
        place += 2 + b.le16(place)
        if place > b.n:
            return -1
    return place - at


def _it(b: Bytes):
    table = 0xC0 + b.le16(0x20) + 4 * b.le16(0x22)
    for i in range(b.le16(0x24)):
        head = b.le32(table + 4 * i)
        if not head or head + 0x50 > b.n:
            continue
        flags, frames, at = b.u8(head + 0x12), b.le32(head + 0x30), b.le32(head + 0x48)
        if not flags & 1 or not frames or not at:
            continue
        bits, channels = 16 if flags & 2 else 8, 2 if flags & 4 else 1
        size = frames * bits // 8 * channels
        if flags & 8:
            span = packed_span(b.data, at, frames, bits, channels)
            yield Slot(i + 1, at, size, bits, channels, True, head, span if span > 0 else None)
        else:
            yield Slot(i + 1, at, min(size, b.n - at), bits, channels)


def _s3m(b: Bytes):
    table = 0x60 + b.le16(0x20)
    for i in range(b.le16(0x22)):
        head = b.le16(table + 2 * i) * 16
        if not head or head + 0x50 > b.n or b.u8(head) != 1:
            continue
        at, frames, flags = (b.u8(head + 0x0D) << 16 | b.le16(head + 0x0E)) * 16, b.le32(head + 0x10), b.u8(head + 0x1F)
        if frames and 0 < at < b.n:
            bits, channels = 16 if flags & 4 else 8, 2 if flags & 2 else 1
            yield Slot(i + 1, at, min(frames * bits // 8 * channels, b.n - at), bits, channels)


def _xm(b: Bytes):
    at, slot = 60 + b.le32(60), 0
    for _ in range(b.le16(70)):
        if at + 9 > b.n:
            return
        at += b.le32(at) + b.le16(at + 7)
    for _ in range(b.le16(72)):
        if at + 29 > b.n:
            return
        size, count, stride = b.le32(at), b.le16(at + 27), b.le32(at + 29)
        heads = []
        place = at + size
        for _ in range(count):
            if place + 18 > b.n:
                break
            heads.append((b.le32(place), 16 if b.u8(place + 14) & 0x10 else 8))
            place += stride
        at = place
        for length, bits in heads:
            slot += 1
            if length and at + length <= b.n:
                yield Slot(slot, at, length, bits)
            at += length
        if not count and not size:
            return


READERS = {"mod": _mod, "it": _it, "mptm": _it, "s3m": _s3m, "xm": _xm, "mo3": lambda b: iter(())}


def sample_slots(data: bytes, fmt: str | None = None) -> list[Slot]:
    """The module's samples that lie inside it."""
    fmt = fmt or detect(data)
    return [s for s in READERS[fmt](Bytes(data)) if s.length > 0 and 0 <= s.offset and s.offset + s.length <= len(data)] if fmt else []


def sample_regions(data: bytes, fmt: str | None = None) -> list[tuple[int, int]] | None:
    """(offset, length) of raw samples without overlaps, in file order; null where the format has none to cut out."""
    fmt = fmt or detect(data)
    if fmt is None or fmt == "mo3":
        return None
    out, end = [], 0
    for s in sorted((s for s in sample_slots(data, fmt) if not s.compressed), key=lambda s: s.offset):
        if s.offset >= end:
            out.append((s.offset, s.length))
            end = s.offset + s.length
    return out


def title_of(data: bytes, fmt: str | None = None) -> str:
    """The title in the header, printable and trimmed."""
    at, size = {"mod": (0, 20), "it": (4, 26), "mptm": (4, 26), "s3m": (0, 28), "xm": (17, 20)}.get(fmt or detect(data) or "", (0, 0))
    raw = data[at : at + size].split(b"\0")[0].decode("latin-1")
    return "".join(c for c in raw if " " <= c <= "~").strip()


def skeleton(data: bytes, regions: list[tuple[int, int]]) -> list[bytes]:
    """What lies between the regions, in file order (one piece more than regions)."""
    out, at = [], 0
    for offset, length in regions:
        out.append(data[at:offset])
        at = offset + length
    return [*out, data[at:]]


def blank_samples(data: bytes, slots: list[Slot]) -> bytes:
    """The file with its streamed samples zeroed. A compressed sample's header loses the flag and points to a zero tail."""
    out = bytearray(data)
    for s in slots:
        size = s.packed if s.compressed else s.length
        if size:
            out[s.offset : s.offset + size] = bytes(size)
    for s in slots:
        if s.compressed and s.header is not None:
            out[s.header + 0x12] &= ~8
            out[s.header + 0x48 : s.header + 0x4C] = struct.pack("<I", len(out))
            out += bytes(s.length)
    return bytes(out)


def it_pattern(data: bytes, at: int) -> tuple[int, list[tuple[int, int, int | None, int | None, int | None, int | None]]]:
    """Rows and events (row, channel, note, instrument, command, parameter) of a packed IT pattern.

    A channel's mask, note, instrument and command carry on: flag bits 16 to 128 of a mask repeat the last of each.
    """
    b, events = Bytes(data), []
    rows, place, row = b.le16(at + 2), at + 8, 0
    mask, note, instrument, command = {}, {}, {}, {}
    while row < rows and place < b.n:
        head = b.u8(place)
        place += 1
        if not head:
            row += 1
            continue
        channel = (head - 1) & 63
        if head & 128:
            mask[channel] = b.u8(place)
            place += 1
        m = mask.get(channel, 0)
        if m & 1:
            note[channel] = b.u8(place)
            place += 1
        if m & 2:
            instrument[channel] = b.u8(place)
            place += 1
        if m & 4:
            place += 1
        if m & 8:
            command[channel] = (b.u8(place), b.u8(place + 1))
            place += 2
        has = lambda bit: m & bit or m & bit << 4  # noqa: B023, E731
        c = command.get(channel) if has(8) else None
        events.append((row, channel, note.get(channel) if has(1) else None, instrument.get(channel) if has(2) else None, c and c[0], c and c[1]))
    return rows, events


def it_report(data: bytes) -> tuple | None:
    """orders, instruments, samples, patterns, compressed and 16-bit samples, and bytes of sample data, of an IT header; null for other files."""
    b = Bytes(data)
    if b.n < 0xC0 or data[:4] != b"IMPM":
        return None
    counts = [b.le16(0x20 + 2 * i) for i in range(4)]
    table, packed, wide, total = 0xC0 + counts[0] + 4 * counts[1], 0, 0, 0
    for i in range(counts[2]):
        head = b.le32(table + 4 * i)
        flags, frames = b.u8(head + 0x12), b.le32(head + 0x30)
        packed, wide = packed + bool(flags & 8), wide + bool(flags & 2)
        total += frames * (2 if flags & 2 else 1) * (2 if flags & 4 else 1) if flags & 1 else 0
    return (*counts, packed, wide, total)


# Synthetic modules for tests and queries.


@functools.cache
def _ramp(step: int, length: int) -> bytes:
    return bytes((i * step + (i >> 3) * 11 + 128) & 255 for i in range(length))


#: For each number a table that adds it to a byte.
_ADDED = [bytes((i + k) & 255 for i in range(256)) for k in range(256)]


def wave(length: int, seed: int) -> bytes:
    """Bytes by rule: a ramp of one of five slopes, moved by the seed."""
    return _ramp(3 + seed % 5, 1 << max(7, (length - 1).bit_length()))[:length].translate(_ADDED[seed * 7 & 255])


def build_mod(title: str, samples: list[tuple[int, int]], patterns: int = 1) -> bytes:
    """A four-channel MOD with empty patterns; samples are (length, seed)."""
    head = bytearray(title.encode("latin-1")[:20].ljust(20, b"\0"))
    for size, _ in samples[:31]:
        head += b"\0" * 22 + struct.pack(">HBBHH", size // 2, 0, 64, 0, 1)
    head += (b"\0" * 22 + struct.pack(">HBBHH", 0, 0, 64, 0, 1)) * (31 - len(samples))
    head += bytes([patterns, 127]) + bytes(range(patterns)).ljust(128, b"\0") + b"M.K."
    return bytes(head) + bytes(1024 * patterns) + b"".join(wave(n, s) for n, s in samples)


def build_it(title: str, samples: list[tuple[int, int]]) -> bytes:
    """An IT with two orders and uncompressed 8-bit samples."""
    head = bytearray(0xC0)
    head[:4] = b"IMPM"
    head[4:30] = title.encode("latin-1")[:26].ljust(26, b"\0")
    struct.pack_into("<HHHHH", head, 0x20, 2, 0, len(samples), 0, 0x0214)
    head += b"\xff\xff"
    first = len(head) + 4 * len(samples)
    data_at = first + 0x50 * len(samples)
    head += b"".join(struct.pack("<I", first + 0x50 * i) for i in range(len(samples)))
    body = b""
    for size, seed in samples:
        part = bytearray(0x50)
        part[:4], part[0x12] = b"IMPS", 1
        struct.pack_into("<I", part, 0x30, size)
        struct.pack_into("<I", part, 0x48, data_at + len(body))
        head += part
        body += wave(size, seed)
    return bytes(head) + body


def build_s3m(title: str, samples: list[tuple[int, int, int]]) -> bytes:
    """An S3M without patterns; samples are (frames, seed, flags: 2 stereo, 4 of 16 bits)."""
    head = bytearray(0x60)
    head[: len(title)] = title.encode("latin-1")[:28]
    struct.pack_into("<HHH", head, 0x20, 2, len(samples), 0)
    head[0x2C:0x30] = b"SCRM"
    head += b"\xff\xff"
    first = -(-(len(head) + 2 * len(samples)) // 16)
    data_at = first + 5 * len(samples)
    head += b"".join(struct.pack("<H", first + 5 * i) for i in range(len(samples)))
    head += bytes(first * 16 - len(head))
    body = b""
    for frames, seed, flags in samples:
        part = bytearray(0x50)
        at = data_at + len(body) // 16
        part[0], part[0x0D], part[0x1F] = 1, at >> 16, flags
        struct.pack_into("<H", part, 0x0E, at & 0xFFFF)
        struct.pack_into("<I", part, 0x10, frames)
        head += part
        size = frames * (2 if flags & 4 else 1) * (2 if flags & 2 else 1)
        body += wave(size, seed) + bytes(-size % 16)
    return bytes(head) + body


def build_xm(title: str, instruments: list[list[tuple[int, int, bool]]]) -> bytes:
    """An XM without patterns; an instrument is a list of samples (bytes, seed, 16 bits or not)."""
    out = bytearray(b"Extended Module: " + title.encode("latin-1")[:20].ljust(20) + b"\x1a" + b"x".ljust(20) + b"\x04\x01")
    out += struct.pack("<IHHHHHHHH", 276, 1, 0, 4, 0, len(instruments), 0, 6, 125) + bytes(256)
    for samples in instruments:
        size = 263 if samples else 33
        head = bytearray(size)
        struct.pack_into("<I", head, 0, size)
        struct.pack_into("<HI", head, 27, len(samples), 40)
        out += head
        for length, _, wide in samples:
            out += struct.pack("<IIIBbBBbB", length, 0, 0, 64, 0, 0x10 if wide else 0, 128, 0, 0) + bytes(22)
        out += b"".join(wave(length, seed) for length, seed, _ in samples)
    return bytes(out)


def pack_it(frames: int, bits: int, sizes: list[int]) -> bytes:
    """Blocks of a compressed sample, each with its length before it."""
    return b"".join(struct.pack("<H", n) + wave(n, bits) for n in sizes)
