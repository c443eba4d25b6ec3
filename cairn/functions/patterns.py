"""Pattern events of all formats in one form: what each played order does, row by row.

An event is (row, channel, sample, note, off, speed, tempo): sample counts from 0 and is -1 where the
event names none, speed and tempo are 0 where they don't change. IT events name their sample by the
instrument's keymap; events of other formats may rely on the channel's last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from .modules import Bytes, detect, it_pattern, mod_channels

Event = tuple[int, int, int, bool, bool, int, int]


@dataclass
class Song:
    """speed and tempo at the start, played orders as (order, pattern), patterns as (rows, events)."""

    speed: int = 6
    tempo: int = 125
    orders: list[tuple[int, int]] = field(default_factory=list)
    patterns: dict[int, tuple[int, list[Event]]] = field(default_factory=dict)


def _mod(b: Bytes) -> Song | None:
    channels = mod_channels(b.mark(1080)) if b.n >= 1084 else 0
    if not channels:
        return None
    song, size, last = Song(), 256 * channels, max(b.data[952:1080])
    song.orders = [(i, b.u8(952 + i)) for i in range(min(b.u8(950), 128))]
    for pattern in {p for _, p in song.orders if p <= last}:
        start, events = 1084 + pattern * size, []
        for cell in range(64 * channels if start + size <= b.n else 0):
            w, x, y, z = b.data[start + 4 * cell : start + 4 * cell + 4]
            sample, note = (w & 0xF0 | y >> 4) - 1, bool((w & 15) << 8 | x)
            sets = y & 15 == 15 and z
            event = (cell // channels, cell % channels, sample, note, False, z if sets and z < 32 else 0, z if sets and z >= 32 else 0)
            if note or sample >= 0 or sets:
                events.append(event)
        song.patterns[pattern] = (64, events)
    return song


def _s3m(b: Bytes) -> Song | None:
    if b.n < 0x60 or b.mark(0x2C) != "SCRM":
        return None
    count, instruments = b.le16(0x20), b.le16(0x22)
    song = Song(b.u8(0x31) or 6, b.u8(0x32) or 125, [(i, b.u8(0x60 + i)) for i in range(count) if b.u8(0x60 + i) < 254])
    for pattern in {p for _, p in song.orders}:
        start, events, row = b.le16(0x60 + count + 2 * instruments + 2 * pattern) * 16, [], 0
        at, end = start + 2, min(start + 2 + b.le16(start), b.n) if start else 0
        while start and at < end and row < 64:
            what = b.u8(at)
            at += 1
            if not what:
                row += 1
                continue
            note, sample, command, value = -1, -1, 0, 0
            if what & 32:
                note, sample = b.u8(at), b.u8(at + 1) - 1
                at += 2
            at += bool(what & 64)
            if what & 128:
                command, value = b.u8(at), b.u8(at + 1)
                at += 2
            speed, tempo = value if command == 1 else 0, value if command == 20 and value >= 32 else 0
            if note >= 0 or sample >= 0 or speed or tempo:
                events.append((row, what & 31, sample, 0 <= note < 254, note >= 254, speed, tempo))
        song.patterns[pattern] = (64, events)
    return song


def _xm(b: Bytes) -> Song | None:
    channels, count = b.le16(68), b.le16(70)
    if b.n < 80 or b.data[:4] != b"Exte" or not 0 < channels <= 64:
        return None
    at, places = 60 + b.le32(60), []
    for _ in range(count):
        if at + 9 > b.n:
            return None
        places.append((at + b.le32(at), b.le16(at + 5), b.le16(at + 7)))
        at = places[-1][0] + places[-1][2]
    first, keys, samples = [], [], 0
    for _ in range(b.le16(72)):
        if at + 29 > b.n:
            break
        size, own, stride = b.le32(at), b.le16(at + 27), b.le32(at + 29)
        first.append(samples)
        keys.append(b.data[at + 33 : at + 129] if own else b"")
        at, total = at + size, 0
        for _ in range(own):
            if at + 18 > b.n:
                break
            samples, total, at = samples + 1, total + b.le32(at), at + stride
        at += total
    song = Song(b.le16(76) or 6, b.le16(78) or 125, [(i, b.u8(80 + i)) for i in range(min(b.le16(64), 256)) if b.u8(80 + i) < count])
    for pattern in {p for _, p in song.orders}:
        place, rows, packed = places[pattern]
        end, events = min(place + packed, b.n), []
        for cell in range(rows * channels):
            if place >= end:
                break
            flags = b.u8(place)
            place += 1
            if not flags & 0x80:
                flags, place = 0x1F, place - 1
            got = [0] * 5  # note, instrument, volume, effect, parameter
            for k in range(5):
                if flags >> k & 1:
                    got[k] = b.u8(place)
                    place += 1
            note, instrument, _, effect, value = got
            sets = flags & 0x18 and effect == 15
            sample = -1
            if 0 < note < 97 and 0 < instrument <= len(first):
                key = keys[instrument - 1]
                sample = first[instrument - 1] + (key[note - 1] if note <= len(key) else 0)
                sample = sample if sample < samples else -1
            event = (cell // channels, cell % channels, sample, 0 < note < 97, note == 97, value if sets and value < 32 else 0, value if sets and value >= 32 else 0)
            if any(event[3:]) or sample >= 0:
                events.append(event)
        song.patterns[pattern] = (rows, events)
    return song


def _it(b: Bytes) -> Song | None:
    if b.n < 0xC0:
        return None
    count, instruments, samples = b.le16(0x20), b.le16(0x22), b.le16(0x24)
    pointers = 0xC0 + count
    patterns = pointers + 4 * (instruments + samples)
    if patterns > b.n or not samples or not count:
        return None
    by_instrument = b.le16(0x2C) & 4 and instruments
    keymap = 0x40 if b.le16(0x2A) >= 0x200 else 0x2E

    def sample_of(note: int, instrument: int) -> int:
        if instrument <= 0:
            return -1
        if not by_instrument:
            return instrument - 1
        head = b.le32(pointers + 4 * (instrument - 1))
        return b.u8(head + keymap + 2 * note + 1) - 1 if head else -1

    song = Song(b.u8(0x32) or 6, b.u8(0x33) or 125, [(i, b.u8(0xC0 + i)) for i in range(count) if b.u8(0xC0 + i) < 254])
    for pattern in {p for _, p in song.orders}:
        start, events = b.le32(patterns + 4 * pattern), []
        rows, raw = it_pattern(b.data, start) if start and start + 8 <= b.n else (64, [])
        for row, channel, note, instrument, command, value in raw:
            sample = sample_of(note, instrument or 0) if note is not None and note < 120 else -1
            speed, tempo = value if command == 1 else 0, value if command == 20 and value >= 32 else 0
            off = note in (254, 255)
            if sample >= 0 or off or speed or tempo:
                events.append((row, channel, sample, sample >= 0, off, speed or 0, tempo or 0))
        song.patterns[pattern] = (rows, events)
    return song


SONGS = {"mod": _mod, "s3m": _s3m, "xm": _xm, "it": _it, "mptm": _it}


def song_of(data: bytes, fmt: str | None = None) -> Song | None:
    read = SONGS.get(fmt or detect(data) or "")
    return read(Bytes(data)) if read else None


def played(data: bytes) -> Iterator[tuple]:
    """place, order, rows, start speed and tempo, then an event (or nulls for an order without any) with its number."""
    song = song_of(data)
    for place, (order, pattern) in enumerate(song.orders if song else ()):
        rows, events = song.patterns.get(pattern, (64, []))
        head = (place, order, rows, song.speed, song.tempo)
        for seq, (row, channel, sample, note, off, speed, tempo) in enumerate(events):
            yield (*head, seq, row, channel, sample if sample >= 0 else None, note, off, speed or None, tempo or None)
        if not events:
            yield (*head, -1, None, None, None, False, False, None, None)
