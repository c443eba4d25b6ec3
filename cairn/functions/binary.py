"""Numbers, flags, hashes and chunks of binary columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, at) -> Column:
    """The unsigned byte at a place counted from 0; null beyond the end."""
    part = F.hex(F.substring(data, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(1)))
    return F.conv(F.nullif(part, F.lit("")), 16, 10).cast("long")


def u16le(data: Column, at) -> Column:
    return byte_at(data, at) + byte_at(data, at + 1) * 256


def u16be(data: Column, at) -> Column:
    return byte_at(data, at) * 256 + byte_at(data, at + 1)


def u32le(data: Column, at) -> Column:
    return u16le(data, at) + u16le(data, at + 2) * 65536


def s8(byte: Column) -> Column:
    """A byte with its sign."""
    return F.when(byte > 127, byte - 256).otherwise(byte)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def without_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.bitwise_not(F.lit(bit).cast("long")))


def tag(data: Column, at: int, length: int = 4) -> Column:
    return F.decode(F.substring(data, at + 1, length), "ISO-8859-1")


def printable(data: Column, at: int, length: int) -> Column:
    """ASCII up to the first NUL, without control characters, trimmed."""
    text = F.substring_index(F.decode(F.substring(data, at + 1, length), "ISO-8859-1"), "\u0000", 1)
    return F.trim(F.regexp_replace(text, "[^\\x20-\\x7E]", ""))


def digest(data: Column) -> Column:
    """The content address: sha-256 in hex."""
    return F.sha2(data, 256)


def fixed_chunks(data: Column, size: int) -> Column:
    """Array of (ord, off, bytes) of equal length but the last; an empty value has none."""
    n = F.length(data)
    count = F.ceil(n / size).cast("int")
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(i.alias("ord"), (i * size).alias("off"), F.substring(data, i * size + 1, F.lit(size)).alias("bytes")))


def row_seconds(speed: Column, tempo: Column) -> Column:
    return speed * 2.5 / tempo


def note_rate(c5: Column, note: Column) -> Column:
    """Playback rate of a sample at a note; 60 is its own."""
    return c5 * F.pow(F.lit(2.0), (note - 60) / 12.0)


def linear_rate(note: Column, finetune: Column) -> Column:
    """Playback rate by linear periods: 64 steps to a semitone."""
    period = 7680 - note * 64 - finetune / 2
    return 8363 * F.pow(F.lit(2.0), (4608 - period) / 768)
