"""Scalar string functions as column expressions; all stay inside generated code."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Extensions of side files, and words from which on a title doesn't identify a work.
SIDECARS = "info|txt|nfo|diz|readme|md|doc|jpg|jpeg|png|gif"
SUFFIX_WORDS = "part|pt|remix|mix|rmx|ver|version|v|edit|final|demo"
#: Block codecs by name.
CODECS = {"raw": 0x55, "dag-pb": 0x70, "dag-cbor": 0x71}
#: Bytes of a chunk where none are asked for.
CHUNK = 16384


@functools.lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Letters whose decomposition is one letter and combining marks, and those letters (lower case only)."""
    pairs = []
    for c in map(chr, range(0x80, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and base.isalnum() and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case, without diacritics, combining or composed."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accented()), r"\p{Mn}+", "")


def folded_words(text: Column) -> Column:
    """The tokens of a text: runs of letters and digits of any alphabet, folded."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def folded_tokens(text: str) -> tuple[str, ...]:
    """The same on the driver, for search strings."""
    low = "".join(c for c in text.lower().translate(str.maketrans(*_accented())) if unicodedata.category(c) != "Mn")
    return tuple(t for t in re.split(r"[^\w]|_", low) if t)


def nocase(col: Column) -> Column:
    """Sort key that folds A-Z only, as SQLite's NOCASE does; other letters keep their place."""
    return F.translate(col, UPPER, LOWER)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case."""
    return F.lower(F.substring_index(name, ".", -1))


def is_sidecar(name: Column) -> Column:
    return F.lower(name).rlike(rf"\.({SIDECARS})$")


def is_module_entry(name: Column) -> Column:
    """Neither a directory nor a side file; a hidden name inside an archive is an entry like others."""
    return ~name.endswith("/") & ~is_sidecar(name)


def title_key(title: Column) -> Column:
    """What identifies a work over its versions; null when less than four characters stay."""
    low = F.regexp_replace(F.lower(title), r"\(.*?\)", " ")
    short = F.regexp_replace(F.regexp_replace(low, rf"(?<![A-Za-z0-9_])({SUFFIX_WORDS})(?![A-Za-z0-9_]).*$", " "), "[^a-z0-9]+", "")
    return F.when(F.length(short) >= 4, short)


def short_id(text: Column, edge: int = 6, longest: int = 16) -> Column:
    """First and last characters with an ellipsis between, where the text is longer than that."""
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(edge)), F.lit("…"), F.right(text, F.lit(edge)))).otherwise(text)


def fmt_time(seconds: Column) -> Column:
    """m:ss; what isn't finite or below zero is 0:00."""
    safe = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), 0.0).otherwise(seconds)
    whole = F.floor(safe)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def fmt_bytes(n: Column) -> Column:
    """MB with one decimal from 1 MiB on, else KB."""
    mb = F.format_string("%.1f MB", F.round(n / 1048576.0, 1))
    return F.when(n >= 1048576, mb).otherwise(F.format_string("%.0f KB", F.round(n / 1024.0, 0)))


def since_label(seconds: Column) -> Column:
    s = F.floor(seconds)
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m"))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def percent_label(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "—").otherwise(F.format_string("%.1f%%", F.round(100.0 * part / whole, 1)))


def strip_prefix(path: Column) -> Column:
    """A content path without /ipfs/ or /ipns/."""
    return F.regexp_replace(path, "^/ip[fn]s/", "")


def chunk_size(chunker: Column, default: int = CHUNK) -> Column:
    """n of size-n; the default for anything else, zero included."""
    n = F.regexp_extract(chunker, r"^size-(\d{1,15})$", 1)
    return F.coalesce(F.nullif(F.when(n != "", n.cast("long")), F.lit(0).cast("long")), F.lit(default).cast("long"))


def duration_seconds(text: Column, default: float) -> Column:
    """Seconds of durations such as 1h30m or 2.5s; the default where the text is none."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    total = part("h") * 3600 + part("m(?!s)") * 60 + part("(?<!m)s") + part("ms") / 1000
    return F.when(text.rlike(r"^(\d+(\.\d+)?(h|ms|m|s))+$"), total).otherwise(F.lit(float(default)))


def percent_encoded(text: Column) -> Column:
    """Every UTF-8 byte but letters, digits and -_.~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def transport_class(address: Column) -> Column:
    """relay where a circuit is in the address, else its transport."""
    return (
        F.when(address.isNull() | (address == ""), "unknown")
        .when(F.contains(address, F.lit("/p2p-circuit")), "relay")
        .when(F.contains(address, F.lit("/quic")), "quic")
        .when(F.contains(address, F.lit("/tcp/")), "tcp")
        .otherwise("direct")
    )


def relay_hop(address: Column) -> Column:
    """The peer through which a relayed address goes; null for others."""
    return F.nullif(F.regexp_extract(address, "/p2p/([^/]+)/p2p-circuit", 1), F.lit(""))


def reachable_label(flag: Column) -> Column:
    return F.when(flag.isNull(), "checking").when(flag, "direct").otherwise("relayed")


def truthy(text: Column, default: bool = False) -> Column:
    """Booleans as environments spell them."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False).otherwise(default)


def first_words(text: Column, count: int = 200) -> Column:
    return F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, count)


def display_name(title: Column, filename: Column) -> Column:
    """The title, or the file's name where it is empty or missing."""
    return F.coalesce(F.nullif(title, F.lit("")), filename)


def codec_code(name: Column) -> Column:
    """The code of a codec by name or in digits; null for other texts."""
    out = F.when(name.rlike(r"^\d{1,9}$"), name.cast("long"))
    for known, code in CODECS.items():
        out = F.when(name == known, F.lit(code).cast("long")).otherwise(out)
    return out


def codec_name(code: Column) -> Column:
    out = code.cast("string")
    for name, known in CODECS.items():
        out = F.when(code == known, name).otherwise(out)
    return out


def joined_names(*lists: Column) -> Column:
    """All names of the lists in order, trimmed, blanks dropped, with a space between."""
    return F.array_join(F.filter(F.transform(F.flatten(F.array(*lists)), lambda x: F.trim(x)), lambda x: x != ""), " ")


def match_string(text: Column) -> Column:
    """The search string that goes to the index: explicit syntax as it is, else each word as a quoted prefix."""
    t = F.trim(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return F.when(t.rlike(r'["*:^]'), t).otherwise(F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " "))
