"""The divergence audit against plain counting over everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairn.llm import divergence as dv
from cairn.llm import queries
from tests.compare import same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """rows of (text, lang, source); every kept term against every source, nothing sparse."""
    docs = [((t or "").translate(LOWER), g or "", s or "") for t, g, s in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in docs]
    seen, counts = Counter(), defaultdict(Counter)
    for (_, g, s), w in zip(docs, terms, strict=True):
        seen.update((g, x) for x in set(w))
        counts[g, s].update(w)
    out = []
    for g in {g for _, g, _ in docs}:
        kept = sorted(x for (h, x), n in seen.items() if h == g and n >= least)
        sources = sorted(s for h, s in counts if h == g)
        shares = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c[y] for y in kept) + len(kept)) for x in kept}  # noqa: E731, B023
        p, q = {s: shares(counts[g, s]) for s in sources}, shares(sum((counts[g, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(far(p[s][x], p[o][x]) for x in kept), o.encode(), o) for o in sources if o != s)
            out += [(g, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            found = sorted((-far(p[s][x], q[x]), x.encode(), x) for x in kept if counts[g, s][x] and p[s][x] > q[x])[:top]
            out += [(g, s, "term", x, -v, i + 1) for i, (v, _, x) in enumerate(found)]
    return sorted(out)


def made(df, **options):
    got = dv.divergence(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def corpus(n, sources, seed=0, words=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgÉñ") for _ in range(r.randint(1, 4))) for _ in range(words)]
    return [(" ".join(r.choices(vocabulary, weights=[1 / (1 + i) for i in range(words)], k=r.randint(0, 30))) + r.choice(["", ". 12", "-x_Y"]), r.choice(["de", "en"]), f"s{r.randrange(sources)}") for _ in range(n)]


def test_equals_sql(spark, sf, duck):
    same(queries.op13_divergence(spark, sf), duck, queries.OP13_SQL)


def test_odd_rows(spark):
    """Null and empty texts, languages and sources, repeated rows, groups and languages without kept terms, ties, clashing columns."""
    rows = corpus(120, 4) + corpus(3, 2, 9) * 5 + [(None, "en", "s0"), ("", "en", "only"), ("12 34", "fr", "s1"), ("rare words", "fr", "s2"), (None, None, None), ("a A a", None, "s1"), ("a", "", "s1"), ("a", None, "s9"), ("東京 東京 x", "ja", "s1"), ("東京", "ja", "s1"), ("東京", "ja", None)]
    df = spark.createDataFrame([(*r, 1, "x", [3]) for r in rows], "text string, lang string, source string, n int, term string, at array<int>").repartition(6)
    assert made(df) == plain(rows)
    assert made(df, min_docs=1, top=2) == plain(rows, 1, 2)


@pytest.mark.parametrize("rows", [[], [("a b", "en", "s")], [("a", "en", "s")] * 4])
def test_few_rows(spark, rows):
    assert made(spark.createDataFrame(rows, "text string, lang string, source string")) == plain(rows)


def test_many_sources_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK_SOURCES", 3)
    rows = [(t, "en", s) for t, _, s in corpus(300, 17, 4)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert made(df) == plain(rows)
    monkeypatch.setattr(dv, "join_side", lambda df, row_bytes: df)
    assert made(df) == plain(rows)


def test_folding_while_counting(spark, monkeypatch):
    """Small runs and few held rows: folded and sent on the way."""
    rows = corpus(200, 3, 5, 400)
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    wanted = plain(rows)
    monkeypatch.setattr(dv, "RUN_BYTES", 500)
    monkeypatch.setattr(dv, "HELD_ROWS", 50)
    assert made(df) == wanted


def test_one_very_long_text(spark):
    rows = [("alpha beta gamma " * 200_000, "en", "a"), ("alpha " * 9, "en", "b"), ("alpha beta", "en", "b"), ("beta", "en", "b")]
    assert made(spark.createDataFrame(rows, "text string, lang string, source string")) == plain(rows)


def test_sketch_is_never_below_the_truth():
    r = np.random.default_rng(1)
    sketch = np.zeros((3, 256), np.uint8)
    truth = Counter()
    for _ in range(60):
        keys = np.unique(r.integers(0, 400, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        truth.update(keys.tolist())
        dv.add_documents(sketch, keys)
    keys = np.array(sorted(truth), np.uint64)
    for least in (1, 3, 9):
        bits = np.packbits(sketch.reshape(-1) >= least)
        ok = dv.possible(bits, keys, 256, 3)
        assert all(o for o, k in zip(ok, keys.tolist(), strict=True) if truth[k] >= least)
    for _ in range(300):
        dv.add_documents(sketch, keys[:1])
    assert sketch.max() == 255


def test_impossible_terms_are_not_shuffled(spark):
    """Terms of too few documents are gone before the first shuffle of counts, but for collisions."""
    rows = [(f"common w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en", "a") for i in range(2000)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "xxhash64(lang) _lang", "xxhash64(lang, source) _group")
    width = dv.sketch_width(2000)
    raw = dv.term_counts(df, dv.document_bits(df, 3, width), width).groupBy("term").sum("n").collect()
    assert {r["term"]: r["sum(n)"] for r in raw}["common"] == 2000 and len(raw) < 20
