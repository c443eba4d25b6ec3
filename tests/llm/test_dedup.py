"""Sentence spans, shingle sets, components and suffix arrays against brute force; the pipeline and its stages."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import graph as G
from cairn.llm import ngram_join as N
from cairn.llm import sentence_dedup as SD
from cairn.llm import suffix_dedup as SA

from .conftest import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sentences(rows):
    """rows (doc_id, text), equal rows once: what is kept of each text."""
    spans, sents = defaultdict(list), {}
    for d, x in set(rows):
        out, cur = [], []
        for m in WORD.finditer(x or ""):
            if cur and (x[cur[-1][1] - 1] in ".!?" or "\n" in x[cur[-1][1] : m.start()] or len(cur) == SD.SENTENCE_WORDS):
                out.append(cur)
                cur = []
            cur.append((m.start(), m.end(), m.group().translate(LOW)))
        sents[d, x] = out + [cur] if cur else out
        s = sents[d, x]
        for i in range(len(s)):
            n, j = 0, i
            while j < len(s) and (n < SD.SPAN_WORDS or j - i < SD.SPAN_SENTENCES):
                n, j = n + len(s[j]), j + 1
            runs = {(i, j)} if n >= SD.SPAN_WORDS and j - i >= SD.SPAN_SENTENCES else set()
            n, k = 0, i + 1
            while k > 0 and (n < SD.SPAN_WORDS or i + 1 - k < SD.SPAN_SENTENCES):
                k -= 1
                n += len(s[k])
            if n >= SD.SPAN_WORDS and i + 1 - k >= SD.SPAN_SENTENCES:
                runs.add((k, i + 1))
            for a, b in runs:
                spans[tuple(w for t in s[a:b] for _, _, w in t)].append((d, x, a, b))
    return sents, spans


def kept_of(rows, gone, sents):
    out = Counter()
    for d, x in rows:
        s, g = sents[d, x], gone.get((d, x), set())
        border = [0] + [t[0][0] for t in s[1:]] + [len(x or "")]
        out[d, len(s), len(g), x if not g else "".join(x[border[i] : border[i + 1]] for i in range(len(s)) if i not in g)] += 1
    return out


def test_sentences(spark, documents, texts):
    rows = list(texts.items())
    sents, spans = brute_sentences(rows)
    gone = defaultdict(set)
    for places in spans.values():
        for d, x, i, j in sorted(set(places), key=lambda p: (p[0], p[2]))[1:]:
            gone[d, x] |= set(range(i, j))
    want = kept_of(rows, gone, sents)
    got = Counter((r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in SD.remove_repeats(documents, cut_window=0).collect())
    assert got == want and gone
    for limit in (0, 1 << 20):
        runs = SD.covered_sentences(documents.select("doc_id", "text"), broadcast_bytes=limit, cut_window=0).collect()
        assert {r["doc_id"] for r in runs} == {d for d, _ in gone}


def test_sentences_odd(odd_docs, no_docs, odd_rows):
    got = Counter((r["doc_id"], r["text"]) for r in SD.remove_repeats(odd_docs).collect())
    assert sum(got.values()) == len(odd_rows) and got[4, None] == 1 and got[5, ""] == 1 and got[7, "one two"] == 1
    first = next(t for d, t, _ in odd_rows if d is None)
    assert got[None, first] == 1 and got[1, ""] + got[1, None] == 1  # the row without id comes first
    assert SD.remove_repeats(no_docs).count() == 0


def test_passage_is_caught(spark):
    passage = prose(60, 9)
    rows = [(i, prose(80, 100 + i) + " " + passage + " " + prose(80, 200 + i)) for i in range(4)] + [(9, prose(200, 300))]
    out = {r["doc_id"]: r for r in SD.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["n_removed"] == 0 and out[9]["n_removed"] == 0 and all(out[i]["n_words_removed"] >= 45 for i in (1, 2, 3))


def test_passage_inside_sentences_is_caught(spark):
    """60 words without an end, at every place in a sentence that is cut."""
    passage = " ".join(f"p{i * i}" for i in range(60))
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(24 + i)), passage, *(f"z{i}x{j}" for j in range(30))])) for i in range(SD.SENTENCE_WORDS)]
    out = {r["doc_id"]: r for r in SD.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["n_removed"] == 0 and out[0]["text"] == rows[0][1]
    for i, text in rows[1:]:
        kept = out[i]["text"].split()
        assert 60 - 4 * SD.CUT_WINDOW <= out[i]["n_words_removed"] <= 60
        assert [w for w in text.split() if w[0] != "p"] == [w for w in kept if w[0] != "p"]  # what is the document's own stays


def test_cuts_follow_the_words():
    """No piece is longer than the window, and far from the ends cuts don't depend on what comes before."""
    words = [f"w{i * 7919 % 1009}" for i in range(200)]
    cuts = []
    for k in range(13):
        _, at, _, _, _ = SD.sentences([" ".join([*(f"x{k}y{j}" for j in range(k)), *words]).encode()], cut_window=SD.CUT_WINDOW)
        assert np.diff(at).max() <= SD.CUT_WINDOW
        cuts.append({a - k for a in at.tolist() if a - k >= SD.CUT_WINDOW})
    assert all(c == cuts[0] for c in cuts)
    assert len(SD.sentences([b"one two. three four"], cut_window=SD.CUT_WINDOW)[1]) == 3


def sets_of(rows):
    out = []
    for d, x in rows:
        w = WORD.findall((x or "").translate(LOW))
        out.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_groups(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, s) in enumerate(sets):
        for j in range(i):
            e, t = sets[j]
            if s and t and d is not None and e is not None and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if d is not None else None) for i, (d, s) in enumerate(sets))


def groups_of(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_join_on_documents(documents, texts):
    assert groups_of(N.similar_groups(documents)) == brute_groups(list(texts.items()))


def test_join_odd(odd_docs, no_docs, odd_rows):
    assert groups_of(N.similar_groups(odd_docs)) == brute_groups([(d, t) for d, t, _ in odd_rows])
    assert N.similar_groups(no_docs).count() == 0
    kept = N.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 3 not in ids and 8 not in ids and {1, 4, 5, 6, 7, 9, 10, 11} <= set(ids)


@pytest.mark.parametrize("group", [2, 64])
def test_join_of_large_groups(spark, group):
    """Families of near copies, and a passage that many share; small groups send them through every tier."""
    import random

    r = random.Random(4)
    passage, rows = prose(150, 1).split(), []
    for f in range(3):
        base = prose(140, 10 + f).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.choice([1, 2, 4, 7])):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append((len(rows), " ".join(w)))
    for i in range(15):
        rows.append((len(rows), " ".join(passage + prose(r.choice([20, 60, 100]), 500 + i).split())))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups_of(N.similar_groups(frame, group=group)) == brute_groups(rows)


@pytest.mark.parametrize("group", [1, 3])
def test_join_through_leaders(spark, group):
    """More than 512 frequent shingles each; families about the threshold whose members partly link with each other only."""
    import random

    r = random.Random(8)
    rows, bases = [], [prose(620, 40).split(), prose(620, 41).split()]
    for i in range(40):
        w = list(bases[i % 2])
        for _ in range(r.choice([2, 10, 14, 18, 20, 22, 30])):
            w[r.randrange(len(w))] = f"q{r.random()}"
        if i % 3 == 0:
            del w[r.randrange(100) : r.randrange(100, 220)]
        rows.append((100 - i, " ".join(w)))
        if i % 4 == 0:  # a copy of the copy, by which links go on
            for _ in range(12):
                w[r.randrange(len(w))] = f"q{r.random()}"
            rows.append((200 + i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert len({c for _, _, c in want}) > 3
    assert groups_of(N.similar_groups(frame, group=group)) == want


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, other texts under the same id, and rows without id or words."""
    a, b = prose(120, 70), prose(120, 71)
    rows = [(1, a, "x"), (1, a, "y"), (1, a + " more", "x"), (2, a, "x"), (1, b, "x"), (3, b + " more", "x"), (None, a, "x"), (None, a, "x"), (4, "", "x"), (4, "", "x"), (5, None, "x")]
    kept = [(r["doc_id"], r["text"]) for r in N.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    one = [t for d, t in kept if d == 1]
    assert len(one) == 2 and b in one and sum(t in (a, a + " more") for t in one) == 1
    assert sorted((d for d, _ in kept if d != 1), key=str) == [4, 4, 5, None, None]


def test_hard_bound():
    """No partner's size asks for fewer shared tokens of the longer prefixes than the bound of hard nodes; nor do prefixes miss."""
    size = lambda n: N.prefix_size(n, n // N.PART)
    ask = lambda n, m: max(1, -(-(n + m) * 75 // 175) - max(n - size(n), m - size(m)))
    for n in [*range(1, 400), 997, 5000, 64001]:
        partners = [m for m in range(-(-n * 75 // 100), n * 100 // 75 + 1)]
        assert min(ask(n, m) for m in partners[:: max(1, len(partners) // 500)] + partners[-1:]) >= max(1, n // N.PART - 1)


def test_prefixes_share_what_they_must(spark):
    """Sets at the threshold share least_shared tokens in their prefixes, under every order, also beyond 512 shingles."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(2)
    for n in (3, 40, 700, 1500):
        for _ in range(20):
            o, extra = -(-2 * n * 75 // 175), n - -(-2 * n * 75 // 175)
            pool = [np.uint64(r.getrandbits(64)) for _ in range(o + 2 * extra)]
            x, y = np.array(pool[: o + extra], np.uint64), np.array(pool[:o] + pool[o + extra :], np.uint64)
            for k in range(N.ORDERS):
                for part in (0, N.PART, 1):
                    p, q = N._prefixes([x, y], k, part)
                    row = spark.range(1).select(N.least_shared(F.lit(n), F.lit(n), F.lit(len(p)), F.lit(len(q))).alias("v")) if _ == 0 else None
                    least = row.first()["v"] if row is not None else max(1, -(-2 * n * 75 // 175) - max(n - len(p), n - len(q)))
                    assert least == max(1, -(-2 * n * 75 // 175) - (n - len(p))) and len(np.intersect1d(p, q)) >= least


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    got = {(r["node"], r["component"]) for r in G.connected_components(spark.createDataFrame(edges or [(1, 1)], "a long, b long")).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == set(label.items())


def test_long_chain(spark):
    got = G.connected_components(spark.range(300).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


@given(st.binary(max_size=200), st.integers(1, 3), st.integers(0, 255))
@settings(max_examples=150, deadline=None)
def test_suffix_array(data, letters, salt):
    text = (np.frombuffer(data, np.uint8) % letters + 97).astype(np.uint8)
    raw = text.tobytes()
    assert SA.suffix_array(text, 400).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    wanted = (np.arange(len(text)) * (salt + 1)) % 3 == 0
    part = SA.suffix_array(text, 400, wanted)
    assert part[wanted[part]].tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


def brute_bytes(rows, width=200):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = Counter()
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                gone[i : i + width] = True
        out[d, len(r), int(gone.sum()), len(SA.runs(gone)[0]), np.frombuffer(r, np.uint8)[~gone].tobytes()] += 1
    return out


def bytes_of(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=8), min_size=1, max_size=6))
@settings(max_examples=6, deadline=None)
def test_merged_ranges(spark, rows):
    from cairn.llm.common import merged_ranges

    table = [(i, sorted({(a, a + n) for a, n in r}) if i != 2 else None) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(table, "_id long, spans array<struct<lo: int, hi: int>>")
    for r in merged_ranges(frame, "spans").collect():
        places = {p for a, b in table[r["_id"]][1] or [] for p in range(a, b)}
        got = [(x["lo"], x["hi"]) for x in r["spans"] or []]
        assert {p for a, b in got for p in range(a, b)} == places and all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_suffix_dedup_on_documents(documents, texts):
    assert bytes_of(SA.remove_repeated_bytes(documents)) == brute_bytes(list(texts.items()))


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"broadcast_bytes": 0}, {"hot": 1, "broadcast_bytes": 0, "array_bytes": 100}])
def test_suffix_dedup_odd(odd_docs, odd_rows, no_docs, options):
    rows = [(d, t) for d, t, _ in odd_rows]
    assert bytes_of(SA.remove_repeated_bytes(odd_docs, **options)) == brute_bytes(rows)
    if not options:
        assert SA.remove_repeated_bytes(no_docs).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES:
        after = stage(spark, before, sf)
        if name == "tokens":
            ids = {d for r in after.collect() for d in r["doc_ids"]}
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()}
            break
        assert after.columns == columns
        had, has = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in (before, after))
        assert set(has) <= set(had) and all((t or "") in (had[d] or "") for d, t in has.items())
        if name == "near_duplicates":
            assert set(has) == {d for (d, _, c), _ in brute_groups(list(had.items())).items() if d == c}
        before = after.sparkSession.createDataFrame(after.collect(), after.schema)


def test_pipeline_on_odd_rows(spark, sf, odd_rows):
    """Nulls in every column, empty texts, repeated rows and extra columns with the operators' own names, through every stage, each against a plain version."""
    import corpus_pipeline as P
    from cairn.llm import common
    from tests.llm.test_text_operators import brute_windows

    rows = [(*r, len(r[1] or "") if r[0] else None, "clash", 5, [1]) for r in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _id string, size int, pos array<int>")
    before = docs
    for name, stage in P.STAGES:
        after = common.materialize(stage(spark, before, sf), f"odd-{name}")
        had = Counter((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect())
        if name == "tokens":
            out = after.collect()
            assert {d for r in out for d in r["doc_ids"]} == {d for d, _ in had}
            break
        assert after.columns == docs.columns
        has = Counter((r["doc_id"], r["text"]) for r in after.select("doc_id", "text").collect())
        if name == "quality":
            scored = Counter()
            for d, t in had.elements():
                scored[d, t] += 1
            assert all(has[k] in (0, n) for k, n in scored.items()) and not has - had  # equal rows share their fate
        elif name == "near_duplicates":
            rows_ = list(had.elements())
            least = {}
            for (d, n, c), k in brute_groups(rows_).items():
                least[d, n] = c
            words = {k: len(s) for k, (_, s) in zip(rows_, sets_of(rows_), strict=True)}
            for (d, t), n in had.items():
                if d is None or not words[d, t]:
                    assert has[d, t] == n
                elif least[d, words[d, t]] < d:
                    assert not has[d, t]
            assert all(n == 1 for (d, t), n in has.items() if d is not None and words[d, t])
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            hit = {(d, t) for d, t in had if next(iter(brute_windows([(d, t)], items)))[2]}
            assert has == Counter({k: n for k, n in had.items() if k not in hit})
        else:
            from cairn.llm import mixing

            want = Counter()
            for r in mixing.mix_totals(before).collect():
                want[r["doc_id"]] += r["taken"]
            got = Counter()
            for (d, t), n in has.items():
                got[d] += n * len(WORD.findall(t or ""))
                assert any(t in (x or "") for e, x in had if e == d)
            assert {k: v for k, v in want.items() if v} == dict(got)
        before = after


def test_pipeline_of_nothing(spark, no_docs, sf):
    import corpus_pipeline as P

    docs = no_docs
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
