"""Classifier, decontamination, secrets, media and packing."""

import hashlib
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import decontaminate as D
from cairn.llm import media as ME
from cairn.llm import packing as P
from cairn.llm import quality as Q
from cairn.llm import secrets as S
from cairn.llm.queries import QUERIES


# Quality.


def test_quality_on_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op1_quality"](spark, sf).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, None), (None, 0), (7, 1), (12, 0), (13, 0), (99, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    rows = Q.score_quality(odd_docs, labels).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1 and len({r["score"] for r in rows if r["doc_id"] == 9}) == 1
    assert Q.score_quality(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in Q.score_quality(odd_docs, none).collect()} == {0.5}
    assert Q.reject_low_quality(odd_docs, none).columns == odd_docs.columns


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Rows are taken in one order until their slots have so many bytes."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda rows, y: seen.append([r.tolist() for r in rows]))
    for limit in (1 << 30, 20_000, 20_000, 1):
        Q.fit_quality(docs, labels, train_bytes=limit)
    assert 30 < len(seen[0]) < 50  # a third is held out
    assert 1 < len(seen[1]) < len(seen[0]) and seen[1] == seen[2] == seen[0][: len(seen[1])] and seen[3] == seen[0][:1]
    assert 4 * sum(map(len, seen[1][:-1])) < 20_000 <= 4 * sum(map(len, seen[1]))


def test_quality_sample_comes_in_pieces(spark, monkeypatch):
    """The order of the rows doesn't hang on the pieces in which the driver gets them, and empty texts are among them."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(i % 7 * 20))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda rows, y: seen.append([(r.tolist(), v) for r, v in zip(rows, y, strict=True)]))
    for piece in (1 << 30, 2500, 15_000):
        monkeypatch.setattr(Q, "PIECE_BYTES", piece)
        Q.fit_quality(docs, labels)
    assert 30 < len(seen[0]) < 50 and seen[0] == seen[1] == seen[2] and not all(r for r, _ in seen[0])


def test_dual_descent_keeps_no_second_copy():
    """What a descent holds beside the slots grows by rows, not by slots."""
    import tracemalloc

    r = np.random.default_rng(4)
    rows = [np.sort(r.choice(1 << Q.BITS, 1000, replace=False)).astype("<i4") for _ in range(1200)]
    labels = r.integers(0, 2, len(rows)).astype(float)
    ratio = Q.log_ratios(rows, labels)
    tracemalloc.start()
    Q.dual_descent(rows, labels, ratio, sweeps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * (1 << Q.BITS) + sum(x.nbytes for x in rows) / 2


def test_dual_descent_separates():
    rows = [np.asarray([i % 2, 2 + i % 7]) for i in range(200)]
    labels = np.asarray([float(i % 2) for i in range(200)])
    model = Q.fit(rows, labels)
    got = [model.scores(r, np.asarray([0, len(r)]))[0] > 0.5 for r in rows]
    assert got == [bool(y) for y in labels]
    ratio = Q.log_ratios(rows, labels)
    assert ratio[1] > 1 > -1 > ratio[0]


def test_dual_descent_reaches_the_optimum():
    """The primal objective against that of a plain projected gradient on the dual."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(80)]
    labels = np.asarray([float((r % 3 == 0).sum() > 2) for r in rows])
    labels[:6] = 1 - labels[:6]  # not separable
    ratio = Q.log_ratios(rows, labels)
    x = np.zeros((80, 41))
    for i, r in enumerate(rows):
        x[i, r], x[i, 40] = ratio[r] / max(1.0, float(np.linalg.norm(ratio[r]))), 1.0
    y = np.where(labels > 0, 1.0, -1.0)
    loss = lambda w: 0.5 * float(w @ w) + Q.COST * float(np.maximum(0, 1 - y * (x @ w)).sum())
    gram, dual = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(80)
    for _ in range(40000):
        dual = np.clip(dual + (1 - gram @ dual) / np.linalg.norm(gram, 2), 0, Q.COST)
    w, bias = Q.dual_descent(rows, labels, ratio, sweeps=500)
    assert loss(np.append(w[:40], bias)) <= 1.01 * loss((dual * y) @ x) + 1e-9


# Decontamination.


def brute_windows(docs, items):
    words = [(i, D.words_in(t)) for i, t in items]
    wins = defaultdict(set)
    for i, w in words:
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[k : k + m])].add(i)
    lengths = {len(w) for w in wins}
    out = Counter()
    for doc, text in docs:
        w = D.words_in(text)
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (key := tuple(w[k : k + m])) in wins:
                    hit |= set(range(k, k + m))
                    found |= {str(x) for x in wins[key] if x is not None}
        out[doc, len(w), len(hit), len(found), ",".join(sorted(found))] += 1
    return out


def test_windows_by_hand(spark, odd_docs, odd_rows, no_docs):
    long = odd_rows[0][1]
    words = long.split()
    items = [(1, " ".join(words[20:45])), (2, "ONE two"), (3, None), (None, " ".join(words[60:75])), (4, "..."), (10, "x" * 3000), (11, " ".join(words[30:33])), (11, "ab ab ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows([(d, t) for d, t, _ in odd_rows], items)
    for limit in (D.BLOCK_WINDOWS, 12):  # one block broadcast, or several from the shared folder
        rows = D.find_contamination(odd_docs, bench, block_windows=limit).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in rows) == want
        assert all(r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in rows)
    clean = D.decontaminate(odd_docs, bench)
    assert clean.columns == odd_docs.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    assert D.find_contamination(no_docs, bench).count() == 0
    assert {r["n_hit"] for r in D.find_contamination(odd_docs, bench.limit(0)).collect()} == {0}


@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=14), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_windows_random(text, items):
    text, items = " ".join(text), [(i, " ".join(x)) for i, x in enumerate(items)]
    n, spans, found, _ = D.Windows(items).search([text.encode()])
    want = next(iter(brute_windows([(0, text)], items)))
    assert (n[0], D.covered(spans[0]), len(found[0])) == want[1:4]


# Secrets.


def test_base_patterns():
    text = 'x token = "abcDEF12" PASSWORD:short secret=12345678 api-key=x apikey: \'k_.=-/+A\' AKIA1234567890ABCD AKIA12 ' + "0" * 31 + "g" + "f" * 32
    points = S.code_points(text)
    spans = S.base_findings(text, points)
    assert [(S.KINDS[k], text[a:b]) for a, k, b in spans] == [
        ("assign", 'token = "abcDEF12'), ("assign", "secret=12345678"), ("assign", "apikey: 'k_.=-/+A"), ("access", "AKIA1234567890ABCD"), ("hex", "f" * 32),
    ]
    assert S.base_findings("ſecret=12345678 toKen=12345678", S.code_points("x")) == []


def test_network_keeps_recall():
    """Over whole texts, the choice of candidates included, on findings that were never seen."""
    net = S.train()
    found, wrong = [], []
    for text, a, b, label in S.labelled_findings(1500, 77):
        spans = S.scan_text(text, net)
        if label:
            found.append(any(s < b and e > a for s, _, e in spans))
        else:
            wrong.append(any(k == 3 for _, k, _ in spans))
    assert np.mean(found) >= 0.95 and np.mean(wrong) < 0.01


def test_keys_of_letters_alone():
    import random
    import string

    r, net = random.Random(3), S.train()
    for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase):
        texts = [f"some words {''.join(r.choices(letters, k=32))} and more" for _ in range(100)]
        assert np.mean([any(k == 3 for _, k, _ in spans) for spans in S.scan_texts(texts, net)]) >= 0.9


def test_base_patterns_over_the_table(spark, sf):
    """Against plain searches of whole texts."""
    import re

    sf = sf.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    kinds = {
        "assign": (re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    }
    order, seen = list(kinds), 0
    for r in QUERIES["op3_secrets"](spark, sf).collect():
        want = sorted((m.start(), order.index(k), m.end()) for k, (pattern, holds) in kinds.items() for m in pattern.finditer(texts[r["doc_id"]] or "") if holds(m))
        seen += len(want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{order[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
    assert seen


def test_secret_query(spark, sf, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in S.find_secrets(odd_docs).collect()}
    assert (rows[14]["n_assign"], rows[14]["n_access"], rows[14]["n_hex"]) == (1, 1, 1) and rows[4]["spans"] == ""
    assert S.find_secrets(no_docs).count() == 0
    for r in QUERIES["op3_secrets"](spark, sf).collect():
        base = [x for x in r["spans"].split(",") if x and not x.startswith("model")]
        assert len(base) == r["n_assign"] + r["n_access"] + r["n_hex"] and r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    key = "ghp_" + "a1B2c3D4" * 5
    assert any(k == 3 for _, k, _ in S.scan_text(f"é deploy with {key} now", S.train()))


def test_every_long_run_is_scored():
    key = "QzWxKvBnRtYpLmHgFdSjCkVbTrEwQaZx"
    net = S.Network(**{**vars(S.train()), "threshold": 0.0})
    text = f"use {key} or sk_live_{'0123456789abcdef' * 2} now, token={'a' * 20}"
    found = [(S.KINDS[k], text[a:b]) for a, k, b in S.scan_text(text, net)]
    assert ("model", key) in found and ("model", "sk_live_" + "0123456789abcdef" * 2) in found
    assert ("assign", "token=" + "a" * 20) in found and ("model", "token=" + "a" * 20) not in found


@pytest.mark.parametrize("count", [1, 3, 4, 5, 40])
def test_a_run_that_a_pattern_holds_whole_is_not_scored(count):
    """However many findings lie inside it."""
    net = S.Network(**{**vars(S.train()), "threshold": 0.0})
    text = "token=" + "-".join(["0123456789abcdef" * 2] * count) + " and " + "QzWxKvBnRtYpLmHg"
    kinds = [k for _, k, _ in S.scan_text(text, net)]
    assert kinds.count(0) == 1 and kinds.count(2) == count and kinds.count(3) == 1



# Media.


@given(st.text(max_size=700))
@settings(max_examples=30, deadline=None)
def test_image_round_trip(text):
    text = text.encode("utf-8", "replace").decode()
    payload, n = ME.payload_of(text)
    assert n == len(text.encode()) and len(payload) % 576 == 0 and payload[:n] == text.encode() and set(payload[n:]) <= {255}
    media = ME.encode_png(payload)
    assert ME.decode_png(media) == payload and ME.png_header(media[:29]) == (576, len(payload) // 576, 8)
    assert ME.feature_of(payload)


def brute_feature(payload):
    """Mean, deviation, histogram and grid of the samples, sample by sample."""
    n, total = len(payload), sum(payload)
    square = sum(x * x for x in payload)
    deviation = int((square * n - total * total) ** 0.5 * 1000 / n)
    shares = [sum(x // 16 == k for x in payload) * 1000 // n for k in range(16)]
    height, bits = n // 576, ""
    for gy in range(8):
        low, high = gy * height // 8, (gy + 1) * height // 8
        for gx in range(8):
            cell = [payload[y * 576 + x] for y in range(low, max(low + 1, high)) for x in range(gx * 72, gx * 72 + 72)]
            bits += "1" if sum(cell) * n > total * len(cell) else "0"
    return f"{total * 1000 // n}:{deviation}:{','.join(map(str, shares))}:{int(bits, 2):016x}"


@pytest.mark.parametrize("n", [1, 576, 577, 5000, 9 * 576])
def test_feature(n):
    payload = ME.payload_of("".join(chr(32 + i * i % 90) for i in range(n)))[0]
    assert ME.feature_of(payload) == brute_feature(payload)


def test_media(spark, odd_docs, odd_rows, no_docs, tmp_path):
    folder = f"file://{tmp_path}/media"
    docs = spark.createDataFrame(odd_docs.rdd.coalesce(3), odd_docs.schema)
    index, places = ME.write_media(docs, folder, shard_bytes=4096)
    stored = []
    for path in sorted((tmp_path / "media").glob("*.tar")):
        with tarfile.open(path) as tar:
            stored += [m.name for m in tar.getmembers()]
    rows = ME.read_features(ME.read_headers(ME.dealt_reads(places, 2048))).collect()
    for r in rows:
        with tarfile.open(r["shard"].removeprefix("file://")) as tar:
            member = tar.getmember(f"{r['digest']}.png")
            assert (member.offset_data, member.size) == (r["offset"], r["length"])
        assert r["digest"] == r["payload_sha256"] and r["width"] * r["height"] == r["payload_bytes"]
    payloads = {hashlib.sha256(p).hexdigest(): p for p in (ME.payload_of(t)[0] for _, t, _ in odd_rows)}
    assert sorted(stored) == sorted(f"{d}.png" for d in payloads) and len(rows) == len(payloads)  # a payload is stored once over all tasks
    assert all(r["feature"] == brute_feature(payloads[r["digest"]]) for r in rows)
    out = ME.media_columns(odd_docs, shard_bytes=4096).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["digest"]) for r in out)
    want = Counter((d, len((t or "").encode()), hashlib.sha256(ME.payload_of(t)[0]).hexdigest(), zlib.crc32(ME.payload_of(t)[0][-32:]), hashlib.sha256(ME.payload_of(t)[0]).hexdigest()) for d, t, _ in odd_rows)
    assert got == want
    assert len({(r["digest"], r["shard"], r["offset"]) for r in out}) == len(payloads)
    assert ME.media_columns(no_docs).count() == 0


# Packing.


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit(lengths):
    rows = P.best_fit_decreasing(lengths, 50)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths))) and all(sum(lengths[i] for i in r) <= 50 for r in rows)
    free, want = [], 0
    for n in sorted(lengths, reverse=True):  # the rule by brute force
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            want += 1
            free.append(50 - n)
    assert len(rows) == want


def test_pieces_of_one_hash(monkeypatch):
    """Where pieces that differ have one hash, ids still decode to the text."""
    tok = P.Tokenizer(P.VOCABULARY)
    texts = [b"some words and some more words", "ÀÉ 東京 words".encode(), b"", b"word"]
    plain = [x.tolist() for x in tok.ids(texts)]
    assert [x.tolist() for x in tok.ids(texts)] == plain and [tok.encoding.decode_bytes(x) for x in plain] == texts
    monkeypatch.setattr(P, "span_hashes", lambda prefix, a, b: (b - a).astype(np.uint64) * 0)
    monkeypatch.setattr(P, "mixed", lambda x: x % np.uint64(3))
    tok.forget()
    for _ in range(2):
        assert [tok.encoding.decode_bytes(x.tolist()) for x in tok.ids(texts)] == texts


def test_packed_files(spark, odd_docs, odd_rows, no_docs, tmp_path):
    import base64

    import tiktoken

    rows = P.pack_tokens(odd_docs.repartition(2), f"file://{tmp_path}/tokens", row=64, window_rows=8).collect()
    with open(P.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    back = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    pieces, empty = defaultdict(list), []
    for r in rows:
        if r["empty"]:
            empty += r["doc_ids"]
            continue
        ids, cu, resets = P.read_packed(r["file"])
        at = 0
        assert cu[0] == 0 and len(cu) == len(resets) + 1 and r["row"] * 64 in resets and ids.dtype == np.uint16
        for doc, piece, n in zip(r["doc_ids"], r["pieces"], r["lengths"], strict=True):
            pieces[doc].append((piece, ids[r["row"], at : at + n].tolist()))
            at += n
        assert at == r["n_tokens"] and hashlib.sha256(ids[r["row"], :at].astype("<u2").tobytes()).hexdigest() == r["ids_sha256"]
    assert sorted(empty) == [4, 5]
    for d, t, _ in odd_rows:
        if t and d not in (9, None):
            assert back.decode_bytes([i for _, x in sorted(pieces[d]) for i in x]).decode() == t
    assert P.pack_tokens(no_docs).count() == 0


def test_chunks_cover():
    from cairn.llm.common import text_chunks

    texts = pa.array(["a" * 10, None, "", "b" * 100, "é", None])
    parts = list(text_chunks(texts, 16))
    assert [x for _, raws in parts for x in raws] == [b"a" * 10, b"", b"", b"b" * 100, "é".encode(), b""]
    assert list(text_chunks(pa.array([], pa.string()))) == [] and F is not None
    with pytest.raises(ValueError):
        ME.png_header(b"x" * 29)
