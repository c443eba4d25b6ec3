"""Line dedup and mixing against SQL and by hand."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import line_dedup as L
from cairn.llm import mixing as M
from cairn.llm.queries import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", ["op2_decontaminate", "op6_line_dedup", "op9_mixing"])
def test_sql(name, spark, sf, duck):
    same(QUERIES[name](spark, sf), duck, SQL[name])


def brute_lines(rows, least):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                docs[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(docs[key(x)]) < least or not key(x)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines_by_hand(spark, odd_rows):
    rows = [(d, t) for d, t, _ in odd_rows] + [(100 + i, f" Same LINE \nown {i}\n\nsame line\r") for i in range(12)] + [(200, "same line\n")]
    for broadcast in (None, 0):
        bits = L.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), 10, 1, broadcast)
        assert {(r["doc_id"], tuple((x["first"], x["last"]) for x in r["drops"])) for r in bits.collect()} == {*((100 + i, ((0, 0), (3, 3))) for i in range(12)), (200, ((0, 0),))}
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(rows, 10)


def test_lines_odd(odd_docs, no_docs, odd_rows):
    got = L.dedup_lines(odd_docs, 2)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines([(d, t) for d, t, _ in odd_rows], 2)
    assert L.dedup_lines(no_docs).count() == 0


def test_water_fill():
    assert M.water_fill([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    assert M.water_fill([1, 100, 100], [5, 2, 1]) == [3.0, 132.0, 66.0]
    assert M.water_fill([0, 4], [5, 2]) == [0.0, 4.0] and M.water_fill([], []) == []


def test_tree_is_exact():
    quotas = [1000, 0, 37, 5]
    tree = list(M.splitting_tree(quotas, 13))
    by_source, by_shard = Counter(), Counter()
    for shard, i, n in tree:
        by_source[i] += n
        by_shard[shard] += n
    assert [by_source[i] for i in range(4)] == quotas
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 13 and tree == list(M.splitting_tree(quotas, 13))


def test_tree_of_many_sources():
    import time

    began = time.time()
    cells = list(M.splitting_tree([50] * 100_000, M.MAX_CELLS // 100_000))
    assert sum(n for _, _, n in cells) == 5_000_000 and time.time() - began < 60


def test_what_the_tree_deals_is_taken(spark, monkeypatch):
    """Without one shard of the tree, its words are missing."""
    options = {"block_words": 16, "shards": 4}
    whole = sum(r["taken"] for r in M.mix_totals(_sources(spark), **options).collect())
    tree = M.splitting_tree
    monkeypatch.setattr(M, "splitting_tree", lambda *a: ((shard, i, n) for shard, i, n in tree(*a) if shard != 2))
    less = sum(r["taken"] for r in M.mix_totals(_sources(spark), **options).collect())
    assert 0.6 * whole < less < 0.9 * whole


def test_drawn_blocks():
    """The blocks drawn add up to the rest, wherever the stream's short block falls."""
    for size in (1, 15, 16, 17, 100, 161):
        blocks = -(-size // 16)
        for rest in range(size):
            count, last = M.drawn_blocks(size, rest, 16, "x")
            at = {M.permuted_number(b, blocks, "x"): min(16, size - 16 * b) for b in range(blocks)}
            assert sorted(at) == list(range(blocks))
            assert sum(at[p] for p in range(count - 1)) + last == rest and (not rest or 0 < last <= at[count - 1])


def test_mix(odd_docs, no_docs, odd_rows):
    rows = M.mix_totals(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    again = M.mix_totals(odd_docs.repartition(7)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    source = {d: s for d, _, s in odd_rows}
    for s in {*source.values()}:
        mine = [r for r in rows if source.get(r["doc_id"]) == s]
        if mine:
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
    assert M.mix_totals(no_docs).count() == 0 and M.mix_documents(no_docs).count() == 0


def test_mixed_texts(odd_docs, odd_rows):
    out = M.mix_documents(odd_docs)
    assert out.columns == odd_docs.columns
    want = Counter()
    for r in M.mix_totals(odd_docs).collect():
        want[r["doc_id"]] += r["taken"]
    got, whole = Counter(), {}
    for d, t, _ in odd_rows:
        whole.setdefault(d, []).append(t or "")
    for r in out.select("doc_id", "text", "n_chars", M.word_count(F.col("text")).alias("w")).collect():
        got[r["doc_id"]] += r["w"]
        assert any(r["text"] in t for t in whole[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_slices_are_disjoint(odd_docs):
    plan = M.mix_plan(odd_docs, block_words=64, shards=5).where("taken > 0").collect()
    assert {r["shard"] for r in plan} <= set(range(5)) and None not in {r["shard"] for r in plan}
    seen = defaultdict(list)
    for r in plan:
        seen[r["doc_id"], r["text_hash"], r["epoch"]].append((r["start"], r["stop"]))
    for (doc, _, _), spans in seen.items():
        if doc != 9:  # two equal rows share their places there
            spans.sort()
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    seen.clear()
    for r in plan:
        seen[r["source"], r["epoch"]].append((r["at"] + r["start"], r["at"] + r["stop"]))
    for spans in seen.values():  # nor do documents share words of their source's stream
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def _sources(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20 + i % 30)), "abc"[i % 3]) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), M._salt(7, "draw", F.lit(None).cast("string")))).orderBy("id").collect()]
        assert sorted(got) == list(range(n)) and got[-1] == M.permuted_number(n - 1, n, "7|draw|") and (n < 1000 or sum(abs(a - i) for i, a in enumerate(got)) > 200 * n)


def test_every_shard_draws_from_all_epochs(spark):
    plan = M.mix_plan(_sources(spark), block_words=16, shards=4).where("taken > 0").collect()
    source = max({r["source"] for r in plan}, key=lambda s: max(r["epoch"] for r in plan if r["source"] == s))
    epochs = defaultdict(set)
    for r in plan:
        if r["source"] == source:
            epochs[r["shard"]].add(r["epoch"])
    assert set(epochs) == set(range(4)) and all(e == {0, 1} for e in epochs.values())


def _shards(docs, **options):
    """The words that the plan deals to each shard, in order: slices of one document and epoch that go on where the last ended are one row, at the place of the first."""
    rows = sorted((tuple(r) for r in M.mix_plan(docs, **options).where("taken > 0").select("shard", "doc_id", "epoch", "start", "stop", "place").collect()))
    out = defaultdict(list)
    for shard, doc, epoch, start, stop, place in rows:
        last = out[shard][-1] if out[shard] else None
        if last and last[1:3] == [doc, epoch] and last[4] == start:
            last[4] = stop
        else:
            out[shard].append([place, doc, epoch, start, stop])
    return {shard: [(d, a, b) for _, d, _, a, b in sorted(v)] for shard, v in out.items()}


@pytest.mark.parametrize("options", [{"block_words": 16, "shards": 4}, {"block_words": 7, "shards": 3}, {"block_words": 64, "shards": 2}])
def test_shards_hold_the_words_of_their_blocks(spark, options):
    """By shard and place, every row is the words of a dealt stretch, also of documents of many blocks in a part epoch."""
    docs = _sources(spark)
    words = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    left = {shard: [(d, words[d][a:b]) for d, a, b in v] for shard, v in _shards(docs, **options).items()}
    tails = sum(a > 0 for v in _shards(docs, **options).values() for _, a, _ in v)
    assert tails > 20  # not the first words only
    parts = defaultdict(list)
    for r in M.mix_documents(docs, **options).withColumn("p", F.spark_partition_id()).collect():
        parts[r["p"]].append((r["doc_id"], r["text"].split()))
    for p in parts.values():
        while p:  # a partition is whole shards, one after another
            shard = next(s for s, v in left.items() if p[: len(v)] == v)
            p[:] = p[len(left.pop(shard)) :]
    assert not left


def test_stretches_keep_blanks_and_add_up(spark):
    """The stretches of one epoch, put together, are the text again, blanks at both ends included."""
    text = "  " + " \t".join(f"w{i}" for i in range(100)) + " \n"
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    rows = [r["text"] for r in M.mix_documents(docs, block_words=10, shards=5, weights=(1,)).collect()]
    assert len(rows) > 3 and sum(map(len, rows)) == len(text) and sorted(w for t in rows for w in t.split()) == sorted(text.split()) and any(t.endswith(" \n") for t in rows)


def test_hash_of_kept(spark, sf, texts):
    row = next(r for r in QUERIES["op6_line_dedup"](spark, sf).collect() if r["n_dropped"] == 0)
    assert row["kept_sha256"] == hashlib.sha256((texts[row["doc_id"]] or "").encode()).hexdigest()
