"""Fingerprints against plain sets of shingles, and the edited texts against plain slices."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.llm import fingerprints as fp
from cairn.llm import queries
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edit(text, following):
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def test_whole_table(spark, sf, texts):
    got = queries.op12_fingerprints(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    by_text, errors = {}, []
    for r in got:
        own, following = texts[r["doc_id"]] or "", texts[after[r["doc_id"]]] or ""
        new = edit(own, following)
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert by_text.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        a, b, c = shingles(own), shingles(new), shingles(following)
        assert (r["shingles"] == len(a)) if len(a) < fp.SIZE else abs(r["shingles"] / len(a) - 1) < 0.5
        for name, want, exact in (("near_edited", alike(a, b), max(len(a), len(b)) < fp.SIZE), ("near_next", alike(a, c), max(len(a), len(c)) < fp.SIZE)):
            assert 0 <= r[name] <= 1
            assert not exact or abs(r[name] - want) < 1e-12
            errors.append(abs(r[name] - want))
        assert r["kept_share"] >= r["near_edited"]
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.03


def test_odd_rows(spark, odd_docs, odd_rows):
    """Nulls, repeats, ties of ids, no id: each row once, followed by the next in a fixed order."""
    got = fp.fingerprints(odd_docs.repartition(3)).collect()
    want = [(r[0], len(r[1] or "")) for r in odd_rows]
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=str) == sorted(want, key=str)
    again = fp.fingerprints(odd_docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    order = {r[0]: r[1] or "" for r in odd_rows if r[0] not in (9, None)}
    assert next(r for r in got if r["doc_id"] == 14)["edited_sha256"] == hashlib.sha256(edit(order[14], order[13]).encode()).hexdigest()
    # The first of two equal rows is followed by the second, the second by the next document.
    nine = next(r[1] for r in odd_rows if r[0] == 9)
    assert sorted(r["edited_sha256"] for r in got if r["doc_id"] == 9) == sorted(hashlib.sha256(edit(nine, x).encode()).hexdigest() for x in (nine, order[8]))
    last = next(r[1] for r in odd_rows if r[0] is None)
    assert [r["edited_sha256"] for r in got if r["doc_id"] is None] == [hashlib.sha256(edit(last, order[14]).encode()).hexdigest()]
    assert all(r["near_edited"] == 1.0 and r["fingerprint"] == "" for r in got if r["n_chars"] == 0)


def test_a_third_of_all_rows_equal(spark):
    rows = [(5, "a b c d e f g h i")] * 400 + [(i, prose(30, i)) for i in range(6, 800)]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 5").groupBy("edited_sha256", "near_next").count().collect()
    assert sorted((r["count"], r["near_next"]) for r in got) == [(1, 0.0), (399, 1.0)]


@pytest.mark.parametrize("rows", [[], [(1, "one two three four five six")], [(1, None)]])
def test_few_rows(spark, rows):
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert all(r["near_next"] == 1.0 for r in got)
    assert not rows or got[0]["edited_sha256"] == hashlib.sha256(edit(rows[0][1] or "", rows[0][1] or "").encode()).hexdigest()


def test_shuffle_path_equals_broadcast_path(spark, documents, monkeypatch):
    one = sorted(map(tuple, fp.fingerprints(documents).collect()))
    monkeypatch.setattr(fp, "join_side", lambda df, row_bytes: df)
    assert sorted(map(tuple, fp.fingerprints(documents).collect())) == one


def test_parts_merge_to_the_whole(spark):
    """Sketches of parts of a set, merged in pairs or by group, are the set's; estimates follow the sets."""
    r = random.Random(5)
    a = [r.getrandbits(64) - 2**63 for _ in range(3000)]
    b = a[1000:] + [r.getrandbits(64) - 2**63 for _ in range(1000)]
    df = spark.createDataFrame([(i % 7, g, x[i::7]) for i in range(7) for g, x in (("a", a), ("b", b))] + [(9, "none", [])], "part int, g string, h array<long>").withColumn("s", fp.bottom(F.col("h")))
    got = {r["g"]: r["s"] for r in fp.merge_groups(df, ["g"], "s").collect()}
    assert got == {"a": sorted(a)[:128], "b": sorted(b)[:128], "none": []}
    one = spark.createDataFrame([(got["a"], got["b"], [])], "a array<long>, b array<long>, c array<long>")
    near, inside, merged, count, none, all_ = one.select(fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b")), fp.merged(F.col("a"), F.col("b")), fp.distinct_shingles(F.col("a")), fp.resemblance(F.col("a"), F.col("c")), fp.containment(F.col("c"), F.col("a"))).first()
    assert abs(near - 0.5) < 0.15 and abs(inside - 2 / 3) < 0.15 and merged == sorted({*a, *b})[:128] and none == 0.0 and all_ == 1.0
    assert abs(count / 3000 - 1) < 0.3


def test_no_python(spark, documents):
    plan = fp.fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
