"""Search by cells against search over all postings; segments, commits and counts of the stored catalogue."""

import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog, fts
from cairn.sources import commits
from cairn.sources import store as ST


def _docs(spark, n):
    """Word w of a row by a hash: some in most rows, some rare, some only in one stretch of ids; long and short rows."""
    h = F.xxhash64("id")
    words = [F.concat(F.lit("common "), F.repeat(F.lit("common "), F.pmod(h, F.lit(4)).cast("int"))), F.when(F.pmod(h, F.lit(7)) == 0, "seldom "), F.when(F.pmod(h, F.lit(97)) == 0, "rare rarely "), F.when(F.col("id").between(3000, 3100), "stretch "), F.when(F.pmod(h, F.lit(5)) == 1, F.repeat(F.lit("burst "), F.when(F.col("id").between(1000, 1200), 10).otherwise(1))), F.repeat(F.lit("filler words "), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)).cast("int"))]
    return spark.range(1, n + 1).select("id", F.concat_ws("", *words).alias("t"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('cells')}"
    before = fts.CELL_IDS
    fts.CELL_IDS = 64
    rows, columns = _docs(spark, 6000), {"t": F.col("t")}
    fts.write_index(rows.where("id <= 4000"), columns, folder)
    fts.append_index(rows.where("id > 4000"), columns, folder)
    yield fts.open_index(spark, folder)
    fts.CELL_IDS = before


SEARCHES = ["common", "rare", "rarel", "seldom rare", "stretch common", "common nothing", "comm fill", '"common" "rare"', "common common"]


@pytest.mark.parametrize("text", SEARCHES)
@pytest.mark.parametrize("most", [50, 100_000])
def test_rows_and_scores_are_those_of_all_postings(index, text, most):
    whole = replace(index, cells=None)
    for limit in (20,) if most == 50 else (400,):
        got, want = ([tuple(r) for r in fts.search(i, text, limit, most=most).collect()] for i in (index, whole))
        assert got == want


def test_a_broad_search_reads_few_cells(index):
    ranked, first = {}, {}
    assert fts.search(index, "burst", 10, most=100_000, report=ranked).count() == 10
    assert fts.search(index, "common", 10, most=100, report=first).count() == 10
    assert ranked["cells"] > 85 and ranked["read"] <= 2 * fts.FIRST_CELLS  # the best rows lie in a few of them
    assert first["cells"] == 94 and first["read"] == fts.FIRST_CELLS
    both = {}
    fts.search(index, "stretch common", 10, most=100_000, report=both).count()
    assert both["cells"] <= 3  # only where both words are


def _modules(spark, a, b, seed=0):
    rows = [(f"s{i:03d}", f"f{i}.mod", "mod" if i % 3 else "it", f"title w{i} all", f"root{i}") for i in range(a, b)]
    return spark.createDataFrame(rows, "source string, filename string, format string, title string, root_cid string")


def test_many_appends_leave_few_segments(spark, tmp_path):
    """Load after load: segments stay few, ids without gaps, meta as a full count says, every row found; old versions still readable, then swept."""
    folder = f"file://{tmp_path}/c"
    ST.write_catalog(_modules(spark, 0, 8).withColumn("id", F.substring("source", 2, 9).cast("long") + 1), folder)
    for k in range(1, 6):
        ST.append(_modules(spark, 8 * k - 2, 8 * k + 8), folder)  # two are known
    version, entry = commits.last(spark, folder)
    assert len(entry["segments"]) <= 4 and sum(s["rows"] for s in entry["segments"]) == 48
    rows = ST.read(spark, folder, "modules")
    assert sorted((r["id"], r["source"]) for r in rows.collect()) == sorted((i + 1, f"s{i:03d}") for i in range(48))
    assert {tuple(r) for r in ST.read(spark, folder, "meta").collect()} == {tuple(r) for r in catalog.meta_table(rows).collect()}
    index = fts.open_index(spark, folder)
    assert index.rows == 48 and [r["id"] for r in fts.search(index, "w37").collect()] == [38] and fts.search(index, "title", 100).count() == 48
    assert ST.read(spark, folder, "modules", version=1).count() == 8
    assert ST.vacuum(spark, folder, keep=1)
    assert ST.read(spark, folder, "modules").count() == 48 and commits.versions(spark, folder) == [version]


def test_an_append_counts_new_rows_only(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/c"
    ST.write_catalog(_modules(spark, 0, 40).withColumn("id", F.substring("source", 2, 9).cast("long") + 1), folder)
    seen = []
    whole = catalog.format_counts
    monkeypatch.setattr(catalog, "format_counts", lambda m: seen.append(m.count()) or whole(m))
    ST.append(_modules(spark, 40, 43), folder)
    assert seen == [3]
    assert ST.total_of(ST.read(spark, folder, "meta"), None) == 43


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    """At every table of a segment, and before the commit: readers see the old version, and the next append is whole."""
    folder = f"file://{tmp_path}/c"
    ST.write_catalog(_modules(spark, 0, 5).withColumn("id", F.substring("source", 2, 9).cast("long") + 1), folder)

    def dies(*_):
        raise RuntimeError("killed")

    for module, name in ((catalog, "format_counts"), (fts, "postings"), (fts, "cells_of"), (fts, "prefixes_of"), (commits, "commit")):
        with monkeypatch.context() as m:
            m.setattr(module, name, dies)
            with pytest.raises(RuntimeError, match="killed"):
                ST.append(_modules(spark, 5, 9), folder)
        assert ST.read(spark, folder, "modules").count() == 5 and fts.open_index(spark, folder).rows == 5
    ST.append(_modules(spark, 5, 9), folder)
    assert sorted(r["id"] for r in ST.read(spark, folder, "modules").collect()) == list(range(1, 10)) and fts.open_index(spark, folder).rows == 9
    ST.vacuum(spark, folder)
    assert ST.read(spark, folder, "modules").count() == 9


def test_one_winner_for_each_version(spark, tmp_path):
    """Many writers at once: every version has one, and all changes are there in the end."""
    folder, won = f"file://{tmp_path}/log-of", []

    def write(i):
        for k in range(5):
            commits.transact(spark, folder, lambda old: ({"all": [*old.get("all", []), f"{i}-{k}"]}, lambda: won.append("again")), tries=1000)  # noqa: B023

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    version, entry = commits.last(spark, folder)
    assert version == 30 and sorted(entry["all"]) == sorted(f"{i}-{k}" for i in range(6) for k in range(5))
    assert commits.claim(spark, f"{folder}/log/{version:010d}.json", "x") is False and commits.last(spark, folder)[1] == entry
    assert not [n for n in commits.names(spark, f"{folder}/log") if n.startswith(".")]


def test_two_appends_at_once_are_both_kept(spark, tmp_path, monkeypatch):
    """Another load is committed while the first one is at work: it starts again from there, with other ids."""
    folder = f"file://{tmp_path}/c"
    ST.write_catalog(_modules(spark, 0, 3).withColumn("id", F.substring("source", 2, 9).cast("long") + 1), folder)
    commit, other = commits.commit, []

    def late(*args):
        if not other:
            other.append(1)
            ST.append(_modules(spark, 3, 6), folder)
        return commit(*args)

    monkeypatch.setattr(commits, "commit", late)
    ST.append(_modules(spark, 4, 8), folder)
    rows = ST.read(spark, folder, "modules").collect()
    assert sorted(r["source"] for r in rows) == [f"s{i:03d}" for i in range(8)] and sorted(r["id"] for r in rows) == list(range(1, 9))


def test_two_publishers_get_two_versions(spark, tmp_path, monkeypatch):
    folder, root = f"file://{tmp_path}/c", f"file://{tmp_path}/r"
    ST.write_catalog(_modules(spark, 0, 3).withColumn("id", F.substring("source", 2, 9).cast("long") + 1), folder)
    commit, other = commits.commit, []

    def late(spark, where, version, new):
        if "names" in where and not other:
            other.append(1)
            other.append(ST.publish(spark, folder, root, "x").first()["version"])
        return commit(spark, where, version, new)

    monkeypatch.setattr(commits, "commit", late)
    assert (ST.publish(spark, folder, root, "x").first()["version"], other[1]) == (2, 1)
    assert sorted(r["version"] for r in ST.read_pointers(spark, root).collect()) == [1, 2]
    with pytest.raises(FileExistsError):
        ST.write_catalog(_modules(spark, 0, 3).withColumn("id", F.lit(1)), folder)


def test_a_ranked_query_is_ranked_however_many_rows_match(spark, duck, tmp_path):
    """Its SQL has no threshold: 600 equal texts of words are more than the threshold of 200 that so few rows have."""
    from cairn import catalog_queries as Q
    from tests.compare import same

    words = F.concat(F.lit("thnt inea que eau vi "), F.repeat(F.lit("more "), F.pmod("doc_id", F.lit(37)).cast("int")))
    d = spark.range(600).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    d.withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("search_bm25", "search_prefix_and"):
        rows = Q.QUERIES[name](spark, str(tmp_path))
        assert rows.where("score IS NULL").count() == 0
        same(rows, con, Q.SQL[name])
