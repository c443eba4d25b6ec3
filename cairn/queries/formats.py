"""Module readers, archives, pattern events, seek tables and manifests over the driver's tables.

Modules are built by rule from rows of `part`; the SQL beside each query has the places from the formats' layouts.
"""

from __future__ import annotations

import io
import struct
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import modules as B
from ..operators import blocks as K
from ..operators import manifest as MF
from ..operators import seek
from ..registry import query, table
from ..sources import archives, folders
from ..sources import modules as M
from ..sources import store
from .blocks import CHUNKED, _chunks, _files


def _built(spark, sf_dir, make):
    """source (the part's key) and bytes of a module for each part; make takes key and size.

    Parts are a few bytes each and modules thousands: a file that is one task's share to read is dealt to all tasks before they are built.
    """

    def run(batches):
        for batch in batches:
            made = [make(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["source", "bytes"])

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("source"), F.col("p_size").cast("long"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(tasks).mapInArrow(run, "source long, bytes binary")


def _mod(key: int, size: int) -> bytes:
    return B.build_mod(f"part {key}", [(2 * (size % 50 + 2), key), (0, 0), (100 + key % 10 * 2, size)])


def _it(key: int, size: int) -> bytes:
    return B.build_it(f"part {key}", [(size + 1, key), (0, 0), (key % 100 + 5, size)])


def _s3m(key: int, size: int) -> bytes:
    return B.build_s3m(f"part {key}", [(size + 1, key, 0), (key % 20 + 3, size, 4), (size % 9 + 2, key, 6)])


def _xm(key: int, size: int) -> bytes:
    return B.build_xm(f"part {key}", [[(size + 2, key, False)], [], [(key % 30 + 1, size, True), (size % 7 + 1, key, False)]])


PART = "WITH p AS (SELECT p_partkey::BIGINT AS source, p_size::BIGINT AS n FROM part) "
SLOTS = {
    "mod": "SELECT source, 1 AS slot, 2108 AS \"offset\", 2 * (n % 50 + 2) AS length, 8 AS bits, 1 AS channels FROM p UNION ALL SELECT source, 3, 2108 + 2 * (n % 50 + 2), 100 + source % 10 * 2, 8, 1 FROM p",
    "it": "SELECT source, 1 AS slot, 446 AS \"offset\", n + 1 AS length, 8 AS bits, 1 AS channels FROM p UNION ALL SELECT source, 3, 446 + n + 1, source % 100 + 5, 8, 1 FROM p",
    "s3m": """SELECT source, 1 AS slot, 352 AS "offset", n + 1 AS length, 8 AS bits, 1 AS channels FROM p UNION ALL SELECT source, 2, 352 + (n + 16) // 16 * 16, 2 * (source % 20 + 3), 16, 1 FROM p
UNION ALL SELECT source, 3, 352 + (n + 16) // 16 * 16 + (2 * (source % 20 + 3) + 15) // 16 * 16, 4 * (n % 9 + 2), 16, 2 FROM p""",
    "xm": """SELECT source, 1 AS slot, 639 AS "offset", n + 2 AS length, 8 AS bits, 1 AS channels FROM p UNION ALL SELECT source, 2, 639 + n + 2 + 33 + 343, source % 30 + 1, 16, 1 FROM p
UNION ALL SELECT source, 3, 639 + n + 2 + 33 + 343 + source % 30 + 1, n % 7 + 1, 8, 1 FROM p""",
}
MAKERS = {"mod": _mod, "it": _it, "s3m": _s3m, "xm": _xm}


def _slots(spark, sf_dir, fmt):
    return M.slots(_built(spark, sf_dir, MAKERS[fmt])).select("source", "slot", "offset", "length", "bits", "channels")


@query(PART + SLOTS["mod"])
def mod_slots(spark, sf_dir):
    return _slots(spark, sf_dir, "mod")


@query(PART + SLOTS["it"])
def it_slots(spark, sf_dir):
    return _slots(spark, sf_dir, "it")


@query(PART + SLOTS["s3m"])
def s3m_slots(spark, sf_dir):
    return _slots(spark, sf_dir, "s3m")


@query(PART + SLOTS["xm"])
def xm_slots(spark, sf_dir):
    return _slots(spark, sf_dir, "xm")


@query(PART + " UNION ALL ".join(f'SELECT source, \'{f}\' AS format, "offset", length FROM ({sql})' for f, sql in SLOTS.items()))
def sample_regions(spark, sf_dir):
    """Raw sample regions of every format."""
    out = None
    for f, make in MAKERS.items():
        part = M.regions(_built(spark, sf_dir, make)).select("source", F.lit(f).alias("format"), "offset", "length")
        out = part if out is None else out.unionByName(part)
    return out


@query(PART + " UNION ALL ".join(f"SELECT source, '{f}' AS format, 'part ' || source AS title, {n} AS num_samples FROM p" for f, n in (("mod", 2), ("it", 2), ("s3m", 3), ("xm", 3))))
def scan_metadata(spark, sf_dir):
    out = None
    for make in MAKERS.values():
        part = M.metadata(_built(spark, sf_dir, make))
        out = part if out is None else out.unionByName(part)
    return out


@query(PART + "SELECT source, 2 AS orders, 0 AS instruments, 3 AS samples, 0 AS patterns, 0 AS compressed, 0 AS wide, n + 1 + source % 100 + 5 AS data_bytes, 446 + n + 1 + source % 100 + 5 AS size, round(100.0 * (n + 1 + source % 100 + 5) / (446 + n + 1 + source % 100 + 5), 1) AS percent FROM p")
def it_report(spark, sf_dir):
    """Header counts and the share of sample data."""
    return M.it_reports(_built(spark, sf_dir, _it))


def _packed(key: int, size: int) -> bytes:
    frames, bits = (size + 1) * 2000, 16 if key % 2 else 8
    blocks = -(-frames // (0x4000 if bits == 16 else 0x8000))
    raw = struct.pack("<IB", frames, bits) + B.pack_it(frames, bits, [10 + i for i in range(blocks)])
    return raw[:-1] if key % 5 == 0 else raw


@query(PART + ", b AS (SELECT source, ((n + 1) * 2000 + CASE WHEN source % 2 = 1 THEN 16384 ELSE 32768 END - 1) // CASE WHEN source % 2 = 1 THEN 16384 ELSE 32768 END AS k FROM p) SELECT source, CASE WHEN source % 5 = 0 THEN -1 ELSE 12 * k + k * (k - 1) // 2 END AS packed FROM b")
def packed_spans(spark, sf_dir):
    """Compressed samples by their chain of blocks; every fifth runs out of the file."""
    return M.packed_spans(_built(spark, sf_dir, _packed))


def _pattern(key: int, size: int) -> bytes:
    rows, out = size % 8 + 1, b""
    for r in range(rows):
        # The first row names mask, note and instrument; later ones repeat the mask, every third with a new note.
        out += bytes([0x81, 3, 40 + key % 60, 1 + key % 9]) if r == 0 else bytes([0x81, 1, 41 + r]) if r % 3 == 0 else bytes([0x81, 0x30])
        out += b"\0"
    return struct.pack("<HHI", len(out), rows, 0) + out


@query(PART + """, r AS (SELECT source, n, unnest(range(n % 8 + 1)) AS "row" FROM p)
SELECT source, "row", 0 AS channel, CASE WHEN "row" < 3 THEN 40 + source % 60 ELSE 41 + "row" // 3 * 3 END AS note, CASE WHEN "row" = 0 OR "row" % 3 <> 0 THEN 1 + source % 9 END AS instrument FROM r""")
def it_pattern_events(spark, sf_dir):
    """Packed rows with the memory of masks, notes and instruments."""
    schema = "row int, channel int, note int, instrument int, command int, value int"
    found = M._exploded(_built(spark, sf_dir, _pattern), "source", "bytes", schema, lambda b: B.it_pattern(b, 0)[1])
    return found.select("source", "row", "channel", "note", "instrument")


def _song(key: int, size: int) -> bytes:
    data = bytearray(_mod(key, size))
    at = 1084 + (size % 64 * 4 + key % 4) * 4
    data[at : at + 4] = bytes([0x01, 0xAC, 0x1F, 3 + key % 4 if key % 2 else 125 + key % 9])
    return bytes(data)


@query(PART + """SELECT source, 0 AS place, 0 AS "order", 64 AS rows, 6 AS speed0, 125 AS tempo0, n % 64 AS "row", source % 4 AS channel, 0 AS sample, true AS note, false AS off, CASE WHEN source % 2 = 1 THEN 3 + source % 4 END AS speed, CASE WHEN source % 2 = 0 THEN 125 + source % 9 END AS tempo FROM p""")
def mod_events(spark, sf_dir):
    """What the played order does: a note, its sample, and a change of speed or tempo."""
    return M.events(_built(spark, sf_dir, _song)).drop("seq")


@query(PART + "SELECT source, 2208 + 2 * (n % 50 + 2) + source % 10 * 2 AS length, 2108 AS kept, true AS zero FROM p")
def blank_samples(spark, sf_dir):
    """Modules with their samples zeroed: the head stays, the rest is zeros."""

    def blank(raw: bytes):
        out = B.blank_samples(raw, B.sample_slots(raw))
        head = min(2108, len(raw), len(out))
        # The first place from 2108 on, or a differing one before; 0 where there is none.
        same = next((i for i in range(head) if raw[i] != out[i]), 0) if raw[:head] != out[:head] else head if min(len(raw), len(out)) > 2108 else 0
        return [(len(out), same, not any(out[2108:]))]

    return M._exploded(_built(spark, sf_dir, _mod), "source", "bytes", "length long, kept long, zero boolean", blank)


# Archives in a folder.


def _write_archives(spark, sf_dir, folder):
    """Outer archives of 20 modules each, a hidden one beside them."""

    def pack(pdf):
        import pandas as pd

        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        group, outer = int(pdf["g"].iloc[0]), io.BytesIO()
        with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as y:
                    for name, body in ((f"m{doc}.mod", text), (f"m{doc}.mod.INFO", "about"), ("dir/", ""), ("page.html", f"{doc}")):
                        y.writestr(zipfile.ZipInfo(name), body)
                z.writestr(zipfile.ZipInfo(f"m{doc}.{'mod' if doc % 3 else 'xm'}.zip"), inner.getvalue())
            z.writestr(zipfile.ZipInfo("torn.mod.zip"), b"PK torn")
        for name in [f"g{group}.ZIP"] + [".hidden.zip"] * (group == 0):
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(outer.getvalue())
        return pd.DataFrame({"g": [group]})

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 20).alias("g"))
    d.groupBy("g").applyInPandas(pack, "g long").count()


def _archives(spark, sf_dir):
    return store.stored_once(spark, (sf_dir,), "archives", lambda folder: _write_archives(spark, sf_dir, folder))


ENTRIES = "WITH e AS (SELECT doc_id, 'g' || doc_id // 20 || '.ZIP!m' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.xm.zip!' ELSE '.mod.zip!' END AS head, text FROM documents) "


@query(ENTRIES + "SELECT head || 'm' || doc_id || '.mod' AS source, octet_length(encode(text)) AS length FROM e WHERE doc_id % 3 <> 0 UNION ALL SELECT head || 'page.html', length(doc_id::VARCHAR) FROM e WHERE doc_id % 3 <> 0")
def corpus_files(spark, sf_dir):
    """Modules of one format in archives of archives, read from a folder of files."""
    found = archives.corpus(spark, _archives(spark, sf_dir), ("mod",))
    return found.select(F.regexp_replace("source", "^.*/", "").alias("source"), F.length("bytes").cast("long").alias("length"))


@query(ENTRIES + ", n AS (SELECT head || 'm' || doc_id || '.mod' AS source FROM e UNION ALL SELECT head || 'page.html' FROM e) SELECT source FROM n ORDER BY source LIMIT 25")
def corpus_limit(spark, sf_dir):
    """The first entries of all formats."""
    found = archives.corpus(spark, _archives(spark, sf_dir), limit=25)
    return found.select(F.regexp_replace("source", "^.*/", "").alias("source"))


@query("SELECT DISTINCT 'g' || doc_id // 20 || '.ZIP' AS name FROM documents")
def list_archives(spark, sf_dir):
    """Archives under a folder; the hidden one is left out."""
    return M.list_zips(spark, _archives(spark, sf_dir)).select(F.substring_index("path", "/", -1).alias("name"))


@query("SELECT 'zip' AS kind, count(DISTINCT doc_id // 20) AS files, true AS sorted FROM documents")
def lab_listing(spark, sf_dir):
    """Plain files of a kind, smallest first."""
    files = M.lab_files(spark, _archives(spark, sf_dir), ("zip",), 100000).select("length", "path")
    return files.agg(F.lit("zip").alias("kind"), F.count(F.lit(1)).alias("files"), (F.sort_array(F.collect_list("length")) == F.collect_list("length")).alias("sorted"))


# Seek tables.

LINES = """WITH e AS (SELECT l_orderkey AS source, l_linenumber AS ln, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem) """


def _acts(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), n.alias("place"), F.col("l_linenumber").cast("int").alias("ln"), F.col("l_partkey").alias("k"))
    return rows.select(
        "source", "place", (F.col("place") * 2).alias("order"), (F.col("ln") % 4 + 1).alias("rows"), F.lit(6).alias("speed0"), F.lit(125).alias("tempo0"), F.lit(0).alias("seq"), F.lit(0).alias("row"), (F.col("ln") % 2).alias("channel"),
        (F.col("k") % 5).cast("int").alias("sample"), F.lit(True).alias("note"), F.lit(False).alias("off"), F.when(F.col("k") % 3 == 0, (F.col("k") % 4 + 2).cast("int")).alias("speed"), F.lit(None).cast("int").alias("tempo"),
    )


@query(LINES + """, s AS (SELECT source, place, (ln % 4 + 1) * coalesce(last_value(CASE WHEN k % 3 = 0 THEN k % 4 + 2 END IGNORE NULLS) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING), 6) * 2.5 / 125 AS len FROM e)
SELECT source, place, place * 2 AS "order", round(coalesce(sum(len) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6)::DOUBLE AS seconds FROM s""")
def seek_orders(spark, sf_dir):
    """When each played order starts; speed counts from its row on."""
    return seek.order_starts(_acts(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query(LINES + """, a AS (SELECT source, place, k % 5 AS sample, lead(place) OVER (PARTITION BY source, ln % 2 ORDER BY place) AS next_ FROM e)
SELECT p.source, p.place * 2 AS "order", array_to_string(list_sort(list(DISTINCT a.sample * 100)), ',') AS offsets FROM e p JOIN a ON a.source = p.source AND (a.place = p.place OR a.place < p.place AND (a.next_ IS NULL OR a.next_ >= p.place)) GROUP BY ALL""")
def seek_checkpoints(spark, sf_dir):
    """Samples that a start at each order needs: those that begin there and those that still sound."""
    offsets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") % 5).cast("int").alias("sample"), (F.col("l_partkey") % 5 * 100).alias("offset"))
    return seek.checkpoints(_acts(spark, sf_dir), offsets).withColumn("offsets", F.array_join("offsets", ","))


@query(LINES + "SELECT source, (k % 5 * 100)::VARCHAR AS offsets FROM e WHERE place = 0")
def seek_first(spark, sf_dir):
    offsets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") % 5).cast("int").alias("sample"), (F.col("l_partkey") % 5 * 100).alias("offset")).distinct()
    return seek.first_segment(_acts(spark, sf_dir), offsets).withColumn("offsets", F.array_join("offsets", ","))


# Manifests: the first three chunks are structure with zeros after them, the others samples of three chunks each.


def _manifests(spark, sf_dir, spill):
    # A document's chunks come of one row: dealt by id before they are cut, they are grouped where they are, and aren't kept.
    c = K.chunk_blocks(_files(spark, sf_dir).repartition("id"), 64).select("id", "ord", "cid", "bytes")
    rest = c.where("ord >= 3").select("id", F.floor(F.col("ord") / 3).cast("int").alias("index"), F.lit(64).cast("long").alias("frames"), F.lit(1).alias("channels"), F.lit(8).alias("bit_depth"), "ord", "cid")
    samples = MF.sample_rows(rest)
    head = c.where("ord < 3").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "cid"))), lambda x: x["cid"]).alias("skeletonChunks"))
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("format"))
    layout = F.array(F.size("skeletonChunks"), (F.col("id") % 50).cast("int"))
    skeletons = head.join(names, "id").select("id", "format", "skeletonChunks", layout.alias("skeletonLayout"), F.array(F.col("id") % 7).alias("plan"))
    return MF.manifests(skeletons, samples, "id", spill), _chunks(spark, sf_dir)


def _stored_manifests(spark, sf_dir):
    """What the manifests' roots lead to, the store of all blocks, each once, and its folder. Manifests as they were made go when they are stored."""
    made, chunks = _manifests(spark, sf_dir, 2000)
    path, temp = folders.work_folder(spark, "blocks"), folders.work_folder(spark, "made")
    folders.store(made, temp)
    made = spark.read.schema(made.schema).parquet(temp)
    roots = folders.written(made.select("id", "root"), "roots")
    many = table(spark, sf_dir, "documents").agg(F.coalesce(F.sum(F.ceil(F.octet_length("text") / 64)), F.lit(0))).first()[0]
    blocks = MF.put_blocks(MF.manifest_blocks(made).unionByName(chunks.select("cid", "bytes")), many, path)
    folders.delete(spark, temp)
    return MF.fetch_indexes(roots, blocks), blocks, path


MANIFESTS = CHUNKED + """, sk AS (SELECT id, list(cid ORDER BY ord) AS c FROM chunks WHERE ord < 3 GROUP BY id),
one AS (SELECT id, ord // 3 AS i, list(cid ORDER BY ord) AS c FROM chunks WHERE ord >= 3 GROUP BY id, ord // 3),
sm AS (SELECT id, list({'index': i::INT, 'frames': 64, 'channels': 1, 'bitDepth': 8, 'chunks': c} ORDER BY i) AS s FROM one GROUP BY id),
mf AS (SELECT id, '{"v":2,"format":"' || lang || '","skeletonChunks":' || to_json(sk.c)::VARCHAR || ',"skeletonLayout":[' || len(sk.c) || ',' || id % 50 || '],' AS head, '{"samples":' || coalesce(to_json(s)::VARCHAR, '[]') || ',"plan":[' || id % 7 || ']}' AS ix FROM sk JOIN documents ON id = doc_id LEFT JOIN sm USING (id)) """


@query(MANIFESTS + """, t AS (SELECT id, head || '"index":' || ix || '}' AS inline_, head || '"indexRoot":"' || sha256(ix) || '"}' AS apart FROM mf)
SELECT id, sha256(CASE WHEN length(inline_) > 2000 THEN apart ELSE inline_ END) AS root, length(inline_) > 2000 AS spilled FROM t""")
def manifest_roots(spark, sf_dir):
    """Roots of manifests; an index of a long one is a block of its own."""
    return _manifests(spark, sf_dir, 2000)[0].select("id", "root", "spilled")


@query(CHUNKED + ", h AS (SELECT id, string_agg(t, '' ORDER BY ord) AS t, max(id) % 50 AS z FROM chunks WHERE ord < 3 GROUP BY id) SELECT id, lang AS format, sha256(unhex(t || repeat('00', z::INT))) AS skeleton, id % 7 AS plan FROM h JOIN documents ON id = doc_id")
def manifest_fetch(spark, sf_dir):
    """Skeletons read back from roots and blocks, zeros put in again."""
    read, blocks, _ = _stored_manifests(spark, sf_dir)
    skeletons = MF.fetch_skeletons(read, blocks)
    return skeletons.select("id", "format", F.sha2("skeleton", 256).alias("skeleton"), F.element_at("plan", 1).alias("plan"))


@query(CHUNKED + "SELECT id, (ord // 3)::INT AS index, 64 AS frames, 1 AS channels, 8 AS \"bitDepth\", sha256(unhex(string_agg(t, '' ORDER BY ord))) AS pcm FROM chunks WHERE ord >= 3 GROUP BY id, ord // 3")
def manifest_samples(spark, sf_dir):
    """Samples read back from roots and blocks."""
    read, blocks, path = _stored_manifests(spark, sf_dir)
    samples = MF.fetch_samples(read, blocks)
    folders.delete(spark, path)
    return samples.withColumn("pcm", F.sha2("pcm", 256))


@query("WITH RECURSIVE " + MANIFESTS.removeprefix("WITH ") + """, t AS (SELECT id, ix, head || '"index":' || ix || '}' AS inline_, head || '"indexRoot":"' || sha256(ix) || '"}' AS apart FROM mf),
m AS (SELECT id, CASE WHEN length(inline_) > 2000 THEN apart ELSE inline_ END AS txt FROM t),
texts AS (SELECT DISTINCT sha256(txt) AS cid, txt FROM (SELECT txt FROM m UNION ALL SELECT ix FROM t WHERE length(inline_) > 2000)),
lists AS (SELECT cid, list_concat(json_extract_string(txt, '$.skeletonChunks[*]'), list_filter([json_extract_string(txt, '$.indexRoot')], lambda x: x IS NOT NULL),
  json_extract_string(txt, '$.index.samples[*].chunks[*]'), json_extract_string(txt, '$.samples[*].chunks[*]')) AS l FROM texts),
links AS (SELECT cid, l[i] AS link, i FROM (SELECT cid, l, unnest(range(1, len(l) + 1)) AS i FROM lists)),
walk AS (SELECT id, 0 AS level, []::BIGINT[] AS path, sha256(txt) AS cid FROM m UNION ALL SELECT w.id, w.level + 1, list_append(w.path, l.i), l.link FROM walk w JOIN links l ON l.cid = w.cid)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY path) - 1)::INT AS place, level, cid FROM walk""")
def dag_walk(spark, sf_dir):
    """Every address below each manifest's root, by way of indexes that are blocks of their own."""
    made, chunks = _manifests(spark, sf_dir, 2000)
    made = folders.written(made, "made")
    blocks = MF.manifest_blocks(made).unionByName(chunks.select("cid", "bytes"))
    return MF.walk(made.select("id", "root"), blocks)
