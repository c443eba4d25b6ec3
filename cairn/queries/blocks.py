"""Blocks, duplicates and sessions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chunking import SMALL
from ..operators import blocks as K
from ..operators import sessions as Z
from ..registry import query, table
from ..sources.modules import content_chunks

#: Whole texts as bytes (h in hex) and their chunks of 64 bytes.
CHUNKED = """WITH files AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents),
ch AS (SELECT id, o AS ord, o * 64 AS off, substr(h, (o * 128 + 1)::INT, 128) AS t FROM (SELECT id, h, unnest(range(0, (length(h) // 2 + 63) // 64)) AS o FROM files)),
chunks AS (SELECT id, ord, off, length(t) // 2 AS len, sha256(unhex(t)) AS cid, t FROM ch) """


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("bytes"))


def _chunks(spark, sf_dir):
    return K.chunk_blocks(_files(spark, sf_dir), 64)


@query(CHUNKED + "SELECT id, ord, off, len, cid FROM chunks")
def fixed_chunks(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("id", F.col("ord").cast("long").alias("ord"), F.col("off").cast("long").alias("off"), F.col("len").cast("long").alias("len"), "cid")


@query(CHUNKED + "SELECT id, 40 + id % 50 AS offset_, substr(h, (81 + id % 50 * 2)::INT, 600) AS data FROM files WHERE length(h) // 2 > 40 + id % 50")
def range_read(spark, sf_dir):
    r = _files(spark, sf_dir).select("id", (40 + F.col("id") % 50).alias("offset"), F.lit(300).alias("length"))
    out = K.read_ranges(_chunks(spark, sf_dir), r)
    return out.select("id", F.col("offset").alias("offset_"), F.hex("data").alias("data"))


@query(CHUNKED + "SELECT count(*) AS bad FROM chunks WHERE ord % 10 = 3 AND len > 0")
def verify_blocks(spark, sf_dir):
    c = _chunks(spark, sf_dir).withColumn("bytes", F.when(F.col("ord") % 10 == 3, F.concat("bytes", F.lit("x").cast("binary"))).otherwise(F.col("bytes")))
    return K.mismatched(c).agg(F.count(F.lit(1)).alias("bad"))


@query(CHUNKED + "SELECT id, sha256(unhex(h)) AS digest FROM files WHERE h <> ''")
def reassemble(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return K.reassemble(c.select("id", "ord", "cid"), c).select("id", F.sha2("bytes", 256).alias("digest"))


@query("SELECT doc_id, to_base64(encode(text)) AS b64, text FROM documents")
def base64_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("b64"), F.decode(F.unbase64(F.base64(F.encode("text", "UTF-8"))), "UTF-8").alias("text"))


@query("SELECT p_partkey, rpad(substr(p_name, 1, p_size % 4), (p_size % 4 + p_size % 5)::INT, chr(9)) || rpad(substr(p_name, (p_size % 4 + 1)::INT), (length(p_name) - p_size % 4 + p_size % 3)::INT, chr(9)) AS t FROM part WHERE p_size IS NOT NULL")
def rle_expand(spark, sf_dir):
    """Whole names in two pieces, each with zeros after it."""
    p = table(spark, sf_dir, "part")
    head = F.least(F.col("p_size") % 4, F.length("p_name"))
    pairs = F.array(head, F.col("p_size") % 5, F.length("p_name") - head, F.col("p_size") % 3)
    out = K.expand_runs(p.select("p_partkey", F.transform(pairs, lambda x: x.cast("int")).alias("pairs"), F.col("p_name").cast("binary").alias("content")), "pairs", "content", "p_partkey")
    return out.select("p_partkey", F.translate(F.decode("expanded", "ISO-8859-1"), "\u0000", "\t").alias("t"))


STATS = "count(*) AS pieces, count(DISTINCT cid) AS unique_pieces, count(*) - count(DISTINCT cid) AS redundant, sum(len)::BIGINT AS bytes, (SELECT sum(l) FROM (SELECT any_value(len) AS l FROM {0} GROUP BY cid))::BIGINT AS unique_bytes, round(1 - (SELECT sum(l) FROM (SELECT any_value(len) AS l FROM {0} GROUP BY cid)) / sum(len)::DOUBLE, 6) AS saved FROM {0}"
WHOLE = "WITH whole AS (SELECT doc_id AS id, lang AS format, source, sha256(text) AS cid, n_chars AS len, text FROM documents) "


def _whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("format"), "source", F.sha2("text", 256).alias("cid"), F.col("n_chars").alias("len"))


@query(WHOLE + "SELECT " + STATS.format("whole"))
def whole_dedup(spark, sf_dir):
    return K.dedup_stats(_whole(spark, sf_dir))


@query(CHUNKED + "SELECT " + STATS.format("chunks"))
def chunk_dedup(spark, sf_dir):
    return K.dedup_stats(_chunks(spark, sf_dir))


@query(CHUNKED + """, named AS (SELECT source, cid, len FROM chunks JOIN documents ON id = doc_id), first_ AS (SELECT source, cid, any_value(len) AS len, count(*) AS n FROM named GROUP BY source, cid)
SELECT source, sum(n)::BIGINT AS pieces, count(*) AS unique_pieces, sum(n * len)::BIGINT AS bytes, sum(len)::BIGINT AS unique_bytes FROM first_ GROUP BY source""")
def pool_dedup(spark, sf_dir):
    """Duplicates inside each source's pool, over all documents."""
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return K.pooled_stats(_chunks(spark, sf_dir).select("id", "cid", "len").join(names, "id"), "source")


@query(WHOLE + "SELECT format, count(*) AS modules, count(DISTINCT source) AS sources, sum(len)::BIGINT AS bytes FROM whole GROUP BY format")
def per_format_stats(spark, sf_dir):
    return _whole(spark, sf_dir).groupBy("format").agg(F.count(F.lit(1)).alias("modules"), F.count_distinct("source").alias("sources"), F.sum("len").alias("bytes"))


@query(WHOLE + "SELECT cid, count(*) AS n, any_value(len) AS bytes FROM whole GROUP BY cid ORDER BY n DESC, bytes DESC, cid LIMIT 12")
def top_reused(spark, sf_dir):
    return K.most_reused(_whole(spark, sf_dir))


@query(CHUNKED + "SELECT id, count(*) AS chunks, count(DISTINCT cid) AS blocks, sum(len)::BIGINT AS bytes FROM chunks GROUP BY id")
def dag_stats(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("cid").alias("blocks"), F.sum("len").alias("bytes"))


@query(CHUNKED + "SELECT id, 0 AS level, sha256('root' || id) AS cid FROM files UNION ALL SELECT id, 1, cid FROM chunks")
def dag_all_cids(spark, sf_dir):
    """All addresses of a graph, level by level; repeats stay."""
    roots = _files(spark, sf_dir).select("id", F.lit(0).alias("level"), F.sha2(F.concat(F.lit("root"), F.col("id").cast("string")), 256).alias("cid"))
    return roots.unionAll(_chunks(spark, sf_dir).select("id", F.lit(1).alias("level"), "cid"))


@query(CHUNKED + "SELECT id, count(*) AS blocks, sum(len)::BIGINT AS bytes FROM (SELECT DISTINCT id, cid, len FROM chunks WHERE ord < 3 OR ord % 7 = 0) GROUP BY id")
def warm_set(spark, sf_dir):
    """First pieces and those needed at the start, each address once."""
    c = _chunks(spark, sf_dir)
    both = c.where("ord < 3").unionByName(c.where("ord % 7 = 0")).dropDuplicates(["id", "cid"])
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("len").alias("bytes"))


# Sessions: a customer's orders in time, each with the parts of its lines.
PLAYS = """WITH plays AS (SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey) AS pos, l_partkey % 40 AS cid, l_linenumber AS line, (l_partkey % 40 + 1) * 10 AS size
FROM (SELECT o_custkey, o_orderdate, o_orderkey FROM orders) JOIN lineitem ON o_orderkey = l_orderkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session, cid ORDER BY pos, line) AS rn FROM plays) """



@query(PLAYS + "SELECT session, sum(size)::BIGINT AS naive, sum(CASE WHEN rn = 1 THEN size ELSE 0 END)::BIGINT AS net FROM ranked GROUP BY session")
def session_net_bytes(spark, sf_dir):
    return Z.session_bytes(_ordered_plays(spark, sf_dir))


def _ordered_plays(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    j = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    pos = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey")).cast("long")
    return j.select(F.col("o_custkey").alias("session"), pos.alias("pos"), (F.col("l_partkey") % 40).alias("cid"), ((F.col("l_partkey") % 40 + 1) * 10).alias("size"))


@query(PLAYS + "SELECT session, pos, cid, rn > 1 AS hit FROM ranked")
def cache_hits(spark, sf_dir):
    return Z.cache_hits(_ordered_plays(spark, sf_dir)).select("session", "pos", "cid", "hit")


@query(PLAYS + ", run AS (SELECT pos, sum(size) OVER w AS naive, sum(CASE WHEN rn = 1 THEN size ELSE 0 END) OVER w AS net FROM ranked WINDOW w AS (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT pos, sum(naive)::BIGINT AS naive, sum(net)::BIGINT AS net, round(1 - sum(net) / sum(naive)::DOUBLE, 6) AS saved FROM run GROUP BY pos")
def savings_curve(spark, sf_dir):
    return Z.savings_curve(_ordered_plays(spark, sf_dir))


@query("WITH k AS (SELECT doc_id, lang || substr(sha256(text), 1, 2) AS k FROM documents) SELECT k AS key, count(*) AS n, min(doc_id) AS first FROM k GROUP BY k HAVING count(*) >= 2")
def title_clusters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.substring(F.sha2("text", 256), 1, 2)).alias("key"))
    return Z.clusters(d, "key", "doc_id")


@query("""WITH m AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents), c AS (SELECT source, doc_id, r, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS size FROM m),
members AS (SELECT source, k AS pos, doc_id FROM c WHERE k < 60), lastm AS (SELECT source, max(r) AS r, any_value(n) AS n, least(60, max(size)) AS size FROM c WHERE k < 60 GROUP BY source),
want AS (SELECT source, size, r, n, unnest(range(1, n)) AS step FROM lastm WHERE size < 60),
near_ AS (SELECT w.source, w.size, w.step, m.doc_id, row_number() OVER (PARTITION BY w.source ORDER BY w.step) - 1 AS j FROM want w JOIN m ON m.r = (w.r + w.step) % w.n WHERE m.source <> w.source)
SELECT source AS cluster, pos, doc_id FROM members UNION ALL SELECT source, size + j, doc_id FROM near_ WHERE size + j < 60""")
def affinity_session(spark, sf_dir):
    """Members of a cluster, then the next rows in browse order (around the end) up to 60."""
    return Z.affinity_sessions(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 60)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 7 = 0")
def stride_sample(spark, sf_dir):
    return Z.every_kth(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("WITH u AS (SELECT s_suppkey AS id, 0 AS rank_ FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_nationkey < 5) SELECT id, min(rank_) AS rank_ FROM u GROUP BY id ORDER BY rank_, id LIMIT 64")
def seeds_first(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"))
    found = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return Z.seeds_first(seeds, found, "id", 64)


# Content-defined chunks of 512, 2048 and 8192 bytes: thirteen zero bits before the average length, nine after it. The SQL has the sum of each place over
# the thirteen bytes that reach these bits, and walks from cut to cut; what lies before a chunk's own sum is taken off.
GEAR = "gear AS (SELECT 0 AS b, (2654435769 * 1664525 + 1013904223) % 4294967296 AS g UNION ALL SELECT b + 1, (g * 1664525 + 1013904223) % 4294967296 FROM gear WHERE b < 255)"
CDC = f"""WITH RECURSIVE {GEAR}, files AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(text)) AS h, octet_length(encode(text))::BIGINT AS n FROM documents WHERE text <> ''),
bytes AS (SELECT r, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(n)) AS p FROM files),
entries AS (SELECT r, p, g % 8192 AS g FROM bytes JOIN gear ON b = ('0x' || x)::INT),
sums AS MATERIALIZED (SELECT r, p, ({" + ".join(f"{2**j} * lag(g, {j}, 0) OVER w" for j in range(13))}) % 8192 AS v FROM entries WINDOW w AS (PARTITION BY r ORDER BY p)),
cuts AS (SELECT r, n, 0::BIGINT AS pos, -1 AS ord, 0::BIGINT AS was FROM files UNION ALL
  SELECT c.r, c.n, least(min(s.p) FILTER (((s.v - b.v * (1 << least(s.p - c.pos - 511, 13))) % 8192 + 8192) % (CASE WHEN s.p < c.pos + 2048 THEN 8192 ELSE 512 END) = 0) + 1, c.pos + 8192, c.n) AS pos, c.ord + 1, c.pos
  FROM cuts c LEFT JOIN sums b ON b.r = c.r AND b.p = c.pos + 511
  LEFT JOIN sums s ON s.r = c.r AND s.p >= c.pos + 512 AND s.p < least(c.pos + 8192, c.n) AND (s.p < c.pos + 525 OR s.v % 512 = 0)
  WHERE c.pos < c.n GROUP BY c.r, c.n, c.pos, c.ord),
chunks AS (SELECT doc_id, ord, was AS off, pos - was AS len, sha256(unhex(substr(h, 2 * was + 1, 2 * (pos - was)))) AS cid FROM cuts JOIN files USING (r) WHERE ord >= 0) """


def _content_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return content_chunks(files, SMALL, "doc_id")


@query(CDC + "SELECT doc_id, ord::INT AS ord, off, len, cid FROM chunks")
def cdc_chunks(spark, sf_dir):
    """Content-defined chunks of every text."""
    return _content_chunks(spark, sf_dir)


@query(CDC + "SELECT " + STATS.format("chunks"))
def cdc_dedup(spark, sf_dir):
    """Total and unique content-defined chunks of all texts, and the share of their bytes that repeats."""
    return K.dedup_stats(_content_chunks(spark, sf_dir))


@query(CDC + """, named AS (SELECT d.lang, c.cid, c.len FROM chunks c JOIN documents d USING (doc_id)), first_ AS (SELECT lang, cid, any_value(len) AS len, count(*) AS n FROM named GROUP BY lang, cid)
SELECT lang, sum(n)::BIGINT AS pieces, count(*) AS unique_pieces, sum(n * len)::BIGINT AS bytes, sum(len)::BIGINT AS unique_bytes FROM first_ GROUP BY lang""")
def cdc_by_language(spark, sf_dir):
    """Repeats of content-defined chunks inside each language."""
    names = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return K.pooled_stats(_content_chunks(spark, sf_dir).select("doc_id", "cid", "len").join(names, "doc_id"), "lang")
