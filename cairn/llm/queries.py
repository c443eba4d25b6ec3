"""The corpus operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clustering import clustered
from .common import read
from .decontaminate import find_contamination
from .divergence import divergence
from .fingerprints import fingerprints
from .line_dedup import dedup_lines
from .media import media_columns
from .mixing import mix_totals
from .ngram_join import similar_groups
from .packing import pack_tokens
from .quality import score_quality
from .secrets import find_secrets
from .sentence_dedup import remove_repeats
from .suffix_dedup import remove_repeated_bytes

FOLD_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a third of the labels (by crc32 of the id) is held out."""
    return score_quality(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of 10 words that the benchmark shares, and the items found."""
    return find_contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")).drop("items")


OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({FOLD_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({FOLD_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bl AS (SELECT *, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT m FROM pat),
win AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT w.r, w.i, w.m, p.item_id FROM win w JOIN pat p ON w.m = p.m AND w.s = p.s),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the fixed patterns and of the network, as code-point spans."""
    return find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored grey image: its place in the shards (by name), digests and features of what is read back."""
    out = media_columns(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumn("shard", F.substring_index("shard", "/", -1))


def op5_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the sentences under spans that occurred before; long sentences are cut by their words."""
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_lines, n_dropped and the hash of what stays, for lines in at least 10 documents."""
    out = dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"), min_docs=10, min_key_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines_ AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM rows_),
keyed AS (SELECT *, {FOLD_SQL.format(f"trim(line, {SPACE_SQL})")} AS key FROM lines_),
bad AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 10),
marked AS (SELECT r, doc_id, pos, line, key IN (SELECT key FROM bad) AS gone FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 5-word shingles are at least 0.75 similar, directly or by links."""
    return similar_groups(read(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text under 200-byte strings that also start elsewhere, and the hash of what stays."""
    out = remove_repeated_bytes(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, for targets by weights 5, 2, 1 under a cap of three times the source."""
    return mix_totals(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


OP9_HASH = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
OP9_SWAP = f"((({OP9_HASH.format("'7|draw|' || src || '|' || k")} % blocks) - x + blocks) % blocks)"
OP9_SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sized GROUP BY source),
pos AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM per WHERE source_size > 0),
part AS (SELECT k, 3 * source_size AS most, w,
  (SELECT sum(source_size) FROM per) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM pos),
cut AS (SELECT * FROM part WHERE rest::DOUBLE * w / open_w <= most ORDER BY k LIMIT 1),
targets AS (SELECT p.source, p.source_size,
  CASE WHEN p.source_size = 0 THEN 0.0 WHEN q.k < (SELECT k FROM cut) THEN 3.0 * p.source_size
       ELSE (SELECT rest FROM cut)::DOUBLE * p.w / (SELECT open_w FROM cut) END AS target
  FROM per p LEFT JOIN pos q ON p.source IS NOT DISTINCT FROM q.source),
facts AS (SELECT *, coalesce(source, '') AS src, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target + 0.5)::BIGINT // source_size, 3) END AS full_,
  (source_size + 4095) // 4096 AS blocks FROM targets),
numbered AS (SELECT source, src, source_size, blocks, words - full_ * source_size AS rest, unnest(range(blocks)) AS block FROM facts),
drawn AS (SELECT *, list_reduce(list_concat([block], range(1, 25)), lambda x, k:
    CASE WHEN {OP9_HASH.format(f"'7|draw|' || src || '|' || k || '|' || greatest(x, {OP9_SWAP})")} % 2 = 0 THEN x ELSE {OP9_SWAP} END) AS at_ FROM numbered),
lengths AS (SELECT *, least(4096, source_size - block * 4096) AS n FROM drawn),
stops AS (SELECT source, block, greatest(0, least(n, rest - (sum(n) OVER (PARTITION BY source ORDER BY at_ ROWS UNBOUNDED PRECEDING) - n)))::BIGINT AS stop FROM lengths),
ordered AS (SELECT row_number() OVER () AS r, s.doc_id, s.source, s.size, f.source_size, f.target, f.full_,
  (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('7|' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS at_
  FROM sized s JOIN facts f ON s.source IS NOT DISTINCT FROM f.source),
spread AS (SELECT r, source, size, at_, unnest(range(at_ // 4096, (at_ + size - 1) // 4096 + 1)) AS block FROM ordered WHERE size > 0),
part_taken AS (SELECT r, sum(greatest(0, least(at_ + size, p.block * 4096 + stop) - greatest(at_, p.block * 4096)))::BIGINT AS n
  FROM spread p JOIN stops t ON p.block = t.block AND p.source IS NOT DISTINCT FROM t.source GROUP BY r)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (full_ * size + coalesce(n, 0))::BIGINT AS taken FROM ordered LEFT JOIN part_taken USING (r)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids in packed rows, with the documents of each row."""
    return pack_tokens(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components after three rounds from 16 first centroids."""
    return clustered(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


_NEAREST = "SELECT r, q, min({{'d': list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)])::BIGINT, 'k': k}}) AS a FROM kept, {0} GROUP BY r, q"
_MOVED = """SELECT o.k, coalesce(n.c, o.c) AS c FROM {1} o LEFT JOIN (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
    SELECT a.k AS k, i, sum(q[i])::HUGEINT AS s, count(*) AS n FROM {0}, range(1, 65) AS t(i) GROUP BY a.k, i) GROUP BY k) n USING (k)"""
_STEPS = ", ".join(f"a{i} AS MATERIALIZED ({_NEAREST.format(f'c{i}')}), c{i + 1} AS MATERIALIZED ({_MOVED.format(f'a{i}', f'c{i}')})" for i in range(3))
OP11_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INT AS k, q AS c FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM kept ORDER BY h, q LIMIT 16)),
{_STEPS},
a3 AS MATERIALIZED ({_NEAREST.format("c3")})
SELECT vec_id, a.k AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (r) JOIN c3 ON c3.k = a.k
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every text and of its edited copy, and how alike they are."""
    return fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source of a language its distance to each other source, and the terms that it has more of than its language."""
    return divergence(read(spark, sf_dir, "documents", "lang", "source", "text"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {FOLD_SQL.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, v.v, v.all_n FROM g JOIN k USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (all_n + v) AS q FROM dense),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {"op2_decontaminate": op2_decontaminate, "op6_line_dedup": op6_line_dedup, "op9_mixing": op9_mixing, "op4_media": op4_media, "op10_packing": op10_packing, "op3_secrets": op3_secrets, "op1_quality": op1_quality, "op7_ngram_join": op7_ngram_join, "op5_sentence_dedup": op5_sentence_dedup, "op8_suffix_dedup": op8_suffix_dedup, "op11_clusters": op11_clusters, "op12_fingerprints": op12_fingerprints, "op13_divergence": op13_divergence}
SQL = {"op2_decontaminate": OP2_SQL, "op6_line_dedup": OP6_SQL, "op9_mixing": OP9_SQL, "op11_clusters": OP11_SQL, "op13_divergence": OP13_SQL}
