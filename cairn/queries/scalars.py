"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import strings as S
from ..registry import query, table
from ..sources import documents as D



def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pick(index, *values: str):
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(index == i, v).otherwise(out)
    return out


def _pick_sql(index: str, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


NAMES = ("a.MOD", "b/readme.TXT", "c.html", ".hidden.xm", "dir/", "d.it", "e.s3m.zip", "f.bmp", "g.pdf", "h.url", "i.mod.INFO", "j.jpeg", "txt", "k.md.gif", "l.doc", "m.nfo.xm")


@query(f"""SELECT doc_id, name FROM (SELECT doc_id, {_pick_sql('doc_id % 16', *NAMES)} AS name FROM documents) WHERE NOT ends_with(name, '/')
AND NOT (contains(name, '.') AND lower(split_part(name, '.', -1)) IN ('info', 'txt', 'nfo', 'diz', 'readme', 'md', 'doc', 'jpg', 'jpeg', 'png', 'gif'))""")
def sidecar_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _pick(F.col("doc_id") % 16, *NAMES).alias("name")).where(S.is_module_entry(F.col("name")))


@query("SELECT page_id, lower(split_part(url, '.', -1)) AS ext FROM pages")
def extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.extension(F.col("url")).alias("ext"))


TITLE_TAILS = (" (live) Remix 2", " Part II", "", " v2 (final)", " VERSION b", " rmx", " (a) pt. 3 demo", " Edited", " mixed ver")


@query(f"""SELECT doc_id, CASE WHEN length(k) >= 4 THEN k END AS k FROM (
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(t), '\\(.*?\\)', ' ', 'g'), '\\b(part|pt|remix|mix|rmx|ver|version|v|edit|final|demo)\\b.*$', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS k
FROM (SELECT doc_id, split_part(text, chr(10), 1) || {_pick_sql('doc_id % 9', *TITLE_TAILS)} AS t FROM documents))""")
def title_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.title_key(F.concat(F.substring_index("text", "\n", 1), _pick(F.col("doc_id") % 9, *TITLE_TAILS))).alias("k"))


@query("SELECT doc_id, trim(regexp_replace(substr(source || ' ' || lang || '   ', 1, 20), '[^ -~]', '', 'g'), ' ') AS title FROM documents")
def title_of(spark, sf_dir):
    raw = F.concat(F.rpad(F.substring(F.concat("source", F.lit(" "), "lang", F.lit("   ")), 1, 20), 20, "\u0000"), F.lit("rest"))
    return _docs(spark, sf_dir).select("doc_id", B.printable(raw.cast("binary"), 0, 20).alias("title"))


@query("SELECT doc_id, substr(h, 1, 6) || '…' || substr(h, -6) AS long_id, source AS short_source FROM (SELECT doc_id, source, sha256(text) AS h FROM documents)")
def short_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.short_id(F.sha2("text", 256)).alias("long_id"), S.short_id(F.col("source")).alias("short_source"))


@query("""SELECT event_id, CASE WHEN s IS NULL OR s < 0 THEN '0:00' ELSE (floor(s)::BIGINT // 60) || ':' || lpad((floor(s)::BIGINT % 60)::VARCHAR, 2, '0') END AS t FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -value ELSE value * 10 END AS s FROM events)""")
def fmt_time(spark, sf_dir):
    s = F.when(F.col("event_id") % 13 == 0, None).when(F.col("event_id") % 17 == 0, -F.col("value")).otherwise(F.col("value") * 10)
    return table(spark, sf_dir, "events").select("event_id", S.fmt_time(s).alias("t"))


@query("SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', round(n / 1048576.0, 1)) ELSE printf('%.0f KB', round(n / 1024.0, 0)) END AS label FROM (SELECT doc_id, n_chars * (doc_id % 300 + 1) AS n FROM documents)")
def fmt_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.fmt_bytes(F.col("n_chars") * (F.col("doc_id") % 300 + 1)).alias("label"))


@query("SELECT doc_id, CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' END AS label FROM (SELECT doc_id, doc_id * 37 % 9000 AS n FROM documents)")
def since_label(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.since_label(F.col("doc_id") * 37 % 9000).alias("label"))


PATHS = ("/ipfs/bafy", "/ipns/k51", "bafy/ipfs/x", "/ipfs")


@query(f"SELECT doc_id, regexp_replace({_pick_sql('doc_id % 4', *PATHS)} || doc_id, '^/ip[fn]s/', '') AS p FROM documents")
def strip_prefix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.strip_prefix(F.concat(_pick(F.col("doc_id") % 4, *PATHS), F.col("doc_id").cast("string"))).alias("p"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) AND doc_id > 0 THEN doc_id ELSE 16384 END AS n FROM documents")
def chunker_parse(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 <= 1, F.concat(F.lit("size-"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("rabin-"), F.col("doc_id").cast("string"))).otherwise("size-x")
    return _docs(spark, sf_dir).select("doc_id", S.chunk_size(text).alias("n"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN (doc_id % 48) * 3600.0 WHEN 1 THEN (doc_id % 9) * 3600.0 + 30 * 60 WHEN 2 THEN doc_id % 50 + 0.5 WHEN 3 THEN (doc_id % 900) / 1000.0 ELSE 7.0 END::DOUBLE AS s FROM documents")
def parse_duration(spark, sf_dir):
    n = lambda m: (F.col("doc_id") % m).cast("string")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(n(48), F.lit("h"))).when(F.col("doc_id") % 5 == 1, F.concat(n(9), F.lit("h30m"))).when(F.col("doc_id") % 5 == 2, F.concat(n(50), F.lit(".5s"))).when(F.col("doc_id") % 5 == 3, F.concat(n(900), F.lit("ms"))).otherwise("soon")
    return _docs(spark, sf_dir).select("doc_id", S.duration_seconds(text, 7).alias("s"))


ADDRESSES = ("/ip4/1.2.3.4/udp/4001/quic-v1/p2p/Q", "/ip4/1.2.3.4/tcp/4001/p2p/Q", "/ip4/1.2.3.4/tcp/1/p2p/H/p2p-circuit/p2p/Q", "", "/dns/x/ws/p2p/Q")


@query(f"SELECT event_id, CASE WHEN a = '' THEN 'unknown' WHEN contains(a, '/p2p-circuit') THEN 'relay' WHEN contains(a, '/quic') THEN 'quic' WHEN contains(a, '/tcp/') THEN 'tcp' ELSE 'direct' END AS class, nullif(regexp_extract(a, '/p2p/([^/]+)/p2p-circuit', 1), '') AS hop FROM (SELECT event_id, {_pick_sql('event_id % 5', *ADDRESSES)} AS a FROM events)")
def transport_class(spark, sf_dir):
    a = _pick(F.col("event_id") % 5, *ADDRESSES)
    return table(spark, sf_dir, "events").select("event_id", S.transport_class(a).alias("class"), S.relay_hop(a).alias("hop"))


@query("SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS words FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')[1:200] AS w FROM documents)")
def words_200(spark, sf_dir):
    w = S.first_words(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(w).alias("n"), F.array_join(w, " ").alias("words"))


CODEC_NAMES = ("raw", "dag-pb", "dag-cbor", "297", "zip")


@query(f"SELECT doc_id, CASE c WHEN 'raw' THEN 85 WHEN 'dag-pb' THEN 112 WHEN 'dag-cbor' THEN 113 WHEN '297' THEN 297 END::BIGINT AS code, CASE c WHEN 'zip' THEN NULL ELSE c END AS name FROM (SELECT doc_id, {_pick_sql('doc_id % 5', *CODEC_NAMES)} AS c FROM documents)")
def codec_map(spark, sf_dir):
    code = S.codec_code(_pick(F.col("doc_id") % 5, *CODEC_NAMES))
    return _docs(spark, sf_dir).select("doc_id", code.alias("code"), S.codec_name(code).alias("name"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'mo3' WHEN 1 THEN 'it' WHEN 2 THEN 's3m' WHEN 3 THEN 'xm' END AS format FROM documents")
def detect_format(spark, sf_dir):
    from ..sources.modules import sniff

    head = F.when(F.col("doc_id") % 5 == 0, "MO3").when(F.col("doc_id") % 5 == 1, "IMPM").when(F.col("doc_id") % 5 == 2, F.concat(F.repeat(F.lit("."), F.lit(44)), F.lit("SCRM"))).when(F.col("doc_id") % 5 == 3, "Extended Module: ").otherwise("....")
    return _docs(spark, sf_dir).select("doc_id", sniff(F.concat(head, F.repeat(F.lit(" "), F.lit(90))).cast("binary")).alias("format"))


@query("SELECT doc_id, b[1] + 256 * b[2] AS le16, 256 * b[1] + b[2] AS be16, b[1] + 256 * b[2] + 65536 * b[3] + 16777216 * b[4] AS le32, CASE WHEN b[1] > 127 THEN b[1] - 256 ELSE b[1] END AS s8, (b[1] // 8) % 2 = 1 AS flag8 FROM (SELECT doc_id, list_transform(range(1, 5), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT doc_id, sha256(text) AS h FROM documents))")
def read_ints(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.unhex(F.sha2("text", 256)).alias("b"))
    b = F.col("b")
    return d.select("doc_id", B.u16le(b, 0).alias("le16"), B.u16be(b, 0).alias("be16"), B.u32le(b, 0).alias("le32"), B.s8(B.byte_at(b, 0)).alias("s8"), B.has_flag(B.byte_at(b, 0), 8).alias("flag8"))


@query("SELECT l_orderkey, l_linenumber, round(8363 * pow(2.0, (l_partkey % 120 - 60) / 12.0), 4) AS rate, round(8363 * pow(2.0, (4608 - (7680 - (l_partkey % 120) * 64 - (l_suppkey % 16) / 2.0)) / 768), 4) AS linear FROM lineitem")
def note_rate(spark, sf_dir):
    note = F.col("l_partkey") % 120
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(B.note_rate(F.lit(8363.0), note), 4).alias("rate"), F.round(B.linear_rate(note, F.col("l_suppkey") % 16), 4).alias("linear"))


@query("SELECT p_partkey, round(1000 * p_size / (50e6 / 8) + 0.9 * p_size, 6) AS ms, 1000.0 * p_size / (50e6 / 8) + 0.9 * p_size < 20 AS quick FROM part")
def ttfpb_model(spark, sf_dir):
    """Transfer at 50 Mbit/s plus parse time, and whether that is within a bound."""
    ms = 1000.0 * F.col("p_size") / (50e6 / 8) + 0.9 * F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(ms, 6).alias("ms"), (ms < 20).alias("quick"))


def _lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.col("role"), F.lit("-"), F.col("turn").cast("string"))
    body = F.when(F.col("turn") % 3 == 2, "not json").otherwise(F.concat(F.lit('{"Hash": "'), name, F.lit('", "Type": '), (F.col("turn") % 2 * 5).cast("string"), F.lit("}")))
    return c.select("conv_id", "turn", body.alias("line"))


@query("SELECT conv_id, max_by(role || '-' || turn, turn) AS value FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id")
def ndjson_last(spark, sf_dir):
    return D.last_field(_lines(spark, sf_dir), "conv_id", "turn", "line", "Hash")


@query("SELECT conv_id, min_by(role || '-' || turn, turn) AS value FROM conversations WHERE turn % 3 <> 2 AND turn % 2 = 1 GROUP BY conv_id")
def ndjson_first_value(spark, sf_dir):
    return D.first_of_kind(_lines(spark, sf_dir), "conv_id", "turn", "line", "Type", "5", "Hash")


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS k, coalesce(props->>'$.missing', '[]') AS other FROM events")
def json_props(spark, sf_dir):
    """Lenient numbers and a fallback for what is not there."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as double)").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("[]")).alias("other"))


@query("""WITH q AS (SELECT conv_id, list(role || turn ORDER BY turn) AS items FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_concat(list_concat(items[1:1], ['new']), items[2:]), ',') AS inserted, array_to_string(items[2:], ',') AS removed,
array_to_string(CASE WHEN len(items) >= 2 THEN list_concat([items[2], items[1]], items[3:]) ELSE items END, ',') AS swapped FROM q""")
def queue_edit(spark, sf_dir):
    """Insert next, remove and swap in ordered lists."""
    from ..operators.lists import insert_at, remove_at, swap

    q = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("items"))
    items = F.col("items")
    return q.select("conv_id", F.array_join(insert_at(items, 1, F.lit("new")), ",").alias("inserted"), F.array_join(remove_at(items, 0), ",").alias("removed"), F.array_join(swap(items, 0, 1), ",").alias("swapped"))
