"""The stored catalogue, its snapshots and small state files, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import sessions as Z
from ..registry import query, table
from ..sources import modules as M
from ..sources import store
from ..functions import strings as S
from .catalog import HITS, LISTS, MODULES, modules, stored

FULL = "id, source, filename, format, title, duration, channels, num_samples, NULL::BIGINT AS num_instruments, NULL::BIGINT AS num_subsongs, root_cid, NULL::BIGINT AS num_blocks, size_bytes, instruments, comment, ingested_at"


@query(MODULES + f"SELECT {FULL} FROM modules")
def catalog_table(spark, sf_dir):
    """The written table by its declared schema."""
    return store.read(spark, stored(spark, sf_dir), "modules")


@query(MODULES + f""", tok AS (SELECT id, {LISTS} FROM modules), t AS (SELECT id, 'title' AS k, unnest(c) AS term FROM tok UNION ALL SELECT id, 'filename', unnest(n) FROM tok UNION ALL SELECT id, 'instruments', unnest(i) FROM tok UNION ALL SELECT id, 'comment', unnest(o) FROM tok)
SELECT 'modules' AS name, (SELECT count(*) FROM modules) AS rows, true AS same UNION ALL SELECT 'meta', 2, true UNION ALL SELECT 'postings', (SELECT count(DISTINCT (id, k, term)) FROM t), true UNION ALL SELECT 'totals', 1, true""")
def catalog_snapshot(spark, sf_dir):
    """Tables of a published snapshot, found by its name, against the catalogue."""
    folder = stored(spark, sf_dir)

    def build(root):
        store.publish(spark, folder, root, "catalogue")
        store.publish(spark, folder, root, "catalogue")

    path = store.latest(spark, store.stored_once(spark, (sf_dir,), "published", build), "catalogue")
    rows = [(t, store.checksum(store.read(spark, path, t)), store.checksum(store.read(spark, folder, t))) for t in store.TABLES]
    return spark.createDataFrame([(t, int(a.split(":")[0]), a == b) for t, a, b in rows], "name string, rows long, same boolean")


GROWN = MODULES.replace("FROM documents)", "FROM documents), grown AS (SELECT row_number() OVER (ORDER BY source) AS rn, * FROM modules WHERE id % 4 = 0)")


@query(GROWN + ", kept AS (SELECT * FROM modules WHERE id % 4 <> 0) SELECT id, source FROM kept UNION ALL SELECT (SELECT max(id) FROM kept) + rn, source FROM grown")
def catalog_append(spark, sf_dir):
    """A catalogue of three quarters, then a load of everything: new sources are numbered on."""
    m = modules(spark, sf_dir)

    def build(folder):
        store.write_catalog(m.where("id % 4 <> 0"), folder)
        store.append(m.drop("id"), folder)

    return store.read(spark, store.stored_once(spark, (sf_dir,), "grown", build), "modules").select("id", "source")


@query(MODULES + "SELECT format, count(*) AS count FROM modules GROUP BY format")
def catalog_meta(spark, sf_dir):
    """Counts by format as the grown catalogue's meta table has them."""
    m = modules(spark, sf_dir)

    def build(folder):
        store.write_catalog(m.where("id % 4 <> 0"), folder)
        store.append(m.drop("id"), folder)

    return C.read_format_counts(store.read(spark, store.stored_once(spark, (sf_dir,), "grown", build), "meta"))


@query(MODULES + "SELECT 'total' AS key, '12' AS value UNION ALL SELECT 'note', 'new' UNION ALL SELECT 'formats', (SELECT count(DISTINCT format) FROM modules)::VARCHAR")
def meta_upsert(spark, sf_dir):
    """A key that is there is replaced, one that isn't is added."""
    m = modules(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("format").alias("formats"))
    meta = m.select(F.explode(F.create_map(F.lit("total"), F.col("total").cast("string"), F.lit("formats"), F.col("formats").cast("string"))).alias("key", "value"))
    return C.upsert_meta(meta, spark.createDataFrame([("total", "12"), ("note", "new")], "key string, value string"))


@query(MODULES + "SELECT (SELECT count(*) FROM modules) AS good, 0::BIGINT AS bad, (SELECT count(*) FROM modules) AS none")
def meta_total(spark, sf_dir):
    """The total from meta, from a value that is no number, and without the key."""
    folder = stored(spark, sf_dir)
    m, meta = store.read(spark, folder, "modules"), store.read(spark, folder, "meta")
    totals = [store.total_of(x, m) for x in (meta, meta.withColumn("value", F.lit("x")), meta.limit(0))]
    return spark.createDataFrame([tuple(totals)], "good long, bad long, none long")


@query(MODULES + "SELECT id, root_cid FROM modules WHERE source IN ('src1!41', (SELECT min(source) FROM modules))")
def get_source(spark, sf_dir):
    m = modules(spark, sf_dir)
    first = m.agg(F.min("source")).first()[0]
    return C.get_source(m, "src1!41").unionByName(C.get_source(m, first)).distinct()


@query(MODULES + 'SELECT id, title, size_bytes AS "sizeBytes", root_cid AS "rootCid", num_samples AS "numSamples", ingested_at AS "ingestedAt" FROM modules')
def camel_case(spark, sf_dir):
    return C.camel_names(modules(spark, sf_dir).select("id", "title", "size_bytes", "root_cid", "num_samples", "ingested_at"))


@query(f"SELECT {HITS} FROM ({MODULES} SELECT * FROM modules) ORDER BY size_bytes, id LIMIT 100")
def by_size(spark, sf_dir):
    """Smallest first."""
    return modules(spark, sf_dir).orderBy("size_bytes", "id").limit(100).select(*C.HIT)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents QUALIFY doc_id % 10 = 3")
def row_position(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return Z.place_of(d, "doc_id", d.where("doc_id % 10 = 3")).select("doc_id", "place")


@query("SELECT doc_id FROM documents ORDER BY md5('5|' || doc_id), doc_id LIMIT 100")
def shuffled_sample(spark, sf_dir):
    return Z.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, 100)


@query("SELECT root, bool_or(complete) AS complete FROM (SELECT source AS root, doc_id % 5 = 0 AS complete FROM documents UNION ALL SELECT source, quality = 1 FROM documents JOIN labels USING (doc_id)) GROUP BY root")
def held_map(spark, sf_dir):
    """Held roots from a JSON map for each row, merged with new marks."""
    d = table(spark, sf_dir, "documents")
    text = F.to_json(F.create_map("source", F.col("doc_id") % 5 == 0))
    held = d.select(F.explode(store.load_flags(text)).alias("root", "complete"))
    marks = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("root"), (F.col("quality") == 1).alias("complete"))
    return store.merge_held(held, marks)


@query("SELECT doc_id, 0 AS n FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 3 = 1")
def flags_lenient(spark, sf_dir):
    """Entries of JSON maps; a text that is none has none."""
    text = F.when(F.col("doc_id") % 3 == 0, "{nonsense").when(F.col("doc_id") % 3 == 1, '{"a": true}')
    return table(spark, sf_dir, "documents").where("doc_id % 3 < 2").select("doc_id", F.size(F.map_keys(store.load_flags(text))).alias("n"))


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN conv_id % 4 = 0 THEN '' ELSE string_agg(role, ',' ORDER BY turn) END AS titles, -1 AS index FROM conversations GROUP BY conv_id")
def queue_store(spark, sf_dir):
    """Play lists saved and loaded again; every fourth is damaged."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(x["turn"].alias("id"), x["role"].alias("title")))
    q = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(store.save_queue(items).alias("text"))
    q = q.withColumn("q", store.load_queue(F.when(F.col("conv_id") % 4 == 0, F.substring("text", 2, 5)).otherwise(F.col("text"))))
    return q.select("conv_id", F.size("q.items").alias("n"), F.array_join(F.col("q.items.title"), ",").alias("titles"), F.col("q.index").alias("index"))


@query("SELECT doc_id, sha256('{\"a\":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE doc_id::VARCHAR END || ',\"b\":\"' || source || '\",\"lang\":\"' || lang || '\"}') AS cid FROM documents")
def canonical_blocks(spark, sf_dir):
    """Addresses of values as canonical text."""
    d = table(spark, sf_dir, "documents")
    text = store.canonical_json({"lang": F.col("lang"), "b": F.col("source"), "a": F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))})
    return d.select("doc_id", F.sha2(text, 256).alias("cid"))


@query("SELECT page_id AS path, page_id * 7919 % 10007 AS modified FROM pages ORDER BY modified DESC, path OFFSET 7")
def rotation(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), (F.col("page_id") * 7919 % 10007).alias("modified"))
    return store.rotated(files, 7)


GAUGE = "'# HELP cairn_{0} {1}' || chr(10) || '# TYPE cairn_{0} gauge' || chr(10) || 'cairn_{0} ' || {2} || chr(10)"


@query(f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {GAUGE.format('up', '1 if the node answered', "'0'")} ELSE {GAUGE.format('up', '1 if the node answered', "'1'")} || {GAUGE.format('peers', 'connected peers', "floor(value)::BIGINT::VARCHAR")}
|| {GAUGE.format('catalog_peers', 'peers on the catalogue topic', "'0'")} || {GAUGE.format('pins', 'pinned roots', "user_id::VARCHAR")} END AS text FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL""")
def gauges(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value IS NOT NULL AND user_id IS NOT NULL")
    status = F.when(F.col("event_id") % 4 == 0, "connection refused").otherwise(F.to_json(F.struct(F.col("value").alias("Peers"), F.col("user_id").alias("Pins"))))
    return e.select("event_id", store.gauge_lines(status).alias("text"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events WHERE value IS NOT NULL")
def poll_snapshot(spark, sf_dir):
    """Every third poll fails; the last good values stay."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "user_id", "ts", "value")
    return store.kept_snapshot(e, "user_id", ["ts", "event_id"], F.col("event_id") % 3 != 0, ["value"]).select("event_id", "user_id", "value")


@query("SELECT event_id, 'n' || user_id AS name, event_id AS seq, event_type AS value FROM events WHERE event_id % 5 > 2")
def gossip_messages(spark, sf_dir):
    """Messages without a name, without a number or not in JSON are dropped."""
    from ..streaming.state import gossip

    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    whole = F.to_json(F.struct(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("seq"), F.col("event_type").alias("value")))
    text = F.when(k == 0, "{torn").when(k == 1, '{"name": "", "seq": 1}').when(k == 2, '{"name": "x"}').otherwise(whole)
    return gossip(e.select("event_id", text.alias("text")), "text").select(F.col("seq").alias("event_id"), "name", "seq", "value")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE CASE doc_id % 4 WHEN 0 THEN 65536 WHEN 1 THEN 512 WHEN 2 THEN 4096 ELSE 16384 END * (doc_id + 70000) END AS bytes FROM documents")
def page_header_size(spark, sf_dir):
    """File sizes by database headers; every fifth has another mark."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    size = F.when(n % 4 == 0, "0001").when(n % 4 == 1, "0200").when(n % 4 == 2, "1000").otherwise("4000")
    mark = F.when(n % 5 == 4, F.lit("53514C69746520666F726D6174203400")).otherwise("53514C69746520666F726D6174203300")
    head = F.unhex(F.concat(mark, size, F.repeat(F.lit("00"), F.lit(10)), F.lpad(F.hex(n + 70000), 8, "0"), F.repeat(F.lit("00"), F.lit(68))))
    return d.select("doc_id", M.database_size(head).cast("long").alias("bytes"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN '—' ELSE printf('%.1f%%', round(100.0 * (n_chars // 3) / n_chars, 1)) END AS label FROM documents")
def percent_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.percent_label(F.floor(F.col("n_chars") / 3), F.col("n_chars")).alias("label"))


@query("SELECT page_id, array_to_string(list_transform(range(1, octet_length(encode(u)) + 1), lambda i: CASE WHEN regexp_matches(chr(('0x' || substr(hex(encode(u)), (2 * i - 1)::INT, 2))::INT), '^[A-Za-z0-9._~-]$') THEN chr(('0x' || substr(hex(encode(u)), (2 * i - 1)::INT, 2))::INT) ELSE '%' || substr(hex(encode(u)), (2 * i - 1)::INT, 2) END), '') AS encoded FROM (SELECT page_id, url || ' +*~é' AS u FROM pages)")
def percent_encode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.percent_encoded(F.concat("url", F.lit(" +*~é"))).alias("encoded"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'checking' WHEN 1 THEN 'direct' ELSE 'relayed' END AS label, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS flag FROM events")
def labels_and_flags(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    spelled = F.when(n % 4 == 0, " YES").when(n % 4 == 1, "Off").when(n % 4 == 2, "maybe").otherwise("0")
    return e.select("event_id", S.reachable_label(F.when(n % 3 != 0, n % 3 == 1)).alias("label"), S.truthy(spelled, True).alias("flag"))


@query("WITH g AS (SELECT text, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text) SELECT first, n, 16 AS digits FROM g")
def hash_groups(spark, sf_dir):
    """Equal contents by a 64-bit hash."""
    from ..operators.blocks import group_hash

    d = table(spark, sf_dir, "documents").select("doc_id", group_hash(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).select("first", "n", F.length("h").alias("digits"))


@query("SELECT DISTINCT sha256(text) AS cid FROM documents WHERE n_chars % 3 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def leaves_touched(spark, sf_dir):
    """Addresses of touched nodes without links that weren't known."""
    from ..operators.blocks import new_leaves

    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("cid"), (F.col("n_chars") % 3).alias("links"))
    return new_leaves(d, d.where("doc_id % 2 = 1"))


@query(MODULES + "SELECT source AS name, sha256(string_agg(comment, '' ORDER BY id)) AS digest FROM (SELECT id, comment, split_part(source, '!', 1) AS source FROM modules) GROUP BY source")
def block_put(spark, sf_dir):
    """Blocks put twice are stored once; files come back whole."""
    from ..operators import blocks as K

    m = modules(spark, sf_dir).select(F.col("id").alias("ord"), F.split_part("source", F.lit("!"), F.lit(1)).alias("name"), F.col("root_cid").alias("cid"), F.col("comment").cast("binary").alias("bytes"))
    kept = K.put(m.where("ord % 2 = 0").select("cid", "bytes").dropDuplicates(["cid"]), m)
    return K.reassemble(m.select("name", "ord", "cid"), kept, "name").select("name", F.sha2("bytes", 256).alias("digest"))
