"""Requests, peers and state machines beyond the session's own, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peers as P
from ..operators import signal as G
from ..registry import query, table
from ..streaming import state as ST


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT DISTINCT 'p' || user_id AS peer FROM events WHERE user_id <> 5 AND user_id NOT IN (SELECT r_regionkey FROM region)")
def forward_targets(spark, sf_dir):
    peers = _events(spark, sf_dir).select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("peer")).distinct()
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("peer"))
    return P.forward_targets(peers, seeds, "p5")


@query("""WITH r AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 3 = 0 THEN 'bad' || l_partkey ELSE 'bafkrei' || translate(md5(l_partkey::VARCHAR), '0189', 'ghij') END ORDER BY l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'bad' || l_partkey ELSE 'bafkrei' || translate(md5(l_partkey::VARCHAR), '0189', 'ghij') END)[1:4] AS c FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter(c, lambda x: starts_with(x, 'baf')), ',') AS cids FROM r""")
def request_cids(spark, sf_dir):
    """The first four addresses of each request; unreadable ones are skipped."""
    cid = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("bad"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("bafkrei"), F.translate(F.md5(F.col("l_partkey").cast("string").cast("binary")), "0189", "ghij")))
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", cid.alias("cid")))), lambda x: x["cid"]).alias("c"))
    return r.select("l_orderkey", F.array_join(P.requested(F.col("c"), 4), ",").alias("cids"))


@query("SELECT DISTINCT 'H' || user_id AS peer FROM events WHERE event_id % 3 = 0 AND user_id > 2 AND user_id NOT IN (SELECT r_regionkey FROM region)")
def warm_hops(spark, sf_dir):
    """Relays of providers behind them, without this node and the seeds."""
    user = F.col("user_id").cast("string")
    circuit = F.concat(F.lit("/ip4/1.2.3.4/tcp/1/p2p/H"), user, F.lit("/p2p-circuit/p2p/Q"), user)
    rows = _events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, circuit).otherwise(F.concat(F.lit("/ip4/1.2.3.4/tcp/1/p2p/H"), user)).alias("address"))
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("H"), F.col("r_regionkey").cast("string")).alias("peer"))
    own = spark.createDataFrame([("H1",), ("H2",)], "peer string")
    return P.warm_hops(rows, seeds.unionByName(own).distinct(), "H0")


@query("SELECT user_id, CASE WHEN s IN ('click', 'error') THEN CASE s WHEN 'click' THEN 'public' ELSE 'private' END ELSE 'unknown' END AS state FROM (SELECT user_id, max_by(event_type, (ts, event_id)) AS s FROM events GROUP BY user_id)")
def reachability(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "public").when(F.col("event_type") == "error", "private").otherwise(F.col("event_type"))
    return P.last_state(_events(spark, sf_dir).withColumn("state", state), "user_id", ["ts", "event_id"], "state")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 4 = 0")
def decimated(spark, sf_dir):
    return P.decimated(_events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT event_id, user_id, CASE WHEN b IS NOT NULL THEN greatest(event_id, b) END AS effective FROM (SELECT event_id, user_id, event_type, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS b FROM events) WHERE event_type <> 'purchase'")
def provide_buffer(spark, sf_dir):
    """Messages before a player's first start wait for it."""
    return P.delivered(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type", "purchase").select("event_id", "user_id", "effective")


@query("SELECT event_id, true AS within, true AS exact FROM events")
def jitter_range(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", P.jittered(30, 10, 3).alias("j"), P.jittered(7, 0, 3).alias("k"))
    return e.select("event_id", F.col("j").between(20, 40).alias("within"), (F.col("k") == 7).alias("exact"))


@query("SELECT p_partkey, (p_size * 1000 - p_size * 300 - p_partkey % 97 * 100) / 50.0 > p_size % 7 * 40.0 AS wins FROM part")
def crossover(spark, sf_dir):
    p = F.col
    return table(spark, sf_dir, "part").select("p_partkey", P.streaming_wins(p("p_size") * 1000, p("p_size") * 300, p("p_partkey") % 97 * 100, F.lit(50.0), p("p_size") % 7, F.lit(40.0)).alias("wins"))


@query("""WITH RECURSIVE b AS (SELECT doc_id, n_chars * 100 AS size, n_chars * (doc_id % 120) AS need, 0::BIGINT AS lo, n_chars * 100 AS hi, n_chars * 100 AS found, 0 AS it FROM documents
UNION ALL SELECT doc_id, size, need, CASE WHEN (lo + hi) // 2 >= need THEN lo ELSE (lo + hi) // 2 END, CASE WHEN (lo + hi) // 2 >= need THEN (lo + hi) // 2 ELSE hi END, CASE WHEN (lo + hi) // 2 >= need THEN (lo + hi) // 2 ELSE found END, it + 1
FROM b WHERE it < 16 AND hi - lo > greatest(256, size * 0.005)) SELECT doc_id, max_by(found, it) AS found FROM b GROUP BY doc_id""")
def bisect_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 100).alias("size"), (F.col("n_chars") * (F.col("doc_id") % 120)).alias("need"))
    return d.select("doc_id", P.least_prefix(F.col("size"), lambda n: n >= F.col("need")).alias("found"))


@query("SELECT event_id, true AS recent FROM events")
def now_millis(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", (P.now_millis() > F.unix_millis(F.col("ts").cast("timestamp"))).alias("recent"))


@query("SELECT l_orderkey, bool_and(l_linenumber <> 3) AS same FROM lineitem GROUP BY l_orderkey")
def bit_equal(spark, sf_dir):
    """Arrays against copies in which one value may differ."""
    q = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q"))))
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(q.alias("a"))
    values = F.transform("a", lambda x: x["q"])
    other = F.transform("a", lambda x: F.when(x["l_linenumber"] == 3, x["q"] + 1e-9).otherwise(x["q"]))
    return r.select("l_orderkey", G.bit_equal(values, other).alias("same"))


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, count(*) AS points, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY l_suppkey")
def seek_means(spark, sf_dir):
    """Means over points, and a ratio of sums."""
    from ..operators.seek import means

    return means(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber % 3, l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def ordered_events(spark, sf_dir):
    """Events by row, those of one row as they came."""
    from ..operators.seek import in_rows

    e = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("row"), F.col("l_linenumber").alias("seq"), "l_partkey")
    return in_rows(e, "l_orderkey", "l_partkey").select("l_orderkey", F.array_join("items", ",").alias("parts"))


@query()
def bounded_buckets(spark, sf_dir):
    """Token buckets of a node that remembers eight peers; tested by a plain walk."""
    e = _events(spark, sf_dir).select((F.col("event_id") % 7).alias("node"), F.col("user_id").alias("peer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (F.col("event_id") % 400 + 1).alias("n"))
    e = e.withColumn("at", F.col("us") / 1e6)
    step = lambda state, row: ST.bounded_buckets(state, row, peers=8)
    return ST.replay(e.select("node", "event_id", "peer", "at", "n"), step, "node", ["at", "event_id"], "node long, event_id long, allowed boolean, known int")


@query()
def admission(spark, sf_dir):
    """Requests that find three places taken are refused; tested by a plain walk."""
    e = _events(spark, sf_dir).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")).withColumn("until", F.col("at") + 20000 + F.col("event_id") % 1000)
    return ST.replay(e, lambda s, r: ST.slots_held(s, r, 3), "user_id", ["at", "event_id"], "user_id long, event_id long, admitted boolean, open int")


@query()
def page_reads(spark, sf_dir):
    """Chunks that reads fetch through a cache with read-ahead; tested by a plain walk."""
    e = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") * 13 % 200).cast("int").alias("first"))
    e = e.withColumn("last", F.least(F.col("first") + (F.col("event_id") % 3).cast("int"), F.lit(199))).withColumn("end", F.lit(199))
    return ST.replay(e, ST.page_cache, "user_id", ["event_id"], "user_id long, event_id long, fetched int, upto int")


@query()
def player_buffer(spark, sf_dir):
    """Samples that come before their player; tested by a plain walk."""
    kind = F.when(F.col("event_type") == "purchase", "init").otherwise("provide")
    e = _events(spark, sf_dir).select("user_id", "event_id", kind.alias("kind"), F.col("event_id").alias("sample"))
    return ST.replay(e, ST.player, "user_id", ["event_id"], "user_id long, event_id long, applied string")
