"""Timelines, spans and plans: orders stand in for modules, their lines for checkpoints and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import plan as P
from ..operators import timeline as T
from ..registry import query, table

ARR = "array_to_string({0}, ',')"
BASE = """WITH trig AS (SELECT l_orderkey AS module, l_linenumber * 2 AS order_, unnest([l_partkey % 30, l_suppkey % 30]) AS sample FROM lineitem),
cps AS (SELECT module, order_, list_sort(list(DISTINCT sample)) AS samples FROM trig GROUP BY 1, 2),
idx AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY order_) - 1 AS i, count(*) OVER (PARTITION BY module) - 1 AS last_ FROM cps),
pts AS (SELECT o_orderkey AS module, o_orderkey % 17 AS x FROM orders) """


def _cps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_orderkey").alias("module"), (F.col("l_linenumber") * 2).alias("order"), F.explode(F.array(F.col("l_partkey") % 30, F.col("l_suppkey") % 30)).alias("sample"))
    return T.checkpoint_sets(t)


def _points(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("module"), (F.col("o_orderkey") % 17).alias("x"))


def _text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@query(BASE + "SELECT module, order_, " + ARR.format("samples") + " AS samples FROM cps")
def checkpoint_sets(spark, sf_dir):
    return _cps(spark, sf_dir).select("module", F.col("order").alias("order_"), _text(F.col("samples")).alias("samples"))


@query(BASE + "SELECT p.module, p.x, coalesce(max(c.order_), -1) AS floor_ FROM pts p LEFT JOIN cps c ON p.module = c.module AND c.order_ <= p.x GROUP BY 1, 2")
def asof_floor(spark, sf_dir):
    c = _cps(spark, sf_dir).withColumn("floor_", F.col("order"))
    return T.asof(_points(spark, sf_dir), c, "module", "x", "order", ["floor_"]).select("module", "x", F.coalesce("floor_", F.lit(-1)).alias("floor_"))


@query(BASE + """, fl AS (SELECT p.module, p.x, coalesce(max(c.i), -1) AS i FROM pts p LEFT JOIN idx c ON p.module = c.module AND c.order_ <= p.x GROUP BY 1, 2),
need AS (SELECT f.module, f.x, unnest(c.samples) AS s FROM fl f JOIN idx c ON c.module = f.module AND c.i BETWEEN greatest(0, f.i) AND CASE WHEN f.i < 0 THEN 0 ELSE least(f.i + 1, c.last_) END)
SELECT p.module, p.x, coalesce((SELECT array_to_string(list_sort(list(DISTINCT s)), ',') FROM need n WHERE n.module = p.module AND n.x = p.x), '') AS need FROM pts p""")
def required_at(spark, sf_dir):
    return T.required_at(_points(spark, sf_dir), _cps(spark, sf_dir)).select("module", "x", _text(F.col("need")).alias("need"))


STARTS = BASE + """, raw AS (SELECT l_orderkey AS module, l_linenumber AS order_, max(CASE WHEN l_quantity > 25 THEN l_quantity::INT % 8 + 1 END) AS speed, max(CASE WHEN l_discount > 0.05 THEN 100 + l_linenumber END) AS tempo FROM lineitem GROUP BY 1, 2),
car AS (SELECT module, order_, coalesce(last_value(speed IGNORE NULLS) OVER w, 6) AS speed, coalesce(last_value(tempo IGNORE NULLS) OVER w, 125) AS tempo FROM raw WINDOW w AS (PARTITION BY module ORDER BY order_)),
starts AS (SELECT module, order_, coalesce(sum(speed * 2.5 / tempo * 64) OVER (PARTITION BY module ORDER BY order_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS seconds, sum(speed * 2.5 / tempo * 64) OVER (PARTITION BY module) AS duration FROM car) """


def _starts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    speed = F.max(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int") % 8 + 1)).alias("speed")
    tempo = F.max(F.when(F.col("l_discount") > 0.05, 100 + F.col("l_linenumber"))).alias("tempo")
    return T.order_seconds(li.groupBy(F.col("l_orderkey").alias("module"), F.col("l_linenumber").alias("order")).agg(speed, tempo))


@query(STARTS + "SELECT module, order_, round(seconds, 6) AS seconds FROM starts")
def order_seconds(spark, sf_dir):
    return _starts(spark, sf_dir).select("module", F.col("order").alias("order_"), F.round("seconds", 6).alias("seconds"))


@query(STARTS + "SELECT p.module, p.x, coalesce(max(order_), 0) AS order_ FROM pts p LEFT JOIN starts s ON p.module = s.module AND round(s.seconds, 6) <= p.x GROUP BY 1, 2")
def order_for_seconds(spark, sf_dir):
    s = _starts(spark, sf_dir).withColumn("seconds", F.round("seconds", 6)).withColumn("order_", F.col("order"))
    return T.asof(_points(spark, sf_dir), s, "module", "x", "seconds", ["order_"]).select("module", "x", F.coalesce("order_", F.lit(0)).alias("order_"))


@query(STARTS + "SELECT p.module, p.x, round(coalesce(max(seconds), 0), 6) AS seconds FROM pts p LEFT JOIN starts s ON p.module = s.module AND s.order_ <= p.x GROUP BY 1, 2")
def seconds_for_order(spark, sf_dir):
    return T.asof(_points(spark, sf_dir), _starts(spark, sf_dir), "module", "x", "order", ["seconds"]).select("module", "x", F.round(F.coalesce("seconds", F.lit(0.0)), 6).alias("seconds"))


@query(STARTS + """, need AS (SELECT a.module, a.order_, unnest(list_concat(a.samples, coalesce(b.samples, []))) AS s FROM idx a LEFT JOIN idx b ON a.module = b.module AND b.i = a.i + 1),
bad AS (SELECT module, min(order_) AS order_ FROM need WHERE s % 11 = module % 11 GROUP BY module),
edge AS (SELECT b.module, max(s.seconds) AS seconds FROM bad b JOIN starts s ON s.module = b.module AND s.order_ <= b.order_ GROUP BY 1)
SELECT d.module, round(coalesce(CASE WHEN b.module IS NOT NULL THEN coalesce(e.seconds, 0) END, d.duration), 6) AS seconds FROM (SELECT DISTINCT module, round(duration, 6) AS duration FROM starts) d LEFT JOIN bad b USING (module) LEFT JOIN edge e USING (module)""")
def playable_seconds(spark, sf_dir):
    c, s = _cps(spark, sf_dir), _starts(spark, sf_dir)
    resident = c.select("module", F.explode("samples").alias("sample")).where("sample % 11 <> module % 11")
    durations = s.groupBy("module").agg(F.round(F.sum(F.col("speed") * 2.5 / F.col("tempo") * 64), 6).alias("duration"))
    return T.playable_seconds(c, resident, s, durations).select("module", F.round("seconds", 6).alias("seconds"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, greatest(1, ceil(count(*) OVER (PARTITION BY user_id) / 16.0))::INT AS s FROM events) WHERE n % s = 0")
def strided(spark, sf_dir):
    return T.strided(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 16).select("user_id", "event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latched FROM events")
def latch_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("set", F.when(F.col("event_type") == "click", F.col("value")))
    return T.latch_forward(e, "user_id", ["ts", "event_id"], "set").select("event_id", "latched")


@query("SELECT user_id AS channel, arg_max(value, (ts, event_id)) AS note FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def held_notes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("value")).alias("note"))
    return T.held_notes(e, F.lit("2024-01-20").cast("timestamp")).select("channel", "note")


SLOTS = BASE + ", os AS (SELECT module, slot, list_sort(list(DISTINCT order_)) AS orders FROM (SELECT module, order_, unnest(samples) AS slot FROM cps) GROUP BY 1, 2) "
NEED = "CASE WHEN orders IS NULL THEN 9223372036854775807 WHEN len(list_filter(orders, lambda o: o >= {0})) > 0 THEN list_min(list_filter(orders, lambda o: o >= {0})) - {0} ELSE 1000000000 + {0} - list_max(orders) END"


@query(SLOTS + "SELECT module, slot, " + ARR.format("orders") + " AS orders FROM os")
def orders_for_slot(spark, sf_dir):
    return T.orders_for_slot(_cps(spark, sf_dir)).select("module", "slot", _text(F.col("orders")).alias("orders"))


@query(SLOTS + f"SELECT module, slot, need::BIGINT AS need, row_number() OVER (PARTITION BY module ORDER BY need, slot) AS place FROM (SELECT module, slot, {NEED.format('(module % 9)')} AS need FROM os)")
def prefetch_order(spark, sf_dir):
    from pyspark.sql import Window as W

    o = T.orders_for_slot(_cps(spark, sf_dir)).withColumn("need", T.need_key(F.col("orders"), F.col("module") % 9))
    return o.select("module", "slot", "need", F.row_number().over(W.partitionBy("module").orderBy("need", "slot")).alias("place"))


@query(SLOTS + f""", all_ AS (SELECT DISTINCT l_orderkey AS module, unnest([l_partkey % 30, l_suppkey % 30, 31]) AS slot FROM lineitem), first_ AS (SELECT module, list(DISTINCT s) AS need FROM (SELECT module, unnest(samples) AS s FROM idx WHERE i = 0) GROUP BY 1),
k AS (SELECT a.module, a.slot, CASE WHEN list_contains(f.need, a.slot) THEN -1 ELSE {NEED.format('3')} END::BIGINT AS need_key FROM all_ a LEFT JOIN os USING (module, slot) LEFT JOIN first_ f USING (module))
SELECT module, slot, need_key, row_number() OVER (PARTITION BY module ORDER BY need_key, slot) AS place FROM k""")
def stream_order(spark, sf_dir):
    """Delivery order: checkpoints start at order 2 here, so the first one is needed at 0."""
    li = table(spark, sf_dir, "lineitem")
    slots = li.select(F.col("l_orderkey").alias("module"), F.explode(F.array(F.col("l_partkey") % 30, F.col("l_suppkey") % 30, F.lit(31))).alias("slot")).distinct()
    return T.stream_order(slots, _cps(spark, sf_dir), F.lit(3))


@query(SLOTS + f""", all_ AS (SELECT DISTINCT l_orderkey AS module, unnest([l_partkey % 30, l_suppkey % 30, 31]) AS slot FROM lineitem), first_ AS (SELECT module, list(DISTINCT s) AS need FROM (SELECT module, unnest(samples) AS s FROM idx WHERE i = 0) GROUP BY 1),
k AS (SELECT a.module, a.slot, CASE WHEN list_contains(f.need, a.slot) THEN -1 ELSE {NEED.format('0')} END::BIGINT AS need_key FROM all_ a LEFT JOIN os USING (module, slot) LEFT JOIN first_ f USING (module)),
p AS (SELECT module, row_number() OVER (PARTITION BY module ORDER BY need_key, slot) AS place, slot FROM k)
SELECT module, place, 'sample' AS kind, slot FROM p UNION ALL SELECT module, 0, 'skeleton', NULL FROM p GROUP BY module UNION ALL SELECT module, max(place) + 1, 'complete', NULL FROM p GROUP BY module""")
def delivery_events(spark, sf_dir):
    """What a player is sent, from the skeleton to the end."""
    li = table(spark, sf_dir, "lineitem")
    slots = li.select(F.col("l_orderkey").alias("module"), F.explode(F.array(F.col("l_partkey") % 30, F.col("l_suppkey") % 30, F.lit(31))).alias("slot")).distinct()
    return T.deliveries(slots, _cps(spark, sf_dir), F.lit(0))


LINES = "WITH s AS (SELECT l_orderkey AS module, l_linenumber AS slot, l_partkey % 10 AS offset_, l_quantity::BIGINT AS length, l_returnflag = 'R' AS compressed, l_partkey FROM lineitem) "


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_linenumber").alias("slot"), (F.col("l_partkey") % 10).alias("offset"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_returnflag") == "R").alias("compressed"), "l_partkey")


@query(LINES + ", d AS (SELECT module, slot, max(CASE WHEN l_partkey % 4 = 0 THEN 0 WHEN l_partkey % 4 = 1 THEN length + 1 ELSE length END) AS length FROM s GROUP BY 1, 2) SELECT s.module, s.slot, s.length FROM s JOIN d USING (module, slot) WHERE d.length > 0 AND d.length = s.length")
def slot_dump_join(spark, sf_dir):
    s = _lines(spark, sf_dir)
    length = F.when(F.col("l_partkey") % 4 == 0, 0).when(F.col("l_partkey") % 4 == 1, F.col("length") + 1).otherwise(F.col("length"))
    dumps = s.groupBy("module", "slot").agg(F.max(length).alias("length"))
    return P.match_dumps(s, dumps).select("module", "slot", "length")


@query(LINES + ", last AS (SELECT module, offset_, max(slot) AS slot FROM s GROUP BY 1, 2) SELECT o.module, o.offset_, l.slot FROM (SELECT DISTINCT module, unnest(range(10)) AS offset_ FROM s) o JOIN last l USING (module, offset_)")
def offset_lookup(spark, sf_dir):
    s = _lines(spark, sf_dir)
    offsets = s.select("module").distinct().select("module", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("offset"))
    return P.slots_of_offsets(offsets, s).select("module", F.col("offset").alias("offset_"), "slot")


@query(LINES + ", need AS (SELECT DISTINCT module, offset_ AS slot FROM s WHERE offset_ < 4) SELECT s.module, s.slot, s.l_partkey FROM s LEFT JOIN need n ON n.module = s.module AND n.slot = s.slot WHERE NOT compressed OR n.slot IS NOT NULL")
def covered_slots(spark, sf_dir):
    s = _lines(spark, sf_dir)
    c = s.where("offset < 4").groupBy("module").agg(F.collect_set("offset").alias("samples"))
    return P.covered(s, c).select("module", "slot", "l_partkey")


@query(BASE + "SELECT module, order_, array_to_string(list_sort(list_filter(samples, lambda x: x % 3 = 1)), ',') AS samples FROM cps WHERE len(list_filter(samples, lambda x: x % 3 = 1)) > 0")
def plan_prune(spark, sf_dir):
    c = _cps(spark, sf_dir)
    streamed = c.select("module", F.explode("samples").alias("slot")).where("slot % 3 = 1").distinct()
    return P.prune(c, streamed).select("module", F.col("order").alias("order_"), _text(F.col("samples")).alias("samples"))


@query(LINES + "SELECT module, sum(length * 2000)::BIGINT AS size, sum(CASE WHEN slot <= 2 THEN length * 2000 ELSE 0 END)::BIGINT AS warm, bool_or(compressed) AS compressed, sum(CASE WHEN slot > 2 THEN length * 2000 ELSE 0 END) < 131072 AND bool_or(compressed) AS resident FROM s GROUP BY module")
def saving_gate(spark, sf_dir):
    m = _lines(spark, sf_dir).groupBy("module").agg(F.sum(F.col("length") * 2000).alias("size"), F.sum(F.when(F.col("slot") <= 2, F.col("length") * 2000).otherwise(0)).alias("warm"), F.bool_or("compressed").alias("compressed"))
    return P.saving_gate(m)


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey) AS slot FROM lineitem")
def global_slot(spark, sf_dir):
    return P.global_slots(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_suppkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "slot")


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM lineitem")
def prefix_offsets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("long"))
    return I.prefix_offsets(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "n").select("l_orderkey", "l_linenumber", "l_partkey", F.col("offset").alias("off"))


SPANS = "WITH sp AS (SELECT l_orderkey AS module, l_partkey % 300 AS start, l_partkey % 300 + l_quantity::BIGINT * 3 AS stop FROM lineitem) "
MERGED = SPANS + """, cl AS (SELECT module, start, least(stop, 350) AS stop FROM sp WHERE start < 350), b AS (SELECT *, max(stop) OVER (PARTITION BY module ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM cl),
g AS (SELECT *, sum(CASE WHEN start > coalesce(before_, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY module ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM b), m AS (SELECT module, min(start) AS start, max(stop) AS stop FROM g GROUP BY module, island) """


def _spans(spark, sf_dir):
    start = F.col("l_partkey") % 300
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 3).alias("stop"), F.lit(350).cast("long").alias("size"))


@query(MERGED + "SELECT module, start, stop FROM m")
def merge_spans(spark, sf_dir):
    return I.merge_spans(_spans(spark, sf_dir), "module", "size")


@query(MERGED + ", r AS (SELECT * FROM m UNION ALL SELECT DISTINCT module, 350, 350 FROM sp), c AS (SELECT module, coalesce(lag(stop) OVER (PARTITION BY module ORDER BY start, stop), 0) AS start, start AS stop, stop - start AS zeros FROM r) SELECT * FROM c WHERE stop > start OR zeros > 0")
def interval_complement(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return I.complement(I.merge_spans(s, "module", "size"), s.select("module", "size").distinct(), "module", "size")


@query("""WITH RECURSIVE sp AS (SELECT l_orderkey AS module, l_partkey % 300 AS start, l_partkey % 300 + l_quantity::BIGINT * 3 AS stop FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY start, stop) AS n FROM sp),
f AS (SELECT module, n, start, stop, start >= 0 AS kept, stop AS last_ FROM o WHERE n = 1 UNION ALL SELECT o.module, o.n, o.start, o.stop, o.start >= f.last_, CASE WHEN o.start >= f.last_ THEN o.stop ELSE f.last_ END FROM f JOIN o ON o.module = f.module AND o.n = f.n + 1)
SELECT module, start, stop FROM f WHERE kept""")
def greedy_overlap(spark, sf_dir):
    return I.greedy(_spans(spark, sf_dir), "module")


@query("""WITH r AS (SELECT user_id, event_id, ts, floor(value * 2)::BIGINT AS first_, floor(value * 2)::BIGINT + event_id % 40 AS last_ FROM events), s AS (SELECT *, coalesce(first_ <= lag(last_) OVER w + 1, false) AS sequential FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, sequential, sum(CASE WHEN sequential THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM s""")
def sequential_runs(spark, sf_dir):
    first = F.floor(F.col("value") * 2)
    r = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", first.alias("first"), (first + F.col("event_id") % 40).alias("last"))
    return I.sequential_runs(r, "user_id", ["ts", "event_id"]).select("event_id", "sequential", "run")
