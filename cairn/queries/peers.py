"""Peers, records, requests and state machines: events stand in for snapshots and messages, users for peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peers as R
from ..operators import signal as G
from ..registry import query, table
from ..streaming import state as St

E = "WITH e AS (SELECT *, epoch(ts) AS at_ FROM events) "
ORDER = ["ts", "event_id"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


PEERS = "WITH t AS (SELECT user_id, sum(floor(value))::BIGINT AS bytes FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 <> 0), p AS (SELECT coalesce(c.user_id, t.user_id) AS user_id, c.user_id IS NOT NULL AS connected, coalesce(bytes, 0) AS bytes FROM c FULL JOIN t ON c.user_id = t.user_id) "


def _peers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum(F.floor("value")).alias("bytes"))
    return R.full_view(e.where("event_type = 'signup' AND user_id % 3 <> 0").select("user_id"), t, "user_id")


@query(PEERS + "SELECT * FROM p")
def peer_full_outer(spark, sf_dir):
    return _peers(spark, sf_dir)


@query(PEERS + "SELECT * FROM p ORDER BY connected DESC, bytes DESC, user_id LIMIT 25")
def peer_sort(spark, sf_dir):
    return R.ranked(_peers(spark, sf_dir), "user_id").limit(25)


@query(PEERS + "SELECT sum(bytes)::BIGINT AS bytes, sum(CASE WHEN user_id % 10 <> 0 THEN bytes ELSE 0 END)::BIGINT AS peer_bytes, count(*) FILTER (user_id % 10 <> 0) AS peers FROM p")
def peer_totals(spark, sf_dir):
    p = _peers(spark, sf_dir).withColumn("role", F.when(F.col("user_id") % 10 == 0, "master").otherwise("other"))
    return R.totals(p, "role", "master")


@query(PEERS + "SELECT user_id, bytes, floor(100.0 * bytes / (SELECT sum(bytes) FROM p) + 0.5)::INT AS percent FROM p")
def peer_share(spark, sf_dir):
    return R.share(_peers(spark, sf_dir).select("user_id", "bytes"), "bytes")


@query("SELECT CASE WHEN event_id % 5 = 2 THEN 'relay' WHEN event_id % 5 = 3 THEN 'unknown' ELSE 'direct' END AS hop, count(*) AS n FROM events GROUP BY 1")
def hop_classes(spark, sf_dir):
    from .scalars import ADDRESSES, _pick

    e = table(spark, sf_dir, "events").select(_pick(F.col("event_id") % 5, *ADDRESSES).alias("address"))
    return R.hop_classes(e, "address")


@query(E + ", c AS (SELECT event_id, user_id, ts, at_, sum(floor(value)) OVER (PARTITION BY user_id, event_id // 5000 ORDER BY ts, event_id) AS down FROM e), d AS (SELECT event_id, at_ - lag(at_) OVER w AS dt, down - lag(down) OVER w AS dd FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(CASE WHEN dt > 0 THEN greatest(0.0, dd / dt) ELSE 0.0 END, 6) AS rate FROM d")
def rate_from_counters(spark, sf_dir):
    from pyspark.sql import Window as W

    down = F.sum(F.floor("value")).over(W.partitionBy("user_id", F.floor(F.col("event_id") / 5000)).orderBy(*ORDER))
    e = _events(spark, sf_dir).withColumn("down", down)
    return R.rates(e, "user_id", "at", ["down"], ORDER).select("event_id", F.round("down_rate", 6).alias("rate"))


@query("SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), ',') AS history FROM events")
def rolling_history(spark, sf_dir):
    h = R.rolling_history(table(spark, sf_dir, "events"), "user_id", ORDER, "event_id")
    return h.select("event_id", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query("WITH r AS (SELECT *, event_type <> 'error' AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT event_id, CASE WHEN ok THEN epoch_us(min(CASE WHEN ok THEN ts END) OVER (PARTITION BY user_id, run)) END AS since FROM r")
def connected_since(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return R.connected_since(e, "user_id", ORDER, "us", "ok").select("event_id", "since")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS progress FROM events")
def monotonic_progress(spark, sf_dir):
    return R.monotonic(table(spark, sf_dir, "events"), "user_id", ORDER, "value").select("event_id", "progress")


@query("SELECT user_id, arg_max(event_id, (floor(value)::BIGINT, -event_id)) AS event_id, max(floor(value)::BIGINT) AS seq FROM events WHERE event_type <> 'error' GROUP BY user_id")
def newest_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").alias("seq"))
    return R.newest(e, "user_id", "seq", "event_id", F.col("event_type") != "error").select("user_id", "event_id", "seq")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 48 HOUR >= TIMESTAMP '2024-01-20'")
def record_freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("eol", F.col("ts").cast("timestamp") + F.expr("INTERVAL 48 HOURS")).withColumn("valid", F.col("event_type") != "error")
    return R.fresh(e, "eol", F.lit("2024-01-20").cast("timestamp"), "valid").select("event_id")


@query("""WITH n AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-28' GROUP BY 1), c AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT n.user_id, coalesce(f.v, CASE WHEN n.user_id % 4 <> 0 THEN c.v END) AS value FROM n LEFT JOIN f USING (user_id) LEFT JOIN c USING (user_id)""")
def resolve_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-28'").groupBy("user_id").agg(F.max("event_id").alias("value"))
    c = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("value")).withColumn("valid", F.col("user_id") % 4 != 0)
    return R.resolve(e.select("user_id").distinct(), f, c, "user_id", "value")


@query(E + ", g AS (SELECT event_id, lead(at_) OVER (PARTITION BY user_id ORDER BY ts, event_id) - at_ AS gap FROM e) SELECT event_id FROM g WHERE gap IS NULL OR gap > 7200")
def debounce(spark, sf_dir):
    return R.debounce(_events(spark, sf_dir), "user_id", ORDER, "at", 7200).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, floor(value / 10) AS ep, max(floor(value / 10)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) WHERE ep = m")
def epoch_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("epoch", F.floor(F.col("value") / 10))
    return R.current_epochs(e, "user_id", ORDER, "epoch").select("event_id")


@query(E + "SELECT event_id, coalesce(at_ - lag(at_) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < 43200, false) AS hit FROM e")
def ttl_cache_hits(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return R.ttl_hits(e, "k", ORDER, "at", 43200.0).select("event_id", "hit")


@query("SELECT user_id, a.value AS value, a.event_id AS event_id FROM (SELECT user_id, min({'value': value, 'event_id': event_id}) AS a FROM events WHERE event_type <> 'error' GROUP BY user_id)")
def first_valid(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("valid", F.col("event_type") != "error")
    return R.first_valid(e, "user_id", "value", "valid", "event_id")


@query("SELECT user_id, bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'signup' AND value > 60) AS suppressed FROM events GROUP BY user_id")
def suppressed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").alias("direct"), ((F.col("event_type") == "signup") & (F.col("value") > 60)).alias("limited"))
    return R.suppressed(e, "user_id", "direct", "limited")


@query("""WITH r AS (SELECT event_id, user_id % 10 AS g, epoch_us(ts) AS a, epoch_us(ts) + (floor(value)::BIGINT + 1) * 60000000 AS b FROM events), x AS (SELECT g, a AS t, 1 AS d, event_id FROM r UNION ALL SELECT g, b, -1, NULL FROM r),
o AS (SELECT event_id, sum(d) OVER (PARTITION BY g ORDER BY t, d, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS open FROM x) SELECT event_id, open, open > 3 AS over FROM o WHERE event_id IS NOT NULL""")
def concurrency_cap(spark, sf_dir):
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("g"), a.alias("a"), (a + (F.floor("value") + 1) * 60000000).alias("b"))
    return R.concurrency(e, "g", "a", "b", 3)


@query("SELECT event_id, s FROM (SELECT event_id, event_type = 'error' AS s, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> s")
def stall_transitions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.col("event_type") == "error")
    return R.transitions(e, "user_id", ORDER, "s").select("event_id", "s")


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000 // 60)::DOUBLE AS at_, (floor(value) * 4)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, at_, 512.0::DOUBLE >= n AS allowed, CASE WHEN 512.0 >= n THEN 512.0 - n ELSE 512.0 END::DOUBLE AS tokens FROM r WHERE k = 1
UNION ALL SELECT r.user_id, r.event_id, r.k, r.at_, least(512.0, f.tokens + (r.at_ - f.at_) * 0.25) >= r.n, (CASE WHEN least(512.0, f.tokens + (r.at_ - f.at_) * 0.25) >= r.n THEN least(512.0, f.tokens + (r.at_ - f.at_) * 0.25) - r.n ELSE least(512.0, f.tokens + (r.at_ - f.at_) * 0.25) END)::DOUBLE FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, event_id, allowed FROM f""")
def token_bucket(spark, sf_dir):
    """Requests against a bucket for each user that gains a quarter token a minute."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).cast("double")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", minute.alias("at"), (F.floor("value") * 4).alias("n"))
    return St.replay(e, lambda s, r: St.token_bucket(s, r, 0.25, 512.0), "user_id", ["ts", "event_id"], "user_id long, event_id long, allowed boolean")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, (floor(value)::BIGINT % 4) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
cp(i, o, s) AS (VALUES (0, 0, 1), (1, 2, 2), (2, 4, 3), (3, 6, 4)),
st AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, []::BIGINT[] AS have, false AS stalled, NULL::BOOLEAN AS ready FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, k, event_id, CASE WHEN play THEN have ELSE list_distinct(list_append(have, v + 1)) END, CASE WHEN play THEN NOT ok ELSE stalled END, CASE WHEN play THEN ok END
FROM (SELECT st.user_id, e.k, e.event_id, e.v, st.have, st.stalled, e.event_type IN ('click', 'view') AS play, list_has_all(st.have, list_transform(range(e.v, least(e.v + CASE WHEN st.stalled THEN 2 ELSE 1 END, 3) + 1), lambda i: i + 1)) AS ok FROM st JOIN e ON e.user_id = st.user_id AND e.k = st.k + 1))
SELECT user_id, event_id, ready, stalled FROM st WHERE k > 0""")
def fence_replay(spark, sf_dir):
    """A plan of checkpoints 0, 2, 4, 6 with one sample each; some events provide samples, others play."""
    e = table(spark, sf_dir, "events")
    v = F.floor("value") % 4
    plays = F.col("event_type").isin("click", "view")
    rows = e.select("user_id", "event_id", "ts", F.when(plays, "play").otherwise("provide").alias("kind"), (v + 1).alias("sample"), (v * 2).alias("order"), F.lit("").alias("plan"))
    start = e.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit("1970-01-01").cast("timestamp_ntz").alias("ts"), F.lit("plan").alias("kind"), F.lit(0).cast("long").alias("sample"), F.lit(0).cast("long").alias("order"), F.lit("[[0, [1]], [2, [2]], [4, [3]], [6, [4]]]").alias("plan"))
    out = St.replay(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).unionByName(start), St.fence, "user_id", ["ts", "event_id"], "user_id long, event_id long, ready boolean, stalled boolean")
    return out.where("event_id >= 0")


SIM = "greatest(0.0, 1 - sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) ** 2)) / len(a)) / sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)))"
PAIRS = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM v x JOIN v y ON y.vec_id = x.vec_id + 1) "


def _pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", G.doubles(F.col("embedding")).alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query(PAIRS + f"SELECT vec_id, round({SIM}, 6) AS similarity FROM p")
def similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(G.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(PAIRS + f", l AS (SELECT vec_id, lag_, CASE WHEN lag_ >= 0 THEN a[1:64 - lag_] ELSE a[1 - lag_:64] END AS a, CASE WHEN lag_ > 0 THEN b[lag_ + 1:64] ELSE b[1:64 + lag_] END AS b FROM (SELECT *, unnest(range(-4, 5)) AS lag_ FROM p)), s AS (SELECT vec_id, lag_, round({SIM}, 6) AS s FROM l) SELECT vec_id, arg_max(lag_, (s, -abs(lag_), -lag_))::INT AS lag, max(s) AS similarity FROM s GROUP BY vec_id")
def best_lag_similarity(spark, sf_dir):
    return G.best_lag(_pairs(spark, sf_dir), "vec_id", "a", "b", 4)


@query()
def corpus_scan(spark, sf_dir):
    """Archives of archives made from documents, read back module by module."""
    import io
    import zipfile

    import pandas as pd

    from ..functions.modules import build_mod
    from ..sources.modules import metadata, scan_corpus

    def pack(batches):
        for pdf in batches:
            out = []
            for doc, source in zip(pdf["doc_id"], pdf["source"], strict=True):
                inner, outer = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    z.writestr(f"{source}.mod", build_mod(source, [(int(doc) % 50 * 2 + 4, int(doc))]))
                    z.writestr("readme.txt", "none")
                with zipfile.ZipFile(outer, "w") as z:
                    z.writestr(f"{source}.mod.zip", inner.getvalue())
                out.append((f"/corpus/{doc}.zip", outer.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    zips = table(spark, sf_dir, "documents").select("doc_id", "source").mapInPandas(pack, "path string, content binary")
    return metadata(scan_corpus(zips, "/corpus", ("mod",)))
