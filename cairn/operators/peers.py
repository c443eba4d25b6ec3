"""Peer snapshots, name records and requests: batch forms over event tables, each key's rows in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = 60


def rates(rows: DataFrame, by: str, at: str, counters: list[str], order: list[str]) -> DataFrame:
    """Per-second rates of counters: never below zero (a counter may start again), zero for a key's first row."""
    w = W.partitionBy(by).orderBy(*order)
    dt = F.col(at) - F.lag(at).over(w)
    for c in counters:
        rows = rows.withColumn(f"{c}_rate", F.when(dt > 0, F.greatest(F.lit(0.0), (F.col(c) - F.lag(c).over(w)) / dt)).otherwise(0.0))
    return rows


def rolling_history(rows: DataFrame, by: str, order: list[str], value: str, most: int = HISTORY) -> DataFrame:
    w = W.partitionBy(by).orderBy(*order).rowsBetween(-(most - 1), 0)
    return rows.withColumn("history", F.collect_list(value).over(w))


def connected_since(rows: DataFrame, by: str, order: list[str], at: str, connected: str) -> DataFrame:
    """Start of the connected run that a row is in; null while not connected."""
    w = W.partitionBy(by).orderBy(*order)
    breaks = F.sum(F.when(F.col(connected), 0).otherwise(1)).over(w)
    runs = rows.withColumn("_run", breaks)
    first = F.min(F.when(F.col(connected), F.col(at))).over(W.partitionBy(by, "_run"))
    return runs.withColumn("since", F.when(F.col(connected), first)).drop("_run")


def full_view(connected: DataFrame, transfers: DataFrame, key: str) -> DataFrame:
    """Peers that are connected or have moved bytes; what is missing is zero or false."""
    c = connected.select(key).distinct().withColumn("connected", F.lit(True))
    out = c.join(transfers, key, "full")
    return out.select(key, F.coalesce("connected", F.lit(False)).alias("connected"), *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in transfers.columns if x != key))


def ranked(peers: DataFrame, key: str) -> DataFrame:
    """Place of each peer: connected ones first, then by bytes, then by id. The order is total."""
    return peers.orderBy(F.col("connected").desc(), F.col("bytes").desc(), F.col(key))


def totals(peers: DataFrame, role: str, own: str) -> DataFrame:
    return peers.agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col(role) != own, F.col("bytes")).otherwise(0)).alias("peer_bytes"), F.count_if(F.col(role) != own).alias("peers"))


def share(peers: DataFrame, value: str) -> DataFrame:
    """Whole percents of the total, zero where nothing moved."""
    total = peers.agg(F.sum(value)).first()[0] or 0
    percent = F.round(100 * F.col(value) / total) if total else F.lit(0)
    return peers.withColumn("percent", percent.cast("int"))


def monotonic(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    return rows.withColumn("progress", F.max(value).over(W.partitionBy(by).orderBy(*order)))


def newest(records: DataFrame, key: str, seq: str, arrival: str, valid: Column) -> DataFrame:
    """The valid record of highest sequence for each name; of equal sequences the first to arrive stays."""
    pick = F.struct(F.col(seq), -F.col(arrival))
    return records.where(valid).groupBy(key).agg(F.max_by(F.struct("*"), pick).alias("r")).select("r.*")


def fresh(records: DataFrame, end: str, now: Column, valid: str) -> DataFrame:
    """Records that verify and aren't past their end of life."""
    return records.where(F.col(valid) & (F.col(end) >= now))


def resolve(names: DataFrame, fresh_: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """A fresh record's value, else the cached one's if it is valid, else null."""
    f = fresh_.select(key, F.col(value).alias("_fresh"))
    c = cached.where("valid").select(key, F.col(value).alias("_cached"))
    return names.join(f, key, "left").join(c, key, "left").select(key, F.coalesce("_fresh", "_cached").alias(value))


def debounce(rows: DataFrame, by: str, order: list[str], at: str, gap: float) -> DataFrame:
    """The last row of each burst; a burst ends where more than gap seconds follow."""
    follows = F.lead(at).over(W.partitionBy(by).orderBy(*order)) - F.col(at)
    return rows.where(F.lit(True)).withColumn("_gap", follows).where(F.col("_gap").isNull() | (F.col("_gap") > gap)).drop("_gap")


def current_epochs(rows: DataFrame, by: str, order: list[str], epoch: str) -> DataFrame:
    """Rows whose epoch isn't behind the largest seen so far."""
    latest = F.max(epoch).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_latest", latest).where(F.col(epoch) == F.col("_latest")).drop("_latest")


def ttl_hits(requests: DataFrame, key: str, order: list[str], at: str, ttl: float) -> DataFrame:
    """Whether each request finds its key put or read less than ttl seconds before (a read renews it)."""
    before = F.lag(at).over(W.partitionBy(key).orderBy(*order))
    return requests.withColumn("hit", F.coalesce(F.col(at) - before < ttl, F.lit(False)))


def first_valid(answers: DataFrame, key: str, latency: str, valid: str, source: str) -> DataFrame:
    """The quickest valid answer to each request; ties by source."""
    return answers.where(F.col(valid)).groupBy(key).agg(F.min(F.struct(latency, source)).alias("a")).select(key, f"a.{latency}", f"a.{source}")


def suppressed(providers: DataFrame, key: str, direct: str, limited: str) -> DataFrame:
    """Forwarding is off where a provider is direct and none is reached by relay only."""
    return providers.groupBy(key).agg((F.bool_or(direct) & ~F.bool_or(limited)).alias("suppressed"))


def concurrency(rows: DataFrame, by: str, start: str, stop: str, cap: int) -> DataFrame:
    """How many intervals are open at each start (its own included), and whether that is over the cap."""
    keyed = rows.withColumn("_id", F.struct(start, "event_id"))
    opens = keyed.select(by, F.col(start).alias("_t"), F.lit(1).alias("_d"), "event_id")
    closes = keyed.select(by, F.col(stop).alias("_t"), F.lit(-1).alias("_d"), F.lit(None).cast("long").alias("event_id"))
    w = W.partitionBy(by).orderBy("_t", "_d", "event_id").rowsBetween(W.unboundedPreceding, 0)
    out = opens.unionByName(closes).withColumn("open", F.sum("_d").over(w)).where("event_id IS NOT NULL")
    return out.select("event_id", "open", (F.col("open") > cap).alias("over"))


def transitions(rows: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """Rows where a state differs from the one before; the first row counts."""
    before = F.lag(state).over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(state))).drop("_b")


def hop_classes(rows: DataFrame, address: str) -> DataFrame:
    from ..functions.strings import transport_class

    kind = transport_class(F.col(address))
    hop = F.when(kind == "relay", "relay").when(kind == "unknown", "unknown").otherwise("direct")
    return rows.groupBy(hop.alias("hop")).agg(F.count(F.lit(1)).alias("n"))


def forward_targets(peers: DataFrame, seeds: DataFrame, own: str, key: str = "peer") -> DataFrame:
    """Peers to forward to: neither this node nor a seed."""
    return peers.where(F.col(key) != own).join(seeds.select(key), key, "left_anti")


def requested(cids: Column, most: int = 256) -> Column:
    """The first `most` addresses of a request; of those the ones that can be read (base-32 version 1, base-58 version 0).

    The first byte of version 1 is 1, so ten bits of base 32 begin with 00000 001: after the b comes an a, then one of e to h.
    """
    return F.filter(F.slice(cids, 1, most), lambda c: c.rlike(r"^(ba[e-h][a-z2-7]{6,}|Qm[1-9A-HJ-NP-Za-km-z]{44})$"))


def warm_hops(addresses: DataFrame, seeds: DataFrame, own: str, address: str = "address", key: str = "peer") -> DataFrame:
    """The relays by which providers are reached, each once: candidates to stay connected with, but not this node or seeds."""
    from ..functions.strings import relay_hop

    hops = addresses.select(relay_hop(F.col(address)).alias(key)).where(F.col(key).isNotNull()).distinct()
    return forward_targets(hops, seeds, own, key)


def last_state(rows: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """The newest state of each key; anything but public and private is unknown."""
    known = F.when(F.col(state).isin("public", "private"), F.col(state)).otherwise("unknown")
    return rows.groupBy(by).agg(F.max_by(known, F.struct(*order)).alias(state))


def decimated(rows: DataFrame, by: str, order: list[str], every: int = 4) -> DataFrame:
    """Every nth row of a key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") % every == 0).drop("_n")


def delivered(messages: DataFrame, by: str, at: str, kind: str, init: str = "init") -> DataFrame:
    """When each message takes effect: one that comes before its key's first init waits for it; without an init it never does."""
    begins = F.min(F.when(F.col(kind) == init, F.col(at))).over(W.partitionBy(by))
    return messages.withColumn("effective", F.when(begins.isNotNull(), F.greatest(F.col(at), begins))).where(F.col(kind) != init)


def jittered(base: float, spread: float, seed: int) -> Column:
    """A pause of base, up to spread less or more; exactly base where spread is not above zero."""
    return F.lit(float(base)) if spread <= 0 else F.lit(float(base - spread)) + F.rand(seed) * (2 * spread)


def streaming_wins(full: Column, skeleton: Column, first: Column, throughput: Column, trips: Column, latency: Column) -> Column:
    """Whether bytes not fetched at the start repay the additional round trips."""
    return (full - skeleton - first) / throughput > trips * latency


def least_prefix(size: Column, holds, steps: int = 16, floor: int = 256, share: float = 0.005) -> Column:
    """By bisection the shortest prefix for which holds(length) is true, to within floor or a share of the size; the size if none is found."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), size.cast("long").alias("hi"), size.cast("long").alias("found"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2)
        ok = holds(mid)
        wide = a["hi"] - a["lo"] > F.greatest(F.lit(float(floor)), size * share)
        down = F.struct(a["lo"].alias("lo"), mid.alias("hi"), mid.alias("found"))
        up = F.struct(mid.alias("lo"), a["hi"].alias("hi"), a["found"].alias("found"))
        return F.when(~wide, a).when(ok, down).otherwise(up)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["found"])


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())
