"""N-gram Jaccard join: prefixes under several global token orders, intersected, then exact verification.

A document is the set of its distinct word shingles as 64-bit hashes; equal sets are one node. An
order is a permutation of all shingles (a mixed hash). Two sets of n1 and n2 shingles are similar if
they share `needed(n1, n2)` of them, and then the first `prefix_size(n)` under any order have a sure number in
common (`least_shared`): what is left behind the prefix is too short for the rest. So a candidate must share
that many tokens under each of three orders, whatever the data; nothing is left out for being frequent,
large or late. The filters meet before whole sets are compared.

Pairs inside a component are never made; the fourth step has no other bound for many documents that each hold another large part of one text.

1. Every node is compared with the least document of the groups of its first tokens; links make components.
2. Tokens are kept whose nodes lie in more than one component (minimum and maximum by partial aggregation).
   In groups of at most `GROUP` nodes pairs across components are made and their shared tokens counted. Tokens of larger groups
   are frequent: a pair needs more shared tokens than both have frequent ones in common, or the node is
   hard: frequent tokens could be all that it shares with a partner.
3. Hard nodes go through the same step with their whole sets, counted among themselves.
4. Pairs still open share frequent tokens only. A large group has a leader, the node of most frequent tokens. Its
   nodes are compared with it; those similar to it are one component. For two others, x and y, either what each
   shares with the leader could be enough (few: such pairs are made by bands of sizes), or they share a token that the
   leader lacks, and meet again under that leader and token, in groups that hold only what it doesn't explain. Small
   groups make their pairs; large ones get a leader in turn, `LEVELS` times; what is still open then is compared across components.

Defined cases: no words, null or empty: empty set, linked with nothing; fewer words than a shingle:
the whole sequence is the one shingle; a document without id isn't linked and gets no component; repeated
rows are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, FOLD, SPACE, Work, batch_texts, fits_broadcast, fresh, join_side, join_skewed, mixed, text_chunks, word_table, words_of
from .graph import connected_components

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Token orders, tokens of each order that find the first step's groups, and the part of a set by which the
#: first order's prefix is longer than one sure shared token asks.
ORDERS, HEADS, PART = 3, 3, 16
#: Nodes of a token group up to which all of its nodes are compared across components.
GROUP = 64
#: Leaders after one another that a pair may be put under.
LEVELS = 3
#: Rows from which a component is joined apart from the others.
HOT_ROWS = 1000
#: Parts in which the rows of a frequent token are dealt where frequent tokens are too many for a broadcast.
SALTS = 16
_WORDS = word_table(SPACE)
_STEP = np.uint64(0x9FB21C651E98DF25)


def prefix_size(n: int, more: int = 0) -> int:
    """Tokens of a prefix such that similar sets share one in it and `more` besides."""
    return min(n, n - -(-n * PERCENT // 100) + 1 + more)


def shingle_sets(raws: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z already in lower case)."""
    _, _, _, words, firsts = words_of(raws, _WORDS)
    out = []
    sums = None
    if len(words) >= shingle:
        sums = np.zeros(len(words) - shingle + 1, np.uint64)
        for k in range(shingle):
            sums = sums * _STEP + words[k : len(words) - shingle + 1 + k]
        sums = mixed(sums)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(sums[a : b - shingle + 1]))
        elif b > a:
            one = b - a
            for w in words[a:b].tolist():
                one = (one * int(_STEP) + w) & (1 << 64) - 1
            out.append(mixed(np.asarray([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _order(tokens: np.ndarray, k: int) -> np.ndarray:
    return mixed(tokens ^ np.uint64((k + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _prefixes(sets: list[np.ndarray], k: int, more: int = 0) -> list[np.ndarray]:
    """The sorted prefix of each set under order k; `more` is the part of a set by which it is longer."""
    out = []
    for s in sets:
        v, size = _order(s, k), prefix_size(len(s), len(s) // more if more else 0)
        out.append(np.sort(np.partition(v, size)[:size] if len(v) > size else v))
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n (size of the set), hi and lo (its digest), the longer prefix under the first order, and the heads of the others."""

    def scan(batches):
        for batch in batches:
            for first, raws in text_chunks(batch_texts(batch)):
                sets = shingle_sets([r.translate(FOLD) for r in raws], shingle)
                digests = [_digest(s) for s in sets]
                heads = [np.concatenate([np.sort(np.partition(v, HEADS)[:HEADS] if len(v) > HEADS else v) for v in (_order(s, k) for k in range(1, ORDERS))]) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(raws)), batch.column(2).slice(first, len(raws)), pa.array([len(s) for s in sets], pa.int64()), pa.array([h for h, _ in digests], pa.int64()), pa.array([w for _, w in digests], pa.int64()), _lists(_prefixes(sets, 0, PART)), _lists(heads)],
                    names=["doc_id", "text_hash", "n", "hi", "lo", "tokens", "heads"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(scan, "doc_id long, text_hash long, n long, hi long, lo long, tokens array<long>, heads array<long>")


def needed(n1: Column, n2: Column) -> Column:
    """Shingles that similar sets of these sizes share at least."""
    return F.ceil((n1 + n2) * PERCENT / (100 + PERCENT))


def _prefix(n: Column, part: int = 0) -> Column:
    return F.least(n, n - F.ceil(n * PERCENT / 100) + 1 + (F.floor(n / part) if part else 0))


def least_shared(n1: Column, n2: Column, p1: Column, p2: Column) -> Column:
    """Tokens that similar sets of these sizes share in prefixes of these lengths at least."""
    return F.greatest(F.lit(1), needed(n1, n2) - F.greatest(n1 - p1, n2 - p2))


def _similar_sizes(n1: Column, n2: Column) -> Column:
    return 100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)


def _own_sets(batch, shingle: int):
    """Nodes and sets of a batch (node, text, hi, lo), without those of other texts."""
    ids, hi, lo = (batch.column(i).to_pylist() for i in (0, 2, 3))
    for first, raws in text_chunks(batch_texts(batch)):
        sets = shingle_sets([r.translate(FOLD) for r in raws], shingle)
        own = [i for i, s in enumerate(sets) if _digest(s) == (hi[first + i], lo[first + i])]
        yield pa.array([ids[first + i] for i in own], pa.int64()), [sets[i] for i in own]


def whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, work: Work, shingle: int = SHINGLE, broadcast_bytes: int | None = None) -> DataFrame:
    """node, tokens (the whole set by the first order) and the exact prefixes p1 and p2 under the others, for the wanted nodes."""
    found = work.write(wanted.select("node").distinct().join(nodes.select("node", F.col("doc").alias("_doc"), "hi", "lo"), "node"), "wanted")
    side = join_side(found, 64) if broadcast_bytes is None else join_side(found, 64, broadcast_bytes)
    # Documents of one id but other texts may be among them; the digest tells.
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("_doc")).select("node", "text", "hi", "lo")

    def expand(batches):
        for batch in batches:
            for ids, sets in _own_sets(batch, shingle):
                yield pa.RecordBatch.from_arrays([ids, _lists(_prefixes(sets, 0, 1)), *(_lists(_prefixes(sets, k)) for k in range(1, ORDERS))], names=["node", "tokens", "p1", "p2"])

    # A repeated row of one document would bring its set twice.
    return work.write(texts.mapInArrow(expand, "node long, tokens array<long>, p1 array<long>, p2 array<long>").dropDuplicates(["node"]), "sets")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share enough prefix tokens under the other orders, and then enough of their whole sets."""
    side = sets.select("node", F.struct(F.size("tokens").cast("long").alias("n"), "tokens", "p1", "p2").alias("s"))
    both = pairs.select("a", "b").join(side.withColumnsRenamed({"node": "a", "s": "x"}), "a").join(side.withColumnsRenamed({"node": "b", "s": "y"}), "b")
    n1, n2 = F.col("x.n"), F.col("y.n")
    test = _similar_sizes(n1, n2)
    for p in ("p1", "p2"):
        test &= F.size(F.array_intersect(f"x.{p}", f"y.{p}")) >= least_shared(n1, n2, F.size(f"x.{p}"), F.size(f"y.{p}"))
    return both.where(test & (F.size(F.array_intersect("x.tokens", "y.tokens")) >= needed(n1, n2))).select("a", "b")


def leader_pairs(nodes: DataFrame) -> DataFrame:
    """Each node with the least document of each group that shares one of its first tokens, if the first order's filter lets them pass."""
    heads = F.concat(F.slice("tokens", 1, HEADS), "heads")
    tokens = nodes.select("node", "doc", F.explode(heads).alias("t"))
    leaders = tokens.groupBy("t").agg(F.min(F.struct("doc", "node")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    pairs = tokens.join(leaders, "t").select(F.col("first.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    side = nodes.select("node", F.struct("n", "tokens").alias("s"))
    both = pairs.join(side.withColumnsRenamed({"node": "a", "s": "x"}), "a").join(side.withColumnsRenamed({"node": "b", "s": "y"}), "b")
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    enough = least_shared(F.col("x.n"), F.col("y.n"), F.size("x.tokens"), F.size("y.tokens"))
    return both.where(_similar_sizes(F.col("x.n"), F.col("y.n")) & (shared >= enough)).select("a", "b")


def _met(rows: DataFrame, keys: list[str], *extra: Column, test: Column | None = None) -> DataFrame:
    """Pairs of rows of one key from different components and of sizes that may be similar."""
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _similar_sizes(F.col("x.n"), F.col("y.n"))
    for k in keys:
        apart = (F.col(f"x.{k}") == F.col(f"y.{k}")) & apart
    return x.join(y, apart if test is None else apart & test).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), *extra)


def _frequent_rows(tokens: DataFrame, often: DataFrame) -> DataFrame:
    """The rows (node, t) of frequent tokens; by broadcast if those are few enough, else in salted parts."""
    if fits_broadcast(often, 32):
        return tokens.join(F.broadcast(often), "t")
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tokens.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["t", "salt"]).drop("salt")


def _tier(known: DataFrame, part: int, group: int, work: Work) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs by tokens of small groups, the hard nodes, and the rows (node, t) of frequent tokens.

    known has node, n, component and tokens: prefixes of the part, whole sets for 1.
    """
    tokens = known.select("node", F.explode("tokens").alias("t"))
    groups = known.select("component", F.explode("tokens").alias("t")).groupBy("t").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"))
    groups = work.write(groups.where("low <> high").select("t", "many"), "groups")
    frequent = work.write(_frequent_rows(tokens, groups.where(F.col("many") > group).select("t")), "frequent")
    # How many frequent tokens a node has, and which, as 128 bits; two in one bit count as excess.
    bit = "shiftleft(1L, cast(pmod(t, 64) as int))"
    half = lambda i: F.coalesce(F.bit_or(F.when(F.expr("pmod(shiftright(t, 6), 2)") == i, F.expr(bit))), F.lit(0).cast("long"))
    facts = frequent.groupBy("node").agg(F.count(F.lit(1)).alias("frequent"), half(0).alias("m0"), half(1).alias("m1"))
    facts = work.write(facts.withColumn("excess", F.col("frequent") - F.bit_count("m0") - F.bit_count("m1")), "facts")
    n = F.col("n")
    # The least that a partner of any size asks; see test_hard_bound.
    least = F.greatest(F.lit(1), F.floor(n / part) - 1) if part > 1 else needed(n, F.ceil(n * PERCENT / 100))
    hard = work.write(facts.select("node", "frequent").join(known.select("node", "n"), "node").where(F.col("frequent") >= least).select("node"), "hard")
    zero = F.lit(0).cast("long")
    sides = known.select("node", "n", "component").join(facts, "node", "left").select("node", "n", "component", *(F.coalesce(c, zero).alias(c) for c in ("frequent", "m0", "m1", "excess")))
    few = tokens.join(groups.where(F.col("many") <= group).select("t"), "t")
    few = work.write(few.join(sides, "node"), "few")
    both = F.least(F.least("x.frequent", "y.frequent"), F.bit_count(F.col("x.m0").bitwiseAND(F.col("y.m0"))) + F.bit_count(F.col("x.m1").bitwiseAND(F.col("y.m1"))) + F.least("x.excess", "y.excess"))
    pairs = _met(few, ["t"], F.col("x.n").alias("na"), F.col("y.n").alias("nb"), both.alias("both")).groupBy("a", "b", "na", "nb", "both").agg(F.count(F.lit(1)).alias("shared"))
    na, nb = F.col("na"), F.col("nb")
    enough = least_shared(na, nb, _prefix(na, part), _prefix(nb, part))
    pairs = work.write(pairs.where(F.col("shared") + F.col("both") >= enough).select("a", "b"), "crossing")
    work.drop("groups", "facts", "few")
    return pairs, hard, frequent


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(labels: DataFrame, links: DataFrame, work: Work) -> DataFrame:
    """The components (node, component) once more links (a written table) are known."""
    if links.isEmpty():
        return labels
    return work.write(connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "components")


def _band(n: Column) -> Column:
    """Sizes by steps of two percent."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(1.02)))).cast("int")


def _explained(led: DataFrame) -> DataFrame:
    """Pairs across components that may be similar by what each shares with their leader alone; one of them isn't similar to it."""
    top = F.least(F.floor(F.col("n") * 100 / PERCENT), F.floor(F.col("have") * (100 + PERCENT) / PERCENT) - F.col("n"))
    low = F.ceil(F.col("n") * PERCENT / 100)
    one = led.where(F.col("component") != F.col("of_leader")).withColumn("band", F.explode(F.when(top >= low, F.sequence(_band(low) - 1, _band(top) + 1)).otherwise(F.array().cast("array<int>"))))
    x, y = one.alias("x"), led.withColumn("band", _band(F.col("n"))).alias("y")
    same = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component"))
    fits = _similar_sizes(F.col("x.n"), F.col("y.n")) & (F.least("x.have", "y.have") >= needed(F.col("x.n"), F.col("y.n")))
    return x.join(y, same & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def by_leaders(sets: DataFrame, frequent: DataFrame, hard: DataFrame, labels: DataFrame, group: int, work: Work, levels: int = LEVELS) -> DataFrame:
    """Labels after all links between hard nodes that share frequent tokens only (the fourth step)."""
    n = F.col("n")
    smallest = F.ceil(n * PERCENT / 100)
    sized = sets.select("node", F.size("tokens").cast("long").alias("n"), "tokens")
    own = frequent.join(hard, "node").groupBy("node").agg(F.sort_array(F.collect_list("t")).alias("f")).join(sized.select("node", "n"), "node")
    # Similar nodes share `needed` of their frequent tokens, so one among the first of them.
    first = F.slice("f", F.lit(1), F.greatest(F.lit(0), F.size("f") - needed(n, smallest) + 1).cast("int"))
    rows = own.select("node", "n", F.size("f").alias("f"), F.lit(0).cast("long").alias("under"), F.explode(first).alias("t"))
    found, key = [], ["under", "t"]
    for level in range(levels + 1):
        rows = work.write(_labelled(rows, labels), "open")
        groups = rows.groupBy(*key).agg(F.max(F.struct("f", "node")).alias("leader"), F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"))
        groups = work.write(groups.where("low <> high").select(*key, F.col("leader.node").alias("leader"), "many"), "leaders")
        few = groups if level == levels else groups.where(F.col("many") <= group)
        found.append(work.write(_met(rows.join(few.select(*key), key), key).distinct(), "crossing"))
        many = groups.where(F.col("many") > group)
        if level == levels or many.isEmpty():
            break
        led = work.write(rows.select("node", "f", *key).join(many.select(*key, "leader"), key).select("leader", "node", "f").distinct(), "led")
        chief = work.write(led.select(F.col("leader").alias("node")).distinct().join(sized, "node").select(F.col("node").alias("leader"), F.col("n").alias("n_leader"), F.col("tokens").alias("of")), "leader-sets")
        if (chief.agg(F.sum("n_leader")).first()[0] or 0) * 16 <= BROADCAST_BYTES:
            chief = F.broadcast(chief)
        rest = led.join(sized, "node").join(chief, "leader").withColumn("rest", F.array_except("tokens", "of"))
        rest = work.write(rest.select("leader", "node", "n", "f", "n_leader", (n - F.size("rest")).alias("have"), F.sort_array("rest").alias("rest")), "rest")
        near = _similar_sizes(n, F.col("n_leader")) & (F.col("have") >= needed(n, F.col("n_leader"))) & (F.col("node") != F.col("leader"))
        labels = _merged(labels, work.write(rest.where(near).select(F.col("leader").alias("a"), F.col("node").alias("b")), "links"), work)
        named = labels.withColumnsRenamed({"node": "leader", "component": "of_leader"})
        led = _labelled(rest.drop("rest", "f"), labels).join(named, "leader", "left").withColumn("of_leader", F.coalesce("of_leader", "leader"))
        found.append(work.write(_explained(work.write(led, "led")).distinct(), "crossing"))
        ask = F.greatest(F.lit(1), needed(n, smallest) - F.col("have"))
        first = F.slice("rest", F.lit(1), F.greatest(F.lit(0), F.size("rest") - ask + 1).cast("int"))
        rows = rest.select("node", "n", "f", F.col("leader").alias("under"), F.explode(first).alias("t"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    # Components have grown meanwhile.
    x, y = (labels.select(F.col("node").alias(e), F.col("component").alias(f"c_{e}")) for e in "ab")
    apart = pairs.distinct().join(x, "a", "left").join(y, "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    return _merged(labels, work.write(verify(apart, sets), "links"), work)


def _components(docs: DataFrame, shingle: int, group: int) -> DataFrame:
    """doc_id, text_hash, n, component_id and component (null for rows that aren't linked at all) for every row of docs."""
    work = Work(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = work.write(sketches(docs, shingle), "sketches")
    sets = rows.where(F.col("n").cast("boolean") & F.col("doc_id").isNotNull())
    nodes = sets.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc"), *(F.any_value(c).alias(c) for c in ("n", "tokens", "heads")))
    nodes = work.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = work.write(rows.select("doc_id", "text_hash", "n", "hi", "lo"), "rows", drop=["sketches"])
    first = work.write(leader_pairs(nodes), "pairs")
    sets = whole_sets(_ends(first), nodes, docs, work, shingle)
    labels = _merged(docs.sparkSession.createDataFrame([], "node long, component long"), work.write(verify(first, sets), "links"), work)
    known = _labelled(nodes.select("node", "n", "tokens"), labels)
    pairs, hard, _ = _tier(known, PART, group, work)
    sets = whole_sets(_ends(pairs).union(hard), nodes, docs, work, shingle)
    links = verify(pairs, sets)
    if not hard.isEmpty():
        hard_sets = _labelled(sets.select("node", F.size("tokens").cast("long").alias("n"), "tokens").join(hard, "node"), labels)
        more, harder, frequent = _tier(hard_sets, 1, group, work)
        labels = _merged(labels, work.write(links.union(verify(more, sets)), "links"), work)
        if not harder.isEmpty():
            labels = by_leaders(sets, frequent, harder, labels, group, work)
    else:
        labels = _merged(labels, work.write(links, "links"), work)
    named = work.write(_labelled(nodes.select("node", "doc", "hi", "lo"), labels), "named")
    # A node without links is its own component; only the others look their least document up, those of large components apart.
    least = named.join(labels.select("node"), "node", "left_semi").groupBy("component").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("many"))
    least = work.write(least, "least")
    linked = join_skewed(named.join(labels.select("node"), "node", "left_semi"), least, ["component"], F.col("many") > HOT_ROWS)
    alone = named.join(labels.select("node"), "node", "left_anti").withColumn("component_id", F.col("doc"))
    names = ["hi", "lo", "component", "component_id"]
    found = work.write(linked.select(*names).union(alone.select(*names)), "found")
    work.drop_all_but("rows", "found")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = rows.join(found, ["hi", "lo"], "left")
    own = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n", own.alias("component_id"), F.when(linked, F.col("component")).alias("component"))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id (the least doc_id that links reach) for every row of docs."""
    return _components(docs, shingle, group).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """One row of each group of documents that are linked, directly or not: the one of least id, then least text hash.

    Of repeated rows of that document one stays, whatever their other columns. Rows without words or id all stay.
    """
    id_, hash_ = fresh(docs, "_gone_id"), fresh(docs, "_gone_hash")
    work = Work(docs.sparkSession, "near-copies")
    rows = work.write(_components(docs, shingle, group).where(F.col("component").isNotNull()).groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "members")
    first = work.write(rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("many")), "first")
    rows = work.write(join_skewed(rows, first, ["component"], F.col("many") > HOT_ROWS).withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first")), "marked")
    named = [F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)]
    gone = work.write(rows.where(~F.col("stays")).select(*named), "gone")
    again = work.write(rows.where(F.col("stays") & (F.col("copies") > 1)).select(*named), "repeated")
    same = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    out = docs.join(join_side(gone, 32), same, "left_anti")
    if again.isEmpty():
        return out
    side = join_side(again, 32)
    one = out.join(side, same).dropDuplicates([id_, hash_]).drop(id_, hash_)
    return out.join(side, same, "left_anti").union(one)
