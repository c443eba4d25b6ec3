"""Keyed state machines, once: a pure step for each, a batch twin over sorted rows, and a streaming form.

The step takes the state of a key and one row, and gives the new state and what comes out. The
batch twin folds a key's rows in order; the stream keeps the same state between micro-batches.
Late rows of a key are taken in the order in which their batch has them; within a batch rows are sorted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Tokens a second and the most that gather; checkpoints beyond the next that a stalled player waits for; cache limits.
RATE, BURST, LOOKAHEAD, TTL, ENTRIES = 256.0, 512.0, 1, 120.0, 512
#: Peers whose buckets a node remembers, requests that it serves at once, and chunks that are read ahead.
PEERS, SLOTS, READ_AHEAD = 4096, 32, 15


def token_bucket(state: dict, row: dict, rate: float = RATE, burst: float = BURST) -> tuple[dict, dict]:
    """A request of n is allowed if that many tokens have gathered. row: at (seconds), n."""
    tokens = min(burst, state.get("tokens", burst) + max(0.0, row["at"] - state.get("at", row["at"])) * rate)
    allowed = tokens >= row["n"]
    return {"tokens": tokens - row["n"] if allowed else tokens, "at": max(row["at"], state.get("at", row["at"]))}, {"allowed": allowed}


def newest_sequence(state: dict, row: dict) -> tuple[dict, dict]:
    """A valid record of strictly higher sequence replaces what is held. row: seq, value, valid."""
    taken = bool(row["valid"]) and row["seq"] > state.get("seq", -1)
    state = {"seq": row["seq"], "value": row["value"]} if taken else state
    return state, {"taken": taken, "held_seq": state.get("seq", -1), "held_value": state.get("value", "")}


def required(orders: list[int], samples: list[list[int]], order: float, ahead: int = 1) -> list[int]:
    """Samples of the floor checkpoint and the next `ahead`, clamped to the plan."""
    floor = sum(o <= order for o in orders) - 1
    return sorted({s for i in range(max(0, floor), min(floor + ahead, len(orders) - 1) + 1) for s in samples[i]})


def fence(state: dict, row: dict, lookahead: int = LOOKAHEAD) -> tuple[dict, dict]:
    """Play only with what the place needs. row: kind plan (orders, samples as JSON), provide (sample) or play (order).

    A player that runs stalls if the floor or next checkpoint lacks a sample; a stalled one runs on only when
    `lookahead` more are there too. Where nothing is required it plays, and a stall stays.
    """
    state = dict(state)
    out = {"ready": None, "stalled": bool(state.get("stalled", False))}
    if row["kind"] == "plan":
        pairs = sorted(json.loads(row["plan"]))
        state["orders"], state["samples"] = [p[0] for p in pairs], [p[1] for p in pairs]
    elif row["kind"] == "provide":
        state["have"] = sorted({*state.get("have", []), row["sample"]})
    else:
        orders, samples, have = state.get("orders", []), state.get("samples", []), set(state.get("have", []))
        need = required(orders, samples, row["order"])
        if not need:
            out["ready"] = True
        elif out["stalled"]:
            out["ready"] = set(required(orders, samples, row["order"], 1 + lookahead)) <= have
            state["stalled"] = not out["ready"]
        else:
            out["ready"] = set(need) <= have
            state["stalled"] = not out["ready"]
        out["stalled"] = bool(state.get("stalled", False))
    return state, out


def ttl_cache(state: dict, row: dict, ttl: float = TTL, entries: int = ENTRIES) -> tuple[dict, dict]:
    """Hits of a cache that drops what is old or, when full, least recently used. row: at, item."""
    held = {k: t for k, t in state.items() if row["at"] - t < ttl}
    hit = row["item"] in held
    held.pop(row["item"], None)
    held[row["item"]] = row["at"]
    while len(held) > entries:
        held.pop(min(held, key=lambda k: (held[k], k)))
    return held, {"hit": hit}


def bounded_buckets(state: dict, row: dict, rate: float = RATE, burst: float = BURST, peers: int = PEERS) -> tuple[dict, dict]:
    """One node's token buckets: the peers that asked last are remembered, others start anew. row: peer, at, n."""
    held = dict(state)
    bucket, out = token_bucket(held.pop(row["peer"], {}), row, rate, burst)
    held[row["peer"]] = bucket  # the order of the keys is that of the last use
    while len(held) > peers:
        del held[next(iter(held))]
    return held, {**out, "known": len(held)}


def slots_held(state: dict, row: dict, cap: int = SLOTS) -> tuple[dict, dict]:
    """A place among cap is taken until its end or the request is refused at once. row: at, until."""
    ends = [e for e in state.get("ends", []) if e > row["at"]]
    admitted = len(ends) < cap
    return {"ends": sorted([*ends, row["until"]]) if admitted else ends}, {"admitted": admitted, "open": len(ends) + admitted}


def page_cache(state: dict, row: dict, ahead: int = READ_AHEAD) -> tuple[dict, dict]:
    """Chunks that a read of first to last fetches: those missing, and when reads go on in sequence so many more, up to the file's last one. row: first, last, end."""
    have, last_end = set(state.get("have", [])), state.get("last_end")
    if all(c in have for c in range(row["first"], row["last"] + 1)):
        fetched = []
    else:
        high = min(row["last"] + ahead, row["end"]) if last_end is not None and row["first"] <= last_end + 1 else row["last"]
        fetched = [c for c in range(row["first"], high + 1) if c not in have]
    return {"have": sorted(have | set(fetched)), "last_end": row["last"]}, {"fetched": len(fetched), "upto": max(fetched, default=-1)}


def player(state: dict, row: dict) -> tuple[dict, dict]:
    """Samples that come before the player exists wait in order and go in when it starts. row: kind init or provide, sample."""
    if row["kind"] == "init":
        return {"on": True}, {"applied": json.dumps(state.get("waiting", []))}
    if state.get("on"):
        return state, {"applied": json.dumps([row["sample"]])}
    return {"waiting": [*state.get("waiting", []), row["sample"]]}, {"applied": "[]"}


Step = Callable[[dict, dict], tuple[dict, dict]]


def replay(rows: DataFrame, step: Step, key: str, order: list[str], schema: str) -> DataFrame:
    """The batch twin: each key's rows in order through the step; schema names the key, order columns and outputs.

    Rows are dealt and sorted by Spark; a task folds its keys one after another over Arrow batches and holds one state.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]
    columns = rows.columns

    def fold(batches):
        current, state = object(), {}
        for pdf in batches:
            out = []
            for values in pdf.itertuples(index=False, name=None):
                row = dict(zip(columns, values, strict=True))
                if row[key] != current:
                    current, state = row[key], {}
                state, made = step(state, row)
                out.append({n: made[n] if n in made else row[n] for n in names})
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


class _Keyed(StatefulProcessor):
    """Holds a key's state as JSON text."""

    def __init__(self, step: Step, key: str, order: list[str], names: list[str]):
        self.step, self.key, self.order, self.names = step, key, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = json.loads(self.state.get()[0]) if self.state.exists() else {}, []
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for row in batch.to_dict("records"):
            state, made = self.step(state, row)
            out.append({n: made[n] if n in made else row[n] for n in self.names})
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, step: Step, key: str, order: list[str], schema: str) -> DataFrame:
    """The streaming form, in append mode; the session needs the RocksDB state store provider."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    return rows.groupBy(key).transformWithStateInPandas(_Keyed(step, key, order, names), schema, "Append", "None")


#: The setting that `stream` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def gossip(lines: DataFrame, field: str = "value") -> DataFrame:
    """name and record of messages; those that are malformed or have no name are dropped."""
    from pyspark.sql import functions as F

    m = F.from_json(field, "name string, seq long, value string, valid boolean")
    return lines.select(m.alias("m")).select("m.*").where("name IS NOT NULL AND name <> '' AND seq IS NOT NULL")
