"""Keyed state machines in the order of event time, over state of its own kind for each part.

A machine names its states (values, maps and lists) and has one step over them, which the batch twin runs with plain Python containers and the stream with Spark's
value, map and list states: a step touches the entries that it names, and nothing else of a key's state is read or written. Rows of a stream may come in any
order within the watermark's delay. They wait in a map by time and number; a timer at each row's time lets them through when the watermark
has passed it, in order, so that the outcome is that of the sorted rows. Entries that time makes void are deleted by timers as well, so a key's state doesn't grow with its
past. Rows later than the delay are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import BURST, RATE, SLOTS, TTL


class Memory:
    """The states of one key in the batch twin."""

    def __init__(self, machine: Machine):
        self.values: dict[str, tuple] = {}
        self.maps: dict[str, dict] = {m: {} for m in machine.maps}
        self.lists: dict[str, list] = {m: [] for m in machine.lists}

    def value(self, name: str) -> tuple | None:
        return self.values.get(name)

    def set_value(self, name: str, row: tuple) -> None:
        self.values[name] = row

    def entry(self, name: str, key: Any) -> tuple | None:
        return self.maps[name].get(key)

    def put(self, name: str, key: Any, row: tuple) -> None:
        self.maps[name][key] = row

    def remove(self, name: str, key: Any) -> None:
        self.maps[name].pop(key, None)

    def items(self, name: str) -> list:
        return self.lists[name]

    def set_items(self, name: str, rows: list) -> None:
        self.lists[name] = rows


class Stored:
    """The states of one key in a stream."""

    def __init__(self, machine: Machine, handle: StatefulProcessorHandle):
        self._values = {n: handle.getValueState(n, s) for n, s in machine.values.items()}
        self._maps = {n: handle.getMapState(n, k, v) for n, (k, v) in machine.maps.items()}
        self._lists = {n: handle.getListState(n, s) for n, s in machine.lists.items()}

    def value(self, name: str) -> tuple | None:
        state = self._values[name]
        return tuple(state.get()) if state.exists() else None

    def set_value(self, name: str, row: tuple) -> None:
        self._values[name].update(row)

    def entry(self, name: str, key: Any) -> tuple | None:
        state = self._maps[name]
        return tuple(state.getValue((key,))) if state.exists() and state.containsKey((key,)) else None

    def put(self, name: str, key: Any, row: tuple) -> None:
        self._maps[name].updateValue((key,), row)

    def remove(self, name: str, key: Any) -> None:
        if self._maps[name].exists():
            self._maps[name].removeKey((key,))

    def items(self, name: str) -> list:
        state = self._lists[name]
        return [tuple(r) for r in state.get()] if state.exists() else []

    def set_items(self, name: str, rows: list) -> None:
        self._lists[name].put(rows) if rows else self._lists[name].clear()


@dataclass
class Machine:
    """What a key remembers. values and lists: schema by name; maps: (key schema, value schema) by name."""

    values: dict[str, str] = field(default_factory=dict)
    maps: dict[str, tuple[str, str]] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)

    def step(self, states, at: int, row: dict) -> dict:
        """What comes out of a row at a time in milliseconds."""
        raise NotImplementedError

    def void(self, states, at: int) -> None:
        """Delete what no later row can need at this time."""

    def until(self, at: int, row: dict) -> int | None:
        """When something of what a row left behind becomes void; a timer looks at it then."""
        return None


@dataclass
class Bucket(Machine):
    """A request of n passes if that many tokens have gathered."""

    rate: float = RATE
    burst: float = BURST
    values: dict = field(default_factory=lambda: {"bucket": "tokens double, at long"})

    def step(self, states, at, row):
        tokens, since = states.value("bucket") or (self.burst, at)
        tokens = min(self.burst, tokens + (at - since) / 1000 * self.rate)
        allowed = tokens >= row["n"]
        states.set_value("bucket", (tokens - row["n"] if allowed else tokens, at))
        return {"allowed": allowed}


@dataclass
class Cache(Machine):
    """Whether an item was used less than ttl seconds before. Items are entries of a map; an old one is looked at, and removed, when its time is over."""

    ttl: float = TTL
    maps: dict = field(default_factory=lambda: {"used": ("item string", "at long")})
    lists: dict = field(default_factory=lambda: {"uses": "item string, at long"})

    def step(self, states, at, row):
        before = states.entry("used", row["item"])
        states.put("used", row["item"], (at,))
        states.set_items("uses", [*self._open(states, at), (row["item"], at)])
        return {"hit": before is not None and at - before[0] < self.ttl * 1000}

    def _open(self, states, at: int) -> list:
        """Uses that still count; the items of the others go unless they were used again."""
        uses = states.items("uses")
        for item, used in uses:
            if at - used >= self.ttl * 1000:
                now = states.entry("used", item)
                if now is not None and now[0] == used:
                    states.remove("used", item)
        return [u for u in uses if at - u[1] < self.ttl * 1000]

    def void(self, states, at):
        states.set_items("uses", self._open(states, at))

    def until(self, at, row):
        return at + int(self.ttl * 1000)


@dataclass
class Newest(Machine):
    """A valid record of strictly higher sequence replaces what is held."""

    values: dict = field(default_factory=lambda: {"held": "seq long, value string"})

    def step(self, states, at, row):
        seq, value = states.value("held") or (-1, "")
        taken = bool(row["valid"]) and row["seq"] > seq
        if taken:
            seq, value = row["seq"], row["value"]
            states.set_value("held", (seq, value))
        return {"taken": taken, "held_seq": seq, "held_value": value}


@dataclass
class Slots(Machine):
    """A place among cap is taken until its end (until, in milliseconds), or the request is refused at once."""

    cap: int = SLOTS
    lists: dict = field(default_factory=lambda: {"ends": "until long"})

    def step(self, states, at, row):
        ends = [e for e in states.items("ends") if e[0] > at]
        admitted = len(ends) < self.cap
        states.set_items("ends", [*ends, (row["until"],)] if admitted else ends)
        return {"admitted": admitted, "open": len(ends) + admitted}

    def void(self, states, at):
        states.set_items("ends", [e for e in states.items("ends") if e[0] > at])

    def until(self, at, row):
        return row["until"]


@dataclass
class Fence(Machine):
    """Play only with the samples that the place's checkpoint and the next one need. row: kind provide (sample) or play (order); the plan (order, samples) is the machine's."""

    plan: tuple[tuple[int, tuple[int, ...]], ...] = ()
    ahead: int = 1
    values: dict = field(default_factory=lambda: {"stalled": "stalled boolean"})
    maps: dict = field(default_factory=lambda: {"have": ("sample long", "at long")})

    def needed(self, order: float, ahead: int) -> list[int]:
        floor = max(0, sum(o <= order for o, _ in self.plan) - 1)
        return sorted({s for _, samples in self.plan[floor : floor + ahead + 1] for s in samples})

    def step(self, states, at, row):
        stalled = bool((states.value("stalled") or (False,))[0])
        if row["kind"] == "provide":
            states.put("have", row["sample"], (at,))
            return {"ready": None, "stalled": stalled}
        need = self.needed(row["order"], 1)
        if not need:
            return {"ready": True, "stalled": stalled}
        wanted = self.needed(row["order"], 1 + self.ahead) if stalled else need
        ready = all(states.entry("have", s) is not None for s in wanted)
        states.set_value("stalled", (not ready,))
        return {"ready": ready, "stalled": not ready}


def _plain(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value.item() if hasattr(value, "item") else value


def _columns(schema: str) -> list[str]:
    return [part.strip().split()[0] for part in schema.split(",")]


class _Ordered(StatefulProcessor):
    def __init__(self, machine: Machine, fields: str, names: list[str], key: str, number: str):
        self.machine, self.fields, self.names, self.key, self.number = machine, fields, names, key, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.states = handle, Stored(self.machine, handle)
        self.waiting = handle.getMapState("waiting", "at long, number long", self.fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, timers = _columns(self.fields), set(self.handle.listTimers())
        for pdf in rows:
            for row in pdf.to_dict("records"):
                at = int(row["event_millis"])
                self.waiting.updateValue((at, int(row[self.number])), tuple(_plain(row[c]) for c in names))
                if at not in timers:
                    timers.add(at)
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # all that the watermark has passed, at the first timer
        ready = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= now) if self.waiting.exists() else []
        out = []
        for (at, number), values in ready:
            row = dict(zip(_columns(self.fields), values, strict=True))
            out.append({self.key: key[0], self.number: number} | self.machine.step(self.states, at, row))
            self.waiting.removeKey((at, number))
            if (over := self.machine.until(at, row)) is not None and over > now:
                self.handle.registerTimer(over)
        self.machine.void(self.states, now)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, key: str, time: str, number: str, fields: str) -> DataFrame:
    millis = F.unix_millis(F.col(time).cast("timestamp"))
    return rows.select(key, F.col(number).cast("long").alias(number), *_columns(fields), millis.alias("event_millis"), time)


def _schema(rows: DataFrame, key: str, number: str, outputs: str) -> str:
    return f"{key} {rows.schema[key].dataType.simpleString()}, {number} long, {outputs}"


def in_order(rows: DataFrame, machine: Machine, key: str, time: str, number: str, fields: str, outputs: str) -> DataFrame:
    """The batch twin: key, number and outputs of each row, by time (in milliseconds) and number. fields is the schema of what a step reads of a row."""
    columns, names = _columns(fields), _columns(outputs)
    schema = T._parse_datatype_string(_schema(rows, key, number, outputs))

    def fold(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, current, states = to_arrow_schema(schema), object(), None
        for batch in batches:
            cells, out = {c: batch.column(c).to_pylist() for c in batch.schema.names}, []
            for i in range(batch.num_rows):
                if states is None or cells[key][i] != current:
                    current, states = cells[key][i], Memory(machine)
                made = machine.step(states, cells["event_millis"][i], {c: cells[c][i] for c in columns})
                machine.void(states, cells["event_millis"][i])
                out.append({key: current, number: cells[number][i]} | {n: made[n] for n in names})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    timed = _timed(rows, key, time, number, fields).drop(time)
    return timed.repartition(key).sortWithinPartitions(key, "event_millis", number).mapInArrow(fold, schema)


def stream_in_order(rows: DataFrame, machine: Machine, key: str, time: str, number: str, fields: str, outputs: str, delay: str) -> DataFrame:
    """The stream: the rows of `in_order`, released once the watermark (delay behind the latest row) has passed them. number tells rows of one time apart."""
    timed = _timed(rows, key, time, number, fields).withWatermark(time, delay)
    schema = _schema(rows, key, number, outputs)
    processor = _Ordered(machine, fields, _columns(schema), key, number)
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
