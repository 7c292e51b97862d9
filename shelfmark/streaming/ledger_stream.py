"""The ledger of sent batches as a keyed state machine over the stream of result events.

State per batch: how far it got, how often it was tried, the newest ids and error with the number of their event, and which events it
has seen, a bit per number. All of it is one value but for the bits of numbers that lie far apart. ``at`` is when a result was received, ``seq`` its place among those of its
batch. Events may come out of order and more than once; what a batch is in the end depends on the set of its events
only, and equals ``ledger.apply_results`` over them. A batch that was receipted never falls back.

A batch that was tried and has no receipt gets a timer; when the time of the events (``at``, less the allowed delay) has passed it, a row with
action ``retry`` asks for it to be sent again, with twice the wait each time, and after ``max_attempts`` a row with action ``exhausted``
hands it to a person. A receipt takes the wish back; a timer that goes off early is set anew, one that goes off for nothing says nothing. State and timers live in Spark's state store and survive a restart with the checkpoint.

Each access to the state store is a message between Python and the JVM, and each key a table of its own on the way there and back. So batches
are dealt to groups by a hash, and a group is the key: its batches are read, written, and woken by one timer together.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfmark.operators.ledger import ERROR_CHARS
from shelfmark.sources.sinks import VersionedTable

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = ("stage string, attempts long, done int, last_seq long, source_id string, source_seq long, job_id string, job_seq long, "
         "error string, error_kind string, error_seq long, timer long, due long, events long, chunk long, bits binary, more boolean")
FIELDS = [f.split()[0] for f in STATE.split(", ")]
OUT = ("instance string, source_key string, stage string, attempts long, source_id string, job_id string, last_error string, "
       "last_error_kind string, action string, events long")
OUT_FIELDS = [f.split()[0] for f in OUT.split(", ")]
KEY = ["instance", "source_key"]
EVENT = ["ms", "seq", "event", "source_id", "job_id", "message", "kind"]
START = ["stage", "attempts", "source_id", "job_id", "last_error", "last_error_kind"]
NONE = -(2**63)  # the number of an event that has not come yet
DONE = {"receipted": 1, "indexed": 2}
CHUNK = 9  # bits of a number that stand for its place in a chunk


@dataclass(slots=True)
class Taken:
    """The events of a batch in a micro-batch, taken into its state."""

    state: dict
    chunks: dict[int, int] = field(default_factory=dict)
    tried: bool = False
    last: int = 0


class Batches(StatefulProcessor):
    """A batch is a key of the state store."""

    def __init__(self, max_attempts: int, wait_ms: int) -> None:
        self.max_attempts, self.wait_ms = max_attempts, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", STATE)
        self.seen = handle.getMapState("seen", "chunk long", "bits binary")  # all chunks but the one in the value

    @staticmethod
    def _blank() -> dict:
        return dict.fromkeys(FIELDS) | {"stage": "pending", "attempts": 0, "done": 0, "last_seq": NONE, "source_seq": NONE, "job_seq": NONE,
                                        "error_seq": NONE, "events": 0, "more": False}

    def _load(self, key) -> dict:
        held = self.state.get()
        return self._blank() if held is None else dict(zip(FIELDS, held))

    def _save(self, key, s: dict) -> None:
        self.state.update(tuple(s.values()))

    @staticmethod
    def _place(key, number: int) -> tuple:
        """The key of a chunk in the map."""
        return (number,)

    @staticmethod
    def _row(key, s: dict, action: str) -> Row:
        stage = {1: "receipted", 2: "indexed"}.get(s["done"], s["stage"])
        return ROW(*key, stage, s["attempts"], s["source_id"], s["job_id"], s["error"], s["error_kind"], action, s["events"])

    def _start(self, key, stage, attempts, source_id, job_id, error, error_kind) -> None:
        """A row of the stored ledger: everything that comes is newer."""
        s = self._blank()
        s.update(stage=stage, attempts=None if attempts is None else int(attempts), done=DONE.get(stage, 0), source_id=source_id, job_id=job_id,
                 error=error, error_kind=error_kind)
        self._save(key, s)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._start(key, *(initialState[c] for c in START))

    def _chunk(self, key, s: dict, number: int) -> int:
        """The bits of a chunk of event numbers."""
        if number == s["chunk"]:
            return int.from_bytes(s["bits"], "little")
        at = self._place(key, number)
        held = self.seen.getValue(at) if s["more"] and self.seen.containsKey(at) else None
        return 0 if held is None else int.from_bytes(held[0], "little")

    def _keep(self, key, s: dict, chunks: dict[int, int]) -> None:
        """Newest bits of some chunks; the last chunk goes into the value, any other into the map."""
        as_bytes = {n: bits.to_bytes((bits.bit_length() + 7) // 8, "little") for n, bits in chunks.items()}
        if s["chunk"] is not None:
            as_bytes.setdefault(s["chunk"], bytes(s["bits"]))
        *others, last = sorted(as_bytes)
        for n in others:
            if n in chunks or n == s["chunk"]:
                self.seen.updateValue(self._place(key, n), (as_bytes[n],))
                s["more"] = True
        s["chunk"], s["bits"] = last, as_bytes[last]

    def _take(self, key, taken: Taken, ms, seq, event, source_id, job_id, message, kind) -> None:
        s, chunks = taken.state, taken.chunks
        if ms > taken.last:
            taken.last = ms
        number, bit = seq >> CHUNK, 1 << (seq & (1 << CHUNK) - 1)
        bits = chunks.get(number)
        if bits is None:
            bits = chunks[number] = self._chunk(key, s, number)
        if bits & bit:
            return
        chunks[number] = bits | bit
        s["events"] += 1
        if event in ("submitted", "failed", "counted"):
            if s["attempts"] is not None:  # unknown stays unknown
                s["attempts"] += 1
            taken.tried = True
            if event != "counted" and seq > s["last_seq"]:
                s["stage"], s["last_seq"] = event, seq
            if seq > s["error_seq"]:
                wrong = event != "submitted"
                s["error"] = message[:ERROR_CHARS] if wrong and message is not None else None
                s["error_kind"], s["error_seq"] = kind if wrong else None, seq
        else:
            s["done"] = max(s["done"], DONE.get(event, 0))
        if source_id is not None and seq > s["source_seq"]:
            s["source_id"], s["source_seq"] = source_id, seq
        if job_id is not None and seq > s["job_seq"]:
            s["job_id"], s["job_seq"] = job_id, seq

    def _settle(self, key, taken: Taken, timerValues) -> Row:
        s = taken.state
        if s["done"]:
            s["due"] = None
        elif taken.tried:
            # In front of the watermark, whatever the event came late by.
            s["due"] = max(taken.last, timerValues.getCurrentWatermarkInMs()) + self.wait_ms * 2 ** min((s["attempts"] or 1) - 1, 20)
            if s["timer"] is None or s["due"] < s["timer"]:
                self._set_timer(s)
        self._keep(key, s, taken.chunks)
        self._save(key, s)
        return self._row(key, s, "state")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        taken = Taken(self._load(key))
        for r in rows:
            self._take(key, taken, int(r.at.timestamp() * 1000), *(r[c] for c in EVENT[1:]))
        yield self._settle(key, taken, timerValues)

    def _set_timer(self, s: dict) -> None:
        if s["timer"] is not None:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = s["due"]
        self.handle.registerTimer(s["timer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._load(key)
        s["timer"] = None
        due = s["due"]
        if due is not None and due > timerValues.getCurrentWatermarkInMs():
            self._set_timer(s)  # it was put off
        else:
            s["due"] = None
        self._save(key, s)
        if due is not None and s["due"] is None:
            yield self._row(key, s, "exhausted" if (s["attempts"] or 0) >= self.max_attempts else "retry")

    def close(self) -> None:
        pass


ROW = Row(*OUT_FIELDS)


class Groups(Batches):
    """A group of batches is a key of the state store: the states of its batches are one value, and its timer is the earliest of theirs.

    A state stays packed until an event or a timer touches its batch. Events come in frames, a part of the group's at a time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batches", "held binary")
        self.seen = handle.getMapState("seen", "instance string, source_key string, chunk long", "bits binary")

    def _open(self) -> None:
        held = self.state.get()
        self.held, self.timers, self.timer = ({}, {}, None) if held is None else pickle.loads(held[0])

    def _close(self) -> None:
        first = min(self.timers.values(), default=None)
        if first is not None and (self.timer is None or first < self.timer):
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.timer = first
            self.handle.registerTimer(first)
        self.state.update((pickle.dumps((self.held, self.timers, self.timer)),))

    def _load(self, key) -> dict:
        held = self.held.get(key)
        return self._blank() if held is None else dict(zip(FIELDS, pickle.loads(held)))

    def _save(self, key, s: dict) -> None:
        self.held[key] = pickle.dumps(tuple(s.values()))
        if s["timer"] is None:
            self.timers.pop(key, None)
        else:
            self.timers[key] = s["timer"]

    @staticmethod
    def _place(key, number: int) -> tuple:
        return (*key, number)

    def _set_timer(self, s: dict) -> None:
        s["timer"] = s["due"]

    @staticmethod
    def _columns(frame: pd.DataFrame, names: list[str]) -> list[list]:
        """Plain values; a null is None in every column."""
        found = []
        for c in names:
            values = frame[c].tolist()
            found.append([None if v != v else v for v in values] if frame[c].hasnans else values)
        return found

    @staticmethod
    def _frame(rows: list[Row]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(OUT_FIELDS, zip(*rows))})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._open()
        for instance, source_key, *row in zip(*self._columns(initialState, KEY + START)):
            self._start((instance, source_key), *row)
        self._close()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        touched: dict[tuple, Taken] = {}
        for frame in rows:
            instances, keys, *events = self._columns(frame, KEY + EVENT)
            for batch, event in zip(zip(instances, keys), zip(*events)):
                taken = touched.get(batch)
                if taken is None:
                    taken = touched[batch] = Taken(self._load(batch))
                self._take(batch, taken, *event)
        made = [self._settle(batch, taken, timerValues) for batch, taken in touched.items()]
        self._close()
        yield self._frame(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        self.timer = None
        now = timerValues.getCurrentWatermarkInMs()
        made = []
        for batch in [batch for batch, timer in self.timers.items() if timer <= now]:
            made += super().handleExpiredTimer(batch, timerValues, expiredTimerInfo)
        self._close()
        if made:
            yield self._frame(made)


def ledger_states(events: DataFrame, ledger: DataFrame | None = None, max_attempts: int = 5, wait_ms: int = 60_000,
                  late: str = "1 minute", groups: int = 1 << 13) -> DataFrame:
    """The state of every batch that an event or a timer touched, per micro-batch. ``ledger`` (batch) is where it starts from.

    ``groups`` is how many values the state is kept in: as many hold a batch each while they are few, and a micro-batch reads and writes those its events are
    of. It stays as it is for the life of a checkpoint.

    Needs the RocksDB state store (``STORE``), which ``start_ledger`` sets for its query.
    """
    group = F.pmod(F.xxhash64(*KEY), F.lit(groups)).alias("group")
    told = events.withWatermark("at", late).select(group, "at", *KEY, F.unix_millis("at").alias("ms"), *EVENT[1:])
    start = None if ledger is None else ledger.select(group, *KEY, *START).groupBy("group")
    return told.groupBy("group").transformWithStateInPandas(Groups(max_attempts, wait_ms), OUT, "Update", "eventTime", initialState=start)


def start_ledger(states: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of states as a version of its own; done again, it replaces that version."""
    conf, key = states.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, STORE)  # a query keeps the settings it was started with
    try:
        return (
            states.writeStream.outputMode("update").foreachBatch(lambda df, n: table.write(df, n))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def current_ledger(ledger: DataFrame, states: DataFrame) -> DataFrame:
    """The ledger after all states that the stream has written: of each batch the one that has seen the most events."""
    keys = ["instance", "source_key"]
    held = ("stage", "attempts", "source_id", "job_id", "last_error", "last_error_kind")
    last = states.where("action = 'state'").groupBy(*keys).agg(F.max_by(F.struct(*held), "events").alias("_now"))
    now = lambda c: F.when(F.col("_now").isNull(), F.col(c)).otherwise(F.col(f"_now.{c}")).alias(c)
    return ledger.join(last, keys, "left").select(*(now(c) if c in held else F.col(c) for c in ledger.columns))
