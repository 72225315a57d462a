"""Streaming operators with state for each entity, on ``transformWithState`` (replay) and ``transformWithStateInPandas`` (commands).

They need the RocksDB state store: spark.sql.streaming.stateStore.providerClass. Both can begin at states that a batch left (``initial``), and
then go on as the batch would have. What a running stream knows of its entities is read from its state store (``running``).

A group's rows of one micro-batch are sorted in a task, so a trigger's limits (files or offsets a batch) bound what a hot entity takes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.process import IDLE, IDLED, OUT, OUT_KINDS, STOPPED, Behaviour, out_row, run_entity
from tidemark.operators.projection import in_batches, mapped_rows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of an entity's events of one micro-batch that a replay holds, and of those in a row that goes to it; each counted as its body and EVENT more.
HELD, PACK, EVENT = 64 << 20, 16 << 10, 250
#: What becomes of the state of an entity that has ended.
KEEP, REMOVE = "keep", "remove"


def held(initial: DataFrame, state: str, active: bool = False):
    """States as groups for a processor to begin with; in a struct, so that whole numbers stay whole beside nulls."""
    on = F.coalesce("active", F.lit(True)) if active and "active" in initial.columns else F.lit(True)
    row = F.struct(F.col("state").cast(state).alias("state"), F.col("sequence").cast("long").alias("sequence"), on.alias("active"))
    return initial.select("id", row.alias("held")).groupBy("id")


def begun(initial: pd.DataFrame) -> tuple:
    """(state, sequence, active) of one entity's row."""
    row = initial["held"].iloc[0]
    return tuple(row[c] for c in ("state", "sequence", "active"))


def from_arrow(value, kind: T.DataType):
    """A value as Python has it; Arrow gives maps as lists of pairs."""
    if value is None or not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return value
    if isinstance(kind, T.StructType):
        return {f.name: from_arrow(value[f.name], f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [from_arrow(v, kind.elementType) for v in value]
    return {from_arrow(k, kind.keyType): from_arrow(v, kind.valueType) for k, v in value}


def to_arrow(value, kind: T.DataType):
    """A value as Arrow takes it: structs, which may be rows or tuples, by name, and maps as lists of pairs."""
    if value is None or not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return value
    if isinstance(kind, T.StructType):
        own = [value.get(c) for c in kind.names] if isinstance(value, dict) else value
        return {f.name: to_arrow(v, f.dataType) for f, v in zip(kind, own)}
    if isinstance(kind, T.ArrayType):
        return [to_arrow(v, kind.elementType) for v in value]
    return [(to_arrow(k, kind.keyType), to_arrow(v, kind.valueType)) for k, v in value.items()]


def packed(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(id, events) of journal rows: what lies together of an entity goes as one row, since each value of a row costs a stateful task more than an event."""
    for id, own in groupby(rows, itemgetter(0)):
        pack, size = [], 0
        for _, *event, body in own:
            pack.append((*event, body))
            size += EVENT + len(body)
            if size >= PACK:
                yield id, pickle.dumps(pack)
                pack, size = [], 0
        if pack:
            yield id, pickle.dumps(pack)


#: What a replay puts out.
REPLAYED = Row("id", "state", "sequence")


class ReplayProcessor(StatefulProcessor):
    """Folds an entity's events in order of sequence, whatever the order of batches.

    An event that comes early waits until all before it are there; with ``patience`` (milliseconds) no longer than that, and
    then the gap is passed over, as in a batch. Writes of one sequence are folded as in a batch as far as they are there at the same
    time: one after the other in order of time, a repetition of the same body once. What comes for a
    sequence that is folded already is left out, which is where a stream differs from a batch. What is
    kept is the state, the number of events folded, the next sequence and the waiting events.

    Rows are those of ``packed``, with times as microseconds. What is in the store is had by round trips from Python, so an entity whose
    events come in order takes a few a micro-batch, whatever their number. kind: the state's type, as SQL ``state``.
    """

    def __init__(self, step: Callable, state: str, kind: T.DataType, first: int = 0, patience: int | None = None):
        self.step, self.state, self.kind, self.first, self.patience, self.room = step, state, kind, first, patience, HELD
        self.began: tuple | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"state {self.state}, folded bigint, next bigint")
        self.waiting = handle.getMapState("waiting", "sequence_id bigint", "parts binary")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        held = initialState["held"]
        now = (from_arrow(held["state"], self.kind), held["sequence"], held["sequence"])
        self.now.update(now)
        self.began = (key, now)  # its rows, if it has any, are next

    def _waited(self, sequence: int) -> list[tuple]:
        """The writes of a sequence that waited, which they do no longer."""
        if not self.waiting.containsKey((sequence,)):
            return []
        parts = pickle.loads(self.waiting.getValue((sequence,))[0])
        self.waiting.removeKey((sequence,))
        return parts

    def _wait(self, held: dict[int, list[tuple]], beside: bool) -> None:
        """Leaves writes waiting; beside: others may wait already."""
        for sequence, parts in held.items():
            self.waiting.updateValue((sequence,), (pickle.dumps([*(self._waited(sequence) if beside else ()), *parts]),))

    def _fold(self, state, folded: int, parts: list[tuple]):
        if len(parts) > 1:
            parts = sorted(parts)
        for i, (_, kind, body) in enumerate(parts):
            if i + 1 < len(parts) and parts[i + 1][2] == body:
                continue  # written again: the latest counts
            state, folded = self.step(state, kind, body), folded + 1
        return state, folded

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.began is not None and self.began[0] == key:
            now, waits = self.began[1], False
        else:
            now = self.now.get() if self.now.exists() else None
            waits = now is not None and self.waiting.exists()
        self.began = None
        state, folded, nxt = now or (None, self.first, self.first)
        held: dict[int, list[tuple]] = {}
        size = 0
        for _, pack in rows:
            for seq, time, kind, body in pickle.loads(pack):
                if seq >= nxt:
                    held.setdefault(seq, []).append((1000 * time, kind, body))  # what waits has nanoseconds
                    size += EVENT + len(body)
            if size > self.room:
                self._wait(held, waits)
                held, size, waits = {}, 0, True
        while True:
            parts = held.pop(nxt, [])
            if waits:
                parts = [*self._waited(nxt), *parts]
            if not parts:
                break
            state, folded = self._fold(state, folded, parts)
            nxt += 1
        self._wait(held, waits)
        self.now.update((state, folded, nxt))
        if self.patience is not None and (held or waits and self.waiting.exists()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield REPLAYED(key[0], to_arrow(state, self.kind), folded)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, folded, nxt = self.now.get()
        for (seq,) in sorted(tuple(k) for k in self.waiting.keys()):
            state, folded = self._fold(state, folded, self._waited(seq))
            nxt = seq + 1
        self.now.update((state, folded, nxt))
        yield REPLAYED(key[0], to_arrow(state, self.kind), folded)

    def close(self) -> None:
        pass


class CommandProcessor(StatefulProcessor):
    """Runs a behaviour: events and rejections go out, state, sequence and whether the entity is active stay.

    timeout (milliseconds): an entity that gets no command for so long is stopped; its row of that goes out. Time is the clock's, or with
    ``by_events`` that of the commands: then a longer gap between two commands stops an entity wherever it comes, in one micro-batch or over several, and
    the watermark stops those after which nothing comes. ended: REMOVE deletes what the store has of a stopped entity; only a spawn command
    starts such an entity, and one that was never there.
    """

    def __init__(self, behaviour: Behaviour, state: str, timeout: int | None = None, by_events: bool = False, ended: str = KEEP):
        self.behaviour, self.kind, self.timeout, self.by_events, self.ended = behaviour, state, timeout, by_events, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"state {self.kind}, sequence bigint, active boolean, due bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        state, sequence, active = begun(initialState)
        if active or self.ended == KEEP:
            self.now.update((state, sequence, active, None))

    def _set(self, state, sequence: int, active: bool, due: int | None) -> None:
        if active or self.ended == KEEP:
            self.now.update((state, sequence, active, due))
        elif self.now.exists():
            self.now.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, sequence, active, due = self.now.get() if self.now.exists() else (None, 0, self.ended == KEEP, None)
        # In a batch's order: by arrival, then kind and body.
        whole = lambda b: bytes(b) if isinstance(b, (bytes, bytearray, memoryview)) else None
        sent = [(int(a), k, whole(b), int(t)) for part in rows for a, k, b, t in zip(part["arrival"], part["kind"], part["bytes"], part["tidemark_at"])]
        sent.sort(key=lambda c: (c[0], c[1], c[2] is not None, c[2] or b""))
        last = [due]

        def timed() -> Iterator[tuple]:
            for arrival, kind, body, at in sent:
                if self.by_events and self.timeout is not None:
                    if last[0] is not None and at > last[0]:
                        yield None, IDLED, None
                    last[0] = at + self.timeout
                yield arrival, kind, body

        out = list(run_entity(self.behaviour, key[0], state, sequence, timed(), active))
        end = dict(zip(OUT_KINDS, out[-1]))
        if self.timeout is not None and not self.by_events:
            last[0] = timerValues.getCurrentProcessingTimeInMs() + self.timeout
        self._set(end["state"], end["sequence"], end["active"], last[0])
        if self.timeout is not None and end["active"]:
            self.handle.registerTimer(last[0] + self.by_events)  # a command that comes just in time is not late
        yield from in_batches(out, OUT_KINDS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.now.exists():
            return
        state, sequence, active, due = self.now.get()
        if active and due is not None and expiredTimerInfo.getExpiryTimeInMs() >= due:  # no command came since the timer was set
            state = self.behaviour.stop(state)
            self._set(state, sequence, False, None)
            yield from in_batches([out_row(id=key[0], what=STOPPED, reason=IDLE, sequence=sequence, active=False, state=state)], OUT_KINDS)

    def close(self) -> None:
        pass


def replay(events: DataFrame, step: Callable, state: str, patience: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """id, state, sequence after each batch, of a stream of journal rows; patience as in ReplayProcessor.

    initial: id, state, sequence (the first to read), such as a batch replay's result; entities without a row begin at 0.
    """
    ddl = f"id string, state {state}, sequence bigint"
    kind = events.sparkSession.createDataFrame([], ddl).schema["state"].dataType
    rows = events.select("id", "sequence_id", F.unix_micros(F.col("created_at").cast("timestamp")), "registry_key", "bytes")
    return mapped_rows(rows, packed, "id string, events binary").groupBy("id").transformWithState(
        ReplayProcessor(step, state, kind, patience=patience), ddl,
        outputMode="Update", timeMode="None" if patience is None else "ProcessingTime", initialState=None if initial is None else held(initial, state),
    )


def process(commands: DataFrame, behaviour: Behaviour, state: str, timeout: int | None = None, initial: DataFrame | None = None, delay: str | None = None, ended: str = KEEP) -> DataFrame:
    """The rows of ``operators.process.entrust`` for a stream of commands; timeout and ended as in CommandProcessor.

    initial: id, state, sequence and perhaps active, such as ``Processes.states()``. delay: time is that of the commands' created_at, by how
    much they may come late (an interval); later ones are left out.
    """
    if ended not in (KEEP, REMOVE):
        raise ValueError("ended is keep or remove")
    by_events = delay is not None
    at = F.unix_millis(F.col("created_at").cast("timestamp")) if by_events else F.lit(0)
    own = commands.withWatermark("created_at", delay) if by_events else commands
    return own.withColumn("tidemark_at", at.cast("long")).groupBy("id").transformWithStateInPandas(
        CommandProcessor(behaviour, state, timeout, by_events, ended), OUT.format(state=state), outputMode="Append",
        timeMode="EventTime" if by_events else "None" if timeout is None else "ProcessingTime", initialState=None if initial is None else held(initial, state, True),
    )


def running(spark: SparkSession, checkpoint: str, process_type: str = "process", operator: int = 0) -> DataFrame:
    """id, process_type, state, sequence of the entities that are active in a stream of commands, as of its last finished batch.

    checkpoint: the stream's folder. The rows are what ``process.found`` and ``entrust`` look up; they are read from the state store beside the running stream.
    """
    own = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "now").load(checkpoint)
    return own.where("value.active").select(F.col("key.id").alias("id"), F.lit(process_type).alias("process_type"), "value.state", "value.sequence")


