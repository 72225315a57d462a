"""Replay: the state of every entity by folding its events in order, from nothing or from a snapshot.

The rows are shuffled once, by id, or not at all where the journal is a table bucketed by id; duplicates go, rows are ordered and
folded within that partitioning. A state's sequence is where the fold began plus the number of events applied, which differs from the last
sequence plus one where there are gaps. The next replay begins at that sequence, itself included.

A column fold gathers an entity's events in a list of at most ``step`` of them: where an entity has more, its events are dealt into
blocks that are folded one after the other, each from the state before. A fold in Python streams over an entity's events
and holds one state. Steps that combine (``replay_composed``) need neither: segments of an entity's events are combined in parallel, then
the segments, so an entity of any size takes one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.errors import ApplyEvent, EmptyJournal, FirstFormation, NotCompatible, ProjectionError
from tidemark.functions.monoids import Monoid
from tidemark.operators.mapping import COMPOSITION, PROJECTION, Change, Fold, Mapper, unmapped
from tidemark.operators.ordering import REPLAY_ORDER, fixture_dedup, with_place
from tidemark.sources.shared import kept, remove, scratch

FIRST, DECODE = "no state to begin with", "body can't be decoded"
#: Events of an entity in one list.
STEP = 100_000
#: Events in a segment, and segments in one of the next level, where steps combine.
SEGMENT = 4_096
#: Event types that an error names.
NAMED = 20
#: Rows of a batch that a Python fold returns.
ROWS = 5_000


def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a partition one by one, as Python values."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def in_record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded size."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def mapped_rows(df: DataFrame, make: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """What ``make`` gives for each partition's rows, streamed through it."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    kinds = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: in_record_batches(make(streamed(batches)), kinds), schema)


def in_batches(rows: Iterable[tuple], columns: dict[str, str], size: int = ROWS) -> Iterator[pd.DataFrame]:
    """Rows as data frames of a bounded size; columns of kind "long" stay whole numbers beside nulls."""
    held: list[tuple] = []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(held, columns=list(columns), dtype=object)
        return out.astype({c: "Int64" for c, kind in columns.items() if kind == "long"})

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield frame()
            held = []
    if held:
        yield frame()


class Projector:
    """Replays of one journal with the projection handlers of one mapper.

    state: the state's SQL type. keep_duplicates leaves repeated writes in. by_id: the journal is bucketed by id, so
    nothing needs to be shuffled.
    """

    def __init__(self, journal: DataFrame, mapper: Mapper, state: str, keep_duplicates: bool = False, by_id: bool = False):
        self.journal, self.state, self.keep_duplicates, self.by_id = journal, state, keep_duplicates, by_id
        self.handlers: dict[str, Fold] = mapper.of_kind(PROJECTION)
        self.changes: dict[str, Change] = mapper.of_kind(COMPOSITION)

    def over(self, rows: DataFrame) -> Projector:
        """The same over some rows of the journal."""
        out = Projector(rows, Mapper(), self.state, self.keep_duplicates, self.by_id)
        out.handlers, out.changes = self.handlers, self.changes
        return out

    def unmapped(self) -> DataFrame:
        """registry_key, n: event types without a handler."""
        return unmapped(self.journal, list(self.handlers))

    def _since(self, snapshot: DataFrame | None, complete: bool) -> DataFrame:
        """The journal's rows from the snapshot's least sequence on, if that is complete."""
        rows = self.journal.select("id", "sequence_id", "registry_key", "bytes", "created_at")
        if snapshot is not None and complete:  # reaches the scan
            least = snapshot.agg(F.min("sequence")).first()[0]
            rows = rows.where(F.col("sequence_id") >= F.lit(least))
        return rows

    def _measured(self, rows: DataFrame, keys: list[str], on_unmapped: str) -> tuple[DataFrame, int, int]:
        """The rows with a handler, the most rows of an entity and the largest sequence. One pass; strict raises NotCompatible."""
        known = F.col("registry_key").isin(keys)
        if on_unmapped != "error":
            rows = rows.where(known)
        by_id = rows.groupBy("id").agg(F.count("*").alias("n"), F.max("sequence_id").alias("last"), F.max(~known).alias("strange"))
        n, last, strange = by_id.agg(F.max("n"), F.max("last"), F.max("strange")).first()
        if strange:
            raise NotCompatible([r["registry_key"] for r in unmapped(rows, keys).select("registry_key").orderBy("registry_key").limit(NAMED).collect()])
        return rows, n or 0, last or 0

    def _rows(self, snapshot: DataFrame | None, complete: bool = False) -> DataFrame:
        rows = self._since(snapshot, complete)
        if snapshot is not None:
            since = snapshot.select("id", F.col("sequence").alias("since"))
            rows = rows.join(since, "id", "left").where("since is null or sequence_id >= since").drop("since")
        return rows

    def _own(self, rows: DataFrame) -> DataFrame:
        rows = rows if self.by_id else rows.repartition("id")
        return rows if self.keep_duplicates else fixture_dedup(rows)

    def _decoded(self, rows: DataFrame) -> tuple[DataFrame, dict[object, str]]:
        """rows with a body column for each decoder, decoded once and before the fold; decoder -> column.

        Bodies of types without an order stay bytes and are decoded in the fold.
        """
        decoders: dict[object, list[str]] = {}
        for name, h in self.handlers.items():
            decoders.setdefault(h.decode, []).append(name)
        made = {f"body{i}": F.when(F.col("registry_key").isin(keys), d(F.col("bytes"))) for i, (d, keys) in enumerate(decoders.items())}
        out = rows.withColumns(made)
        text = {c: out.schema[c].dataType.simpleString() for c in made}
        plain = {d: c for d, c in zip(decoders, made) if "variant" not in text[c] and "map<" not in text[c]}
        return out.drop(*set(made) - set(plain.values())), plain

    def _step(self, bodies: dict[object, str], acc: Column, x: Column) -> Column:
        state, key = acc["state"], x["registry_key"]
        after, wrong = F.lit(None).cast(self.state), F.lit(None).cast("string")
        for name, h in self.handlers.items():
            body = x[bodies[h.decode]] if h.decode in bodies else h.decode(x["bytes"])
            formed = F.lit(None).cast(self.state) if h.first is None else h.first(body).cast(self.state)
            after = F.when(key == name, F.when(state.isNull(), formed).otherwise(h.apply(state, body).cast(self.state))).otherwise(after)
            reason = F.lit(None).cast("string") if h.reject is None else F.when(state.isNotNull(), h.reject(state, body))
            reason = F.when(body.isNull(), DECODE).when(state.isNull() & formed.isNull(), FIRST).otherwise(reason)
            wrong = F.when(key == name, reason).otherwise(wrong)
        stop = acc["error"].isNotNull() | wrong.isNotNull()
        return F.struct(
            F.when(stop, state).otherwise(after).alias("state"),
            (acc["sequence"] + F.when(stop, 0).otherwise(1)).cast("long").alias("sequence"),
            F.coalesce(acc["error"], wrong).alias("error"),
        )

    def _zero(self) -> Column:
        return F.struct(F.lit(None).cast(self.state).alias("state"), F.lit(0).cast("long").alias("sequence"), F.lit(None).cast("string").alias("error"))

    def _folded(self, rows: DataFrame, bodies: dict[object, str], start: DataFrame | None, how: str) -> DataFrame:
        """id and r (state, sequence, error) of the rows' entities from where they start (id, start)."""
        part = F.struct("sequence_id", "created_at", "registry_key", "bytes", *bodies.values())
        parts = rows.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        zero = self._zero()
        if start is not None:
            parts, zero = parts.join(start, "id", how), F.coalesce(F.col("start"), zero)
        events = F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType))
        return parts.select("id", F.aggregate(events, zero, lambda acc, x: self._step(bodies, acc, x)).alias("r"))

    def replay(self, snapshot: DataFrame | None = None, on_unmapped: str = "error", on_error: str = "raise", step: int = STEP, complete: bool = False) -> DataFrame:
        """id, state, sequence (and error, with on_error='keep') of every entity with events or a snapshot.

        snapshot: id, state, sequence (the first to read). complete: every entity with events before the snapshot's least sequence
        has a row in it, so that no earlier event need be read. A strict replay first looks for event types without a
        handler in all rows to be read and raises NotCompatible (an action). An entity's fold stops at its first
        error; 'raise' raises it (an action, whose states are kept in the checkpoint folder), 'keep' returns it with the state before.
        """
        rows, most, _ = self._measured(self._rows(snapshot, complete), list(self.handlers), on_unmapped)
        own, start = self._own(rows), self._start(snapshot)
        if most <= step:
            folded = self._folded(*self._decoded(own), start, "full")
        else:
            folded = self._in_blocks(own, start, step)
        return self._checked(folded.select("id", "r.state", "r.sequence", "r.error"), on_error)

    def _start(self, snapshot: DataFrame | None) -> DataFrame | None:
        if snapshot is None:
            return None
        begun = F.struct(F.col("state").cast(self.state).alias("state"), F.col("sequence").cast("long").alias("sequence"), F.lit(None).cast("string").alias("error"))
        return snapshot.select("id", begun.alias("start"))

    def _in_blocks(self, rows: DataFrame, start: DataFrame | None, step: int) -> DataFrame:
        """Folds blocks of events one after the other; each block is read once, an entity's last state is its result.

        Each round's entities that have no more events go to one folder, which is read at the end; running ones are written for the next round.
        """
        spark = self.journal.sparkSession
        path, ended = scratch(spark, "blocks"), scratch(spark, "ended")
        placed = with_place(rows, ["id"], [*REPLAY_ORDER, "registry_key", "bytes"], "tidemark_at").withColumn("tidemark_block", F.floor(F.col("tidemark_at") / step).cast("int"))
        placed.drop("tidemark_at").write.partitionBy("tidemark_block").parquet(path)
        blocks = spark.read.schema(placed.drop("tidemark_at").schema).parquet(path)
        n = (blocks.agg(F.max("tidemark_block")).first()[0] or 0) + 1
        now, before, kind = start, None, None
        for k in range(n):
            block, bodies = self._decoded(blocks.where(F.col("tidemark_block") == k).drop("tidemark_block"))
            if now is not None:
                now.join(block.select("id").distinct(), "id", "left_anti").withColumnRenamed("start", "r").write.mode("append").parquet(ended)
            folded = self._folded(block, bodies, now, "left")
            kind, written = folded.schema, scratch(spark, "running")
            folded.write.parquet(written)
            now = spark.read.schema(kind).parquet(written).withColumnRenamed("r", "start")
            remove(spark, [before] if before else [])
            before = written
        now.withColumnRenamed("start", "r").write.mode("append").parquet(ended)
        remove(spark, [before, path])
        return spark.read.schema(kind).parquet(ended)

    def replay_composed(self, monoid: Monoid, snapshot: DataFrame | None = None, on_unmapped: str = "error", on_error: str = "raise", segment: int = SEGMENT, complete: bool = False) -> DataFrame:
        """``replay`` for handlers that are changes of a monoid, in one job whatever the size of an entity.

        Rows are shuffled by entity and segment of sequences, so an entity with a third of all events is spread over tasks; each
        segment becomes one change, and each ``segment`` of these one of the next level, up to one for an entity. A body that can't be decoded, or is no
        change, stops its entity as an error does in ``replay``.
        """
        rows, _, last = self._measured(self._since(snapshot, complete), list(self.changes), on_unmapped)
        part = F.floor(F.col("sequence_id") / segment)
        rows = rows.withColumn("part", part).repartition("id", "part")
        if snapshot is not None:
            # Rows of the segment where an entity begins are compared with its sequence; earlier segments go as a whole, below.
            begins = snapshot.select("id", F.floor(F.col("sequence") / segment).alias("part"), F.col("sequence").alias("since"))
            rows = rows.join(begins, ["id", "part"], "left").where("since is null or sequence_id >= since").drop("since")
        rows = rows if self.keep_duplicates else fixture_dedup(rows, "part")
        change = F.lit(None).cast(monoid.kind)
        for key, h in self.changes.items():
            change = F.when(F.col("registry_key") == key, h.change(h.decode(F.col("bytes"))).cast(monoid.kind)).otherwise(change)

        def made(c: Column, n: Column, error: Column) -> Column:
            return F.struct(c.cast(monoid.kind).alias("change"), n.cast("long").alias("n"), error.cast("string").alias("error"))

        def combined(a: Column, b: Column) -> Column:
            later = made(monoid.combine(a["change"], b["change"]), a["n"] + b["n"], b["error"])
            return F.when(a["error"].isNotNull(), a).otherwise(later)

        none = made(monoid.none(), F.lit(0), F.lit(None))
        one = F.when(F.col("made").isNull(), made(monoid.none(), F.lit(0), F.lit(DECODE))).otherwise(made(F.col("made"), F.lit(1), F.lit(None)))
        ordered = rows.withColumn("made", change).select("id", "part", F.struct("sequence_id", "created_at", "registry_key", "bytes", one.alias("r")).alias("x"))
        level = ordered.groupBy("id", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        level = level.select("id", "part", F.aggregate("xs", none, lambda acc, x: combined(acc, x["r"])).alias("r"))
        if snapshot is not None:
            level = level.join(snapshot.select("id", F.floor(F.col("sequence") / segment).alias("since")), "id", "left").where("since is null or part >= since").drop("since")
        parts = last // segment + 1
        while parts > 1:
            parts = -(-parts // segment)
            x = F.struct("part", "r")
            up = F.floor(F.col("part") / segment).alias("part") if parts > 1 else F.lit(0).cast("long").alias("part")
            level = level.select("id", up, x.alias("x")).groupBy("id", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
            level = level.select("id", "part", F.aggregate("xs", none, lambda acc, x: combined(acc, x["r"])).alias("r"))
        whole = level.select("id", "r")
        state, since = F.lit(None).cast(self.state), F.lit(0).cast("long")
        if snapshot is not None:
            whole = whole.join(snapshot.select("id", F.col("state").cast(self.state).alias("begun"), F.col("sequence").cast("long").alias("since")), "id", "full")
            state, since = F.col("begun"), F.coalesce("since", F.lit(0).cast("long"))
        r = F.coalesce("r", none)
        # An entity without events keeps its state, which may be null.
        after = F.when(r["n"] == 0, state).otherwise(monoid.act(state, r["change"]).cast(self.state))
        return self._checked(whole.select("id", after.alias("state"), (since + r["n"]).alias("sequence"), r["error"].alias("error")), on_error)

    @staticmethod
    def _checked(out: DataFrame, on_error: str) -> DataFrame:
        if on_error == "keep":
            return out
        out = kept(out)
        bad = out.where("error is not null").select("id", "sequence", "error").first()
        if bad:
            kind = FirstFormation if bad["error"] == FIRST else ApplyEvent
            raise kind(f"{bad['id']} after {bad['sequence']} events: {bad['error']}")
        return out.drop("error")

    def replay_one(self, id: object, snapshot: tuple | None = None) -> tuple:
        """(state, sequence) of one entity; no event and no snapshot raise EmptyJournal."""
        own = self.over(self.journal.where(F.col("id") == str(id)))
        spark = self.journal.sparkSession
        start = None if snapshot is None else spark.createDataFrame([(str(id), *snapshot)], f"id string, state {self.state}, sequence bigint")
        row = own.replay(start).first()
        if row is None:
            raise EmptyJournal(f"{id} has no events")
        return row["state"], row["sequence"]

    def until(self, sequence: int | None = None, time=None) -> Projector:
        """The same over the events up to a sequence, or up to a time, both included."""
        rows = self.journal
        if sequence is not None:
            rows = rows.where(F.col("sequence_id") <= sequence)
        if time is not None:
            rows = rows.where(F.col("created_at") <= time)
        return self.over(rows)

    def replay_in_steps(self, step: int, on_unmapped: str = "error") -> DataFrame:
        """``replay``, folding at most ``step`` events of an entity at a time; no events raise EmptyJournal."""
        if self.journal.isEmpty():
            raise EmptyJournal("no events")
        return self.replay(None, on_unmapped, step=step)

    def replay_python(self, step: Callable, state: str, snapshot: DataFrame | None = None, on_unmapped: str = "error", complete: bool = False) -> DataFrame:
        """id, state, sequence by ``step(state or None, key, bytes) -> state`` in Python, for folds that columns can't say.

        state: the SQL type of what step returns. ProjectionError is raised for what step raises. Events stream through a task
        in order, entity by entity; it holds one state.
        """
        null = lambda kind: F.lit(None).cast(kind)
        rows = self._rows(snapshot, complete)
        rows = self._measured(rows, list(self.handlers), on_unmapped)[0] if on_unmapped == "error" else rows.where(F.col("registry_key").isin(list(self.handlers)))
        rows = self._own(rows).withColumns({"state": null(state), "since": null("long")})
        if snapshot is not None:
            begun = snapshot.select("id", null("long").alias("sequence_id"), null("string").alias("registry_key"), null("binary").alias("bytes"), null("timestamp").alias("created_at"), F.col("state").cast(state).alias("state"), F.col("sequence").cast("long").alias("since"))
            rows = rows.unionByName(begun)
        # The snapshot's row, which alone has no sequence_id, comes first; rows of one sequence come as in a column fold.
        rows = rows.select("id", "registry_key", "bytes", "since", "state", "sequence_id", "created_at")
        ordered = rows.repartition("id").sortWithinPartitions("id", F.col("sequence_id").asc_nulls_first(), "created_at", "registry_key", "bytes")

        def states(rows: Iterator[tuple]) -> Iterator[tuple]:
            for id, own in groupby(rows, itemgetter(0)):
                now, at = None, 0
                for _, key, body, since, begun, _, _ in own:
                    if key is None:
                        now, at = begun, since
                        continue
                    try:
                        now = step(now, key, body)
                    except Exception as cause:
                        raise ProjectionError(f"{id} after {at} events: {cause}") from cause
                    at += 1
                yield id, now, at

        return mapped_rows(ordered, states, f"id string, state {state}, sequence bigint")
