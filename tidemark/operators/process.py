"""Entities as processes: commands become events or rejections, events change states.

Commands have id, arrival (their order), kind, bytes. An entity's commands run one after the other in order of
arrival. An event has the sequence before it and moves it by one; a rejection or a message doesn't. Each batch
is atomic: deciding and applying never interleave with another batch.

Rules that look only at a command are column rules and need no Python; deciding alone (``handle``) may also look at
the state before the batch. Rules that look at the state as it changes are a ``Behaviour``, which commands stream through
entity by entity. An entity stops at poison (the command kind ``POISON``), when its behaviour asks for it, and, in a
stream, when it was idle too long; what comes then is rejected until a command of kind ``SPAWN`` starts it again. States carry
``active``, so an entity that one batch stops stays stopped in the next; ``operators.status`` keeps them over batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.errors import AlreadyExist, InvalidCast, NotFound, StaleState
from tidemark.operators.ordering import with_place
from tidemark.operators.projection import mapped_rows

POISON, SPAWN, STOPPED = "poison", "spawn", "stopped"
#: The reason of a stop after idle time, and what stands among an entity's commands where it had been idle too long.
IDLE, IDLED = "idle", object()


@dataclass(frozen=True)
class Rule:
    """A column rule for a kind of command: the event's key and body, and a reason to reject or null.

    The functions get the state (null if there is none) and the command's bytes.
    """

    event: str
    body: Callable[[Column, Column], Column]
    reject: Callable[[Column, Column], Column] | None = None


def handle(commands: DataFrame, states: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Decides alone: id, arrival, kind, event_key and event_bytes or reason. No state or sequence changes."""
    joined = commands.join(states.select("id", "state"), "id", "left")
    key = reason = F.lit(None).cast("string")
    body = F.lit(None).cast("binary")
    for kind, r in rules.items():
        mine = F.col("kind") == kind
        why = F.lit(None).cast("string") if r.reject is None else r.reject(F.col("state"), F.col("bytes"))
        reason = F.when(mine, why).otherwise(reason)
        key = F.when(mine, F.lit(r.event)).otherwise(key)
        body = F.when(mine, r.body(F.col("state"), F.col("bytes")).cast("binary")).otherwise(body)
    known = F.col("kind").isin(list(rules))
    reason = F.when(~known, F.lit("no rule for this command")).otherwise(reason)
    decided = joined.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return decided.select("id", "arrival", "kind", F.when(ok, key).alias("event_key"), F.when(ok, body).alias("event_bytes"), "reason")


#: Events of an entity that are ordered in one task; where an entity has more, all are placed by ranges.
IN_ONE = 1_000_000


def sequenced(events: DataFrame, states: DataFrame | None = None, order: str = "arrival", in_one: int = IN_ONE) -> DataFrame:
    """Adds sequence_id: an entity's events from its state's sequence (0 without one) on, in order of arrival.

    The events of entities are counted first (an action), so that an entity with a third of all events is not one task's.
    """
    most = events.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    if most > in_one:
        out = with_place(events, ["id"], [order], "sequence_id")
    else:
        out = events.withColumn("sequence_id", (F.row_number().over(W.partitionBy("id").orderBy(order)) - 1).cast("long"))
    if states is None:
        return out
    start = states.select("id", F.col("sequence").alias("tidemark_start"))
    return out.join(start, "id", "left").withColumn("sequence_id", (F.col("sequence_id") + F.coalesce("tidemark_start", F.lit(0))).cast("long")).drop("tidemark_start")


def entrust_rules(commands: DataFrame, states: DataFrame, rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """(events with their sequence, rejections) of column rules.

    A rule that reads the state raises StaleState: it would judge every command of a batch by the state before the batch.
    Such rules are for ``entrust``.
    """
    probe = F.col("tidemark_state")
    for kind, r in rules.items():
        for made in (r.body, r.reject):
            if made is not None and made(probe, F.col("bytes")) is not None and "tidemark_state" in str(made(probe, F.col("bytes"))):
                raise StaleState(kind)
    decided = handle(commands, states, rules)
    events = sequenced(decided.where("reason is null").select("id", "arrival", "event_key", "event_bytes"), states)
    return events, decided.where("reason is not null").select("id", "arrival", "kind", "reason")


def to_journal(events: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Events with their sequence as journal rows."""
    time = F.current_timestamp() if created_at is None else created_at
    return events.select("id", "sequence_id", F.col("event_key").alias("registry_key"), F.col("event_bytes").alias("bytes"), time.cast("timestamp").alias("created_at"))


@dataclass
class Context:
    """What a behaviour can know of its process and of the one that a command names, and how it ends its own."""

    id: str
    sequence: int
    active: bool = True
    #: The process that the present command names, as it was before the batch: process_type and sequence, or None.
    named: tuple[str, int] | None = None

    def find(self, process_type: str) -> int | None:
        """The sequence of the process that the command names, None if it doesn't run; one of another type raises InvalidCast."""
        if self.named is not None and self.named[0] != process_type:
            raise InvalidCast(f"it is a {self.named[0]}, not a {process_type}")
        return None if self.named is None else self.named[1]

    def poison(self) -> None:
        """Stops the process after this command."""
        self.active = False


class Behaviour:
    """An entity in Python. ``state`` is what ``evolve`` returned last, None before; ``context`` is the entity's at each call.

    ``messages`` are kinds that change the state without an event or a sequence.
    """

    messages: tuple[str, ...] = ()
    context: Context

    def start(self, state):
        """The state that an entity begins this batch, or its life, with."""
        return state

    def stop(self, state):
        """The state that an entity leaves when it is stopped."""
        return state

    def begin(self, state, sequence: int, body: bytes) -> tuple:
        """(state, sequence) that a spawn command starts an entity with; given are those that it ended with, None and 0 where it isn't known."""
        return state, sequence

    def decide(self, state, kind: str, body: bytes) -> tuple[str, bytes] | str:
        """(event key, event bytes), or the reason to reject."""
        raise NotImplementedError

    def evolve(self, state, key: str, body: bytes):
        raise NotImplementedError

    def receive(self, state, kind: str, body: bytes):
        """The state after a message."""
        return state


OUT = "id string, what string, arrival bigint, kind string, sequence_id bigint, event_key string, event_bytes binary, reason string, sequence bigint, active boolean, state {state}"
OUT_KINDS = dict.fromkeys((c.split()[0] for c in OUT.split(", ")), "") | dict.fromkeys(("arrival", "sequence_id", "sequence"), "long")


def out_row(**known) -> tuple:
    return tuple(known.get(c) for c in OUT_KINDS)


def run_entity(behaviour: Behaviour, id: str, state, sequence: int, commands: Iterable[tuple], active: bool = True) -> Iterator[tuple]:
    """The rows of OUT for one entity's commands (arrival, kind, bytes, and the process that they name) in order: events, rejections, then the state.

    The last row's ``what`` is state, or stopped where the entity isn't active any more.
    """
    context = behaviour.context = Context(id, sequence, active)
    if active:
        state = behaviour.start(state)
    for arrival, kind, body, *named in commands:
        context.named = named[0] if named else None
        if not context.active:
            if kind == SPAWN:
                state, context.sequence = behaviour.begin(state, context.sequence, body)
                context.active, state = True, behaviour.start(state)
            elif kind is not IDLED:
                yield out_row(id=id, what="rejection", arrival=arrival, kind=kind, reason=STOPPED)
            continue
        if kind is IDLED:
            context.poison()
            state = behaviour.stop(state)
            yield out_row(id=id, what=STOPPED, reason=IDLE, sequence=context.sequence, active=False, state=state)
            continue
        if kind == POISON:
            context.poison()
        elif kind == SPAWN:
            yield out_row(id=id, what="rejection", arrival=arrival, kind=kind, reason="running already")
        elif kind in behaviour.messages:
            state = behaviour.receive(state, kind, body)
        else:
            made = behaviour.decide(state, kind, body)
            if isinstance(made, str):
                yield out_row(id=id, what="rejection", arrival=arrival, kind=kind, reason=made)
            else:
                state = behaviour.evolve(state, *made)
                yield out_row(id=id, what="event", arrival=arrival, kind=kind, sequence_id=context.sequence, event_key=made[0], event_bytes=made[1])
                context.sequence += 1
        if not context.active:
            state = behaviour.stop(state)
    yield out_row(id=id, what="state" if context.active else STOPPED, sequence=context.sequence, active=context.active, state=state)


def entrust(commands: DataFrame, states: DataFrame, behaviour: Behaviour, state: str, running: DataFrame | None = None, names: Column | None = None) -> DataFrame:
    """Runs a behaviour over a batch: rows of events, rejections and the new states, told apart by ``what``.

    states: id, state, sequence and, if entities may be stopped, active. state: the state's SQL type. Entities without commands keep their state.
    running and names: the processes (id, process_type, sequence) and the id that a command names, for ``Context.find``. A task holds one
    entity's state and streams its commands.
    """
    null = lambda kind: F.lit(None).cast(kind)
    active = F.coalesce("active", F.lit(True)) if "active" in states.columns else F.lit(True)
    held = states.select("id", null("bigint").alias("arrival"), null("string").alias("kind"), null("binary").alias("bytes"), F.col("state").cast(state).alias("state"), F.col("sequence").cast("long").alias("sequence"), active.alias("active"), null("string").alias("other_type"), null("long").alias("other_sequence"), F.lit(0).alias("turn"))
    sent = commands.withColumns({"other_type": null("string"), "other_sequence": null("long")})
    if running is not None and names is not None:
        others = running.select(F.col("id").alias("tidemark_other"), F.col("process_type").alias("other_type"), F.col("sequence").cast("long").alias("other_sequence"))
        sent = commands.withColumn("tidemark_other", names.cast("string")).join(others, "tidemark_other", "left")
    sent = sent.select("id", "arrival", "kind", "bytes", null(state).alias("state"), null("bigint").alias("sequence"), null("boolean").alias("active"), "other_type", "other_sequence", F.lit(1).alias("turn"))
    ordered = held.unionByName(sent).repartition("id").sortWithinPartitions("id", "turn", "arrival", "kind", "bytes")

    def entities(rows: Iterator[tuple]) -> Iterator[tuple]:
        for id, own in groupby(rows, itemgetter(0)):
            first = next(own)
            begun = first[9] == 0
            now, at, on = (first[4], first[5], first[6]) if begun else (None, 0, True)
            rest = own if begun else chain([first], own)
            yield from run_entity(behaviour, id, now, at, ((r[1], r[2], r[3], None if r[7] is None else (r[7], r[8])) for r in rest), on)

    return mapped_rows(ordered, entities, OUT.format(state=state))


def spawn(running: DataFrame, wanted: DataFrame, strict: bool = True) -> DataFrame:
    """``running`` (id, process_type, sequence, ...) with the wanted processes added.

    An id that runs already raises AlreadyExist (an action), or is left as it is if not strict; so is the same
    id wanted twice, of which the first by type, then sequence counts.
    """
    if strict:
        taken = conflicts(running, wanted).select("id").limit(20).collect()
        if taken:
            raise AlreadyExist([r["id"] for r in taken])
    order = [c for c in ("process_type", "sequence") if c in wanted.columns]
    one = F.min(F.struct(*order, *(c for c in wanted.columns if c not in ("id", *order)))).alias("one")
    fresh = wanted.join(running.select("id"), "id", "left_anti").groupBy("id").agg(one).select("id", "one.*")
    return running.unionByName(fresh)


def conflicts(running: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids wanted that run already or are wanted more than once."""
    taken = wanted.select("id").join(running.select("id"), "id", "left_semi")
    twice = wanted.groupBy("id").count().where("count > 1").select("id")
    return taken.union(twice).distinct()


def find(running: DataFrame, id: object, process_type: str):
    """The process's row, or None; a process of another type raises InvalidCast."""
    row = running.where(F.col("id") == str(id)).first()
    if row is not None and row["process_type"] != process_type:
        raise InvalidCast(f"{id} is a {row['process_type']}, not a {process_type}")
    return row


def found(running: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, process_type) with ``status``: found, of another type, or missing."""
    own = running.select("id", F.col("process_type").alias("runs_as"))
    status = F.when(F.col("runs_as").isNull(), "missing").when(F.col("runs_as") == F.col("process_type"), "found").otherwise("other type")
    return wanted.join(own, "id", "left").select("id", "process_type", status.alias("status"))


def deregister(running: DataFrame, id: object) -> DataFrame:
    """Without the process; one that doesn't run raises NotFound."""
    if running.where(F.col("id") == str(id)).isEmpty():
        raise NotFound(str(id))
    return running.where(F.col("id") != str(id))


def poison_cutoff(messages: DataFrame, is_poison: Column, order: list) -> DataFrame:
    """An entity's messages up to its first poison, which is included."""
    before = F.sum(is_poison.cast("int")).over(W.partitionBy("id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    kept = messages.withColumn("tidemark_poisoned", F.coalesce(before, F.lit(0)))
    return kept.where("tidemark_poisoned = 0").drop("tidemark_poisoned")


def idle_cutoff(messages: DataFrame, timeout: str, order: list, time: str = "created_at") -> DataFrame:
    """An entity's messages before the first gap longer than the timeout (an interval), after which it has stopped."""
    w = W.partitionBy("id").orderBy(*order)
    late = (F.col(time) > F.lag(time).over(w) + F.expr(f"interval {timeout}")).cast("int")
    gaps = messages.withColumn("tidemark_late", F.coalesce(late, F.lit(0)))
    kept = gaps.withColumn("tidemark_gaps", F.sum("tidemark_late").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return kept.where("tidemark_gaps = 0").drop("tidemark_late", "tidemark_gaps")
