"""Which handler treats which event type, by kind of handler."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ResolveError
from tidemark.functions.codec import Codec, EventType, key_of

PROJECTION, SUBSCRIBE, PROCESS_SUBSCRIBER = "projection", "subscribe", "process-subscriber"
#: Projections whose steps combine.
COMPOSITION = "composition"


class ResolveType(NamedTuple):
    event: str
    handler: str

    def __str__(self) -> str:
        return f"{self.event}-{self.handler}"


@dataclass(frozen=True)
class Fold:
    """How an event changes a state. All are column functions; ``reject`` gives a reason or null.

    decode: the body from bytes; it need not be that of the key. first: the state from the first event,
    a state missing so far; without it the first event is an error.
    """

    decode: Codec
    apply: Callable[[Column, Column], Column]
    first: Callable[[Column], Column] | None = None
    reject: Callable[[Column, Column], Column] | None = None
    kind: str = PROJECTION


@dataclass(frozen=True)
class Change:
    """The change of a monoid (``functions.monoids``) that an event is; null is an error."""

    decode: Codec
    change: Callable[[Column], Column]
    kind: str = COMPOSITION


@dataclass(frozen=True)
class Callback:
    """What a subscriber does with the rows of an event type, decoded as ``event``."""

    decode: Codec
    on: Callable[[DataFrame], None]
    kind: str = SUBSCRIBE


@dataclass(frozen=True)
class Reaction:
    """How a process turns an event into a command for itself: body is null where it can't."""

    decode: Codec
    target: Callable[[Column], Column]
    command: str
    body: Callable[[Column], Column]
    kind: str = PROCESS_SUBSCRIBER


class Mapper:
    """(event type, handler kind) -> handler; the last registration of a pair holds."""

    def __init__(self):
        self._handlers: dict[ResolveType, object] = {}

    def register(self, event: EventType | type | str, handler) -> Mapper:
        self._handlers[ResolveType(key_of(event), handler.kind)] = handler
        return self

    def register_with(self, event: EventType | type | str, handler) -> Mapper:
        """The same for a handler with state of its own, such as one whose decoder is another type's."""
        return self.register(event, handler)

    def find(self, wanted: Callable[[ResolveType], bool]):
        """The handler of the one pair that fits, or None; several raise ResolveError."""
        found = [h for t, h in self._handlers.items() if wanted(t)]
        if len(found) > 1:
            raise ResolveError(f"{len(found)} handlers fit")
        return found[0] if found else None

    def filter(self, wanted: Callable[[ResolveType], bool]) -> Mapper:
        out = Mapper()
        out._handlers = {t: h for t, h in self._handlers.items() if wanted(t)}
        return out

    def of_kind(self, kind: str) -> dict[str, object]:
        """Event key -> handler."""
        return {t.event: h for t, h in self._handlers.items() if t.handler == kind}

    def __iter__(self) -> Iterator[ResolveType]:
        return iter(self._handlers)

    def __len__(self) -> int:
        return len(self._handlers)

    def as_rows(self, spark: SparkSession) -> DataFrame:
        """event, handler."""
        return spark.createDataFrame([tuple(t) for t in self._handlers], "event string, handler string")


def last_registered(registrations: DataFrame) -> DataFrame:
    """event, kind, handler of a table of registrations with their order in ``turn``: the last of each pair."""
    return registrations.groupBy("event", "kind").agg(F.max_by("handler", "turn").alias("handler"))


def of_kind(mapping: DataFrame, kind: str) -> DataFrame:
    """event, handler of the pairs of a kind."""
    return mapping.where(F.col("kind") == kind).select("event", "handler")


def resolved(journal: DataFrame, mapping: DataFrame, kind: str) -> DataFrame:
    """The rows whose key has a handler of the kind, with it. A mapping has a row for each registered pair, so it is small."""
    return journal.join(of_kind(mapping, kind).withColumnRenamed("event", "registry_key"), "registry_key")


def unmapped(journal: DataFrame, keys: list[str]) -> DataFrame:
    """registry_key, n: the event types of a journal that are not among the keys."""
    return journal.where(~F.col("registry_key").isin(keys)).groupBy("registry_key").agg(F.count("*").alias("n"))
