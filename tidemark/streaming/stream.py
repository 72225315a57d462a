"""The event stream: a log of published batches of journal rows, which subscribers follow.

Every subscription is a streaming query of its own with its own checkpoint, so each subscriber sees every event
after its start, none is lost when one lags, and a failed one resumes where it was. Batches have rising numbers: a subscription starts
after the numbers that were there when it was first made, also over restarts, unless asked otherwise; no clock is asked. Event types that a subscriber
has no handler for are skipped. Delivery to callbacks is at least once; (id, sequence_id) tells repeats. Publications that are
repeated reach a subscriber once if it asks for that. Commands that reactions make are there once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import SubscriberMissing, WriteError
from tidemark.functions.envelope import stream_trace
from tidemark.operators.mapping import PROCESS_SUBSCRIBER, SUBSCRIBE, Mapper, Reaction
from tidemark.schema import JOURNAL, checked
from tidemark.sources.batches import MAIN, BatchLog, after

#: Where a subscription starts, besides a time.
NOW, BEGINNING = "now", "beginning"
#: What tells an event from its repetitions.
SAME = ("id", "sequence_id")
REACTED = "id string, arrival bigint, kind string, bytes binary, sequence_id bigint, registry_key string"


def subscribed(events: DataFrame, mapper: Mapper, kind: str = SUBSCRIBE) -> DataFrame:
    """The events that a mapper has a handler of the kind for."""
    return events.where(F.col("registry_key").isin(list(mapper.of_kind(kind))))


def once_each(events: DataFrame, within: str, by: tuple[str, ...] = SAME) -> DataFrame:
    """A stream's events without repetitions (equal in ``by``) that come within an interval of the first, by created_at.

    What is kept of an event goes when the watermark has passed its time by the interval, so memory follows the rate and not the age of the stream.
    An event that is older than the latest by more than the interval is left out.
    """
    return events.withWatermark("created_at", within).dropDuplicatesWithinWatermark(list(by))


class EventStream:
    """path: the stream's folder. checkpoints: a folder for subscribers' progress. files: files a batch, as back-pressure."""

    def __init__(self, spark: SparkSession, path: str, checkpoints: str, files: int = 100):
        self.spark, self.path, self.checkpoints, self.files = spark, path, checkpoints, files
        self.log = BatchLog(spark, path, JOURNAL)
        self.queries: dict[str, StreamingQuery] = {}
        self.errors: list[tuple[str, str, str]] = []

    def publish(self, rows: DataFrame, wanted: bool = False, number: int | None = None, publisher: str = MAIN) -> int:
        """Adds journal rows as one batch and returns its number. wanted: nobody subscribing raises SubscriberMissing.

        number: the publisher's own, where it may publish a batch again; it is there once.
        """
        if wanted and not any(q.isActive for q in self.queries.values()):
            raise SubscriberMissing(self.path)
        try:
            return self.log.append(checked(rows), number, publisher)
        except WriteError as cause:
            raise WriteError(f"publishing failed: {cause}") from cause

    def expire(self, upto: int, publisher: str = MAIN) -> list[int]:
        """Deletes a publisher's batches up to a number and returns theirs; subscribers that haven't had them won't."""
        return self.log.forget(upto, publisher)

    def source(self) -> DataFrame:
        """All events as a streaming DataFrame."""
        return self.log.stream(self.files).select(*JOURNAL.names)

    def begun(self, name: str) -> dict[str, int]:
        """The numbers that a subscription starts after: those of its first start, which are kept with its progress."""
        starts = BatchLog(self.spark, f"{self.checkpoints}/{name}-begun", self.spark.createDataFrame([], "publisher string, number bigint").schema)
        if not starts.has(0):
            found = [(w, n) for w, n in self.log.offsets().items()]
            starts.append(self.spark.createDataFrame(found, "publisher string, number bigint"), 0)
        return {r["publisher"]: r["number"] for r in starts.batch(0).collect()}

    def _since(self, name: str, since) -> DataFrame:
        """The events from the beginning, from a time of theirs on, after given numbers, or (NOW) published after the subscription was first made."""
        if since == BEGINNING:
            return self.source()
        if since == NOW or isinstance(since, dict):
            return self.log.stream(self.files).where(after(self.begun(name) if since == NOW else since)).select(*JOURNAL.names)
        return self.source().where(F.col("created_at") >= F.lit(since))

    def _run(self, rows: DataFrame, name: str, each: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
        out = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.checkpoints}/{name}")
        query = (out.trigger(availableNow=True) if once else out).start()
        self.queries[name] = query
        return query

    def subscribe(self, name: str, mapper: Mapper, since=NOW, once: bool = False, within: str | None = None) -> StreamingQuery:
        """Calls the mapper's subscribe handlers with each batch's rows of their type, body decoded as ``event``.

        since: NOW, BEGINNING, a time, before which events are not delivered, or a publisher's numbers. once: stop at what is there now. within: an
        interval in which a repeated publication is delivered once (``once_each``). An
        error of a handler is kept in ``errors`` and doesn't stop the subscription.
        """
        handlers = mapper.of_kind(SUBSCRIBE)
        rows = subscribed(self._since(name, since), mapper, SUBSCRIBE)
        rows = rows if within is None else once_each(rows, within)
        errors = self.errors

        def each(batch: DataFrame, _: int) -> None:
            batch.persist()
            for key, h in handlers.items():
                try:
                    h.on(batch.where(F.col("registry_key") == key).withColumn("event", h.decode(F.col("bytes"))))
                except Exception as cause:
                    errors.append((name, key, str(cause)))
            batch.unpersist()

        return self._run(rows, name, each, once)

    def commands(self, folder: str) -> BatchLog:
        """The log of commands that reactions add to; its ``stream`` is what ``stateful.process`` takes."""
        return BatchLog(self.spark, folder, self.spark.createDataFrame([], REACTED).schema)

    def react(self, name: str, mapper: Mapper, commands: str, since=NOW, once: bool = False, within: str | None = None) -> StreamingQuery:
        """Turns events into commands by the mapper's reactions and adds these to a log; failures go to ``<commands>-failed``.

        A batch that runs again finds its number there, so each of its commands is there once. A target that poison has stopped rejects what
        still comes (``stateful.process``). The log is the hop that keeps event-command-event circles apart: each circle is another batch.
        """
        reactions = mapper.of_kind(PROCESS_SUBSCRIBER)
        made, failed = self.commands(commands), BatchLog(self.spark, f"{commands}-failed", self.spark.createDataFrame([], "id string, sequence_id bigint, registry_key string").schema)
        rows = subscribed(self._since(name, since), mapper, PROCESS_SUBSCRIBER)

        def each(batch: DataFrame, number: int) -> None:
            out = reacted(batch, reactions)
            made.append(out.where("bytes is not null"), number, name)
            failed.append(out.where("bytes is null"), number, name)

        return self._run(rows if within is None else once_each(rows, within), name, each, once)

    def trace(self, path: str, name: str = "trace", since=NOW, once: bool = False) -> StreamingQuery:
        """Notes every event that passes as text files."""
        out = self._since(name, since).select(stream_trace().alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", f"{self.checkpoints}/{name}")
        query = (out.trigger(availableNow=True) if once else out).start()
        self.queries[name] = query
        return query

    def lag(self, name: str) -> dict:
        """The last progress of a subscriber."""
        progress = self.queries[name].lastProgress
        return {} if progress is None else json.loads(progress.json) if hasattr(progress, "json") else dict(progress)

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()


def reacted(events: DataFrame, reactions: dict[str, Reaction]) -> DataFrame:
    """REACTED: id (the target), arrival (the event's time), kind, bytes (null where the event can't be turned into a command), sequence_id, registry_key."""
    target = kind = F.lit(None).cast("string")
    body = F.lit(None).cast("binary")
    for key, r in reactions.items():
        mine, event = F.col("registry_key") == key, r.decode(F.col("bytes"))
        target = F.when(mine, r.target(event).cast("string")).otherwise(target)
        kind = F.when(mine, F.lit(r.command)).otherwise(kind)
        body = F.when(mine, r.body(event).cast("binary")).otherwise(body)
    mapped = events.where(F.col("registry_key").isin(list(reactions)))
    arrival = F.unix_micros(F.col("created_at").cast("timestamp")).alias("arrival")
    return mapped.select(F.coalesce(target, F.col("id")).alias("id"), arrival, kind.alias("kind"), body.alias("bytes"), "sequence_id", "registry_key")


def fanned_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """subscriber, id, sequence_id, registry_key: each event for each subscriber of its type.

    subscriptions: subscriber, registry_key and optionally subscribed_at, before which nothing is delivered. The two
    sides meet by key; Spark broadcasts the subscriptions where their size allows it.
    """
    joined = events.join(subscriptions, "registry_key")
    if "subscribed_at" in subscriptions.columns:
        joined = joined.where(F.col("created_at") >= F.col("subscribed_at"))
    return joined.select("subscriber", "id", "sequence_id", "registry_key")
