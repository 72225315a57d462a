"""One object for what a program sets up once: journal, writer, stream, projectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import SetupError
from tidemark.operators.mapping import Mapper
from tidemark.operators.process import Behaviour, entrust, to_journal
from tidemark.operators.projection import Projector
from tidemark.sources.journal import EventWriter, Journal
from tidemark.sources.shared import kept
from tidemark.streaming.stream import EventStream


class Engine:
    """Parts are set once; setting one again, or using one that isn't set, raises SetupError."""

    def __init__(self, spark: SparkSession, journal: Journal | None = None):
        self.spark, self._parts = spark, {}
        if journal is not None:
            self.set_writer(EventWriter(journal))

    def _set(self, name: str, part) -> None:
        if name in self._parts:
            raise SetupError(f"{name} is set already")
        self._parts[name] = part

    def _get(self, name: str):
        if name not in self._parts:
            raise SetupError(f"{name} is not set")
        return self._parts[name]

    def set_writer(self, writer: EventWriter) -> None:
        self._set("writer", writer)

    def set_stream(self, stream: EventStream) -> None:
        self._set("stream", stream)

    @property
    def writer(self) -> EventWriter:
        return self._get("writer")

    @property
    def journal(self) -> Journal:
        return self.writer.journal

    @property
    def stream(self) -> EventStream:
        return self._get("stream")

    def projector(self, mapper: Mapper, state: str) -> Projector:
        return Projector(self.journal.rows(), mapper, state, by_id=self.journal.by_id)

    def run(self, commands: DataFrame, states: DataFrame, behaviour: Behaviour, state: str, publish: bool = False) -> DataFrame:
        """Runs a batch of commands, writes its events to the journal (and stream), returns all rows of the batch.

        The batch is checkpointed before it is written, so writing and returning see the same events.
        """
        out = kept(entrust(commands, states, behaviour, state))
        events = kept(to_journal(out.where("what = 'event'")))
        self.writer.write(events)
        if publish:
            self.stream.publish(events)
        return out
