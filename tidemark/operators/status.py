"""Processes over many batches: what one batch leaves, running or stopped, is what the next begins with.

All that a batch makes (events, rejections, states) is one numbered batch of a log, so it is there as a whole or not at all, and a
batch that runs again finds itself there and isn't run twice. The state of an entity is its row in the latest batch that had
commands for it; a snapshot of all states can be written, and then older batches are not read for states any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import AlreadyExist
from tidemark.operators.process import OUT, STOPPED, Behaviour, conflicts, entrust
from tidemark.sources.batches import BATCH, BatchLog
from tidemark.sources.journal import Journal
from tidemark.streaming.stream import EventStream

STATES = ("state", STOPPED)


class Processes:
    """The processes of one behaviour. state: the state's SQL type."""

    def __init__(self, spark: SparkSession, path: str, behaviour: Behaviour, state: str, process_type: str = "process"):
        self.spark, self.behaviour, self.state, self.process_type = spark, behaviour, state, process_type
        kinds = lambda ddl: spark.createDataFrame([], ddl).schema
        self.made = kinds(OUT.format(state=state) + ", created_at timestamp")
        self.log = BatchLog(spark, f"{path}/batches", self.made, ("what",))
        self.snapshots = BatchLog(spark, f"{path}/snapshots", kinds(f"id string, state {state}, sequence bigint, active boolean"))

    def states(self, upto: int | None = None) -> DataFrame:
        """id, state, sequence, active after the latest batch, or after batch ``upto``."""
        last = self.log.last() if upto is None else upto
        whole = max((n for n in self.snapshots.numbers() if n <= last), default=-1)
        rows = self.log.rows().where(F.col(BATCH).between(whole + 1, last) & F.col("what").isin(*STATES))
        rows = rows.select("id", "state", "sequence", "active", BATCH)
        if whole >= 0:
            rows = rows.unionByName(self.snapshots.batch(whole).withColumn(BATCH, F.lit(whole).cast("long")))
        latest = rows.groupBy("id").agg(F.max_by(F.struct("state", "sequence", "active"), BATCH).alias("now"))
        return latest.select("id", "now.*")

    def running(self, upto: int | None = None) -> DataFrame:
        """id, process_type, state, sequence of the processes that aren't stopped, as ``process.found`` takes them."""
        return self.states(upto).where("active").select("id", F.lit(self.process_type).alias("process_type"), "state", "sequence")

    def run(self, commands: DataFrame, number: int | None = None, running: DataFrame | None = None, names=None) -> DataFrame:
        """Runs a batch of commands and returns what it made, in the columns of OUT.

        number: the batch's number where whoever asks may ask again, such as a stream's; a batch that is there is returned as it is.
        Without one the batch follows the latest; if another program adds one meanwhile, the batch is decided again from the states that
        that one left. running and names as in ``entrust``.
        """
        while number is None or not self.log.has(number):
            last = self.log.last()
            own = self.states(last).join(commands.select("id").distinct(), "id", "left_semi")
            out = entrust(commands, own, self.behaviour, self.state, running, names).withColumn("created_at", F.current_timestamp())
            at = last + 1 if number is None else number
            if self.log.put(out, at):
                number = at
        return self.log.batch(number).drop("created_at")

    def spawn(self, wanted: DataFrame, strict: bool = True) -> int:
        """Starts processes (id, and if they don't begin with nothing state and sequence) as a batch of its own, whose number it returns.

        An id that runs, or is wanted twice, raises AlreadyExist, or if not strict keeps running, or begins with the least sequence, then state.
        """
        last = self.log.last()
        if strict:
            taken = conflicts(self.running(last), wanted).limit(20).collect()
            if taken:
                raise AlreadyExist([r["id"] for r in taken])
        state = F.col("state") if "state" in wanted.columns else F.lit(None)
        sequence = F.col("sequence") if "sequence" in wanted.columns else F.lit(0)
        begun = wanted.select("id", sequence.cast("long").alias("sequence"), state.cast(self.state).alias("state"))
        one = begun.groupBy("id").agg(F.min(F.struct("sequence", "state")).alias("one")).join(self.running(last).select("id"), "id", "left_anti")
        null = {f.name: F.lit(None).cast(f.dataType) for f in self.made if f.name not in ("id", "what", "sequence", "state", "active", "created_at")}
        rows = one.select("id", F.lit("state").alias("what"), "one.sequence", "one.state", F.lit(True).alias("active"), F.current_timestamp().alias("created_at")).withColumns(null)
        if not self.log.put(rows, last + 1):  # others were faster: what they did counts
            return self.spawn(wanted, strict)
        return last + 1

    def events(self, since: int = -1) -> DataFrame:
        """The journal rows of the batches after ``since``."""
        return self._events(self.log.rows().where(F.col(BATCH) > since))

    @staticmethod
    def _events(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("what") == "event").select("id", "sequence_id", F.col("event_key").alias("registry_key"), F.col("event_bytes").alias("bytes"), "created_at")

    def rejections(self, since: int = -1) -> DataFrame:
        """id, arrival, kind, reason of the batches after ``since``."""
        return self.log.rows().where((F.col(BATCH) > since) & (F.col("what") == "rejection")).select("id", "arrival", "kind", "reason")

    def journal(self) -> Journal:
        """The events of all batches, for keyed reads and replays."""
        return Journal(self.spark, self.events())

    def publish(self, stream: EventStream) -> list[int]:
        """Publishes the events of the batches that the stream doesn't have yet, under their numbers, which are returned.

        The publisher is the process type. A program that was lost between a batch and its publication publishes it the next time, and none twice.
        """
        there = set(stream.log.numbers(self.process_type))
        fresh = [n for n in self.log.numbers() if n not in there]
        for n in fresh:
            stream.publish(self._events(self.log.batch(n)), number=n, publisher=self.process_type)
        return fresh

    def follow(self, commands: DataFrame, progress: str, once: bool = False) -> StreamingQuery:
        """Runs a stream of commands batch by batch; a micro-batch that comes again after a failure is not run twice.

        The log's numbers are the stream's, so nothing else may run batches of this log. progress: the stream's checkpoint folder.
        """
        out = commands.writeStream.foreachBatch(lambda batch, number: self.run(batch, number) and None).option("checkpointLocation", progress)
        return (out.trigger(availableNow=True) if once else out).start()

    def forget(self, upto: int) -> list[int]:
        """Deletes batches up to a number, with their events and rejections, and returns theirs. A snapshot must have their states."""
        if self.snapshots.last() < upto:
            raise ValueError(f"there is no snapshot after batch {upto}")
        return self.log.forget(upto)

    def snapshot(self) -> int:
        """Writes all states as they are after the latest batch, whose number it returns."""
        last = self.log.last()
        if last >= 0 and not self.snapshots.has(last):
            self.snapshots.append(self.states(), last)
        return last

