"""Reading and appending journals: a folder of Parquet, a table, a JDBC table, or any DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ReadError, WriteError
from tidemark.functions.codec import EventType, decoded
from tidemark.functions.envelope import payload
from tidemark.schema import COLUMNS, JOURNAL, checked
from tidemark.sources.shared import scratch

LATEST = 2**63 - 1
#: Attempts of an append.
ATTEMPTS = 3


class Journal:
    """Keyed range reads and appends over one journal. Copies share the store."""

    def __init__(self, spark: SparkSession, source: str | DataFrame, buckets: int = 0):
        """source: a path (has a slash), a table's name, or a DataFrame, which can't be appended to.

        buckets: with a path, the number of folders by a hash of the id, so that a keyed read opens one of them; with a table, of
        Spark's own buckets by id, so that a keyed read opens one and a replay shuffles nothing.
        """
        self.spark, self.source, self.buckets = spark, source, buckets

    @property
    def by_id(self) -> bool:
        """Whether rows of one id lie in one bucket of a table."""
        return bool(self.buckets) and isinstance(self.source, str) and "/" not in self.source

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, table: str, parts: int = 1, column: str = "sequence_id", conditions: list[str] | None = None, **options: str) -> Journal:
        """A journal in a database, through Spark's own reader, which pushes keyed reads down. Column names may have any case.

        parts: whole reads go by so many ranges of a column of numbers. Every entity begins at sequence 0, so a column of row numbers, if there is
        one, cuts more evenly. conditions: the parts instead, as SQL of the database that together hold for every row once, such as hashes of the id.
        """
        reader = lambda: spark.read.format("jdbc").options(url=url, **options)
        rows = reader().option("dbtable", table).load()
        if conditions:
            rows = spark.read.jdbc(url, table, predicates=conditions, properties=options)
        elif parts > 1:
            name = next(c for c in rows.columns if c.lower() == column.lower())
            quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)
            low, high = reader().option("query", f"select min({quoted}) as lo, max({quoted}) as hi from {table}").load().first()
            if low is not None:
                ranges = reader().options(dbtable=table, partitionColumn=name, lowerBound=low, upperBound=high + 1, numPartitions=parts)
                rows = ranges.load()
        return cls(spark, rows.toDF(*(c.lower() for c in rows.columns)))

    @staticmethod
    def to_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
        """Appends journal rows to a database's table; what fails raises WriteError."""
        try:
            types = {"createTableColumnTypes": "id VARCHAR(255), registry_key VARCHAR(255)"}  # types that databases compare
            checked(rows).write.format("jdbc").options(**types | options, url=url, dbtable=table).mode("append").save()
        except Exception as cause:
            raise WriteError(f"append failed: {cause}") from cause

    @classmethod
    def at_rest(cls, spark: SparkSession, rows: DataFrame, buckets: int = 16) -> Journal:
        """A journal that keeps these rows as a table in the shared folder, bucketed and sorted by id and sequence."""
        name = f"tidemark_journal_{uuid.uuid4().hex}"
        out = cls(spark, name, buckets)
        out._into_buckets(checked(rows)).option("path", scratch(spark, "journal")).saveAsTable(name)
        return out

    def _into_buckets(self, rows: DataFrame) -> DataFrameWriter:
        # One task a bucket, so that a bucket is one file for each append.
        dealt = rows.repartition(self.buckets, "id")
        return dealt.write.mode("append").bucketBy(self.buckets, "id").sortBy("id", "sequence_id")

    def rows(self) -> DataFrame:
        """All rows."""
        if isinstance(self.source, DataFrame):
            return checked(self.source)
        if "/" not in self.source:
            return checked(self.spark.table(self.source))
        schema = T.StructType([*JOURNAL.fields, *([T.StructField("bucket", T.IntegerType())] if self.buckets else [])])
        return self.spark.read.schema(schema).parquet(self.source)

    def _bucket(self, id):
        return F.pmod(F.xxhash64(id), F.lit(self.buckets)).cast("int")

    def of(self, id: object) -> DataFrame:
        """All rows of one entity."""
        rows = self.rows()
        if self.buckets and not isinstance(self.source, DataFrame) and "/" in self.source:
            rows = rows.where(F.col("bucket") == self._bucket(F.lit(str(id))))
        return rows.where(F.col("id") == str(id)).select(*COLUMNS)

    def read(self, id: object, sequence: int) -> DataFrame:
        """The rows of one event; none raises ReadError."""
        found = self.of(id).where(F.col("sequence_id") == sequence)
        if found.isEmpty():
            raise ReadError(f"{id} has no event {sequence}")
        return found

    def read_to(self, id: object, first: int, last: int) -> DataFrame:
        """The events from first to last, both included."""
        return self.of(id).where(F.col("sequence_id").between(first, last))

    def read_to_latest(self, id: object, first: int) -> DataFrame:
        """The events from first on."""
        return self.of(id).where(F.col("sequence_id") >= first)

    def read_event(self, id: object, sequence: int, kind: EventType | type) -> DataFrame:
        """The event decoded as ``kind``, whatever its key; a body that is none raises ReadError."""
        return decoded(self.read(id, sequence), kind)

    def append(self, rows: DataFrame) -> None:
        """Appends journal rows; what fails raises WriteError."""
        if isinstance(self.source, DataFrame):
            raise WriteError("a journal over a DataFrame can't be appended to")
        try:
            out = checked(rows)
            if "/" not in self.source:
                (self._into_buckets(out) if self.buckets else out.write.mode("append")).saveAsTable(self.source)
            elif self.buckets:
                out.withColumn("bucket", self._bucket(F.col("id"))).write.mode("append").partitionBy("bucket").parquet(self.source)
            else:
                out.write.mode("append").parquet(self.source)
        except Exception as cause:
            raise WriteError(f"append failed: {cause}") from cause

    def append_events(self, events: DataFrame, kind: EventType, value: str = "event") -> None:
        """Appends decoded events (id, sequence_id, and ``value``), encoded as ``kind`` and stamped with the present time."""
        self.append(events.select(*payload(F.col("id"), F.col("sequence_id"), kind, F.col(value))))


class EventWriter:
    """Appends with some attempts. What is exhausted raises WriteError, or drops the rows if so asked."""

    def __init__(self, journal: Journal, attempts: int = ATTEMPTS, on_exhausted: str = "raise"):
        if on_exhausted not in ("raise", "drop"):
            raise ValueError("on_exhausted is raise or drop")
        self.journal, self.attempts, self.on_exhausted = journal, attempts, on_exhausted

    def set_retry(self, attempts: int) -> EventWriter:
        self.attempts = attempts
        return self

    def write(self, rows: DataFrame, warn: Callable[[str], None] = print) -> bool:
        """Whether the rows were written, after one attempt at least."""
        for attempt in range(1, max(1, self.attempts) + 1):
            try:
                self.journal.append(rows)
                return True
            except WriteError as cause:
                warn(f"attempt {attempt}: {cause}")
                last = cause
        if self.on_exhausted == "raise":
            raise last
        return False
