"""Journals in SQLite files as a data source: ``spark.read.format("tidemark_sqlite")`` and ``readStream``.

Options: ``path`` (or ``load(path)``), a database file that all executors can open; ``table`` (journal); ``parts``, tasks of a whole read (8). Keyed reads
reach the database: conditions on id, sequence_id and registry_key become its own, answered by the index of the primary
key, and are taken off Spark's hands. Whole reads go by ranges of row numbers, which are dense whatever the entities are like. A stream follows
appends by row number: what is in the table is delivered once, by tasks of at most ``rows_per_part`` rows.

Appending is idempotent: the primary key is a journal row's identity (id, sequence_id, created_at), and rows that are there are left
alone, so a task that runs again adds nothing. A row whose body or type differs from one of the same identity is left out too.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from tidemark.errors import ReadError, WriteError
from tidemark.schema import JOURNAL, checked

FORMAT = "tidemark_sqlite"
COLUMNS = ", ".join(f.name for f in JOURNAL)
SCHEMA = pa.schema([("id", pa.string()), ("sequence_id", pa.int64()), ("registry_key", pa.string()), ("bytes", pa.binary()), ("created_at", pa.timestamp("us", "UTC"))])
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Conditions that the database answers, by the columns they are about.
PUSHED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
KEYED = ("id", "sequence_id", "registry_key")
#: Rows of an Arrow batch; values that one condition may list.
ROWS, LISTED = 5_000, 500


def opened(path: str, write: bool = False) -> closing:
    """A connection that waits for others."""
    path = path.removeprefix("file://")
    found = sqlite3.connect(path if write else f"file:{path}?mode=ro", timeout=60, uri=not write)
    return closing(found)


def quoted(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


def create(path: str, table: str = "journal") -> None:
    """Makes the table where it isn't there."""
    with opened(path, write=True) as db, db:
        db.execute(
            f"create table if not exists {quoted(table)} (n integer primary key autoincrement, id text not null, sequence_id integer not null, "
            "registry_key text not null, bytes blob not null, created_at integer not null, unique (id, sequence_id, created_at))"
        )


def micros(time: datetime) -> int:
    return (time.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


class Source:
    """Where the rows are."""

    def __init__(self, options):
        self.path, self.table = options.get("path"), options.get("table", "journal")
        self.parts, self.most = int(options.get("parts", 8)), int(options.get("rows_per_part", 100_000))
        if not self.path:
            raise ReadError("a path is needed")

    def bounds(self) -> tuple[int, int]:
        """The least and the largest row number; (1, 0) of no rows."""
        with opened(self.path) as db:
            low, high = db.execute(f"select min(n), max(n) from {quoted(self.table)}").fetchone()
        return (1, 0) if low is None else (low, high)

    def rows(self, where: list[str], values: list) -> Iterator[pa.RecordBatch]:
        """The rows that meet the conditions, a batch at a time."""
        query = f"select {COLUMNS} from {quoted(self.table)}" + (f" where {' and '.join(where)}" if where else "")
        with opened(self.path) as db:
            found = db.execute(query, values)
            while some := found.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), SCHEMA)], schema=SCHEMA)


class Range(ds.InputPartition):
    """Row numbers from first to last, both included."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))


def ranges(first: int, last: int, parts: int) -> list[Range]:
    step = max(1, -(-(last - first + 1) // max(1, parts)))
    return [Range(a, min(last, a + step - 1)) for a in range(first, last + 1, step)]


class Reader(ds.DataSourceReader):
    def __init__(self, source: Source):
        self.source, self.where, self.values = source, [], []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in KEYED and type(f) in PUSHED and f.value is not None:
                self.where.append(f"{column} {PUSHED[type(f)]} ?")
                self.values.append(f.value)
            elif column in KEYED and isinstance(f, ds.In) and len(f.value) <= LISTED and None not in f.value:
                self.where.append(f"{column} in ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif column in KEYED and isinstance(f, ds.IsNotNull):
                pass  # no column is null
            else:
                yield f

    def partitions(self):
        if any(w.startswith("id ") for w in self.where):  # the index finds them
            return [Range(0, 2**62)]
        return ranges(*self.source.bounds(), self.source.parts) or [Range(1, 0)]

    def read(self, partition):
        first, last = partition.value
        yield from self.source.rows([*self.where, "n between ? and ?"], [*self.values, first, last])


class StreamReader(ds.DataSourceStreamReader):
    """Offsets are row numbers. A batch takes what is there, by tasks of at most ``rows_per_part`` rows."""

    def __init__(self, source: Source):
        self.source = source

    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        return {"n": max(0, self.source.bounds()[1])}

    def partitions(self, start, end):
        n = end["n"] - start["n"]
        return ranges(start["n"] + 1, end["n"], -(-n // self.source.most))

    def read(self, partition):
        yield from self.source.rows(["n between ? and ?"], list(partition.value))


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, source: Source, overwrite: bool):
        self.source = source
        create(source.path, source.table)
        if overwrite:
            with opened(source.path, write=True) as db, db:
                db.execute(f"delete from {quoted(source.table)}")

    def write(self, iterator):
        for batch in iterator:
            rows = zip(*(batch.column(f.name).to_pylist() for f in JOURNAL))
            with opened(self.source.path, write=True) as db, db:
                db.executemany(f"insert or ignore into {quoted(self.source.table)} ({COLUMNS}) values (?, ?, ?, ?, ?)", ((i, s, k, b, micros(t)) for i, s, k, b, t in rows))
        return ds.WriterCommitMessage()


class SqliteJournal(ds.DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return JOURNAL

    def reader(self, schema):
        return Reader(Source(self.options))

    def streamReader(self, schema):
        return StreamReader(Source(self.options))

    def writer(self, schema, overwrite):
        return Writer(Source(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the data source, and with conditions handed to it."""
    spark.dataSource.register(SqliteJournal)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, path: str, table: str = "journal", parts: int = 8) -> DataFrame:
    """A table's journal rows, for ``Journal(spark, rows)``."""
    return registered(spark).read.format(FORMAT).options(table=table, parts=parts).load(path)


def follow(spark: SparkSession, path: str, table: str = "journal", rows_per_part: int = 100_000) -> DataFrame:
    """The same rows and what is appended as a stream."""
    return registered(spark).readStream.format(FORMAT).options(table=table, rows_per_part=rows_per_part).load(path)


def append(rows: DataFrame, path: str, table: str = "journal") -> None:
    """Appends journal rows that aren't there; what fails raises WriteError."""
    registered(rows.sparkSession)
    try:
        checked(rows).write.format(FORMAT).options(table=table).mode("append").save(path)
    except Exception as cause:
        raise WriteError(f"append failed: {cause}") from cause
