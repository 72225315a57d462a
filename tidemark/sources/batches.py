"""Rows in numbered batches: each batch is there as a whole or not at all, and once.

A batch is written beside the log and takes its name, ``writer=<name>/batch=<number>``, by one rename that fails if the name is taken. So a
batch that is written again, after a failure, finds itself there and leaves what is there as it is; two programs that append
at a time get different numbers; and a reader sees whole batches only. Writers have numbers of their own, rising from 0. "What
came after" is a number for each writer and needs no clock.

The file system must have a rename that is atomic and fails if the target is there (HDFS and local ones have; most object stores have not).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import WriteError

WRITER, BATCH = "writer", "batch"
#: A folder that readers don't see and whose name has the largest number whose batches are deleted.
FORGOTTEN = ".forgotten"
MAIN = "main"


class BatchLog:
    """schema: that of the rows. within: columns of the rows that a batch is split into folders by, for reads that need some of them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, within: tuple[str, ...] = ()):
        self.spark, self.path, self.within = spark, path.rstrip("/"), within
        kinds = {f.name: f.dataType for f in schema}
        plain = [T.StructField(f.name, f.dataType) for f in schema if f.name not in within]
        folders = [T.StructField(WRITER, T.StringType()), T.StructField(BATCH, T.LongType()), *(T.StructField(c, kinds[c]) for c in within)]
        self.names, self.schema = schema.names, T.StructType([*plain, *folders])
        self._made(self.path)

    def _jvm(self):
        return self.spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        """(file system, path) as Hadoop knows them."""
        at = self._jvm().Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _made(self, path: str) -> None:
        files, at = self._at(path)
        files.mkdirs(at)

    def _renamed(self, source: str, target: str) -> bool:
        """Whether the folder got the name; False if the name is taken."""
        fs = self._jvm()
        rename = getattr(fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        files, at = self._at(target)
        try:
            context = fs.FileContext.getFileContext(files.makeQualified(at).toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(files.makeQualified(fs.Path(source)), files.makeQualified(at), never)
            return True
        except Py4JJavaError as cause:
            if files.exists(at):
                return False
            raise WriteError(f"{target} can't be named: {cause.java_exception.getMessage()}") from cause

    def _folder(self, writer: str, number: int) -> str:
        return f"{self.path}/{WRITER}={writer}/{BATCH}={number}"

    def has(self, number: int, writer: str = MAIN) -> bool:
        """Whether the writer's batch is there, or was and is forgotten."""
        files, at = self._at(self._folder(writer, number))
        return files.exists(at) or number <= self._listed(writer)[1]

    def last(self, writer: str = MAIN) -> int:
        """The number of the writer's latest batch, -1 before the first."""
        there, forgotten = self._listed(writer)
        return max(there, default=forgotten)

    def _listed(self, writer: str) -> tuple[list[int], int]:
        """The numbers that are there, ascending, and the largest that is forgotten."""
        files, at = self._at(f"{self.path}/{WRITER}={writer}")
        names = [b.getPath().getName().partition("=") for b in files.listStatus(at)] if files.exists(at) else []
        of = lambda kind: sorted(int(n) for k, _, n in names if k == kind)
        return of(BATCH), max(of(FORGOTTEN), default=-1)

    def numbers(self, writer: str = MAIN) -> list[int]:
        """The numbers of a writer's batches, ascending."""
        return self._listed(writer)[0]

    def offsets(self) -> dict[str, int]:
        """Every writer's latest number."""
        files, top = self._at(self.path)
        writers = [n.partition("=")[2] for w in files.listStatus(top) if (n := w.getPath().getName()).startswith(f"{WRITER}=")]
        return {w: n for w in writers if (n := self.last(w)) >= 0}

    def forget(self, upto: int, writer: str = MAIN) -> list[int]:
        """Deletes a writer's batches up to a number and returns theirs. They stay taken: a batch of such a number isn't written again.

        Who hasn't read them can't any more. What fails halfway is done by asking again.
        """
        there, before = self._listed(writer)
        gone = [n for n in there if n <= upto]
        if gone and upto > before:
            self._made(f"{self.path}/{WRITER}={writer}/{FORGOTTEN}={min(upto, there[-1])}")
        for n in gone:
            self._removed(self._folder(writer, n))
        return gone

    def put(self, rows: DataFrame, number: int, writer: str = MAIN) -> bool:
        """Adds a batch of this number; False, and the log as it is, where the number is taken.

        What fails raises WriteError and leaves nothing that a reader sees.
        """
        return not self.has(number, writer) and self._written(rows, number, writer, False) == number

    def append(self, rows: DataFrame, number: int | None = None, writer: str = MAIN) -> int:
        """Adds a batch and returns its number; without one it gets the writer's next.

        A number that is there already leaves the log as it is. What fails raises WriteError and leaves nothing that a reader sees.
        """
        if number is not None:
            self.put(rows, number, writer)
            return number
        return self._written(rows, self.last(writer) + 1, writer, True)

    def _written(self, rows: DataFrame, at: int, writer: str, go_on: bool) -> int | None:
        """Writes a batch under a number, or the next one that is free; None if it is taken and it can't go on."""
        if not writer.replace("-", "").replace("_", "").replace(".", "").isalnum():
            raise ValueError(f"{writer!r} is no name of a writer")
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
        out = rows.select(*self.names).write
        try:
            (out.partitionBy(*self.within) if self.within else out).parquet(staged)
        except Exception as cause:
            self._removed(staged)
            raise WriteError(f"a batch could not be written: {cause}") from cause
        self._made(f"{self.path}/{WRITER}={writer}")
        while not self._renamed(staged, self._folder(writer, at)):
            if not go_on:  # another was faster
                self._removed(staged)
                return None
            at += 1
        return at

    def _removed(self, path: str) -> None:
        files, at = self._at(path)
        files.delete(at, True)

    def _reader(self, reader):
        return reader.schema(self.schema).option("basePath", self.path)

    def rows(self) -> DataFrame:
        """All batches' rows with their writer and batch, which are folders: a filter on them reads no other."""
        return self._reader(self.spark.read).parquet(self.path)

    def batch(self, number: int, writer: str = MAIN) -> DataFrame:
        """One batch's rows."""
        return self._reader(self.spark.read).parquet(self._folder(writer, number)).select(*self.names)

    def stream(self, files: int = 100) -> DataFrame:
        """The same rows as a streaming DataFrame, files at a time.

        No file is too old to be read, whatever its time; Spark then remembers the names of all files of the log, some 200 bytes each.
        """
        return self._reader(self.spark.readStream).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").parquet(self.path)


def after(offsets: dict[str, int]) -> Column:
    """Whether a row's batch came after these offsets; all batches of writers that they don't name did."""
    later = F.lit(True)
    for writer, number in offsets.items():
        later = F.when(F.col(WRITER) == writer, F.col(BATCH) > number).otherwise(later)
    return later
