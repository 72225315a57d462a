"""The journal's fixed schema, and making a journal of other tables.

A row is one event of one entity: ``id``, ``sequence_id`` (from 0, or from where the entity was started),
``registry_key`` (the event's type), ``bytes`` (its body in the type's own encoding), ``created_at`` (UTC).
All columns are set by contract. Times have microseconds; rows that differ only below that would be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ReadError

JOURNAL = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("sequence_id", T.LongType(), False),
        T.StructField("registry_key", T.StringType(), False),
        T.StructField("bytes", T.BinaryType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)
COLUMNS = JOURNAL.names


def as_journal(df: DataFrame, id: Column, key: Column, body: Column, created_at: Column, sequence: Column | None = None, order: list | None = None) -> DataFrame:
    """A journal of any table: give each row's sequence, or the columns that order an entity's rows.

    Keys of any type become strings; a body of strings becomes UTF-8 bytes.
    """
    if sequence is None:
        if not order:
            raise ValueError("a journal needs sequence or order")
        sequence = F.row_number().over(W.partitionBy(id).orderBy(*order)) - 1
    return df.select(
        id.cast("string").alias("id"),
        sequence.cast("long").alias("sequence_id"),
        key.cast("string").alias("registry_key"),
        body.cast("binary").alias("bytes"),
        created_at.cast("timestamp").alias("created_at"),
    )


def checked(df: DataFrame) -> DataFrame:
    """The journal columns of ``df``, in order; columns or types that differ raise ReadError."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in JOURNAL if have.get(f.name) != f.dataType]
    if wrong:
        raise ReadError(f"not a journal, these columns are missing or of another type: {', '.join(wrong)}")
    return df.select(*COLUMNS)


def time_collisions(nanos: DataFrame, created_ns: str = "created_ns") -> DataFrame:
    """Rows of an imported journal that microseconds can't tell apart: id, sequence_id, created_us, n.

    ``nanos`` has the time as whole nanoseconds since 1970.
    """
    us = F.floor(F.col(created_ns) / 1000)
    return nanos.groupBy("id", "sequence_id", us.alias("created_us")).agg(F.countDistinct(created_ns).alias("n")).where("n > 1")
