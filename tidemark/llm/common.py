"""What the operators of this subpackage share: table access, the shared folder, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import forgotten, scratch, shared_dir

__all__ = ["scratch", "shared_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage: what follows survives lost executors without computing ``df`` again.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, stored; all other folders that were made for it are removed."""
    with forgotten(spark) as made:
        out = stored(make(), label)
        made.pop()  # the result itself
    return out


#: Rows that an executor's Python holds as objects at once.
SLICE = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that memory follows the rows and not the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_arrow_columns(
    df: DataFrame,
    added: dict[str, T.DataType],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """Adds columns computed from Arrow batches. ``make`` runs once per task on the executor."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added.items())])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch)], names)

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def strings(column: pa.Array) -> list[str]:
    """The values of a string column, nulls as empty strings."""
    return ["" if x is None else x for x in column.to_pylist()]
