"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import SetupError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset and all runs on one machine a temporary folder; else SetupError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise SetupError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Lists of the paths made since each ``forgotten`` that is open.
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, wherever Spark finds them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def forgotten(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end the scratch folders that were made within and are still in the list that it gives."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        remove(spark, made)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
