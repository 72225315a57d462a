"""Additions: what a journal tells about lost and repeated writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gaps(journal: DataFrame) -> DataFrame:
    """id, after, missing: where an entity's sequences leave some out."""
    once = journal.select("id", "sequence_id").distinct()
    nxt = F.lead("sequence_id").over(W.partitionBy("id").orderBy("sequence_id"))
    return once.withColumn("next", nxt).where("next - sequence_id > 1").select("id", F.col("sequence_id").alias("after"), (F.col("next") - F.col("sequence_id") - 1).alias("missing"))


def duplicates(journal: DataFrame) -> DataFrame:
    """id, sequence_id, n: events with more than one row."""
    return journal.groupBy("id", "sequence_id").agg(F.count("*").alias("n")).where("n > 1")


def drift(journal: DataFrame, states: DataFrame) -> DataFrame:
    """id, sequence, expected: states whose counter is not the last sequence plus one."""
    last = journal.groupBy("id").agg((F.max("sequence_id") + 1).alias("expected"))
    return states.select("id", "sequence").join(last, "id").where("sequence <> expected")
