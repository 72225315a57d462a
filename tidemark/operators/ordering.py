"""Order and duplicate elimination of journal rows.

Two kinds of sameness. In a journal two rows are one if id, sequence and time are equal; of such
twins the one with the smallest key, then bytes, stays. In a replay a row goes if the entity's next row (by
sequence, then time) has its sequence and bytes, so a repeated write counts once, as the latest; bodies x, y, x
of one sequence all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import kept

TOTAL_ORDER = ["sequence_id", "created_at", "id"]
REPLAY_ORDER = ["sequence_id", "created_at"]


def in_order(journal: DataFrame) -> DataFrame:
    """Sorted by sequence, then time, then id: across entities, sequence first."""
    return journal.orderBy(*TOTAL_ORDER)


def with_place(rows: DataFrame, by: list[str], order: list, name: str = "position") -> DataFrame:
    """Adds a row's number from 0 in this order among the rows of its group, however large a group is.

    Rows are range-partitioned by group and order, so no group is one task's; each part numbers its own rows of a group, and the counts of parts, a row
    for each part and group, are added up.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = kept(rows.repartitionByRange(*by, *columns).withColumn("tidemark_part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "tidemark_part").agg(F.count("*").alias("n"))
    parts = (W.partitionBy(*by) if by else W).orderBy("tidemark_part").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("tidemark_before")
    rank = F.row_number().over(W.partitionBy(*by, "tidemark_part").orderBy(*columns)) - 1
    placed = ranged.withColumn("tidemark_rank", rank)
    keys = [*by, "tidemark_part"]
    sums = counts.select(before, *(F.col(k).alias(f"tidemark_of_{k}") for k in keys))
    both = placed.join(sums, [F.col(k).eqNullSafe(F.col(f"tidemark_of_{k}")) for k in keys])
    return both.withColumn(name, (F.col("tidemark_before") + F.col("tidemark_rank")).cast("long")).select(*rows.columns, name)


def with_total_position(journal: DataFrame, name: str = "position") -> DataFrame:
    """Adds a row's number in the total order, from 1; rows equal in the order are told apart by type and body."""
    placed = with_place(journal, [], [*TOTAL_ORDER, "registry_key", "bytes"], name)
    return placed.withColumn(name, F.col(name) + 1)


def with_replay_position(journal: DataFrame, name: str = "position") -> DataFrame:
    """Adds an entity's row number by sequence, then time, from 0."""
    return journal.withColumn(name, F.row_number().over(W.partitionBy("id").orderBy(*REPLAY_ORDER, "registry_key", "bytes")) - 1)


def journal_dedup(journal: DataFrame) -> DataFrame:
    """One row for each id, sequence and time. Partial minima before the shuffle; no sort."""
    rest = [c for c in journal.columns if c not in ("id", "sequence_id", "created_at")]
    least = F.min(F.struct("registry_key", "bytes", *(c for c in rest if c not in ("registry_key", "bytes")))).alias("least")
    kept = journal.groupBy("id", "sequence_id", "created_at").agg(least)
    return kept.select(*(F.col(f"least.{c}").alias(c) if c in rest else F.col(c) for c in journal.columns))


def fixture_dedup(journal: DataFrame, *with_: str) -> DataFrame:
    """Without rows whose next row of the entity has the same sequence and bytes.

    with_: columns that follow from id and sequence, by which the rows are partitioned already.
    """
    w = W.partitionBy("id", *with_, "sequence_id").orderBy("created_at", "registry_key", "bytes")
    marked = journal.withColumn("tidemark_next", F.lead("bytes").over(w)).withColumn("tidemark_last", F.lead(F.lit(1)).over(w).isNull())
    kept = marked.where(F.col("tidemark_last") | ~F.col("tidemark_next").eqNullSafe(F.col("bytes")))
    return kept.drop("tidemark_next", "tidemark_last")
