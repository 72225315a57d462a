"""Journals in SQLite files: conditions that reach the database, streams by row number, appends that may be repeated."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from test_journal import journal, joined, states

from tidemark import errors
from tidemark.sources import sqlite
from tidemark.sources.journal import Journal


def content(df):
    return sorted((r["id"], r["sequence_id"], r["registry_key"], bytes(r["bytes"]), r["created_at"]) for r in df.collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "events.db")


def test_rows_come_back_as_they_were(spark, path):
    rows = journal(spark, [(f"e{n % 7}", n // 7, "put", f"ü{n}\0", n) for n in range(100)])
    odd = rows.withColumn("created_at", F.col("created_at") + F.expr("interval 123456 microseconds"))
    sqlite.append(odd, path)
    assert content(sqlite.read(spark, path, parts=3)) == content(odd) and sqlite.read(spark, path, parts=3).rdd.getNumPartitions() == 3
    sqlite.append(odd.limit(30), path)  # a write that is tried again
    assert sqlite.read(spark, path).count() == 100
    later = odd.where("id = 'e1'").withColumn("created_at", F.col("created_at") + F.expr("interval 1 second"))
    sqlite.append(later, path)
    assert sqlite.read(spark, path).count() == 100 + later.count()
    assert sqlite.read(spark, path).where("registry_key = 'none'").count() == 0


def test_empty_and_missing_tables(spark, path):
    sqlite.create(path, 'odd "name"')
    assert sqlite.read(spark, path, 'odd "name"').count() == 0
    sqlite.append(journal(spark, [("a", 0, "k", "b", 0)]), path, 'odd "name"')
    assert sqlite.read(spark, path, 'odd "name"').count() == 1
    with pytest.raises(Exception, match="no such table"):
        sqlite.read(spark, path, "none").count()
    with pytest.raises(errors.WriteError):
        sqlite.append(journal(spark, [("a", 0, "k", "b", 0)]), "/proc/none/x.db")


def test_keyed_reads_reach_the_database(spark, path):
    rows = journal(spark, [(e, n, k, f"{e}{n}", n) for e in "ab" for n in range(20) for k in ("x", "y")])
    sqlite.append(rows.withColumn("created_at", F.when(F.col("registry_key") == "y", F.col("created_at") + F.expr("interval 1 second")).otherwise(F.col("created_at"))), path)
    own = Journal(spark, sqlite.read(spark, path))
    assert sorted(r["sequence_id"] for r in own.read_to("a", 3, 5).collect()) == [3, 3, 4, 4, 5, 5]
    assert own.read_to_latest("b", 18).count() == 4 and own.read("a", 7).count() == 2
    with pytest.raises(errors.ReadError):
        own.read("c", 0)
    reader = sqlite.Reader(sqlite.Source({"path": path}))
    from pyspark.sql import datasource as ds

    given = [ds.EqualTo(("id",), "a"), ds.GreaterThanOrEqual(("sequence_id",), 3), ds.In(("registry_key",), ("x", "y")), ds.IsNotNull(("id",)), ds.StringContains(("id",), "a"), ds.EqualTo(("bytes",), b"a3")]
    left = list(reader.pushFilters(given))
    assert [type(f) for f in left] == [ds.StringContains, ds.EqualTo] and reader.where == ["id = ?", "sequence_id >= ?", "registry_key in (?, ?)"]
    [part] = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 34
    with sqlite3.connect(path) as db:
        plan = str(db.execute("explain query plan select * from journal where id = ? and sequence_id >= ?", ("a", 3)).fetchall())
    assert "INDEX" in plan and "SCAN" not in plan
    shown = own.read_to("a", 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in shown and "*(1) Filter" not in shown, shown


def test_a_replay_over_the_database_is_a_replay(spark, path):
    p = joined(spark, [(e, n, "put", f"{e}{n}", n) for e in "abc" for n in range(9)])
    sqlite.append(p.journal, path)
    assert states(p.over(sqlite.read(spark, path)).replay()) == states(p.replay())


def test_a_stream_follows_appends_by_row_number(spark, path, tmp_path):
    sqlite.append(journal(spark, [("a", n, "put", str(n), n) for n in range(25)]), path)
    parts, seen = [], []

    def each(df, n):
        rows = df.select("sequence_id", F.spark_partition_id().alias("part")).collect()
        parts.append(len({r["part"] for r in rows}))
        seen.extend(r["sequence_id"] for r in rows)

    def run():
        q = sqlite.follow(spark, path, rows_per_part=10).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()

    run()
    assert sorted(seen) == list(range(25)) and parts == [3]
    sqlite.append(journal(spark, [("a", n, "put", str(n), n) for n in range(20, 30)]), path)  # five are there already
    run()  # goes on where it ended
    assert sorted(seen) == list(range(30))
