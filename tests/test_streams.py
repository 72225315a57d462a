"""Streams that begin at batch states, commands that are there once, repetitions, event time, ended state, look-ups, offsets."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_journal import T0, TEXT, journal, joined, run_stream, states
from test_status import Summing, sent

from tidemark.operators import process
from tidemark.operators.mapping import Callback, Mapper, Reaction
from tidemark.operators.status import Processes
from tidemark.schema import JOURNAL
from tidemark.streaming import stateful
from tidemark.streaming.stream import BEGINNING, EventStream

COMMANDS = "id string, arrival bigint, kind string, bytes binary, created_at timestamp"


def stored(spark, path, *parts):
    """A stream of commands (id, arrival, kind, number, seconds), a micro-batch a part."""
    for n, rows in enumerate(parts):
        made = [(i, a, k, str(b).encode(), T0 + timedelta(seconds=t)) for i, a, k, b, t in rows]
        spark.createDataFrame(made, COMMANDS).coalesce(1).write.mode("append").parquet(path)
        # Files are taken in order of their times.
        for f in os.listdir(path):
            if f.startswith("part-") and not os.path.exists(f"{path}/.{f}.set"):
                os.utime(f"{path}/{f}", (1_700_000_000 + 10 * n,) * 2)
                open(f"{path}/.{f}.set", "w").close()
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(path)


def ends(rows):
    """The last state row of each entity."""
    out = {}
    for r in rows:
        if r["sequence"] is not None:
            out[r["id"]] = (r["state"], r["sequence"], r["active"])
    return out


def lines(rows):
    return sorted(str((r["id"], r["what"], r["arrival"], r["sequence_id"], r["reason"])) for r in rows if r["what"] in ("event", "rejection"))


# Beginning at a state


def test_a_replay_stream_begins_at_a_batch_snapshot(spark, tmp_path):
    rows = [(e, s, "put", f"{e}{s}", s) for e in "ab" for s in range(6)] + [("new", 0, "put", "n", 0)]
    p = joined(spark, rows)
    snapshot = p.until(2).replay().where("id <> 'new'").unionByName(spark.createDataFrame([("still", "s", 9)], "id string, state string, sequence bigint"))
    for n, part in enumerate((p.journal.where("sequence_id >= 3"), p.journal.where("id = 'new' or sequence_id < 2"))):  # what the snapshot has comes again
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    source = spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    step = lambda now, key, body: (now or "") + bytes(body).decode()
    out = run_stream(stateful.replay(source, step, "string", initial=snapshot), f"{tmp_path}/c", mode="update")
    last = {}
    for r in sorted(out, key=lambda r: r["sequence"]):
        last[r["id"]] = (r["state"], r["sequence"])
    assert last == states(p.replay())


def test_a_command_stream_goes_on_where_a_batch_ended(spark, tmp_path):
    """Batch, then stream, is the whole in one batch; what the batch stopped is stopped; whole numbers stay whole."""
    rnd = random.Random(5)
    rows = [(rnd.choice("abcd"), n, *rnd.choice([("add", 2**60 // 3), ("add", -1), ("poison", 0), ("spawn", 0), ("add", 7)]), n) for n in range(40)]
    batch = Processes(spark, f"file://{tmp_path}/p", Summing(), "bigint")
    first = batch.run(sent(spark, *(r[:4] for r in rows[:20]))).collect()
    source = stored(spark, f"{tmp_path}/s", rows[20:30], rows[30:])
    then = run_stream(stateful.process(source, Summing(), "bigint", initial=batch.states()), f"{tmp_path}/c")
    none = spark.createDataFrame([], "id string, state bigint, sequence bigint")
    whole = process.entrust(sent(spark, *(r[:4] for r in rows)), none, Summing(), "bigint").collect()
    assert lines(first + then) == lines(whole)
    assert ends(first) | ends(then) == ends(whole) and not all(x[2] for x in ends(whole).values())


# Commands once


def test_a_batch_that_dies_between_its_writes_makes_no_command_twice(spark, tmp_path, monkeypatch):
    stream = EventStream(spark, f"{tmp_path}/s", f"{tmp_path}/c")
    stream.publish(journal(spark, [("p", n, "sold", str(n), n) for n in range(6)]))
    made = Mapper().register("sold", Reaction(TEXT, lambda e: F.lit("store"), "ship", lambda e: F.when(F.col("sequence_id") % 3 > 0, e)))
    from tidemark.sources import batches

    append = batches.BatchLog.append

    def dies(self, rows, number=None, writer="main"):
        if self.path.endswith("-failed") and alive:
            raise RuntimeError("the driver is lost")
        return append(self, rows, number, writer)

    monkeypatch.setattr(batches.BatchLog, "append", dies)
    alive = [True]
    with pytest.raises(Exception, match="lost"):
        stream.react("r", made, f"{tmp_path}/commands", since=BEGINNING, once=True).awaitTermination(60)
    assert stream.commands(f"{tmp_path}/commands").rows().count() == 4
    alive.clear()
    stream.react("r", made, f"{tmp_path}/commands", since=BEGINNING, once=True).awaitTermination(60)
    log = stream.commands(f"{tmp_path}/commands")
    assert log.rows().count() == 4 and spark.read.parquet(f"{tmp_path}/commands-failed").count() == 2
    stream.publish(journal(spark, [("p", 7, "sold", "7", 7)]))
    stream.react("r", made, f"{tmp_path}/commands", since=BEGINNING, once=True).awaitTermination(60)
    # What follows the commands gets each once, in the order of their events.
    out = run_stream(stateful.process(log.stream().withColumn("kind", F.lit("add")), Summing(), "bigint"), f"{tmp_path}/c2")
    assert [(bytes(r["event_bytes"]), r["sequence_id"]) for r in sorted(out, key=lambda r: r["sequence_id"] if r["sequence_id"] is not None else 99) if r["what"] == "event"] == [(str(n).encode(), k) for k, n in enumerate((1, 2, 4, 5, 7))]


# Repetitions


def test_repeated_publications_reach_a_subscriber_once(spark, tmp_path):
    stream = EventStream(spark, f"{tmp_path}/s", f"{tmp_path}/c", files=1)
    seen, often = [], []
    mapper = Mapper().register("put", Callback(TEXT, lambda df: seen.extend(r["event"] for r in df.collect())))
    all_of = Mapper().register("put", Callback(TEXT, lambda df: often.extend(r["event"] for r in df.collect())))
    sizes = []
    for n in range(8):  # each is published twice, a little later the second time
        rows = journal(spark, [("p", n, "put", str(n), 60 * n)]).coalesce(1)
        stream.publish(rows)
        stream.publish(rows.withColumn("created_at", F.col("created_at") + F.expr("interval 5 seconds")))
        q = stream.subscribe("s", mapper, since=BEGINNING, once=True, within="90 seconds")
        q.awaitTermination(60)
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    stream.subscribe("all", all_of, since=BEGINNING, once=True).awaitTermination(60)
    assert seen == [str(n) for n in range(8)] and len(often) == 16
    assert max(sizes) <= 4, sizes  # events that are older than the interval are not kept


def test_a_publisher_that_tries_again_publishes_once(spark, tmp_path):
    stream = EventStream(spark, f"{tmp_path}/s", f"{tmp_path}/c")
    rows = journal(spark, [("p", 0, "put", "x", 0)])
    assert [stream.publish(rows, number=4, publisher="shop"), stream.publish(rows, number=4, publisher="shop"), stream.publish(rows)] == [4, 4, 0]
    assert stream.log.rows().count() == 2


# Event time


def idle_rows(seed):
    """(id, arrival, seconds) with gaps below, at and above 100 seconds."""
    rnd = random.Random(seed)
    out = []
    for e in "abcd":
        t = rnd.randrange(50)
        for n in range(12):
            out.append((e, n, t))
            t += rnd.choice([1, 40, 99, 100, 100, 101, 150] if n > 3 else [1, 40, 100])
    return out


class Accepting(Summing):
    def decide(self, state, kind, body):
        return "seen", body

    def evolve(self, state, key, body):
        return (state or 0) + 1


@pytest.mark.parametrize("parts", [1, 6])
def test_a_backlog_is_cut_at_the_gaps_of_its_own_times(spark, tmp_path, parts):
    rows = sorted(idle_rows(parts), key=lambda r: r[2])
    size = -(-len(rows) // parts)
    source = stored(spark, f"{tmp_path}/s", *([(e, n, "add", 1, t) for e, n, t in rows[i : i + size]] for i in range(0, len(rows), size)))
    out = run_stream(stateful.process(source, Accepting(), "bigint", timeout=100_000, delay="0 seconds"), f"{tmp_path}/c")
    messages = spark.createDataFrame([(e, n, T0 + timedelta(seconds=t)) for e, n, t in rows], "id string, arrival int, created_at timestamp")
    wanted = sorted((r["id"], r["arrival"]) for r in process.idle_cutoff(messages, "100 seconds", ["arrival"]).collect())
    assert sorted((r["id"], r["arrival"]) for r in out if r["what"] == "event") == wanted
    stopped = {r["id"] for r in out if r["reason"] == "idle"}
    assert stopped >= {e for e in "abcd" if sum(w[0] == e for w in wanted) < 12}


def test_the_watermark_stops_who_sends_no_more(spark, tmp_path):
    source = stored(spark, f"{tmp_path}/s", [("a", 1, "add", 1, 0), ("b", 1, "add", 1, 0)], [("b", 2, "add", 1, 90)], [("b", 3, "add", 1, 180)], [("b", 4, "add", 1, 270)])
    out = run_stream(stateful.process(source, Accepting(), "bigint", timeout=100_000, delay="0 seconds"), f"{tmp_path}/c")
    assert [(r["id"], r["sequence"], r["state"]) for r in out if r["reason"] == "idle"] == [("a", 1, -1)]
    assert sum(r["what"] == "event" for r in out) == 5


# Ended state, and look-ups beside a running stream


def test_state_goes_when_a_process_ends(spark, tmp_path):
    source = stored(
        spark, f"{tmp_path}/s", [(e, 1, "spawn", 0, 0) for e in "abcdef"] + [("x", 1, "add", 1, 0)], [(e, 2, "add", 3, 0) for e in "abcdef"],
        [(e, 3, "poison", 0, 0) for e in "abcde"], [("a", 4, "add", 1, 0), ("b", 4, "spawn", 0, 0), ("b", 5, "add", 9, 0)],
    )
    sizes, out = [], []
    q = stateful.process(source, Summing(), "bigint", ended=stateful.REMOVE).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    assert sizes == [6, 6, 1, 2]
    assert [(r["id"], r["reason"]) for r in out if r["what"] == "rejection"] == [("x", "stopped"), ("a", "stopped")]
    found = {r["id"]: (r["state"], r["sequence"]) for r in stateful.running(spark, f"{tmp_path}/c").collect()}
    assert found == {"f": (3, 1), "b": (9, 1)}


def test_processes_of_a_running_stream_are_found(spark, tmp_path):
    import time

    source = stored(spark, f"{tmp_path}/s", [("a", 1, "add", 5, 0), ("a", 2, "add", 6, 0), ("b", 1, "add", 2, 0), ("b", 2, "poison", 0, 0)])
    q = stateful.process(source, Summing(), "bigint").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        q.processAllAvailable()
        live = stateful.running(spark, f"{tmp_path}/c", "account")
        assert [tuple(r) for r in live.collect()] == [("a", "account", 11, 2)] and q.isActive
        wanted = spark.createDataFrame([("a", "account"), ("a", "shop"), ("b", "account")], "id string, process_type string")
        assert sorted(r["status"] for r in process.found(live, wanted).collect()) == ["found", "missing", "other type"]
        # A batch's behaviour asks for it.
        asks = sent(spark, ("z", 1, "ask", "a"), ("z", 2, "ask", "b"))
        none = spark.createDataFrame([], "id string, state bigint, sequence bigint")
        out = process.entrust(asks, none, Summing(), "bigint", live.withColumn("process_type", F.lit("process")), F.col("bytes").cast("string"))
        assert [bytes(r["event_bytes"]) for r in out.where("what = 'event'").orderBy("arrival").collect()] == [b"2", b"None"]
        assert time.time() > 0
    finally:
        q.stop()


# Offsets


def test_a_subscription_starts_at_a_number_whatever_the_clocks_say(spark, tmp_path):
    stream = EventStream(spark, f"{tmp_path}/s", f"{tmp_path}/c")
    stream.publish(journal(spark, [("p", 0, "put", "before", 0)]))
    stream.publish(journal(spark, [("p", 0, "put", "shop before", 0)]), publisher="shop", number=12)
    seen, later = [], []
    mapper = Mapper().register("put", Callback(TEXT, lambda df: seen.extend(r["event"] for r in df.collect())))
    stream.subscribe("s", mapper, once=True).awaitTermination(60)
    stream.publish(journal(spark, [("p", 1, "put", "first", 0)]))
    stream.publish(journal(spark, [("p", 1, "put", "shop", 0)]), publisher="shop", number=13)
    stream.publish(journal(spark, [("p", 1, "put", "third writer", 0)]), publisher="other")
    # Files of before are as new as in a year, those of after as old as the epoch.
    for folder, _, names in os.walk(f"{tmp_path}/s"):
        for name in names:
            time = 1 if "batch=1/" in f"{folder}/" or "batch=13/" in f"{folder}/" or "other" in folder else datetime(2031, 1, 1).timestamp()
            os.utime(f"{folder}/{name}", (time, time))
    stream.subscribe("s", mapper, once=True).awaitTermination(60)
    assert sorted(seen) == ["first", "shop", "third writer"]
    assert stream.begun("s") == {"main": 0, "shop": 12}
    given = Mapper().register("put", Callback(TEXT, lambda df: later.extend(r["event"] for r in df.collect())))
    stream.subscribe("given", given, since={"main": 1, "other": 0}, once=True).awaitTermination(60)
    assert sorted(later) == ["shop", "shop before"]


# Processes that follow a stream


def test_processes_follow_a_stream_and_publish_their_events_once(spark, tmp_path, monkeypatch):
    """A micro-batch dies after it was written and comes again; so does a publication. In the end all is as in one batch."""
    rnd = random.Random(8)
    rows = [(rnd.choice("abcd"), n, *rnd.choice([("add", 5), ("add", -1), ("poison", 0), ("spawn", 0), ("add", 7)]), n) for n in range(40)]
    source = stored(spark, f"{tmp_path}/s", rows[:15], rows[15:30], rows[30:])
    kept = Processes(spark, f"file://{tmp_path}/p", Summing(), "bigint", "account")
    run, died = kept.run, []

    def dies(batch, number):
        out = run(batch, number)
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("the driver is lost")
        return out

    monkeypatch.setattr(kept, "run", dies)
    with pytest.raises(Exception, match="lost"):
        kept.follow(source, f"{tmp_path}/c", once=True).awaitTermination(60)
    kept.follow(source, f"{tmp_path}/c", once=True).awaitTermination(60)
    none = spark.createDataFrame([], "id string, state bigint, sequence bigint")
    whole = process.entrust(sent(spark, *(r[:4] for r in rows)), none, Summing(), "bigint").collect()
    assert died == [1] and kept.log.numbers() == [0, 1, 2]
    assert lines(kept.log.rows().collect()) == lines(whole)
    assert {r["id"]: (r["state"], r["sequence"], r["active"]) for r in kept.states().collect()} == ends(whole)

    stream = EventStream(spark, f"{tmp_path}/events", f"{tmp_path}/progress")
    stream.publish(journal(spark, [("other", 0, "k", "b", 0)]))
    publish = stream.publish

    def once(rows, number=None, publisher="main", wanted=False):
        if number == 2:
            raise RuntimeError("lost again")
        return publish(rows, wanted, number, publisher)

    monkeypatch.setattr(stream, "publish", once)
    with pytest.raises(RuntimeError):
        kept.publish(stream)
    monkeypatch.setattr(stream, "publish", publish)
    assert kept.publish(stream) == [2] and kept.publish(stream) == []
    events = [r for r in whole if r["what"] == "event"]
    assert sorted((r["id"], r["sequence_id"]) for r in stream.log.rows().where("writer = 'account'").collect()) == sorted((r["id"], r["sequence_id"]) for r in events)
    first = min((r for r in events), key=lambda r: (r["id"], r["sequence_id"]))
    assert bytes(kept.journal().read(first["id"], 0).first()["bytes"]) == bytes(first["event_bytes"])
    assert kept.journal().rows().count() == len(events)
