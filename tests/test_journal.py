from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.engine import Engine
from tidemark.functions import codec
from tidemark.functions.codec import command, event, kebab
from tidemark.operators import audit, ordering, process
from tidemark.operators.mapping import Callback, Fold, Mapper, Reaction, ResolveType
from tidemark.operators.process import Behaviour
from tidemark.operators.projection import Projector
from tidemark.schema import JOURNAL, time_collisions
from tidemark.sources.journal import EventWriter, Journal
from tidemark.streaming import stateful
from tidemark.streaming.stream import BEGINNING, EventStream, fanned_out

T0 = datetime(2024, 1, 1)
TEXT = lambda b: codec.text_of(b)


def journal(spark, rows):
    """rows: id, sequence, key, body, seconds."""
    return spark.createDataFrame([(i, s, k, bytearray(b, "utf-8"), T0 + timedelta(seconds=t)) for i, s, k, b, t in rows], JOURNAL)


def joined(spark, rows, **options):
    """A projector whose state is the bodies in order."""
    fold = Fold(TEXT, lambda s, e: F.concat(s, e), lambda e: e)
    return Projector(journal(spark, rows), Mapper().register("put", fold), "string", **options)


def states(df):
    return {r["id"]: (r["state"], r["sequence"]) for r in df.collect()}


@pytest.mark.parametrize(
    "rows, state, sequence",
    [
        ([(0, "a", 0), (1, "b", 1), (2, "c", 2)], "abc", 3),
        ([(0, "a", 0), (0, "a", 5)], "a", 1),
        ([(0, "w", 0), (1, "x", 1), (1, "y", 2), (1, "x", 3)], "wxyx", 4),
        ([(0, "a", 0), (2, "c", 1)], "ac", 2),
        ([(2, "c", 2), (0, "a", 0), (1, "b", 1)], "abc", 3),
    ],
    ids=["plain", "retry", "conflict", "gap", "disorder"],
)
def test_replay(spark, rows, state, sequence):
    p = joined(spark, [("e", s, "put", b, t) for s, b, t in rows])
    assert states(p.replay()) == {"e": (state, sequence)}
    assert states(p.replay_python(lambda now, key, body: (now or "") + bytes(body).decode(), "string")) == {"e": (state, sequence)}


def test_replay_of_nothing(spark):
    p = joined(spark, [])
    assert p.replay().count() == 0
    assert p.replay_one("e", ("s", 7)) == ("s", 7)
    with pytest.raises(errors.EmptyJournal):
        p.replay_one("e")


def test_strict_and_lenient_replay(spark):
    p = joined(spark, [("e", 0, "put", "a", 0), ("e", 1, "other", "b", 1)])
    with pytest.raises(errors.NotCompatible) as caught:
        p.replay()
    assert caught.value.keys == ["other"]
    assert states(p.replay(on_unmapped="skip")) == {"e": ("a", 1)}


def test_errors_of_a_fold_stop_it(spark):
    fold = Fold(TEXT, lambda s, e: F.concat(s, e), lambda e: e, lambda s, e: F.when(e == "bad", "refused"))
    p = Projector(journal(spark, [("e", 0, "put", "a", 0), ("e", 1, "put", "bad", 1), ("e", 2, "put", "c", 2)]), Mapper().register("put", fold), "string")
    assert [tuple(r) for r in p.replay(on_error="keep").collect()] == [("e", "a", 1, "refused")]
    with pytest.raises(errors.ApplyEvent):
        p.replay()
    no_first = Mapper().register("put", Fold(TEXT, lambda s, e: e))
    with pytest.raises(errors.FirstFormation):
        Projector(p.journal, no_first, "string").replay()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", min_size=1, max_size=2), min_size=1, max_size=8), st.data())
def test_replay_from_a_snapshot_is_replay(spark, bodies, data):
    rows = [("e", i, "put", b, i) for i, b in enumerate(bodies)]
    whole, at = joined(spark, rows), data.draw(st.integers(1, len(rows)))
    snapshot = whole.until(sequence=at - 1).replay()
    shuffled = joined(spark, data.draw(st.permutations(rows)))
    assert states(shuffled.replay(snapshot)) == states(whole.replay()) == {"e": ("".join(bodies), len(bodies))}
    assert states(whole.replay_in_steps(3)) == states(whole.replay())


def test_sets(spark):
    twins = journal(spark, [("e", 0, "b", "y", 0), ("e", 0, "a", "x", 0), ("e", 0, "a", "x", 1)])
    assert sorted((r["registry_key"], r["created_at"].second) for r in ordering.journal_dedup(twins).collect()) == [("a", 0), ("a", 1)]
    assert audit.duplicates(twins).first()["n"] == 3
    assert [tuple(r) for r in audit.gaps(journal(spark, [("e", 0, "a", "", 0), ("e", 3, "a", "", 0)])).collect()] == [("e", 0, 2)]
    assert time_collisions(spark.createDataFrame([("e", 0, 1001), ("e", 0, 1999), ("f", 0, 5)], "id string, sequence_id long, created_ns long")).count() == 1


def test_stores(spark, tmp_path):
    rows = journal(spark, [("e", i, "put", str(i), i) for i in range(5)] + [("f", 0, "put", "x", 0)])
    for store in (Journal(spark, f"{tmp_path}/plain"), Journal(spark, f"{tmp_path}/dealt", buckets=4), Journal(spark, "kept_events")):
        EventWriter(store).write(rows)
        assert store.read("e", 2).first()["bytes"] == b"2"
        assert store.read_to("e", 1, 3).count() == 3 and store.read_to_latest("e", 3).count() == 2
        with pytest.raises(errors.ReadError):
            store.read("e", 9)
    said = []
    failing = EventWriter(Journal(spark, rows), on_exhausted="drop").set_retry(0)
    assert failing.write(rows, said.append) is False and len(said) == 1
    with pytest.raises(errors.WriteError):
        EventWriter(Journal(spark, rows)).write(rows, said.append)
    assert len(said) == 4


def scan_of(df):
    """The scans in a plan, as Spark shows them."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(x for x in plan.splitlines() if "FileScan" in x), plan


def test_a_journal_at_rest(spark):
    """Keyed reads reach the scan and one bucket; a replay of the table shuffles nothing."""
    rows = journal(spark, [(e, i, "put", f"{e}{i}", i) for e in "abc" for i in range(9)])
    store = Journal.at_rest(spark, rows, buckets=4)
    scan, _ = scan_of(store.read_to("b", 2, 4))
    assert "EqualTo(id,b)" in scan and "GreaterThanOrEqual(sequence_id,2)" in scan
    assert [bytes(r["bytes"]) for r in store.read_to("b", 2, 4).orderBy("sequence_id").collect()] == [b"b2", b"b3", b"b4"]
    store.append(journal(spark, [("b", 9, "put", "b9", 9)]))
    fold = Mapper().register("put", Fold(TEXT, lambda s, e: F.concat(s, F.lit(","), e), lambda e: e))
    p = Projector(store.rows(), fold, "string", by_id=store.by_id)
    _, plan = scan_of(p.replay(on_unmapped="skip", on_error="keep"))
    assert "Exchange" not in plan
    whole = states(p.replay())
    assert whole["b"] == (",".join(f"b{i}" for i in range(10)), 10) and whole["a"][1] == 9
    snapshot = p.until(3).replay()
    scan, plan = scan_of(p.replay(snapshot, on_unmapped="skip", on_error="keep", complete=True))
    assert "GreaterThanOrEqual(sequence_id,4)" in scan and "hashpartitioning(id" not in plan.partition("FileScan parquet spark_catalog")[0].rpartition("Window")[2]
    assert states(p.replay(snapshot, complete=True)) == whole == states(p.replay_in_steps(4))


@pytest.mark.parametrize("step", [1, 2, 3, 100])
def test_folds_in_blocks_are_folds(spark, step):
    rows = [("e", s, "put", b, t) for s, b, t in [(-2, "z", 0), (10**12, "a", 0), (10**12, "a", 5), (10**12 + 1, "x", 1), (10**12 + 1, "y", 2), (10**12 + 1, "x", 3), (10**12 + 9, "c", 1)]]
    p = joined(spark, [*rows, ("f", 0, "put", "one", 0)])
    begun = spark.createDataFrame([("e", "s", 10**12 + 1), ("g", "old", 4)], "id string, state string, sequence long")
    assert states(p.replay(step=step)) == {"e": ("zaxyxc", 6), "f": ("one", 1)}
    assert states(p.replay(begun, step=step)) == {"e": ("sxyxc", 10**12 + 5), "f": ("one", 1), "g": ("old", 4)}
    join = lambda now, key, body: (now or "") + bytes(body).decode()
    assert states(p.replay_python(join, "string", begun)) == states(p.replay(begun))
    stopping = Fold(TEXT, lambda s, e: F.concat(s, e), lambda e: e, lambda s, e: F.when(e == "y", "refused"))
    q = Projector(p.journal, Mapper().register("put", stopping), "string")
    assert sorted(map(tuple, q.replay(on_error="keep", step=step).collect())) == [("e", "zax", 3, "refused"), ("f", "one", 1, None)]


def test_total_order(spark):
    rows = journal(spark, [("b", 1, "p", "", 5), ("a", 1, "p", "", 5), ("c", 0, "p", "", 9), ("c", 1, "p", "", 4), ("c", 1, "p", "", 4)])
    placed = sorted((r["position"], r["id"], r["sequence_id"]) for r in ordering.with_total_position(rows).collect())
    assert placed == [(1, "c", 0), (2, "c", 1), (3, "c", 1), (4, "a", 1), (5, "b", 1)]
    assert [r["id"] for r in ordering.in_order(rows).collect()] == ["c", "c", "c", "a", "b"]
    assert ordering.with_total_position(rows.limit(0)).count() == 0


def test_places_in_groups_of_any_size(spark):
    """A hot group, ties, null groups and orders, and no rows: as a window numbers them."""
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).alias("id"), F.expr("if(id % 11 = 0, null, hash(id) % 900)").alias("arrival"), F.col("id").alias("n"))
    w = Window.partitionBy("id").orderBy("arrival", "n")
    placed = ordering.with_place(rows, ["id"], ["arrival", "n"])
    assert rows.withColumn("position", F.row_number().over(w) - 1).exceptAll(placed).count() == 0 and placed.count() == 4000
    assert ordering.with_place(rows.limit(0), ["id"], ["arrival"]).count() == 0
    events = rows.where("id is not null and arrival is not null").select("id", "arrival").distinct()
    begun = spark.createDataFrame([("hot", 7)], "id string, sequence long")
    one, parts = (process.sequenced(events, begun, in_one=n) for n in (10**6, 5))
    assert one.exceptAll(parts.select(*one.columns)).count() == 0 and one.where("id = 'hot'").agg(F.min("sequence_id")).first()[0] == 7


def test_a_journal_in_a_database(spark, tmp_path):
    """Derby comes with Spark: a round trip, keyed reads in the database, ranges of a whole read."""
    url, driver = f"jdbc:derby:{tmp_path}/derby;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = journal(spark, [(e, i, "put", f"{e}{i}", i) for e in "ab" for i in range(6)])
    Journal.to_jdbc(rows.limit(0), url, "events", **driver)
    assert Journal.from_jdbc(spark, url, "events", parts=3, **driver).rows().count() == 0
    Journal.to_jdbc(rows, url, "events", **driver)
    store = Journal.from_jdbc(spark, url, "events", parts=3, **driver)
    assert store.rows().rdd.getNumPartitions() == 3
    same = lambda df: sorted((r["id"], r["sequence_id"], r["registry_key"], bytes(r["bytes"]), r["created_at"]) for r in df.collect())
    assert same(store.rows()) == same(rows)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert "EqualTo" in store.read_to("a", 2, 3)._jdf.queryExecution().executedPlan().toString() and store.read_to("a", 2, 3).count() == 2
    fold = Mapper().register("put", Fold(TEXT, lambda s, e: F.concat(s, e), lambda e: e))
    assert states(Projector(store.rows(), fold, "string").replay()) == {e: ("".join(f"{e}{i}" for i in range(6)), 6) for e in "ab"}
    with pytest.raises(errors.WriteError):
        Journal.to_jdbc(rows, "jdbc:none:", "events")
    halves = Journal.from_jdbc(spark, url, "events", conditions=["mod(length(\"id\") + \"sequence_id\", 2) = 0", "mod(length(\"id\") + \"sequence_id\", 2) = 1"], **driver)
    assert halves.rows().rdd.getNumPartitions() == 2 and same(halves.rows()) == same(rows)


def test_the_shared_folder_must_be_named(spark):
    from tidemark.sources.shared import shared_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(errors.SetupError):
        shared_dir(Cluster())


def test_event_types(spark, tmp_path):
    @event(schema="struct<new:string>")
    class ChangedName:
        pass

    @command
    class ChangeName:
        pass

    assert ChangedName.event_type.key == "changed-name" and ChangeName.command_kind == "change-name"
    names = ["DomainEvent", "HTTPEvent", "ÉcoleEvent", "x"]
    expected = ["domain-event", "h-t-t-p-event", "École-event", "x"]
    assert [kebab(n) for n in names] == expected
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(codec.kebab_case(F.col("n"))).collect()] == expected
    with pytest.raises(errors.EncodeError):
        event()
    store = Journal(spark, f"{tmp_path}/j")
    store.append_events(spark.range(1).select(F.lit("e").alias("id"), F.lit(0).alias("sequence_id"), F.struct(F.lit("n").alias("new")).alias("event")), ChangedName)
    assert store.read_event("e", 0, ChangedName).first()["event"]["new"] == "n"
    store.append(journal(spark, [("e", 1, "changed-name", "no json", 0)]))
    with pytest.raises(errors.ReadError):
        store.read_event("e", 1, ChangedName).collect()


def test_mapper():
    m = Mapper().register("a", Fold(TEXT, None)).register("a", Fold(codec.json_field("$.x"), None)).register("a", Callback(TEXT, print))
    assert len(m) == 2 and str(ResolveType("a", "subscribe")) == "a-subscribe"
    assert m.find(lambda t: t.handler == "nothing") is None
    assert len(m.filter(lambda t: t.handler == "projection")) == 1
    with pytest.raises(errors.ResolveError):
        m.find(lambda t: t.event == "a")


class Account(Behaviour):
    messages = ("note",)

    def decide(self, state, kind, body):
        amount = int(bytes(body))
        return ("paid", body) if (state or 0) + amount >= 0 else "not covered"

    def evolve(self, state, key, body):
        return (state or 0) + int(bytes(body))


def commands(spark, rows):
    return spark.createDataFrame([(i, n, k, bytearray(str(b), "utf-8")) for i, n, k, b in rows], "id string, arrival long, kind string, bytes binary")


def test_a_batch_of_commands(spark, tmp_path):
    engine = Engine(spark, Journal(spark, f"{tmp_path}/journal"))
    begun = spark.createDataFrame([("a", 5, 3)], "id string, state long, sequence long")
    out = engine.run(commands(spark, [("a", 2, "pay", -9), ("a", 1, "pay", 4), ("a", 3, "note", 0), ("a", 4, "pay", -100), ("b", 1, "pay", 1)]), begun, Account(), "long").toPandas()
    assert sorted((r.id, r.sequence_id) for r in out[out.what == "event"].itertuples()) == [("a", 3), ("a", 4), ("b", 0)]
    assert list(out[out.what == "rejection"].reason) == ["not covered"]
    assert {r.id: (r.state, r.sequence) for r in out[out.what == "state"].itertuples()} == {"a": (0, 5), "b": (1, 1)}
    assert engine.journal.rows().count() == 3
    with pytest.raises(errors.SetupError):
        engine.set_writer(EventWriter(engine.journal))
    with pytest.raises(errors.SetupError):
        engine.stream  # noqa: B018


class Mortal(Account):
    """Ends itself at a payment of 13 and leaves a round sum."""

    def evolve(self, state, key, body):
        if key == "told":
            return state
        if bytes(body) == b"13":
            self.context.poison()
        return super().evolve(state, key, body)

    def decide(self, state, kind, body):
        if kind == "tell":
            return "told", f"{self.context.id}:{self.context.sequence}:{state}".encode()
        return super().decide(state, kind, body)

    def stop(self, state):
        return state - state % 10


def test_processes_end_and_begin_again(spark):
    rows = [("a", 1, "pay", 7), ("a", 2, "poison", 0), ("a", 3, "pay", 1), ("a", 4, "spawn", 0), ("a", 5, "spawn", 0), ("a", 6, "pay", 2), ("b", 1, "pay", 13), ("b", 2, "pay", 1)]
    none = spark.createDataFrame([], "id string, state long, sequence long")
    out = process.entrust(commands(spark, rows), none, Mortal(), "long").toPandas()
    assert sorted((r.id, r.arrival, r.reason) for r in out[out.what == "rejection"].itertuples()) == [("a", 3, "stopped"), ("a", 5, "running already"), ("b", 2, "stopped")]
    assert {(r.id, r.what, r.state, r.sequence) for r in out[out.sequence.notna()].itertuples()} == {("a", "state", 2, 2), ("b", "stopped", 10, 1)}


def test_rules_that_read_the_state_are_refused(spark):
    stale = {"pay": process.Rule("paid", lambda s, b: b, lambda s, b: F.when(s < 0, "no"))}
    fresh = {"pay": process.Rule("paid", lambda s, b: b, lambda s, b: F.when(F.length(b) > 5, "no"))}
    begun = spark.createDataFrame([("a", 5, 3)], "id string, state long, sequence long")
    with pytest.raises(errors.StaleState):
        process.entrust_rules(commands(spark, [("a", 1, "pay", 1)]), begun, stale)
    events, rejected = process.entrust_rules(commands(spark, [("a", 1, "pay", 1), ("a", 2, "pay", 1234567)]), begun, fresh)
    assert [r["sequence_id"] for r in events.collect()] == [3] and rejected.count() == 1


def test_processes(spark):
    running = spark.createDataFrame([("a", "x", 0)], "id string, process_type string, sequence long")
    wanted = spark.createDataFrame([("b", "x", 0)], running.schema)
    assert process.spawn(running, wanted).count() == 2
    with pytest.raises(errors.AlreadyExist):
        process.spawn(running, running)
    assert process.spawn(running, running, strict=False).count() == 1
    assert process.find(running, "a", "x") and process.find(running, "c", "x") is None
    with pytest.raises(errors.InvalidCast):
        process.find(running, "a", "y")
    with pytest.raises(errors.NotFound):
        process.deregister(running, "c")
    sent = journal(spark, [("e", 0, "m", "", 0), ("e", 1, "poison", "", 1), ("e", 2, "m", "", 9)])
    assert process.poison_cutoff(sent, F.col("registry_key") == "poison", ["sequence_id"]).count() == 2
    assert process.idle_cutoff(sent, "5 seconds", ["sequence_id"]).count() == 2


def test_subscriptions(spark, tmp_path):
    stream = EventStream(spark, f"{tmp_path}/stream", f"{tmp_path}/progress")
    with pytest.raises(errors.SubscriberMissing):
        stream.publish(journal(spark, []), wanted=True)
    stream.publish(journal(spark, [("p", i, k, k, i) for i, k in enumerate(["signal2", "signal1", "signal2", "other"])]))
    seen = []
    mapper = Mapper().register("signal1", Callback(TEXT, lambda df: seen.extend((r["registry_key"], r["event"]) for r in df.collect())))
    mapper.register("signal2", Callback(TEXT, lambda df: 1 / 0))
    stream.subscribe("s", mapper, since=BEGINNING, once=True).awaitTermination(60)
    assert seen == [("signal1", "signal1")] and {e[1] for e in stream.errors} == {"signal2"}
    late = []
    only = Mapper().register("signal2", Callback(TEXT, lambda df: late.extend(r["sequence_id"] for r in df.collect())))
    stream.subscribe("late", only, since=T0 + timedelta(seconds=1), once=True).awaitTermination(60)
    assert late == [2]
    react = Mapper().register("signal2", Reaction(TEXT, lambda e: F.lit("target"), "do", lambda e: F.when(F.col("sequence_id") > 0, e)))
    stream.react("r", react, f"{tmp_path}/commands", since=BEGINNING, once=True).awaitTermination(60)
    assert [(r["id"], r["kind"]) for r in spark.read.parquet(f"{tmp_path}/commands").collect()] == [("target", "do")]
    assert spark.read.parquet(f"{tmp_path}/commands-failed").count() == 1
    stream.trace(f"{tmp_path}/trace", since=BEGINNING, once=True).awaitTermination(60)
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/trace").collect()) == ["p#other", "p#signal1", "p#signal2", "p#signal2"]
    subs = spark.createDataFrame([("x", "signal2"), ("y", "signal2")], "subscriber string, registry_key string")
    assert fanned_out(spark.read.parquet(f"{tmp_path}/stream"), subs).count() == 4


def test_a_subscription_starts_at_the_present(spark, tmp_path):
    import time

    stream = EventStream(spark, f"{tmp_path}/stream", f"{tmp_path}/progress")
    stream.publish(journal(spark, [("p", 0, "signal", "before", 0)]))
    time.sleep(1.1)
    seen = []
    mapper = Mapper().register("signal", Callback(TEXT, lambda df: seen.extend(r["event"] for r in df.collect())))
    for published in "first", "second":  # the second run goes on where the first ended
        stream.subscribe("s", mapper, once=True).awaitTermination(60)
        stream.publish(journal(spark, [("p", 1, "signal", published, 0)]))
    stream.subscribe("s", mapper, once=True).awaitTermination(60)
    assert sorted(seen) == ["first", "second"]


def run_stream(df, path, until=None, mode="append"):
    """All rows that a stream puts out: what is there now, or until a condition on them holds."""
    import time

    out = []
    writer = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", path)
    q = (writer.trigger(availableNow=True) if until is None else writer.trigger(processingTime="1 second")).start()
    if until is None:
        q.awaitTermination(120)
    else:
        end = time.time() + 90
        while time.time() < end and not until(out) and q.isActive:
            time.sleep(0.5)
        q.stop()
    return out


def test_poison_and_idle_time_in_a_stream(spark, tmp_path):
    schema = "id string, arrival long, kind string, bytes binary"
    for part in ([("a", 1, "pay", 25)], [("a", 2, "poison", 0), ("a", 3, "pay", 1)], [("a", 4, "pay", 1)], [("a", 5, "spawn", 0), ("a", 6, "pay", 4), ("a", 7, "tell", 0)]):
        commands(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/commands")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/commands")
    out = run_stream(stateful.process(source, Mortal(), "long"), f"{tmp_path}/c1")
    assert sorted((r["arrival"], r["reason"]) for r in out if r["what"] == "rejection") == [(3, "stopped"), (4, "stopped")]
    assert [bytes(r["event_bytes"]) for r in out if r["event_key"] == "told"] == [b"a:2:24"]
    assert {(r["what"], r["state"], r["sequence"]) for r in out if r["sequence"] is not None} == {("state", 25, 1), ("stopped", 20, 1), ("state", 24, 3)}

    commands(spark, [("a", 1, "pay", 25)]).coalesce(1).write.parquet(f"{tmp_path}/more")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/more")
    idle = lambda rows: any(r["reason"] == "idle" for r in rows)
    out = run_stream(stateful.process(source, Mortal(), "long", timeout=1500), f"{tmp_path}/c2", idle)
    assert [(r["what"], r["state"], r["sequence"]) for r in out if r["reason"] == "idle"] == [("stopped", 20, 1)]


def test_streamed_gaps_and_conflicts_are_as_in_a_batch(spark, tmp_path):
    rows = [("e", 0, "put", "w", 0), ("e", 1, "put", "x", 1), ("e", 1, "put", "y", 2), ("e", 1, "put", "x", 3), ("e", 2, "put", "r", 4), ("e", 2, "put", "r", 9), ("e", 5, "put", "c", 5), ("e", 9, "put", "d", 1)]
    journal(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/events")
    step = lambda now, key, body: (now or "") + bytes(body).decode()
    source = spark.readStream.schema(JOURNAL).parquet(f"{tmp_path}/events")
    waits = run_stream(stateful.replay(source, step, "string"), f"{tmp_path}/c1", mode="update")
    assert tuple(max(waits, key=lambda r: r["sequence"])) == ("e", "wxyxr", 5)
    source = spark.readStream.schema(JOURNAL).parquet(f"{tmp_path}/events")
    out = run_stream(stateful.replay(source, step, "string", patience=1000), f"{tmp_path}/c2", lambda rows: any(r["sequence"] == 7 for r in rows), "update")
    last = max(out, key=lambda r: r["sequence"])
    assert {last["id"]: (last["state"], last["sequence"])} == states(joined(spark, rows).replay()) == {"e": ("wxyxrcd", 7)}


def test_streamed_folds_are_batch_folds(spark, tmp_path):
    """Rows in disorder over several batches, and commands in two batches."""
    rows = [("e", 2, "put", "c", 2), ("e", 0, "put", "a", 0), ("e", 1, "put", "b", 1), ("e", 0, "put", "a", 7)]
    for i, r in enumerate(rows):
        journal(spark, [r]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    source = spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    folded = stateful.replay(source, lambda now, key, body: (now or "") + bytes(body).decode(), "string")
    got = []
    q = folded.writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max(got, key=lambda r: r[2]) == ("e", "abc", 3)

    for part in ([("a", 1, "pay", 5)], [("a", 2, "pay", -3), ("a", 3, "pay", -9)]):
        commands(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/commands")
    source = spark.readStream.schema("id string, arrival long, kind string, bytes binary").parquet(f"{tmp_path}/commands")
    out = []
    q = stateful.process(source, Account(), "long").writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["sequence_id"] for r in out if r["what"] == "event"] == [0, 1]
    assert [r["reason"] for r in out if r["what"] == "rejection"] == ["not covered"]
