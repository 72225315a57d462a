"""Numbered batches, processes over batches, and folds by changes that combine."""

import random

import pytest
from pyspark.sql import functions as F
from test_journal import TEXT, journal, joined, states

from tidemark import errors
from tidemark.functions import monoids
from tidemark.operators import process
from tidemark.operators.mapping import Change, Fold, Mapper
from tidemark.operators.process import Behaviour
from tidemark.operators.projection import DECODE, Projector
from tidemark.operators.status import Processes
from tidemark.sources.batches import BatchLog, after

COMMANDS = "id string, arrival bigint, kind string, bytes binary"


class Summing(Behaviour):
    """Adds what it is told; asks to end at 100; looks at the process that a command names."""

    def start(self, state):
        return state or 0

    def stop(self, state):
        return -state

    def decide(self, state, kind, body):
        if kind == "ask":
            return "asked", str(self.context.find("process")).encode()
        return ("added", body) if int(body) >= 0 else "negative"

    def evolve(self, state, key, body):
        if key == "asked":
            return state
        if int(body) == 100:
            self.context.poison()
        return state + int(body)


def sent(spark, *rows):
    return spark.createDataFrame([(i, a, k, str(b).encode()) for i, a, k, b in rows], COMMANDS)


def shown(rows):
    return sorted(((r["id"], r["what"], r["arrival"], r["reason"], r["sequence_id"], r["sequence"], r["active"], r["state"]) for r in rows.collect()), key=str)


# Batches


@pytest.fixture
def log(spark, tmp_path):
    return BatchLog(spark, f"file://{tmp_path}/log", spark.createDataFrame([], "id string, n bigint").schema)


def test_batches_have_rising_numbers_and_are_there_once(spark, log):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n bigint")
    assert log.rows().count() == 0 and log.offsets() == {} and log.last() == -1
    assert [log.append(rows), log.append(rows), log.append(rows, 7, "other"), log.append(rows.where("n = 1"), 7, "other")] == [0, 1, 7, 7]
    assert log.offsets() == {"main": 1, "other": 7} and log.numbers() == [0, 1] and log.rows().count() == 6
    assert log.rows().where(after({"main": 0})).count() == 4 and log.rows().where(after({"main": 1, "other": 7})).count() == 0
    assert log.batch(7, "other").count() == 2


def test_a_failed_batch_leaves_nothing(spark, log):
    bad = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n bigint").withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("n")))
    with pytest.raises(errors.WriteError):
        log.append(bad)
    assert log.rows().count() == 0 and log.last() == -1
    with pytest.raises(ValueError):
        log.append(bad, writer="a/b")


def test_two_that_append_at_a_time_get_two_numbers(spark, log, monkeypatch):
    """Both saw the same last number: the second finds the name taken and goes on to the next."""
    rows = spark.createDataFrame([("a", 1)], "id string, n bigint")
    log.append(rows)
    monkeypatch.setattr(log, "last", lambda writer="main": -1)
    assert [log.append(rows), log.append(rows)] == [1, 2] and log.rows().count() == 3
    monkeypatch.setattr(log, "has", lambda *a: False)
    assert log.append(rows.union(rows), 1) == 1 and not log.put(rows, 1) and log.rows().count() == 3  # another attempt was faster
    assert log.put(rows, 3) and log.rows().count() == 4


def test_forgotten_batches_stay_taken(spark, log):
    rows = spark.createDataFrame([("a", 1)], "id string, n bigint")
    for _ in range(4):
        log.append(rows)
    log.append(rows, 9, "other")
    assert log.forget(1) == [0, 1] and log.numbers() == [2, 3] and log.rows().count() == 3
    assert log.has(0) and log.append(rows, 1) == 1 and log.rows().count() == 3 and log.last() == 3
    assert log.forget(1) == [] and log.forget(7) == [2, 3] and log.last() == 3 and log.append(rows) == 4
    assert log.forget(9, "other") == [9] and log.offsets() == {"main": 4, "other": 9} and log.rows().count() == 1


# Processes over batches


@pytest.fixture
def kept(spark, tmp_path):
    return Processes(spark, f"file://{tmp_path}/p", Summing(), "bigint")


def test_what_a_batch_stops_stays_stopped(spark, kept):
    first = shown(kept.run(sent(spark, ("a", 1, "add", 5), ("a", 2, "poison", 0), ("b", 1, "add", 100), ("b", 2, "add", 1), ("c", 1, "add", 2**60))))
    assert ("a", "stopped", None, None, None, 1, False, -5) in first and ("b", "rejection", 2, "stopped", None, None, None, None) in first
    second = shown(kept.run(sent(spark, ("a", 3, "add", 1), ("c", 2, "add", 1))))
    assert second == sorted([("a", "rejection", 3, "stopped", None, None, None, None), ("a", "stopped", None, None, None, 1, False, -5), ("c", "event", 2, None, 1, None, None, None), ("c", "state", None, None, None, 2, True, 2**60 + 1)], key=str)
    third = shown(kept.run(sent(spark, ("a", 4, "spawn", 0), ("a", 5, "add", 1))))
    assert ("a", "event", 5, None, 1, None, None, None) in third and ("a", "state", None, None, None, 2, True, -4) in third
    assert {r["id"]: (r["state"], r["sequence"], r["active"]) for r in kept.states().collect()} == {"a": (-4, 2, True), "b": (-100, 1, False), "c": (2**60 + 1, 2, True)}
    assert {r["id"]: r["sequence"] for r in kept.running(0).collect()} == {"c": 1}
    assert sorted((r["id"], r["sequence_id"]) for r in kept.events().collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)]
    assert kept.rejections(since=0).count() == 1


def test_a_batch_that_runs_again_is_not_run_twice(spark, kept):
    batch = sent(spark, ("a", 1, "add", 5))
    assert shown(kept.run(batch, 3)) == shown(kept.run(batch, 3)) and kept.events().count() == 1
    assert [(r["state"], r["sequence"]) for r in kept.states().collect()] == [(5, 1)]


def test_two_programs_do_not_overwrite_each_other(spark, kept, tmp_path, monkeypatch):
    """While one decides, the other adds a batch: the first decides again, from what the other left."""
    kept.run(sent(spark, ("a", 1, "add", 5)))
    other = Processes(spark, f"file://{tmp_path}/p", Summing(), "bigint")
    states_, meanwhile = kept.states, [("a", 2, "add", 10)]

    def slow(upto=None):
        found = states_(upto)
        if meanwhile:
            other.run(sent(spark, meanwhile.pop()))
        return found

    monkeypatch.setattr(kept, "states", slow)
    assert ("a", "event", 3, None, 2, None, None, None) in shown(kept.run(sent(spark, ("a", 3, "add", 1))))
    assert [(r["state"], r["sequence"]) for r in states_().collect()] == [(16, 3)] and kept.log.numbers() == [0, 1, 2]


def test_batches_are_one_batch(spark, tmp_path):
    """Cut anywhere, with snapshots between, they end in the states and give the events of all commands in one."""
    rnd = random.Random(2)
    rows = [(rnd.choice("abcd"), n, *rnd.choice([("add", 3), ("add", -1), ("add", 100), ("poison", 0), ("spawn", 0), ("add", 7)])) for n in range(60)]
    none = spark.createDataFrame([], "id string, state bigint, sequence bigint, active boolean")
    whole = process.entrust(sent(spark, *rows), none, Summing(), "bigint")
    lines = lambda df: sorted(map(str, df.where("what in ('event', 'rejection')").select("id", "arrival", "what", "sequence_id", "reason").collect()))
    for cuts in (20, 40), (1, 2, 59):
        kept = Processes(spark, f"file://{tmp_path}/p{cuts[0]}", Summing(), "bigint")
        made = None
        for a, b in zip((0, *cuts), (*cuts, 60)):
            out = kept.run(sent(spark, *rows[a:b]))
            made = out if made is None else made.unionByName(out)
            assert kept.snapshot() == kept.log.last()
        assert lines(made) == lines(whole)
        ends = sorted(tuple(r) for r in whole.where("what in ('state', 'stopped')").select("id", "state", "sequence", "active").collect())
        assert sorted(tuple(r) for r in kept.states().collect()) == ends
        # Where a snapshot is, older batches are not read for states.
        plan = kept.states()._jdf.queryExecution().executedPlan().toString()
        assert "batch#" in plan and kept.snapshots.numbers()[-1] == kept.log.last()


def test_batches_go_when_a_snapshot_has_their_states(spark, kept):
    for n, rows in enumerate(([("a", 1, "add", 5), ("b", 1, "add", 7)], [("a", 2, "add", 5), ("c", 1, "poison", 0)], [("b", 2, "add", 1)])):
        kept.run(sent(spark, *rows))
        if n == 1:
            assert kept.snapshot() == 1
    before = sorted(map(tuple, kept.states().collect()))
    with pytest.raises(ValueError):
        kept.forget(2)
    assert kept.forget(1) == [0, 1] and kept.log.numbers() == [2]
    assert sorted(map(tuple, kept.states().collect())) == before and kept.events().count() == 1
    assert ("c", "rejection", 2, "stopped", None, None, None, None) in shown(kept.run(sent(spark, ("c", 2, "add", 1)))) and kept.log.last() == 3


def test_processes_are_spawned_and_found(spark, kept):
    wanted = spark.createDataFrame([("a", 10, 4), ("b", 20, 0)], "id string, state bigint, sequence bigint")
    kept.spawn(wanted)
    with pytest.raises(errors.AlreadyExist):
        kept.spawn(wanted)
    kept.spawn(wanted.unionByName(spark.createDataFrame([("c", 2, 1), ("c", 1, 1)], wanted.schema)), strict=False)
    assert {r["id"]: (r["state"], r["sequence"]) for r in kept.running().collect()} == {"a": (10, 4), "b": (20, 0), "c": (1, 1)}
    asks = sent(spark, ("b", 1, "ask", "a"), ("b", 2, "ask", "x"))
    out = kept.run(asks, running=kept.running(), names=F.col("bytes").cast("string"))
    assert [bytes(r["event_bytes"]) for r in out.where("what = 'event'").orderBy("arrival").collect()] == [b"4", b"None"]
    other = kept.running().withColumn("process_type", F.lit("account"))
    with pytest.raises(Exception, match="not a process"):
        kept.run(asks, running=other, names=F.col("bytes").cast("string"))


# Changes that combine


def affine(spark, rows, **options):
    """"a,b" -> times a plus b; "r,b" resets to b."""
    times = lambda e: F.split_part(e, F.lit(","), F.lit(1)).try_cast("long")
    plus = lambda e: F.split_part(e, F.lit(","), F.lit(2)).try_cast("long")
    change = lambda e: F.when(times(e).isNotNull(), F.struct(F.struct(times(e).alias("times"), plus(e).alias("plus")).alias("x"), e.alias("last")))
    fold = Fold(lambda b: F.when(times(TEXT(b)).isNotNull(), TEXT(b)), lambda s, e: F.struct((s["x"] * times(e) + plus(e)).alias("x"), e.alias("last")), lambda e: F.struct(plus(e).alias("x"), e.alias("last")))
    m = Mapper().register("put", Change(TEXT, change)).register("put", fold)
    return Projector(journal(spark, rows), m, "struct<x:bigint,last:string>", **options)


MONOID = monoids.together(x=monoids.scaling("bigint"), last=monoids.latest("string"))


@pytest.mark.parametrize("segment", [2, 3, 1000])
@pytest.mark.parametrize("keep_duplicates", [False, True])
def test_composed_folds_are_folds(spark, segment, keep_duplicates):
    """With gaps, writes of one sequence, repeated writes, a hot entity, and from snapshots."""
    rnd = random.Random(segment)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.randrange(40), "put", f"{rnd.choice([-1, 1, 1, 2, 0])},{rnd.randrange(5)}", rnd.randrange(3)) for _ in range(150)]
    p = affine(spark, rows, keep_duplicates=keep_duplicates)
    assert states(p.replay_composed(MONOID, segment=segment)) == states(p.replay())
    snapshot = p.until(11).replay().unionByName(spark.createDataFrame([("new", None, 5)], "id string, state struct<x:bigint,last:string>, sequence bigint"))
    assert states(p.replay_composed(MONOID, snapshot, segment=segment)) == states(p.replay(snapshot))


def test_composed_folds_stop_at_an_error(spark):
    rows = [("a", s, "put", "x" if s == 5 else f"2,{s}", s) for s in range(9)] + [("b", 0, "put", "1,1", 0)]
    p = affine(spark, rows)
    one, other = (sorted(map(str, d.collect())) for d in (p.replay_composed(MONOID, on_error="keep", segment=2), p.replay(on_error="keep")))
    assert one == other and any(DECODE in x for x in one)
    with pytest.raises(errors.ApplyEvent):
        p.replay_composed(MONOID, segment=2)


def test_composed_folds_are_strict_or_lenient(spark):
    p = affine(spark, [("a", 0, "put", "1,1", 0), ("a", 1, "else", "", 1), ("b", 0, "else", "", 0)])
    with pytest.raises(errors.NotCompatible, match="else"):
        p.replay_composed(MONOID)
    assert states(p.replay_composed(MONOID, on_unmapped="skip")) == states(p.replay(on_unmapped="skip"))
    assert p.over(p.journal.limit(0)).replay_composed(MONOID).count() == 0


def test_composition_is_associative_and_acts_alike(spark):
    """Every monoid, on random changes: ways to put them together, and one by one on a state."""
    rnd = random.Random(4)
    kinds = {"adding": (monoids.adding("bigint"), lambda: rnd.randrange(9)), "latest": (monoids.latest("bigint"), lambda: rnd.choice([None, 1, 2])), "resetting": (monoids.resetting("bigint"), lambda: (rnd.random() < 0.3, rnd.randrange(9))), "scaling": (monoids.scaling("bigint"), lambda: (rnd.randrange(-2, 3), rnd.randrange(9)))}
    for m, value in kinds.values():
        rows = spark.createDataFrame([(value(), value(), value(), rnd.choice([None, 5])) for _ in range(40)], f"a {m.kind}, b {m.kind}, c {m.kind}, s bigint")
        a, b, c, s = (F.col(x) for x in "abcs")
        left, right = m.combine(m.combine(a, b), c), m.combine(a, m.combine(b, c))
        same = left.eqNullSafe(right) & m.act(s, left).eqNullSafe(m.act(m.act(m.act(s, a), b), c)) & m.combine(m.none(), a).eqNullSafe(a) & m.combine(a, m.none()).eqNullSafe(a)
        assert rows.where(~same).count() == 0


def test_rounds_do_not_lengthen_the_plan(spark):
    """Entities of very different sizes, block by block: the plan is the same for 5 rounds and for 25."""
    def of(n):
        rows = [(f"e{k}", s, "put", "x", s) for k in range(4) for s in range(n // (k + 1))]
        out = joined(spark, rows).replay(step=2, on_error="keep")
        assert {r["id"]: r["sequence"] for r in out.collect()} == {f"e{k}": n // (k + 1) for k in range(4)}
        return len(out._jdf.queryExecution().executedPlan().toString().split("\n"))

    assert of(10) == of(50)


def test_errors_name_some_event_types(spark):
    rows = [("a", n, f"k{n:03d}", "", n) for n in range(50)]
    with pytest.raises(errors.NotCompatible) as found:
        joined(spark, rows).replay()
    assert "k000" in str(found.value) and "k019" in str(found.value) and "k020" not in str(found.value)
