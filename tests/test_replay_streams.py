"""What a streamed replay asks of its state store, and that it folds the same whatever waits there."""

import pickle
import random

import pytest
from pyspark.sql import functions as F
from test_journal import joined, run_stream, states

from tidemark.schema import JOURNAL
from tidemark.streaming import stateful
from tidemark.streaming.stream import EventStream


def text(now, key, body):
    return (now or "") + bytes(body).decode()


def last(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["sequence"]):
        out[r["id"]] = (r["state"], r["sequence"])
    return out


@pytest.mark.parametrize("begun", [False, True])
def test_the_store_is_asked_for_entities_and_not_for_events(spark, tmp_path, begun):
    """stream_from_snapshot took five round trips to the store an event, and four writes."""
    p = joined(spark, [(e, s, "put", f"{e}{s},", s) for e in "abc" for s in range(200)])
    snapshot = p.until(19).replay() if begun else None
    events = EventStream(spark, f"{tmp_path}/s", f"{tmp_path}/c")
    events.publish(p.journal.where("sequence_id >= 20") if begun else p.journal)
    out = []
    q = stateful.replay(events.source(), text, "string", initial=snapshot).writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.collect()))
    q = q.option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
    q.awaitTermination(120)
    written = sum(o["numRowsUpdated"] + o["numRowsRemoved"] for progress in q.recentProgress for o in progress["stateOperators"])
    assert last(out) == states(p.replay())
    assert written <= 2 * 3, written


@pytest.mark.parametrize("held", [stateful.HELD, 2_000])
def test_events_in_any_order_fold_as_in_a_batch(spark, tmp_path, monkeypatch, held):
    """In seven micro-batches, early, late and written again; also where a task can hold only some of them."""
    monkeypatch.setattr(stateful, "HELD", held)
    rnd = random.Random(3)
    rows = [(e, s, "put", f"{s},", s) for e in "abcd" for s in range(60)]
    parts = [[] for _ in range(7)]
    for r in rows:
        own = rnd.choice(parts)
        own.append(r)
        if rnd.random() < 0.3:  # once more, with another body or the same
            own.append((*r[:3], rnd.choice([r[3], "again,"]), r[4] + 1))
    p = joined(spark, [r for part in parts for r in part], keep_duplicates=False)
    for part in parts:
        rnd.shuffle(part)
        joined(spark, part).journal.coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    source = spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    out = run_stream(stateful.replay(source, text, "string"), f"{tmp_path}/c", mode="update")
    assert last(out) == states(p.replay())


def test_a_state_may_be_nested(spark, tmp_path):
    """Structs, lists and maps go from a snapshot through two micro-batches; a struct may be a tuple."""
    kind = "struct<n:bigint,seen:array<string>,of:map<string,bigint>>"
    p = joined(spark, [(e, s, "put", "xyz"[s % 3], s) for e in "ab" for s in range(9)])

    def step(now, key, body):
        n, seen, of = (now["n"], now["seen"], now["of"]) if now else (0, [], {})
        k = bytes(body).decode()
        return {"n": n + 1, "seen": [*seen, k], "of": {**of, k: of.get(k, 0) + 1}}

    begun = p.until(2).replay().select("id", F.expr("named_struct('n', 3L, 'seen', array('x', 'y', 'z'), 'of', map('x', 1L, 'y', 1L, 'z', 1L))").alias("state"), "sequence")
    for low, high in ((3, 5), (6, 8)):
        p.journal.where(F.col("sequence_id").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    source = spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    out = run_stream(stateful.replay(source, step, kind, initial=begun), f"{tmp_path}/c", mode="update")
    assert {i: (s.asDict(), n) for i, (s, n) in last(out).items()} == {e: ({"n": 9, "seen": list("xyz" * 3), "of": {"x": 3, "y": 3, "z": 3}}, 9) for e in "ab"}
    assert stateful.to_arrow((1, ("a",), {"k": 2}), spark.createDataFrame([], f"s {kind}").schema["s"].dataType) == {"n": 1, "seen": ["a"], "of": [("k", 2)]}


def test_packs_have_every_event_once_and_a_bounded_size():
    rows = [("a", s, s, "k", b"x" * 100) for s in range(300)] + [("b", 0, 0, "k", b"x" * 50_000)] * 2 + [("a", 300, 0, "k", b"")]
    packs = [(i, pickle.loads(p)) for i, p in stateful.packed(iter(rows))]
    assert [(i, *e) for i, p in packs for e in p] == rows
    assert max(len(p) for _, p in packs) <= stateful.PACK // stateful.EVENT + 1 and [len(p) for i, p in packs if i == "b"] == [1, 1]
