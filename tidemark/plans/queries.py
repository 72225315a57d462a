"""The engine's operators as queries over the test tables, and the SQL that gives the same rows.

Journal J: the events of a user are an entity; sequence by (ts, event_id); the body is JSON of value and
props. Journal K: the turns of a conversation are an entity; the body is the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import codec, envelope, monoids
from tidemark.functions.codec import EventType
from tidemark.operators import audit, mapping, ordering, process
from tidemark.operators.mapping import Callback, Change, Fold, Mapper, Reaction
from tidemark.operators.process import Behaviour, Rule
from tidemark.operators.projection import Projector
from tidemark.operators.status import Processes
from tidemark.schema import as_journal
from tidemark.sources.batches import BatchLog
from tidemark.sources.journal import Journal
from tidemark.sources.shared import kept, scratch
from tidemark.streaming import stateful
from tidemark.streaming.stream import BEGINNING, EventStream, fanned_out, once_each, reacted, subscribed

MONEY = "decimal(18,2)"
STATE = f"struct<balance:{MONEY},events:int>"
KEYS = ["click", "error", "purchase", "signup", "view"]
ONE, FROM, TO, SNAP = "7", 3, 12, 20

amount = codec.json_field("$.value", MONEY)
k_of = codec.json_field("$.props.k", "int")


def events_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.concat(F.lit('{"value":'), F.col("value").cast(MONEY).cast("string"), F.lit(',"props":'), "props", F.lit("}"))
    return as_journal(e, F.col("user_id"), F.col("event_type"), body, F.col("ts"), order=["ts", "event_id"])


_AT_REST: dict[tuple[str, str], Journal] = {}


def at_rest(spark: SparkSession, sf_dir: str) -> Journal:
    """The same journal as a store: written once in a session, bucketed by id."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _AT_REST:
        _AT_REST[key] = Journal.at_rest(spark, events_journal(spark, sf_dir))
    return _AT_REST[key]


def conversations_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return as_journal(c, F.col("conv_id"), F.col("role"), F.col("text"), F.lit("2024-01-01 00:00:00"), sequence=F.col("turn"))


def shown(journal: DataFrame) -> DataFrame:
    """A journal's columns as results: the body as text, the time without zone."""
    return journal.select("id", "sequence_id", "registry_key", codec.text_of(F.col("bytes")).alias("body"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def balance_mapper() -> Mapper:
    """A balance that errors reset to zero, and the number of events."""
    state = lambda b, n: F.struct(b.cast(MONEY).alias("balance"), n.cast("int").alias("events"))
    m = Mapper()
    for key in KEYS:
        if key == "error":
            fold = Fold(amount, lambda s, e: state(F.lit(0), s["events"] + 1), lambda e: state(F.lit(0), F.lit(1)))
        else:
            fold = Fold(amount, lambda s, e: state(s["balance"] + e, s["events"] + 1), lambda e: state(e, F.lit(1)))
        m.register(key, fold)
    return m


def balances(states: DataFrame) -> DataFrame:
    return states.select("id", F.col("state.balance").cast("double").alias("balance"), "state.events", "sequence")


def projector(spark: SparkSession, sf_dir: str) -> Projector:
    return Projector(at_rest(spark, sf_dir).rows(), balance_mapper(), STATE, by_id=True)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projector(spark, sf_dir).until(SNAP - 1).replay()


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events from the snapshot on, as commands."""
    j = at_rest(spark, sf_dir).rows().where(F.col("sequence_id") >= SNAP)
    return j.select("id", F.col("sequence_id").alias("arrival"), F.col("registry_key").alias("kind"), "bytes")


def rules() -> dict[str, Rule]:
    """Purchases up to 50 are accepted, clicks up to the balance; nothing else has a rule."""
    def small(state: Column, body: Column) -> Column:
        return F.when(amount(body) > 50, "too much")

    def covered(state: Column, body: Column) -> Column:
        return F.when(state.isNull(), "no account").when(amount(body) > state["balance"], "not covered")

    return {"purchase": Rule("purchased", lambda s, b: b, small), "click": Rule("clicked", lambda s, b: b, covered)}


def small_rules() -> dict[str, Rule]:
    return {k: Rule(f"{k}-done", lambda s, b: b, lambda s, b: F.when(amount(b) > 50, "too much")) for k in ("purchase", "click")}


class Counting(Behaviour):
    """Counts views as messages, accepts purchases, rejects the rest."""

    messages = ("view",)

    def decide(self, state, kind, body):
        return ("purchased", body) if kind == "purchase" else "not for sale"

    def evolve(self, state, key, body):
        return state or 0

    def receive(self, state, kind, body):
        return (state or 0) + 1


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

J = """j as (select cast(user_id as varchar) as id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as sequence_id, event_type as registry_key,
  '{"value":' || cast(cast(value as decimal(18,2)) as varchar) || ',"props":' || props || '}' as body,
  cast(value as decimal(18,2)) as amount, ts as created_at, event_id from events)"""
#: Balances over j's rows that meet a condition.
BALANCE = """(select id, cast(coalesce(sum(amount) filter (where sequence_id > reset), 0) as double) as balance,
  cast(count(*) as int) as events, count(*) as sequence
  from (select *, coalesce(max(sequence_id) filter (where registry_key = 'error') over (partition by id), -1) as reset from j where {where})
  group by id)"""


def query(sql: str, journal: bool = True):
    """Registers a query under its function's name with the SQL for its rows."""

    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = f"with {J} {sql}" if journal else sql
        return f

    return put


ALL = "select id, sequence_id, registry_key, body, created_at from j"


@query("select distinct cast(user_id as varchar) as id from events", False)
def entity_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(envelope.entity_id(F.col("user_id")).alias("id")).distinct()


@query(
    f"{ALL} union all select cast(conv_id as varchar), turn, role, text, timestamp '2024-01-01 00:00:00' from conversations"
)
def payload_new(spark, sf_dir):
    return shown(events_journal(spark, sf_dir).unionByName(conversations_journal(spark, sf_dir)))


@query(
    """select id, sequence_id, 'Payload#' || registry_key as label, '<' || octet_length(encode(body)) || ' bytes>' as size from j
    union all select cast(conv_id as varchar), turn, 'Payload#' || role, '<' || octet_length(encode(text)) || ' bytes>' from conversations"""
)
def payload_debug(spark, sf_dir):
    both = events_journal(spark, sf_dir).unionByName(conversations_journal(spark, sf_dir))
    return both.select("id", "sequence_id", envelope.payload_label().alias("label"), envelope.payload_size().alias("size"))


@query("select id, sequence_id, cast(json_extract_string(body, '$.props.k') as int) as k, cast(amount as double) as amount from j")
def payload_decode(spark, sf_dir):
    kind = EventType("any", codec.json_encode, codec.json_decode(f"value {MONEY}, props struct<k:int>"))
    rows = codec.decoded(events_journal(spark, sf_dir), kind)
    return rows.select("id", "sequence_id", "event.props.k", F.col("event.value").cast("double").alias("amount"))


@query(f"select id, sequence_id, cast(json_extract_string(body, '$.props.k') as int) as k from j where id = '{ONE}' and sequence_id = {FROM}")
def read_decoded(spark, sf_dir):
    kind = EventType("view", codec.json_encode, k_of)
    return at_rest(spark, sf_dir).read_event(ONE, FROM, kind).select("id", "sequence_id", F.col("event").alias("k"))


@query(
    """select distinct name, lower(ltrim(regexp_replace(name, '([A-Z])', '-\\1', 'g'), '-')) as key
    from (select upper(event_type[1]) || event_type[2:] || 'Event' as name from events union all select 'HTTPEvent')""",
    False,
)
def event_key_kebab(spark, sf_dir):
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    named = kinds.select(F.concat(F.initcap("event_type"), F.lit("Event")).alias("name")).union(spark.createDataFrame([("HTTPEvent",)], "name string"))
    return named.select("name", codec.kebab_case(F.col("name")).alias("key"))


@query(f"{ALL} where id = '{ONE}' and sequence_id = {FROM}")
def read_one(spark, sf_dir):
    return shown(at_rest(spark, sf_dir).read(ONE, FROM))


@query(f"{ALL} where id = '{ONE}' and sequence_id between {FROM} and {TO}")
def read_range(spark, sf_dir):
    return shown(at_rest(spark, sf_dir).read_to(ONE, FROM, TO))


@query(f"{ALL} where id = '{ONE}' and sequence_id >= {FROM}")
def read_to_latest(spark, sf_dir):
    return shown(at_rest(spark, sf_dir).read_to_latest(ONE, FROM))


@query("select id, sequence_id, row_number() over (order by sequence_id, created_at, id) as position from j")
def journal_order(spark, sf_dir):
    return ordering.with_total_position(at_rest(spark, sf_dir).rows()).select("id", "sequence_id", "position")


@query("select id, sequence_id, registry_key, row_number() over (partition by id order by sequence_id, created_at) - 1 as position from j")
def replay_order(spark, sf_dir):
    return ordering.with_replay_position(events_journal(spark, sf_dir)).select("id", "sequence_id", "registry_key", F.col("position").cast("long").alias("position"))


@query("")
def journal_dedup(spark, sf_dir):
    j = events_journal(spark, sf_dir)
    twin = j.where("sequence_id % 5 = 0").withColumn("bytes", F.concat(codec.text_of(F.col("bytes")), F.lit(" ")).cast("binary"))
    return shown(ordering.journal_dedup(j.unionByName(twin).unionByName(j.where("sequence_id % 7 = 0"))))


SQL["journal_dedup"] = f"""with {J}, both_rows as (
  select id, sequence_id, registry_key, body, created_at from j
  union all select id, sequence_id, registry_key, body || ' ', created_at from j where sequence_id % 5 = 0
  union all select id, sequence_id, registry_key, body, created_at from j where sequence_id % 7 = 0)
select id, sequence_id, registry_key, min(body) as body, created_at from both_rows group by id, sequence_id, registry_key, created_at"""


@query("")
def fixture_dedup(spark, sf_dir):
    """Retries a second later with the same body (left out), and one of another body between (all kept)."""
    j = events_journal(spark, sf_dir)
    later = lambda d, s: d.withColumn("created_at", F.col("created_at") + F.expr(f"interval {s} seconds"))
    retry, between = later(j.where("sequence_id % 3 = 0"), 2), later(j.where("sequence_id % 6 = 0"), 1)
    other = between.withColumn("bytes", F.concat(codec.text_of(F.col("bytes")), F.lit(" ")).cast("binary"))
    return shown(ordering.fixture_dedup(j.unionByName(retry).unionByName(other)))


SQL["fixture_dedup"] = f"""with {J}, rows as (
  select id, sequence_id, registry_key, body, created_at from j
  union all select id, sequence_id, registry_key, body, created_at + interval 2 second from j where sequence_id % 3 = 0
  union all select id, sequence_id, registry_key, body || ' ', created_at + interval 1 second from j where sequence_id % 6 = 0
), marked as (
  select *, lead(body) over w as following, lead(1) over w is null as is_last from rows window w as (partition by id, sequence_id order by created_at)
)
select id, sequence_id, registry_key, body, created_at from marked where is_last or following is distinct from body"""

#: Every event as a registration of its type, in order of event_id.
R = """r as (select event_type as event, case event_id % 3 when 0 then 'projection' when 1 then 'subscribe' else 'process-subscriber' end as kind,
  'handler' || event_id % 7 as handler, event_id as turn from events)"""
LAST = "last_one as (select event, kind, arg_max(handler, turn) as handler from r group by event, kind)"


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    kind = F.when(n % 3 == 0, "projection").when(n % 3 == 1, "subscribe").otherwise("process-subscriber")
    return e.select(F.col("event_type").alias("event"), kind.alias("kind"), F.concat(F.lit("handler"), n % 7).alias("handler"), n.alias("turn"))


@query(f"with {R} select event || '-' || kind as shown, handler, count(*) as n from r group by all", False)
def resolve_type_display(spark, sf_dir):
    r = registered(spark, sf_dir)
    return r.groupBy(envelope.resolve_type(F.col("event"), F.col("kind")).alias("shown"), "handler").agg(F.count("*").alias("n"))


@query(f"with {R}, {LAST} select * from last_one", False)
def mapper_last_wins(spark, sf_dir):
    return mapping.last_registered(registered(spark, sf_dir))


@query(f", {R}, {LAST} select id, sequence_id, registry_key, handler from j join last_one on event = registry_key and kind = 'projection'")
def mapper_find(spark, sf_dir):
    last = mapping.last_registered(registered(spark, sf_dir))
    return mapping.resolved(events_journal(spark, sf_dir), last, "projection").select("id", "sequence_id", "registry_key", "handler")


@query(f"with {R}, {LAST} select event, handler from last_one where kind = 'projection'", False)
def mapper_filter(spark, sf_dir):
    return mapping.of_kind(mapping.last_registered(registered(spark, sf_dir)), "projection")


FULL = f"select * from {BALANCE.format(where='true')}"


@query(FULL)
def replay_full(spark, sf_dir):
    return balances(projector(spark, sf_dir).replay())


@query(FULL)
def replay_from_snapshot(spark, sf_dir):
    return balances(projector(spark, sf_dir).replay(snapshot(spark, sf_dir), complete=True))


def composing(spark: SparkSession, sf_dir: str) -> Projector:
    """The same balances by changes that combine: an amount is added, an error resets."""
    m = Mapper()
    for key in KEYS:
        change = lambda e, key=key: F.when(e.isNotNull(), F.struct(F.struct(F.lit(key == "error").alias("reset"), (F.lit(0) if key == "error" else e).cast(MONEY).alias("add")).alias("balance"), F.lit(1).alias("events")))
        m.register(key, Change(amount, change))
    return Projector(at_rest(spark, sf_dir).rows(), m, STATE)


BALANCES = monoids.together(balance=monoids.resetting(MONEY), events=monoids.adding("int"))


@query(FULL)
def replay_composed(spark, sf_dir):
    return balances(composing(spark, sf_dir).replay_composed(BALANCES))


@query(FULL)
def replay_composed_from_snapshot(spark, sf_dir):
    return balances(composing(spark, sf_dir).replay_composed(BALANCES, snapshot(spark, sf_dir), complete=True))


@query("select id, cast(balance as double) as balance, sequence from " + BALANCE.format(where="true"))
def replay_python(spark, sf_dir):
    """The same fold in Python, in whole cents."""
    import json

    def step(state, key, body):
        return 0 if key == "error" else (state or 0) + round(json.loads(body)["value"] * 100)

    out = projector(spark, sf_dir).replay_python(step, "bigint")
    return out.select("id", (F.col("state") / 100).alias("balance"), "sequence")


@query(f"select * from {BALANCE.format(where='sequence_id < ' + str(SNAP))}")
def replay_until(spark, sf_dir):
    return balances(snapshot(spark, sf_dir))


@query("select id, arg_min(registry_key, sequence_id) as first_key, count(*) as sequence from j group by id")
def replay_first(spark, sf_dir):
    m = Mapper()
    for key in KEYS:
        m.register(key, Fold(amount, lambda s, e: s, lambda e, key=key: F.lit(key)))
    return Projector(at_rest(spark, sf_dir).rows(), m, "string", by_id=True).replay().select("id", F.col("state").alias("first_key"), "sequence")


@query(f"select id, {FROM} + count(*) filter (where sequence_id >= {FROM}) as sequence from j group by id")
def replay_sequence(spark, sf_dir):
    """From a snapshot that says where to begin: the counter goes on from there."""
    p = projector(spark, sf_dir)
    start = p.until(FROM - 1).replay().select("id", "state", F.lit(FROM).cast("long").alias("sequence"))
    return p.replay(start).select("id", "sequence")


@query("select registry_key, count(*) as n from j where registry_key not in ('purchase', 'view') group by registry_key")
def replay_unmapped(spark, sf_dir):
    return mapping.unmapped(events_journal(spark, sf_dir), ["purchase", "view"])


AT_SNAP = BALANCE.format(where=f"sequence_id < {SNAP}")


@query(
    f""", s as {AT_SNAP}
    select c.id, c.sequence_id as arrival, c.registry_key as kind,
      case when reason is null then case registry_key when 'purchase' then 'purchased' else 'clicked' end end as event_key, reason
    from (select j.*, case when registry_key = 'purchase' then case when amount > 50 then 'too much' end
        when registry_key = 'click' then case when s.id is null then 'no account' when amount > balance then 'not covered' end
        else 'no rule for this command' end as reason
      from j left join s on s.id = j.id where j.sequence_id >= {SNAP}) c"""
)
def command_handle(spark, sf_dir):
    decided = process.handle(commands(spark, sf_dir), snapshot(spark, sf_dir), rules())
    return decided.select("id", "arrival", "kind", "event_key", "reason")


@query(
    f"select id, sequence_id as arrival, registry_key as event_key, {SNAP} + row_number() over (partition by id order by sequence_id) - 1 as sequence_id from j where sequence_id >= {SNAP}"
)
def apply_sequence(spark, sf_dir):
    made = commands(spark, sf_dir).select("id", "arrival", F.col("kind").alias("event_key"), F.col("bytes").alias("event_bytes"))
    return process.sequenced(made, snapshot(spark, sf_dir)).select("id", "arrival", "event_key", "sequence_id")


DONE = f"""(select id, sequence_id as arrival, registry_key || '-done' as event_key, body, created_at,
  {SNAP} + row_number() over (partition by id order by sequence_id) - 1 as sequence_id
  from j where sequence_id >= {SNAP} and registry_key in ('purchase', 'click') and amount <= 50)"""


@query(
    f"""select id, arrival, event_key, sequence_id, null as reason from {DONE}
    union all select id, sequence_id, null, null, case when registry_key in ('purchase', 'click') then 'too much' else 'no rule for this command' end
    from j where sequence_id >= {SNAP} and not (registry_key in ('purchase', 'click') and amount <= 50)"""
)
def entrust(spark, sf_dir):
    events, rejected = process.entrust_rules(commands(spark, sf_dir), snapshot(spark, sf_dir), small_rules())
    out = events.select("id", "arrival", "event_key", "sequence_id", F.lit(None).cast("string").alias("reason"))
    none = F.lit(None)
    return out.unionByName(rejected.select("id", "arrival", none.cast("string").alias("event_key"), none.cast("long").alias("sequence_id"), "reason"))


class Covered(Behaviour):
    """Purchases and clicks take from the balance what it covers, all else adds to it; in cents."""

    def _cents(self, body) -> int:
        import json

        return round(json.loads(body)["value"] * 100)

    def decide(self, state, kind, body):
        takes = kind in ("purchase", "click")
        if takes and self._cents(body) > (state or 0):
            return "not covered"
        return "taken" if takes else "added", body

    def evolve(self, state, key, body):
        return (state or 0) + (-1 if key == "taken" else 1) * self._cents(body)


@query("")
def entrust_stateful(spark, sf_dir):
    """Every event as a command, judged by the balance that the commands before it have left."""
    j = at_rest(spark, sf_dir).rows()
    sent = j.select("id", F.col("sequence_id").alias("arrival"), F.col("registry_key").alias("kind"), "bytes")
    none = spark.createDataFrame([], "id string, state bigint, sequence bigint")
    out = process.entrust(sent, none, Covered(), "bigint")
    return out.select("id", "what", "arrival", "kind", "event_key", "sequence_id", "reason", "sequence", F.col("state").alias("balance"))


SQL["entrust_stateful"] = f"""with recursive {J}, c as (
  select id, sequence_id, registry_key as kind, cast(amount * 100 as bigint) as cents, registry_key in ('purchase', 'click') as takes from j
), run as (
  select id, cast(-1 as bigint) as arrival, cast(null as varchar) as kind, false as takes, false as ok, cast(0 as bigint) as balance, cast(0 as bigint) as sequence from c where sequence_id = 0
  union all
  select c.id, c.sequence_id, c.kind, c.takes, not c.takes or cents <= balance,
    balance + case when not c.takes then cents when cents <= balance then -cents else 0 end, sequence + case when not c.takes or cents <= balance then 1 else 0 end
  from run join c on c.id = run.id and c.sequence_id = run.arrival + 1
)
select id, case when ok then 'event' else 'rejection' end as what, arrival, kind, case when ok then case when takes then 'taken' else 'added' end end as event_key,
  case when ok then sequence - 1 end as sequence_id, case when not ok then 'not covered' end as reason, null as sequence, null as balance
from run where arrival >= 0
union all
select id, 'state', null, null, null, null, null, sequence, balance from (select *, row_number() over (partition by id order by arrival desc) as back from run) where back = 1"""


class Stopping(Covered):
    """Every command but poison and spawn is accepted."""

    def decide(self, state, kind, body):
        return kind, body

    def evolve(self, state, key, body):
        return (state or 0) + self._cents(body)


@query("")
def process_status(spark, sf_dir):
    """Two batches of commands: errors are poison, signups spawn. What the first batch stops, the second finds stopped."""
    j = at_rest(spark, sf_dir).rows()
    kind = F.when(F.col("registry_key") == "error", process.POISON).when(F.col("registry_key") == "signup", process.SPAWN).otherwise(F.col("registry_key"))
    sent = j.select("id", F.col("sequence_id").alias("arrival"), kind.alias("kind"), "bytes")
    kept = Processes(spark, scratch(spark, "processes"), Stopping(), "bigint")
    parts = [kept.run(sent.where(F.col("arrival") < SNAP), 0), kept.run(sent.where(F.col("arrival") >= SNAP), 1)]
    out = ["id", "what", "arrival", "kind", "sequence_id", "reason", "sequence", "active", F.col("state").alias("cents")]
    made = [rows.select(F.lit(n).alias("batch"), *out) for n, rows in enumerate(parts)]
    last = kept.states().withColumns({c: F.lit(None).cast(k) for c, k in (("arrival", "long"), ("kind", "string"), ("sequence_id", "long"), ("reason", "string"))})
    return made[0].unionByName(made[1]).unionByName(last.select(F.lit(2).alias("batch"), "id", F.lit("last").alias("what"), *out[2:]))


SQL["process_status"] = f"""with {J}, c as (
  select id, sequence_id as arrival, case registry_key when 'error' then 'poison' when 'signup' then 'spawn' else registry_key end as kind,
    cast(amount * 100 as bigint) as cents, sequence_id >= {SNAP} as later from j
), seen as (
  select *, coalesce(last_value(case when kind in ('poison', 'spawn') then kind end ignore nulls) over (partition by id order by arrival rows between unbounded preceding and 1 preceding), 'spawn') = 'spawn' as active from c
), taken as (
  select *, active and kind not in ('poison', 'spawn') as ok from seen
), counted as (
  select *, cast(coalesce(sum(case when ok then 1 else 0 end) over (partition by id order by arrival), 0) as bigint) as n,
    cast(sum(case when ok then cents end) over (partition by id order by arrival) as bigint) as total from taken
), ends as (
  select id, later, arg_max(n, arrival) as n, arg_max(coalesce(total, -1), arrival) as total, arg_max(case when kind = 'poison' then false when kind = 'spawn' then true else active end, arrival) as active
  from counted group by id, later
), states as (
  select id, later, n, case when total >= 0 then total end as total, active from ends
)
select cast(later as int) as batch, id, case when ok then 'event' else 'rejection' end as what, arrival, kind, case when ok then n - 1 end as sequence_id,
  case when ok then null when active then 'running already' else 'stopped' end as reason, null as sequence, null as active, null as cents
from counted where ok or (active and kind = 'spawn') or (not active and kind <> 'spawn')
union all
select cast(later as int), id, case when active then 'state' else 'stopped' end, null, null, null, null, n, active, total from states
union all
select 2, id, 'last', null, null, null, null, arg_max(n, later), arg_max(active, later), max(total) from states group by id"""


@query(
    """select id, coalesce(count(*) filter (where registry_key = 'view'), 0) as views, count(*) filter (where registry_key = 'purchase') as sequence
    from j group by id"""
)
def message_receive(spark, sf_dir):
    """All events as commands for entities in Python: messages move no sequence."""
    j = at_rest(spark, sf_dir).rows()
    sent = j.select("id", F.col("sequence_id").alias("arrival"), F.col("registry_key").alias("kind"), "bytes")
    none = spark.createDataFrame([], "id string, state bigint, sequence bigint")
    out = process.entrust(sent, none, Counting(), "bigint").where("what = 'state'")
    return out.select("id", F.coalesce("state", F.lit(0)).alias("views"), "sequence")


@query(f"select id, sequence_id, event_key as registry_key, body, timestamp '2024-02-01 00:00:00' as created_at from {DONE}")
def process_journal(spark, sf_dir):
    events, _ = process.entrust_rules(commands(spark, sf_dir), snapshot(spark, sf_dir), small_rules())
    return shown(process.to_journal(events, F.lit("2024-02-01 00:00:00")))


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a purchase run as accounts, the others with an even id as visitors."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = e.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max(F.col("event_type") == "purchase").alias("bought"), (F.count("*")).alias("sequence"))
    named = kinds.withColumn("process_type", F.when(F.col("bought"), "account").otherwise("visitor"))
    return named.where("bought or cast(id as int) % 2 = 0").select("id", "process_type", "sequence")


RUNNING = """run as (select id, case when bought then 'account' else 'visitor' end as process_type from
  (select cast(user_id as varchar) as id, bool_or(event_type = 'purchase') as bought, user_id from events group by user_id) where bought or user_id % 2 = 0)"""


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").cast("string").alias("id")).distinct().withColumn("process_type", F.when(F.col("id").cast("int") % 3 == 0, "visitor").otherwise("account"))


WANTED = "want as (select distinct cast(conv_id as varchar) as id, case when conv_id % 3 = 0 then 'visitor' else 'account' end as process_type from conversations)"


@query(f"with {RUNNING}, {WANTED} select id from want where id in (select id from run)", False)
def spawn_conflicts(spark, sf_dir):
    return process.conflicts(running(spark, sf_dir), wanted(spark, sf_dir))


@query(
    f"""with {RUNNING}, {WANTED} select want.id, want.process_type,
    case when run.id is null then 'missing' when run.process_type = want.process_type then 'found' else 'other type' end as status
    from want left join run on run.id = want.id""",
    False,
)
def registry_find(spark, sf_dir):
    return process.found(running(spark, sf_dir), wanted(spark, sf_dir))


@query(
    """select id, sequence_id, registry_key from (
      select *, sum(late) over (partition by id order by sequence_id) as gaps from (
        select *, case when created_at > lag(created_at) over (partition by id order by sequence_id) + interval 24 hour then 1 else 0 end as late from j)) where gaps = 0"""
)
def idle_timeout(spark, sf_dir):
    return process.idle_cutoff(events_journal(spark, sf_dir), "24 hours", ["sequence_id"]).select("id", "sequence_id", "registry_key")


def streamed(spark: SparkSession, sf_dir: str, name: str, run: Callable[[str], DataFrame], mode: str = "append") -> DataFrame:
    """All rows that a stream puts out until it has taken what is there. A store of state is opened for each partition, so there are two for each core at most."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STATE_STORE)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), 2 * spark.sparkContext.defaultParallelism)))
    try:
        folder = scratch(spark, name)
        rows = run(folder)
        out = BatchLog(spark, f"{folder}/out", rows.schema)
        query = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, n: out.append(batch, n) and None).option("checkpointLocation", f"{folder}/progress")
        query.trigger(availableNow=True).start().awaitTermination()
        return out.rows().select(*rows.columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


@query(SQL["idle_timeout"], False)
def stream_idle_timeout(spark, sf_dir):
    """The same by a stream of commands with the events' own times: a backlog that is played again is cut at the same gaps."""

    def run(folder: str) -> DataFrame:
        events = EventStream(spark, f"{folder}/events", f"{folder}/subscribers")
        events.publish(events_journal(spark, sf_dir))
        sent = events.source().select("id", F.col("sequence_id").alias("arrival"), F.col("registry_key").alias("kind"), "bytes", "created_at")
        return stateful.process(sent, Stopping(), "bigint", timeout=24 * 3_600_000, delay="0 seconds")

    out = streamed(spark, sf_dir, "idle", run).where("what = 'event'")
    return out.select("id", F.col("arrival").alias("sequence_id"), F.col("kind").alias("registry_key"))


@query(f"{ALL} where registry_key in ('purchase', 'signup')")
def stream_once_each(spark, sf_dir):
    """Every event is published twice, the second time a minute later; a subscriber gets it once."""
    m = Mapper()
    for key in ("purchase", "signup"):
        m.register(key, Callback(amount, print))

    def run(folder: str) -> DataFrame:
        events, j = EventStream(spark, f"{folder}/events", f"{folder}/subscribers"), events_journal(spark, sf_dir)
        events.publish(j)
        events.publish(j.withColumn("created_at", F.col("created_at") + F.expr("interval 1 minute")))
        return once_each(subscribed(events.source(), m), "3650 days")

    # Which of the two comes first in a micro-batch is open, so the time is the original's in the result.
    out = streamed(spark, sf_dir, "once", run)
    return shown(out.drop("created_at").join(events_journal(spark, sf_dir).select("id", "sequence_id", "created_at"), ["id", "sequence_id"]))


@query("select id, cast(balance as double) as balance, sequence from " + BALANCE.format(where="true"))
def stream_from_snapshot(spark, sf_dir):
    """A stream that begins at the states of a batch replay and folds what came since."""
    import json

    def step(state, key, body):
        return 0 if key == "error" else (state or 0) + round(json.loads(body)["value"] * 100)

    begun = kept(projector(spark, sf_dir).until(SNAP - 1).replay_python(step, "bigint"))

    def run(folder: str) -> DataFrame:
        events = EventStream(spark, f"{folder}/events", f"{folder}/subscribers")
        events.publish(at_rest(spark, sf_dir).rows().where(F.col("sequence_id") >= SNAP))
        return stateful.replay(events.source(), step, "bigint", initial=begun)

    out = streamed(spark, sf_dir, "snapshot", run, "update").unionByName(begun)
    last = out.groupBy("id").agg(F.max_by("state", "sequence").alias("state"), F.max("sequence").alias("sequence"))
    return last.select("id", (F.col("state") / 100).alias("balance"), "sequence")


@query("")
def react_once(spark, sf_dir):
    """Reactions of a stream to what is published in two batches, each published twice under its number."""
    body = lambda k: F.when(k % 7 != 0, F.concat(F.lit("k="), k.cast("string")))
    m = Mapper()
    for event, command in (("purchase", "ship"), ("signup", "welcome")):
        m.register(event, Reaction(k_of, lambda k: (k % 10).cast("string"), command, body))
    folder, j = scratch(spark, "reactions"), events_journal(spark, sf_dir)
    events = EventStream(spark, f"{folder}/events", f"{folder}/subscribers")
    for n, part in ((0, j.where(F.col("sequence_id") < SNAP)), (1, j.where(F.col("sequence_id") >= SNAP))):
        for _ in range(2):
            events.publish(part, number=n, publisher="shop")
    events.react("reactions", m, f"{folder}/commands", since=BEGINNING, once=True).awaitTermination()
    out = events.commands(f"{folder}/commands").rows()
    return out.select("id", "kind", codec.text_of(F.col("bytes")).alias("body"), "sequence_id", "registry_key")


@query(
    """select id, sequence_id, registry_key from (
      select *, coalesce(sum(case when registry_key = 'error' then 1 else 0 end) over (partition by id order by sequence_id rows between unbounded preceding and 1 preceding), 0) as poisoned from j) where poisoned = 0"""
)
def poison_cutoff(spark, sf_dir):
    j = events_journal(spark, sf_dir)
    return process.poison_cutoff(j, F.col("registry_key") == "error", ["sequence_id"]).select("id", "sequence_id", "registry_key")


@query(f"{ALL} where registry_key in ('purchase', 'signup')")
def subscribe_filter(spark, sf_dir):
    m = Mapper()
    for key in ("purchase", "signup"):
        m.register(key, Callback(amount, print))
    return shown(subscribed(events_journal(spark, sf_dir), m))


SUBSCRIBED = [("mail", "purchase", "2024-01-10 00:00:00"), ("mail", "signup", "2024-01-10 00:00:00"), ("audit", "error", "2024-01-20 00:00:00"), ("audit", "purchase", "2024-01-01 00:00:00")]
SUBS = "s(subscriber, registry_key, subscribed_at) as (values " + ", ".join(f"('{a}', '{b}', timestamp '{c}')" for a, b, c in SUBSCRIBED) + ")"


def subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIBED, "subscriber string, registry_key string, subscribed_at string").withColumn("subscribed_at", F.to_timestamp("subscribed_at"))


@query(f", {SUBS} select subscriber, id, sequence_id, j.registry_key from j join s on s.registry_key = j.registry_key and created_at >= subscribed_at")
def subscribe_late(spark, sf_dir):
    return fanned_out(events_journal(spark, sf_dir), subscriptions(spark))


@query(f", {SUBS} select subscriber, id, sequence_id, j.registry_key from j join s on s.registry_key = j.registry_key")
def fanout(spark, sf_dir):
    return fanned_out(events_journal(spark, sf_dir), subscriptions(spark).drop("subscribed_at"))


@query("select id || '#' || registry_key as trace, count(*) as n from j group by all")
def stream_trace(spark, sf_dir):
    return events_journal(spark, sf_dir).groupBy(envelope.stream_trace().alias("trace")).agg(F.count("*").alias("n"))


@query(
    """select cast(k % 10 as varchar) as id, kind, case when k % 7 <> 0 then 'k=' || k end as body, sequence_id, registry_key from (
      select *, cast(json_extract_string(body, '$.props.k') as int) as k, case registry_key when 'purchase' then 'ship' else 'welcome' end as kind from j where registry_key in ('purchase', 'signup'))"""
)
def event_to_command(spark, sf_dir):
    """Purchases and signups become commands for another entity, but for those whose k is a multiple of 7."""
    body = lambda k: F.when(k % 7 != 0, F.concat(F.lit("k="), k.cast("string")))
    made = {e: Reaction(k_of, lambda k: (k % 10).cast("string"), c, body) for e, c in (("purchase", "ship"), ("signup", "welcome"))}
    out = reacted(events_journal(spark, sf_dir), made)
    return out.select("id", "kind", codec.text_of(F.col("bytes")).alias("body"), "sequence_id", "registry_key")


SQL["react_once"] = f"select * from ({SQL['event_to_command']}) where body is not null"


GAPPY = "sequence_id % 5 <> 4 and sequence_id % 11 not in (2, 3)"


@query(f"select id, sequence_id as after, following - sequence_id - 1 as missing from (select id, sequence_id, lead(sequence_id) over (partition by id order by sequence_id) as following from j where {GAPPY}) where following - sequence_id > 1")
def audit_gaps(spark, sf_dir):
    return audit.gaps(events_journal(spark, sf_dir).where(GAPPY))


@query("select id, sequence_id, count(*) as n from (select id, sequence_id from j union all select id, sequence_id from j where sequence_id % 4 = 0) group by id, sequence_id having count(*) > 1")
def audit_duplicates(spark, sf_dir):
    j = events_journal(spark, sf_dir)
    return audit.duplicates(j.unionByName(j.where("sequence_id % 4 = 0")))


@query(f"select id, count(*) as sequence, max(sequence_id) + 1 as expected from j where {GAPPY} group by id having count(*) <> max(sequence_id) + 1")
def audit_drift(spark, sf_dir):
    j = at_rest(spark, sf_dir).rows().where(GAPPY)
    return audit.drift(j, Projector(j, balance_mapper(), STATE, by_id=True).replay())
