"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

Every source has a target: its share, by weight, of a budget of ``SHARE`` times all words; no target
exceeds ``EPOCHS`` times the source's words, and what is cut off there is shared anew by weight among the
others until none is above (the fixed point is found in one pass over the sources in order of words a
weight). The documents of a source are shuffled by a hash of their id. A document's virtual finish time
is the cumulative words of its source up to it, divided by the source's target; the second epoch follows the
first. The mix takes documents in order of finish time until the next would exceed the budget.

Cumulative words come from sums of (source, hash range) buckets and a window within each, so a hot
source spreads over all buckets. The global order is a range partition by finish time: sums of equal stretches of
time tell the stretch in which the budget ends, and only that is sorted, over all partitions, with sums of partitions
carried over. Orders over all sources are made the same way, so there may be as many as there are hosts. The first document that
does not fit is the cut; everything before it is taken. In one source and epoch that is all before some place in its shuffled order, so
a table of these places, a row a source, tells of any document how often it is taken, and texts aren't shuffled.

Edge cases: a null text has size 0; a null source is a source of its own and comes last; documents of
size 0 take part and take no words; a source without words has target 0; a null id is shuffled as the
empty text; repeated rows are documents of their own; ties are broken by source, hash, id and size; an
empty table gives an empty table; only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SHARE, EPOCHS, WEIGHTS, SEED = 1.5, 2, (3, 1, 2), "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Stretches of virtual finish time in one unit of it, the time from which all is one (targets are reached at 1), and hex digits of the hash that make a bucket.
RANGES, LATE, DIGITS = 4096, 2, 3
#: Sources in a broadcast table, about 200 bytes each.
BROADCAST_SOURCES = 50_000


def running_totals(df: DataFrame, order: list[str], **values: str) -> DataFrame:
    """Adds, under the given names, the sums of columns over all rows before a row in a total order.

    Rows are range-partitioned by the order; sums of partitions, a row each, are carried over to the partitions behind.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("tidemark_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("tidemark_part").agg(*(F.sum(c).alias(f"tidemark_{name}") for name, c in values.items()))
    earlier = W.orderBy("tidemark_part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("tidemark_part", *(F.coalesce(F.sum(f"tidemark_{name}").over(earlier), F.lit(0)).alias(f"tidemark_{name}") for name in values))
    within = W.partitionBy("tidemark_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(F.broadcast(carried), "tidemark_part").select(
        *df.columns, *((F.col(f"tidemark_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in values.items())
    )


def sized_columns(id_col: str, text_col: str, source_col: str) -> list[Column]:
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.xxhash64(text_col).alias("h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.substring(key, 1, DIGITS).alias("bucket"),
    ]


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, no_source, source (null: empty), h (text hash), size, key (shuffle order), bucket."""
    return docs.select(*sized_columns(id_col, text_col, source_col))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds weight and target to (no_source, source, source_size); one row a source."""
    ranked = running_totals(by_source.withColumn("one", F.lit(1).cast("long")), ["no_source", "source"], rank="one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    caps = ranked.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    tried = stored(running_totals(caps, ["fill", "rank"], cap_before="cap", weight_before="weight"), "levels")
    words, all_weights = tried.agg(F.sum("source_size"), F.sum("weight")).first()
    # Sources fill up in order of fill; from the first that the level leaves below its cap on, all are at that level.
    level = (F.lit(float(words or 0)) * share - F.col("cap_before")) / (F.lit(all_weights or 0) - F.col("weight_before"))
    fit = tried.withColumn("level", level).where(F.col("cap") > F.col("weight") * F.col("level"))
    first = fit.agg(F.min(F.struct("fill", "rank", "level")).alias("at")).select("at.*").first()
    if first["fill"] is None:
        return tried.select("no_source", "source", "source_size", F.col("cap").cast("double").alias("target"))
    free = F.struct("fill", "rank") >= F.struct(F.lit(first["fill"]).alias("fill"), F.lit(first["rank"]).alias("rank"))
    target = F.when(free, F.col("weight") * F.lit(first["level"])).otherwise(F.col("cap").cast("double"))
    return tried.select("no_source", "source", "source_size", target.alias("target"))


ORDER = ["no_source", "source", "key", "doc_id", "size", "h"]


def finish_times(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds source_size, target and finish, an array of the virtual finish times by epoch."""
    per_bucket = sized.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    per_bucket = per_bucket.withColumn("before", F.coalesce(before, F.lit(0))).join(by_source, ["no_source", "source"])
    within = W.partitionBy("no_source", "source", "bucket").orderBy("key", "doc_id", "size", "h").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.join(per_bucket, ["no_source", "source", "bucket"]).withColumn("cum", F.col("before") + F.sum("size").over(within))
    finish = lambda epoch: F.when(F.col("target") > 0, (F.col("source_size") * epoch + F.col("cum")) / F.col("target")).otherwise(F.lit(0.0))
    return placed.select(*ORDER, "source_size", "target", F.array(*map(finish, range(EPOCHS))).alias("finish"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ORDER, source_size, target, epochs (times that the mix takes the document)."""
    sized = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    by_source = stored(targets(sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))), "targets")
    placed = stored(finish_times(sized, by_source), "placed")
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    budget = total * SHARE

    entries = placed.select(*ORDER, F.explode("finish").alias("time")).where("size > 0")
    entries = entries.withColumn("range", F.floor(F.least("time", F.lit(float(LATE))) * RANGES))
    sums = running_totals(entries.groupBy("range").agg(F.sum("size").alias("words")), ["range"], before="words")
    end = sums.where(F.col("before") + F.col("words") > budget).orderBy("range").first()
    if end is None:
        taken = F.size("finish")
    else:
        order = ["time", *ORDER]
        inside = running_totals(entries.where(F.col("range") == end["range"]), order, before="size")
        cut = inside.where(F.lit(end["before"]) + F.col("before") + F.col("size") > budget).orderBy(*order).select(*order).first()
        kinds = {f.name: f.dataType for f in inside.schema}
        limit = F.struct(*(F.lit(cut[c]).cast(kinds[c]).alias(c) for c in order))
        earlier = lambda t: F.struct(t.alias("time"), *map(F.col, ORDER)) < limit
        taken = F.size(F.filter("finish", earlier))
    return placed.select(*ORDER, "source_size", "target", taken.cast("long").alias("epochs"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the document)."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them; rows equal in id and text are taken as often as the least of them."""
    place = ["key", "doc_id", "size", "h"]
    epochs = range(EPOCHS)
    left_out = [F.min(F.when(F.col("epochs") <= e, F.struct(*place))).alias(f"tidemark_cut{e}") for e in epochs]
    cuts = mix(docs, id_col, text_col, source_col).groupBy("no_source", "source").agg(*left_out)
    cuts = stored(cuts.withColumnsRenamed({c: f"tidemark_{c}" for c in ("no_source", "source")}), "cuts")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    columns = dict(zip(("doc_id", "no_source", "source", "h", "size", "key"), sized_columns(id_col, text_col, source_col)))
    joined = docs.join(cuts, (columns["no_source"] == F.col("tidemark_no_source")) & (columns["source"] == F.col("tidemark_source")))
    before = lambda e: F.col(f"tidemark_cut{e}").isNull() | (F.struct(*(columns[c].alias(c) for c in place)) < F.col(f"tidemark_cut{e}"))
    often = sum((before(e).cast("int") for e in epochs), F.lit(0))
    repeated = joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), often)).alias("tidemark_copy"))
    return repeated.select(*docs.columns)


SQL = rf"""
with sized as (
  select doc_id, source is null as no_source, coalesce(source, '') as source,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '')) as key
  from documents
), by_source as (
  select no_source, source, sum(size)::bigint as source_size,
         row_number() over (order by no_source, source) as rank
  from sized group by no_source, source
), caps as (
  select *, {list(WEIGHTS)}[((rank - 1) % {len(WEIGHTS)} + 1)::int] as weight, {EPOCHS} * source_size as cap from by_source
), tried as (
  select *, row_number() over o as turn,
         (sum(source_size) over ()::double * {SHARE} - coalesce(sum(cap) over b, 0))
         / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
  from caps
  window o as (order by cap / weight, rank), b as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)
), opened as (
  select *, min(case when cap > weight * level then turn end) over () as open_at from tried
), target as (
  select no_source, source, source_size,
         case when turn >= open_at then weight * max(case when turn = open_at then level end) over () else cap::double end as target
  from opened
), placed as (
  select s.*, t.source_size, t.target,
         sum(size) over (partition by no_source, source order by key, doc_id nulls first, size rows unbounded preceding)::bigint as cum
  from sized s join target t using (no_source, source)
), entry as (
  select *, case when target > 0 then (source_size * epoch + cum) / target else 0 end as time
  from placed, (values (0), (1)) e(epoch)
), run as (
  select *, sum(size) over (order by time, no_source, source, key, doc_id nulls first, size rows unbounded preceding) as through
  from entry
)
select doc_id, size, source_size, target,
       (size * count(*) filter (where through <= (select sum(size)::double * {SHARE} from sized)))::bigint as taken
from run group by doc_id, size, source_size, target, no_source, source, key, cum
"""
