"""Divergence of sources within a language: which sources differ most, and by which terms.

Terms are runs of letters (ASCII, or any character beyond), A-Z lower-cased; a language keeps the terms that stand in at least ``LEAST`` of its
documents. A group (language and source) gives a kept term the whole-number share p = 1 + floor(10^9 (count + 1) / (N + V)); so does the
language as a whole. A term's part in the divergence of shares p from q is floor((p - q)^2 / q) where p and q are shares of two sources, or of a source and
its language.

Method: deduplicated count columns. Tasks count terms of many documents before anything is shuffled. A term's counts by source are a sparse
vector; terms of a language with the same vector have the same part in every pair, so terms are grouped by vector, each pair of sources is
evaluated once for each distinct vector, and the result is multiplied by the number of its terms. Of a pair, only cells where a vector is
not zero are computed, against the part of a term that neither source has, which all V terms have at first. For the rank of
terms a vector keeps its ``RANKS`` least terms: others of the same value can't be among the first. All numbers are whole numbers.

Sizes: a task holds the groups' totals and a matrix of pairs of at most ``CELLS`` cells: languages with more pairs are evaluated by blocks of rows
of the matrix. More than ``GROUPS`` groups raise ValueError, as their pairs could not be returned.

Edge cases: null text, language or source counts as the empty one; an empty text makes its group occur; a language without kept terms has
pairs of value 0 and no terms; a language with one source has no pairs; repeated rows count as often as they stand there; texts of
any length are read whole, in steps; extra columns are not read; an empty table has no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

#: Fixed value: what a term is.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, RANKS, UNIT = 3, 200, 10**9
#: Groups of language and source that are sent to executors, some 200 bytes each.
GROUPS = 300_000
#: Entries of a task's table of counts, some 150 bytes each; cells of a task's matrix; entries of vectors that are evaluated at once.
HELD, CELLS, AT_ONCE = 1_000_000, 4_000_000, 4_096
#: Characters of a text that are read at a time, up to the end of a term.
STEP = 1 << 20
#: Each byte as it counts: capitals lowered, what is no part of a term as a space, bytes of other characters as they are.
COUNTS_AS = bytes(b if b > 0x7F or chr(b) in ascii_lowercase else b + 32 if chr(b) in ascii_uppercase else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time. A long text is cut where no term goes on."""
    text, at = text.translate(COUNTS_AS), 0
    while at < len(text):
        end = text.find(b" ", at + STEP)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, added up in each task as far as its table holds them."""
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, found) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 10_000):
                    part = terms[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array([t.decode() for t in part]), pa.array([n[t] for t in part]), pa.array([found[t] for t in part])], schema=kinds)
            held.clear()

        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                own: Counter = Counter()
                for some in terms_of(text):
                    own.update(some)
                n, found = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                found.update(own.keys())
                size += len(n) - before
                if size >= HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return own.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, vector: the counts of each kept term by source, sources ascending."""
    # One partitioning by language and term serves both sums.
    found = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.struct("source", "n")
    by_term = found.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("vector"), F.sum("docs").alias("docs"))
    return stored(by_term.where(F.col("docs") >= least).select("lang", "term", "vector"), "kept-terms")


def distinct_vectors(kept: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, vector, m (its terms) and terms, the least of them."""
    m = kept.groupBy("lang", "vector").agg(F.count("*").alias("m"))
    rank = F.row_number().over(W.partitionBy("lang", "vector").orderBy("term"))
    least = kept.withColumn("rank", rank).where(F.col("rank") <= ranks).groupBy("lang", "vector").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return stored(m.join(least, ["lang", "vector"]), "vectors")


def totals(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, source, v, n, all_n: every group that occurs, with its language's kept terms, its occurrences and those of its language."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    v = vectors.groupBy("lang").agg(F.sum("m").alias("v"))
    entries = vectors.select("lang", "m", F.explode("vector").alias("e"))
    n = entries.groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.n") * F.col("m")).alias("n"))
    all_n = n.groupBy("lang").agg(F.sum("n").alias("all_n"))
    zero = F.lit(0).cast("long")
    joined = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").join(all_n, "lang", "left")
    return stored(joined.select("lang", "source", *(F.coalesce(F.col(c), zero).alias(c) for c in ("v", "n", "all_n"))), "groups")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exact for counts of any size."""
    over = (count + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", over, n.cast("decimal(19,0)") + v.cast("decimal(19,0)"))


def part_of(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square fits a long, since shares are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def evaluated(vectors: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """lang, source, item, value: for each pair of sources of a language, the sum over its kept terms."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("k"))
    most = sizes.agg(F.max("k")).first()[0] or 0
    rows = max(1, min(most, cells // max(1, most)))  # of the matrix that a task holds
    blocks = -(-most // rows) if most else 1
    named = Groups(groups)
    lent = vectors.select("lang", "vector", "m")
    dealt = lent.withColumn("block", F.lit(0)) if blocks == 1 else lent.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def evaluate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, block), matrix in sums.items():
                names = named.of(lang).names
                for i, row in enumerate(matrix):
                    here = block * rows + i
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([names[here]] * len(names)), pa.array(names), pa.array(row)], schema=kinds)
            sums.clear()

        for batch in slices(batches, AT_ONCE):
            by_part: dict[tuple[str, int], list[tuple]] = {}
            for lang, vector, m, block in zip(*(c.to_pylist() for c in batch.columns)):
                by_part.setdefault((lang, block), []).append((vector, m))
            for (lang, block), some in by_part.items():
                own = named.of(lang)
                first, last = block * rows, min(len(own.names), (block + 1) * rows)
                if first >= last:
                    continue
                if (lang, block) not in sums:
                    if sum(x.size for x in sums.values()) + (last - first) * len(own.names) > cells and sums:
                        yield from flushed()
                    sums[lang, block] = np.zeros((last - first, len(own.names)), np.int64)
                own.add(sums[lang, block], some, first, last)
        yield from flushed()

    partial = dealt.mapInArrow(evaluate, "lang string, source string, item string, value bigint")

    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, source in ((r["lang"], r["source"]) for b in batches for r in b.to_pylist()):
            own = named.of(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own.names)), pa.array([source] * len(own.names)), pa.array(own.names), pa.array(own.plain(own.at[source]) * own.v)], schema=kinds)

    result = "lang string, source string, item string, value bigint"
    partial = dealt.mapInArrow(evaluate, result).unionByName(groups.select("lang", "source").mapInArrow(plain, result))
    return partial.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


class Language:
    """A language's sources with what their shares need."""

    def __init__(self, names: list[str], n: list[int], v: int):
        self.names, self.at, self.v = names, {s: i for i, s in enumerate(names)}, v
        self.under = [x + v for x in n]
        self.p0 = np.array([1 + UNIT // max(1, u) for u in self.under], np.int64)

    def plain(self, i: int, of: slice = slice(None)) -> np.ndarray:
        """The part of a term that neither source has, of a source from each."""
        return (self.p0[i] - self.p0[of]) ** 2 // self.p0[of]

    def add(self, sums: np.ndarray, vectors: list[tuple], first: int, last: int) -> None:
        """Adds to rows first to last of the matrix, for each vector and as often as it has terms, what differs from a term without occurrences."""
        for some in (vectors[i : i + self._at_once()] for i in range(0, len(vectors), self._at_once())):
            at, of, p = [], [], np.repeat(self.p0[None, :], len(some), 0)
            for k, (vector, _) in enumerate(some):
                for e in vector:
                    i = self.at[e["source"]]
                    p[k, i] = 1 + UNIT * (e["n"] + 1) // self.under[i]
                    of.append(k)
                    at.append(i)
            of, at = np.array(of), np.array(at)
            m = np.array([x for _, x in some], np.int64)
            zero = np.ones(p.shape, bool)
            zero[of, at] = False
            for i in np.unique(at):
                mine = of[at == i]
                q, weight = p[mine], m[mine]
                if first <= i < last:  # the row of a source that has the term, against all
                    own = q[:, i : i + 1]
                    sums[i - first] += (((own - q) ** 2 // q - self.plain(i)) * weight[:, None]).sum(0)
                rows = p[mine, first:last]  # the column of that source, against those without the term
                under = q[:, i : i + 1]
                plain = (self.p0[first:last] - self.p0[i]) ** 2 // self.p0[i]
                sums[:, i] += (((rows - under) ** 2 // under - plain) * weight[:, None] * zero[mine, first:last]).sum(0)

    def _at_once(self) -> int:
        return max(1, CELLS // (8 * len(self.names)))


class Groups:
    """The languages by name, for executors. More than ``GROUPS`` groups raise ValueError."""

    def __init__(self, groups: DataFrame):
        n = groups.count()
        if n > GROUPS:
            raise ValueError(f"{n} groups of language and source, more than {GROUPS}")
        rows = sorted((r["lang"], r["source"], r["n"], r["v"]) for r in groups.collect())
        self.sent = groups.sparkSession.sparkContext.broadcast(rows)
        self.languages: dict[str, Language] | None = None

    def __getstate__(self):
        return {"sent": self.sent, "languages": None}

    def of(self, lang: str) -> Language:
        if self.languages is None:
            by: dict[str, list[tuple]] = {}
            for r in self.sent.value:
                by.setdefault(r[0], []).append(r)
            self.languages = {k: Language([r[1] for r in own], [r[2] for r in own], own[0][3]) for k, own in by.items()}
        return self.languages[lang]


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """Adds part and rank by value, then item."""
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank.cast("int"))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def term_parts(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the least terms of each vector, for the sources that have more of them than the language."""
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    entries = vectors.withColumn("total", total).select("lang", "terms", "total", F.explode("vector").alias("e"))
    entries = entries.select("lang", F.col("e.source").alias("source"), F.col("e.n").alias("own"), "total", "terms").join(groups, ["lang", "source"])
    v = F.col("v")
    entries = entries.withColumns({"p": share(F.col("own"), F.col("n"), v), "q": share(F.col("total"), F.col("all_n"), v)}).where("p > q")
    return entries.select("lang", "source", F.explode("terms").alias("item"), part_of(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: of every group its pairs with the other sources of its language, and its first terms."""
    vectors = distinct_vectors(kept_terms(docs, least), ranks)
    groups = totals(docs, vectors)
    return ranked(evaluated(vectors, groups), "pair").unionByName(ranked(term_parts(vectors, groups), "term", ranks))


SQL = rf"""
with doc as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), found as (
  select i, lang, source, translate(unnest(regexp_extract_all(text, '{TERM}')), '{ascii_uppercase}', '{ascii_lowercase}') as term from doc
), kept as (
  select lang, term from found group by lang, term having count(distinct i) >= {LEAST}
), grp as (
  select distinct lang, source from doc
), v as (
  select lang, (select count(*) from kept where kept.lang = l.lang) as v from (select distinct lang from doc) l
), counts as (
  select grp.lang, grp.source, kept.term, (select count(*) from found f where f.lang = grp.lang and f.source = grp.source and f.term = kept.term) as n
  from grp join kept on kept.lang = grp.lang
), by_group as (
  select *, 1 + cast({UNIT} as hugeint) * (n + 1) // (sum(n) over (partition by lang, source) + v) as p from counts join v using (lang)
), by_lang as (
  select lang, term, 1 + cast({UNIT} as hugeint) * (sum(n) + 1) // (sum(sum(n)) over (partition by lang) + any_value(v)) as q from by_group group by lang, term
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum((x.p - y.p) * (x.p - y.p) // y.p)
    from by_group x join by_group y on y.lang = x.lang and y.term = x.term where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
), terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from by_group join by_lang using (lang, term) where n > 0 and p > q
), both_parts as (
  select * from pairs union all select * from terms
), numbered as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from numbered where part = 'pair' or rank <= {RANKS}
"""
