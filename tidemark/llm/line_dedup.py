"""Line dedup by site-relative frequency.

For every host the pages that contain a line are counted, a page once for a line, and divided by the pages of
the host. Lines whose ratio exceeds the limit are boilerplate of that host and dropped from its pages. Counting
shuffles 128-bit line hashes, never texts. A host has at most (lines a page) / (limit) boilerplate
lines, so the table of them stays small; it is broadcast only when its counted size is below
``BROADCAST_LINES`` and joined on the host else, where adaptive execution splits a hot host.

Edge cases: a null host is a host of its own; a null text stays null, an empty one empty; lines of
white space alone are never counted or dropped; a line on fewer than ``least`` pages is never dropped, so
that tiny hosts keep their text; repeated rows are pages of their own; an empty table gives an empty table;
lines end at line feeds alone. Input columns other than host and text pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

RATIO, LEAST = 0.02, 3
#: 16-byte hashes; with arrays' and rows' overhead about 5 MB.
BROADCAST_LINES = 100_000


def host_of(url: Column) -> Column:
    """A URL's host in lower case, without a leading www; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, a, b (the hash of a boilerplate line), n_pages, host_pages."""
    own = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("host_pages"))
    said = F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    lines = own.select("host", F.explode(F.transform(said, _hashes)).alias("h"))
    counts = lines.groupBy("host", "h.a", "h.b").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)
    return counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(
        F.col("n_pages") / F.col("host_pages") > ratio
    ).select("host", "a", "b", "n_pages", "host_pages")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The pages with boilerplate lines taken out of ``text``, and tidemark_lines (before), tidemark_dropped."""
    found = stored(boilerplate(pages, host, text, ratio, least), "boilerplate")
    drop = found.groupBy(F.col("host").alias("tidemark_host")).agg(F.collect_list(F.struct("a", "b")).alias("tidemark_drop"))
    if found.count() <= BROADCAST_LINES:
        drop = F.broadcast(drop)
    lines = _lines(F.col(text))
    kept = F.when(F.col("tidemark_drop").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains("tidemark_drop", _hashes(x)))
    )
    joined = pages.join(drop, F.col(host).eqNullSafe(F.col("tidemark_host")), "left").withColumn("tidemark_kept", kept)
    size = lambda x: F.when(F.col(text).isNull(), 0).otherwise(F.size(x)).cast("long")
    return joined.select(
        *(F.array_join("tidemark_kept", "\n").alias(c) if c == text else F.col(c) for c in pages.columns),
        size(lines).alias("tidemark_lines"),
        (size(lines) - size(F.col("tidemark_kept"))).alias("tidemark_dropped"),
    )


def site_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without its host's boilerplate lines, n_lines before, n_dropped."""
    cleaned = drop_boilerplate(docs.select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "text", F.col("tidemark_lines").alias("n_lines"), F.col("tidemark_dropped").alias("n_dropped"))


def site_pages(pages: DataFrame, url: str = "url", html: str = "html", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The pages with tidemark_host, the host of their URL, and their html without its boilerplate lines; pages without a host are one site."""
    cleaned = drop_boilerplate(pages.withColumn("tidemark_host_of", host_of(F.col(url))), "tidemark_host_of", html, ratio, least)
    return cleaned.select(*pages.columns, F.col("tidemark_host_of").alias("tidemark_host"), "tidemark_lines", "tidemark_dropped")


SQL = rf"""
with line as (
  select distinct doc_id, source, unnest(string_split(text, chr(10))) as line, row_no
  from (select *, row_number() over () as row_no from documents)
), page as (
  select source, count(*) as host_pages from documents group by source
), counted as (
  select source, line, count(*) as n_pages from line
  where trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '' group by source, line
), dropped as (
  select c.source, list(c.line) as lines from counted c join page p on c.source is not distinct from p.source
  where c.n_pages >= {LEAST} and c.n_pages / p.host_pages > {RATIO} group by c.source
), cut as (
  select d.doc_id, d.text, string_split(d.text, chr(10)) as lines,
         list_filter(string_split(d.text, chr(10)), lambda x: not list_contains(coalesce(b.lines, []), x)) as kept
  from documents d left join dropped b on d.source is not distinct from b.source
)
select doc_id, case when text is null then null else array_to_string(kept, chr(10)) end as text,
       coalesce(len(lines), 0) as n_lines, coalesce(len(lines) - len(kept), 0) as n_dropped
from cut
"""
