"""WARC archives without repeated payloads: revisit resolution by payload digest.

Writing. Pages are stored once with their payload's digest and a number for each row. Headers alone (digest, row number, id) are
shuffled by digest: among equal payloads of at least ``LEAST`` bytes the record with the smallest page_id is the response and
the others are revisits of it, shorter payloads are always responses. What was decided goes back to the
stored parts as one file of headers a part, so no payload is shuffled. Each task streams its pages into one archive with fresh
headers: a response carries the payload, a revisit only headers that name the response's record, address and date.

Reading. Archives are parsed record by record, also those that others wrote: records of any type, with or without digests, folded
header lines, packed or not. Revisits are joined to responses by the record id that they name, else by
the digest that they state, headers only, to resolve their payload's length and digest.

Edge cases: a null page has an empty payload; a null URL is left out, one with characters that a URI can't have is written percent-encoded with
the exact text in a header of its own, so that every URL reads back as it was; a null page_id is never the smallest, and among null
ids alone every record is a response; rows that repeat the smallest page_id are all responses; every record has an id of its own; only the
named columns are read, so extra columns cannot clash; an empty table gives no archives and reads back empty; payloads of any
length are kept whole.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, slices, stored
from tidemark.llm.files import opened, replaced

LEAST = 100
DATE = "2000-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: WARC 1.1's profile of a revisit whose payload is identical.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
#: Ids that fit a long.
PAGE_ID = re.compile(r"-?[0-9]{1,18}|-?[1-8][0-9]{18}")
#: Characters that stay as they are in a written URI.
URI = "!#$%&'()*+,/:;=?@[]~"


def record_id(row: int, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}:{digest}:{row}')}>"


def record(row: int, page_id: int | None, url: str | None, date: str, digest: str, payload: bytes, of: dict | None) -> bytes:
    """One record: a response with the payload, or a revisit ``of`` another row (row, page_id, url, date)."""
    head = [("WARC-Type", "revisit" if of else "response"), ("WARC-Record-ID", record_id(row, page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=URI)))
        if head[-1][1] != url:
            head.append(("X-Target-Text", json.dumps(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    block = b""
    if of:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(of["row"], of["page_id"], digest)), ("WARC-Refers-To-Date", of["date"])]
        if of["url"] is not None:
            head.append(("WARC-Refers-To-Target-URI", quote(of["url"], safe=URI)))
    else:
        block = HTTP_HEAD % len(payload) + payload
        head.append(("Content-Type", "application/http; msgtype=response"))
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def numbered(pages: DataFrame, id_col: str, url_col: str, html_col: str, date_col: str | None) -> DataFrame:
    """row, page_id, url, html, date, digest, n_bytes, stored; a row's upper bits are its part."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    date = F.lit(DATE) if date_col is None else F.coalesce(F.col(date_col), F.lit(DATE))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), date.alias("date"))
    own = own.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "n_bytes": F.octet_length("html")})
    return stored(own.withColumn("row", F.monotonically_increasing_id()), "pages")


def part_of(row):
    return F.shiftright(row, 33)


def decide(own: DataFrame, folder: str, least: int = LEAST) -> None:
    """Writes a file for each part of ``own`` that has revisits: the rows that are, and of whom."""
    heads = own.where(F.col("n_bytes") >= least).select("digest", "row", "page_id")
    known = heads.where("page_id is not null")
    groups = heads.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    # The least page_id; of rows that repeat it the first is named.
    owners = known.groupBy("digest").agg(F.min(F.struct("page_id", "row")).alias("of")).join(groups, "digest", "left_semi")
    named = own.select(F.col("row").alias("of_row"), "url", "date")
    owners = stored(owners.select("digest", "of.page_id", F.col("of.row").alias("of_row")).join(named, "of_row"), "owners")
    owned = heads.withColumnRenamed("page_id", "own_id").join(owners, "digest").where(~F.col("own_id").eqNullSafe(F.col("page_id")))
    revisits = owned.select(part_of(F.col("row")).alias("part"), "row", "of_row", "page_id", "url", "date")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, entered, out, writer = None, None, None, None

        def ended() -> pa.RecordBatch:
            writer.close()
            entered.__exit__(None, None, None)
            return pa.RecordBatch.from_pydict({"part": [part]})

        for batch in batches:
            own_part = batch.column("part").to_pylist()
            at = 0
            while at < len(own_part):
                end = next((i for i in range(at, len(own_part)) if own_part[i] != own_part[at]), len(own_part))
                if own_part[at] != part:
                    if writer is not None:
                        yield ended()
                    part = own_part[at]
                    entered = replaced(f"{folder}/{part}.parquet")
                    out = entered.__enter__()
                    writer = pq.ParquetWriter(out, batch.schema)
                writer.write_batch(batch.slice(at, end - at))
                at = end
        if writer is not None:
            yield ended()

    revisits.repartition("part").sortWithinPartitions("part", "row").mapInArrow(write, "part bigint").write.parquet(f"{folder}/parts")


def revisits_of(folder: str, part: int) -> dict[int, dict]:
    """What was decided on a part's rows."""
    files, path = opened(f"{folder}/{part}.parquet")
    if not files.get_file_info(path).is_file:
        return {}
    with files.open_input_file(path) as f:
        rows = pq.read_table(f).to_pylist()
    return {r["row"]: {"row": r["of_row"], "page_id": r["page_id"], "url": r["url"], "date": r["date"]} for r in rows}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date_col: str | None = None) -> DataFrame:
    """Writes gzip archives, a member a record, and returns the manifest: path, n_records, n_bytes.

    date_col: a column of WARC dates (UTC, as 2000-01-01T00:00:00Z); without it, or where it is null, ``DATE``.
    """
    own, decided = numbered(pages, id_col, url_col, html_col, date_col), scratch(pages.sparkSession, "revisits")
    decide(own, decided, least)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        n = size = 0
        entered = out = part = None
        revisits: dict[int, dict] = {}
        for batch in slices(batches):
            for row, page_id, url, html, date, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    entered = replaced(path)
                    out = entered.__enter__()
                if row >> 33 != part:
                    part = row >> 33
                    revisits = revisits_of(decided, part)
                packed = gzip.compress(record(row, page_id, url, date, digest, html.encode("utf-8"), revisits.get(row)), 6, mtime=0)
                out.write(packed)
                n, size = n + 1, size + len(packed)
        if entered is not None:
            entered.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    manifest = own.select("row", "page_id", "url", "html", "date", "digest").mapInArrow(write, "path string, n_records bigint, n_bytes bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records of an uncompressed stream; a folded line goes on with the header before it."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head, name = {}, None
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and name:
                head[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            head[name] = value.strip()
        if not head.get("content-length", "").isdecimal():
            raise ValueError("a record does not state its length")
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its length")
        yield head, block


#: A row a record. stated_digest is that of the headers; payload_digest bare if it is of SHA-256; error says why an archive was read no further.
RECORDS = "page_id bigint, url string, date string, record_id string, record_type string, payload_digest string, stated_digest string, refers_to_record string, payload binary, payload_bytes bigint, error string"
KINDS = pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")])
#: The record type of the row that stands for the rest of an archive that can't be read.
MALFORMED = "malformed"
#: Record types that have a payload of their own.
WITH_PAYLOAD = ("response", "resource", "conversion")


def as_row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A record as RECORDS says. The payload of a message in HTTP is its body, of other blocks the whole block."""
    kind, stated = head.get("warc-type", "").lower(), head.get("warc-payload-digest")
    payload = digest = None
    if kind in WITH_PAYLOAD:
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        digest = hashlib.sha256(payload).hexdigest()
    elif stated:
        digest = stated.removeprefix("sha256:")
    page, exact, uri = head.get("x-page-id", ""), head.get("x-target-text"), head.get("warc-target-uri")
    url = uri and uri.removeprefix("<").removesuffix(">")
    if exact:
        try:
            url = str(json.loads(exact))
        except ValueError:  # a header of another writer
            pass
    return (
        int(page) if PAGE_ID.fullmatch(page) else None, url, head.get("warc-date"), head.get("warc-record-id"), kind, digest, stated or digest and f"sha256:{digest}",
        head.get("warc-refers-to"), payload if with_payload else None, None if payload is None else len(payload), None,
    )


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row a record of all archives (``*.warc``, ``*.warc.gz``) below a folder, whoever wrote them, as RECORDS says.

    Where an archive is cut or a record malformed, one row of type ``MALFORMED`` with an ``error`` stands for what follows in that archive;
    others are read on. Files that a lost attempt has left have other names and are not read.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").option("recursiveFileLookup", "true").load(folder).select("path")
    dealt = listed.repartitionByRange(max(1, listed.count()), "path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), KINDS)], schema=KINDS)
            rows.clear()
            return out

        for path in (p for b in batches for p in b.column("path").to_pylist()):
            files, at = opened(path)
            with files.open_input_stream(at, compression=None) as raw:
                with gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw) as stream:
                    found = records(stream)
                    while True:
                        try:
                            row = next(found, None)
                        except (ValueError, EOFError, zlib.error, gzip.BadGzipFile) as wrong:
                            rows.append((*[None] * 4, MALFORMED, *[None] * 5, f"{path}: {wrong}"))
                            break
                        if row is None:
                            break
                        rows.append(as_row(*row, with_payload))
                        if len(rows) == 256:
                            yield flushed()
        if rows:
            yield flushed()

    return dealt.mapInArrow(read, RECORDS)


def resolve_revisits(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the responses and revisits among records."""
    heads = stored(read.where("record_type in ('response', 'revisit')").drop("payload", "error"), "records")
    responses = heads.where("record_type = 'response'")
    # Of responses with one id the one with the least page_id is meant.
    named = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("of"))
    named = named.select("refers_to_record", *(F.col(f"of.{c}").alias(n) for c, n in (("page_id", "refers_to"), ("payload_bytes", "of_bytes"), ("payload_digest", "of_digest"))))
    by_digest = responses.groupBy("stated_digest").agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("of"))
    revisits = heads.where("record_type = 'revisit'")
    found = revisits.where("refers_to_record is not null").join(stored(named, "responses"), "refers_to_record", "left")
    rest = revisits.where("refers_to_record is null").join(by_digest, "stated_digest", "left")
    rest = rest.withColumns({"refers_to": F.col("of.page_id"), "of_bytes": F.col("of.payload_bytes"), "of_digest": F.col("of.payload_digest")})
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = found.unionByName(rest.select(*found.columns)).select("page_id", F.col("of_bytes").alias("payload_bytes"), F.coalesce("of_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(whole)


SQL = f"""
with page as (
  select page_id, coalesce(html, '') as html from pages
), digested as (
  select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from page
), owned as (
  select *, min(page_id) over (partition by payload_digest, payload_bytes >= {LEAST}) as owner, payload_bytes >= {LEAST} as shared from digested
)
select page_id, payload_bytes, payload_digest,
       case when shared and owner is not null and page_id is distinct from owner then 'revisit' else 'response' end as record_type,
       case when shared and owner is not null and page_id is distinct from owner then owner end as refers_to
from owned
"""
