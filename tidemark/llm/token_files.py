"""Token ids as flat binary files with 64-bit document offsets.

Format. A folder of parts in ascending order of doc_id. Part ``n`` (ten digits) has three files: ``n.ids``, all ids of
its documents one after the other as little-endian unsigned integers (16 bits if the vocabulary allows it,
else 32); ``n.offsets``, 64-bit positions in ids where its documents start, and a last one where they end; ``n.docs``,
the 64-bit doc_ids (a null id as the least 64-bit integer). ``manifest`` (Parquet) has a row a part: its
number of documents and ids and its base, the ids in all parts before it, a prefix sum. The position of a document
in the whole is its part's base plus its offset. Reading maps the files into memory.

Writing range-partitions by doc_id, so each task streams its documents in order into its own parts, of a bounded size each, and no
task sees another's ids. Where files can't be mapped into memory, they are read range by range.

Edge cases: a null or empty text is the end id alone; a null id comes first; repeated ids keep an order by
text hash; only the two named columns are read, so extra columns cannot clash; an empty table gives no parts
and reads back empty; texts of any length are encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import TextEncoder, byte_alphabet, read_vocabulary
from tidemark.llm.common import slices, strings, texts_of
from tidemark.llm.files import mapped, replaced

NO_ID = -(2**63)
#: Ids and documents of a part, at which a task begins its next one; and parts that a task can have.
PART_IDS, PART_DOCS, SUBPARTS = 1 << 28, 1 << 22, 10**5
#: Entries of a worker's table of what stands between spaces; about 200 bytes each.
LIBRARY_LIMIT = 600_000


def library_encoder(path: str) -> TextEncoder:
    """The tokenizers library's ids of a text.

    Its model encodes the pieces of a text independently of one another, so each distinct piece is given to it
    once while a bounded table holds the ids. A vocabulary that cuts texts into other pieces raises ValueError.
    """
    model = Tokenizer.from_file(path).model
    special = {x["content"]: x["id"] for x in read_vocabulary(path)["added_tokens"]}
    letters = {byte: letter for letter, byte in byte_alphabet().items()}
    space, tokens = letters[32], model.tokenize

    def piece(text: str) -> list[int]:
        if text[1:].isalpha() and text.isascii():
            spelled = text.replace(" ", space)
        else:
            spelled = text.encode("utf-8").decode("latin-1").translate(letters)
        return [t.id for t in tokens(spelled)]

    return TextEncoder(piece, special, LIBRARY_LIMIT)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = library_encoder(path)
    return _encoders[path]


def id_type(path: str, end_id: int) -> str:
    """The narrowest unsigned type that holds every id."""
    size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    return "<u2" if size <= 1 << 16 else "<u4"


class Part:
    """The three files of a part, written as its documents come."""

    def __init__(self, folder: str, number: int, kind: str, first: tuple):
        self.stem, self.number, self.kind, self.first = f"{folder}/{number:010d}", number, kind, first
        self.ends, self.docs = array("q", [0]), array("q")  # 8 bytes a document each
        self.entered = replaced(f"{self.stem}.ids")
        self.out = self.entered.__enter__()

    def add(self, doc: int, blob: bytes) -> None:
        self.docs.append(int(doc))
        self.ends.append(self.ends[-1] + len(blob) // 4)
        self.out.write(np.frombuffer(blob, "<u4").astype(self.kind).tobytes())

    def close(self) -> pa.RecordBatch:
        self.entered.__exit__(None, None, None)
        for name, numbers in (("offsets", self.ends), ("docs", self.docs)):
            with replaced(f"{self.stem}.{name}") as out:
                out.write(np.frombuffer(numbers, np.int64).astype("<i8").tobytes())
        row = {"part": [self.number], "first_id": [self.first[0]], "first_tie": [self.first[1]], "n_docs": [len(self.docs)], "n_ids": [self.ends[-1]]}
        return pa.RecordBatch.from_pydict(row, PARTS)


def write_token_files(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", part_ids: int = PART_IDS, part_docs: int = PART_DOCS) -> DataFrame:
    """Writes the files and returns the manifest: part, first_id, n_docs, n_ids, base, kind."""
    kind = id_type(vocabulary_path, end_id)
    ranged = texts_of(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path)
        number, part, end = TaskContext.get().partitionId() * SUBPARTS, None, pack("<I", end_id)
        for batch in slices(batches):
            known = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for i, text in enumerate(strings(batch.column("text"))):
                if part is None:
                    first = (batch.column("doc_id")[i].as_py(), batch.column("tie")[i].as_py())
                    part = Part(folder, number, kind, first)
                part.add(known[i], own.encode(text) + end)
                if part.ends[-1] >= part_ids or len(part.docs) >= part_docs:
                    yield part.close()
                    number, part = number + 1, None
        if part is not None:
            yield part.close()

    parts = ranged.mapInArrow(write, "part bigint, first_id bigint, first_tie bigint, n_docs bigint, n_ids bigint")
    parts.write.parquet(f"{folder}/parts")
    parts = docs.sparkSession.read.schema(parts.schema).parquet(f"{folder}/parts")
    before = F.sum("n_ids").over(W.orderBy(F.col("first_id").asc_nulls_first(), "first_tie").rowsBetween(W.unboundedPreceding, -1))
    manifest = parts.select("part", "first_id", "n_docs", "n_ids", F.coalesce(before, F.lit(0)).alias("base"), F.lit(kind).alias("kind"))
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


PARTS = pa.schema([("part", pa.int64()), ("first_id", pa.int64()), ("first_tie", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    dealt = manifest.repartitionByRange(max(1, manifest.count()), "part")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            stem = f"{folder}/{row['part']:010d}"
            ids, ends, docs = mapped(f"{stem}.ids", row["kind"]), mapped(f"{stem}.offsets", "<i8"), mapped(f"{stem}.docs", "<i8")
            for at in range(0, len(docs), 256):
                e = ends[at : at + 257]
                doc = docs[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=doc == NO_ID), pa.array(e[:-1] + row["base"]), pa.array(np.diff(e)), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(e[:-1], e[1:])], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
