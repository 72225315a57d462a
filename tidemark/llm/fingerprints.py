"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``K`` smallest distinct hashes (63 bits) of a text's shingles, in ascending order; with fewer
shingles it has them all. Sketches of parts merge into the sketch of the whole: the smallest of their
union. Two sketches estimate resemblance from the K smallest of their union, containment from that and
the counts, and one estimates the number of distinct shingles from its largest hash. Short sketches are exact.

Edge cases: a null or empty text has an empty sketch; two empty sketches are alike (1.0), an empty and
another are not (0.0); a text of fewer words than a shingle is one shingle; equal texts have equal
sketches; repeated ids are ordered by text; a null id comes last; only the named columns are read, so extra
columns cannot clash; an empty table gives an empty table; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices, stored, strings, with_arrow_columns
from tidemark.llm.simhash import combined_hashes

K, WORDS = 128, 5
#: Sketches that a task merges before it passes them on, about 2 KB each.
HELD = 20_000
#: Documents of a part, and keys in a broadcast table of estimates (100 bytes each).
PART_ROWS, BROADCAST_KEYS = 50_000, 50_000
#: Ids of the sample that parts are cut at, for each part and at most; 8 bytes each. There are no more parts than the largest sample gives.
SAMPLED, MOST_SAMPLED = 100, 4_000_000


def sketch(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    hashes = (combined_hashes(text, words) >> np.uint64(1)).astype(np.int64)
    if len(hashes) > 4 * k:  # all that can be among the k smallest distinct ones, mostly
        least = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The resemblance that two sketches estimate."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def counted(a: np.ndarray, k: int = K) -> float:
    """``distinct_shingles`` of one sketch."""
    return float(len(a)) if len(a) < k else (k - 1) * float(2**63) / float(a[-1])


def contained(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """``containment`` of two sketches."""
    if not len(a):
        return 1.0
    j = likeness(a, b, k)
    return min(1.0, j * (counted(a, k) + counted(b, k)) / (1 + j) / counted(a, k))


def with_sketch(docs: DataFrame, text_col: str = "text", sketch_col: str = "sketch", k: int = K, words: int = WORDS) -> DataFrame:
    """Adds ``sketch_col`` (array<bigint>)."""
    docs = docs.drop(sketch_col)

    def make():
        def work(batch):
            return [pa.array([sketch(t, k, words) for t in strings(batch.column(text_col))], pa.list_(pa.int64()))]

        return work

    return with_arrow_columns(docs, {sketch_col: T.ArrayType(T.LongType())}, make)


def merged(sketches: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """key, sketch: each key's merged sketch; null keys are one.

    Tasks merge what they have of a key before anything is shuffled, so a hot key sends one sketch from each task, and
    the tasks behind the shuffle merge key by key as rows come in.
    """
    most = HELD

    def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.union1d(a, b)[:k]

    def rows(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], [key, "sketch"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in slices(batches):
            for of, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.empty(0, np.int64) if own.values is None else own.values.to_numpy()
                if of not in held and len(held) >= most:  # behind the shuffle keys come in order, so those held are whole
                    yield rows(held, batch.column(0).type)
                    held = {}
                held[of] = union(held[of], own) if of in held else own
        if held:
            yield rows(held, batch.column(0).type)

    schema = T.StructType([T.StructField(key, sketches.schema[key].dataType), T.StructField("sketch", T.ArrayType(T.LongType()))])
    first = sketches.select(key, sketch_col).mapInArrow(merge, schema)
    return first.repartition(key).sortWithinPartitions(key).mapInArrow(merge, schema)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of equal shingles in the union, of two sketch columns."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(2**63) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has, 1 at most; 1 for an empty a."""
    j = resemblance(a, b, k)
    common = j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + j)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def cut_ids(ids: DataFrame, least: int, part_rows: int = PART_ROWS, most: int = MOST_SAMPLED) -> np.ndarray:
    """Ids, ascending, that cut a table into parts of about ``part_rows`` rows, ``least`` parts at least; the last is the largest id.

    They come from a sample whose size is bounded, so neither a task nor the driver holds more than ``most`` of them; the result of what uses them
    does not depend on where the cuts are.
    """
    n, largest = ids.agg(F.count("doc_id"), F.max("doc_id")).first()
    if largest is None:
        return np.empty(0, np.int64)
    parts = min(max(least, n // part_rows), max(1, most // SAMPLED))
    wanted = min(n, SAMPLED * parts)
    sample = ids.where(F.col("doc_id").isNotNull()).sample(wanted / n, seed=7) if wanted < n else ids.where(F.col("doc_id").isNotNull())
    some = np.sort(sample.toPandas()["doc_id"].to_numpy(np.int64))
    cuts = some[np.arange(1, parts) * len(some) // parts] if len(some) else some
    return np.unique(np.concatenate([cuts, [largest]]))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, halo, doc_id, source, text in sorted partitions: descending doc_id, each part followed by the document after it.

    Ids are cut into ranges at some of the ids themselves, of a bounded sample. The largest id of a range is also sent, as a halo,
    to the end of the range above it, and the largest of all to the end of the lowest; so each task finds the
    document after each of its own without a window over the table. Every text is shuffled once.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = cut_ids(own.select("doc_id"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, len(bounds))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            values = ids.fill_null(0).to_numpy()
            part = np.where(known, np.searchsorted(bounds, values), 0)
            if len(bounds):
                edge = np.flatnonzero(known & (bounds[np.minimum(part, len(bounds) - 1)] == values))
                after = (part[edge] + 1) % len(bounds)
            else:
                edge, after = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at, to, halo in ((np.arange(batch.num_rows), part, 0), (edge, after, 1)):
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.astype(np.int32)), pa.array(np.full(len(at), halo, np.int32)), *(batch.column(c).take(pa.array(at)) for c in ("doc_id", "source", "text"))],
                        ["part", "halo", "doc_id", "source", "text"],
                    )

    dealt = own.mapInArrow(deal, "part int, halo int, doc_id bigint, source string, text string")
    return dealt.repartitionById(parts + 1, "part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "text")


PAIRS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("sketch", pa.list_(pa.int64())), ("edited_sketch", pa.list_(pa.int64())), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64()), ("kept_in_edited", pa.float64()), ("source", pa.string())])
PAIRS_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, sketch array<bigint>, edited_sketch array<bigint>, near_edited double, near_next double, n_shingles double, kept_in_edited double, source string"


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document's sketch, that of its text with the last third taken from the next document, and likenesses.

    n_shingles: distinct shingles of the text; kept_in_edited: the share of them that the edited text has.
    """

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []  # last: part, id, source, text, sketch

        def close(text: str, own: np.ndarray) -> None:
            _, doc_id, source, before, sketched = last
            cut = len(before) // 3
            edited = before[: len(before) - cut] + text[:cut]
            other = sketch(edited)
            rows.append((doc_id, len(before), hashlib.sha256(edited.encode("utf-8")).hexdigest(), sketched, other, likeness(sketched, other), likeness(sketched, own), counted(sketched), contained(sketched, other), source))

        for batch in slices(batches):
            for part, halo, doc_id, source, text in zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "doc_id", "source", "text"))):
                if halo and (last is None or last[0] != part):
                    continue  # not the first halo of its part
                own = sketch(text)
                if last is not None:
                    close(text, own)
                last = None if halo else (part, doc_id, source, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), PAIRS)], schema=PAIRS)
                rows = []

    return with_next(docs, id_col, text_col, source_col).mapInArrow(pair, PAIRS_DDL)


def source_shingles(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, source_shingles: the estimated number of distinct shingles in all documents of a source, from their merged sketches."""
    own = docs.select(F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return merged(with_sketch(own).select("source", "sketch"), "source").select("source", distinct_shingles(F.col("sketch")).alias("source_shingles"))


def fingerprint_digests(pairs: DataFrame) -> DataFrame:
    """The pairs with sketches as strings: hexadecimal hashes, dot-separated."""
    text = lambda c: F.array_join(F.transform(c, F.hex), ".")
    rest = [c for c in pairs.columns if c not in ("sketch", "edited_sketch")]
    return pairs.select(text("sketch").alias("fingerprint"), text("edited_sketch").alias("edited_fingerprint"), *rest)


def documents_and_sources(docs: DataFrame) -> DataFrame:
    """``fingerprint_digests`` of every document, with its source and the source's distinct shingles."""
    sources = stored(source_shingles(docs).withColumnRenamed("source", "of"), "sources")
    if sources.count() <= BROADCAST_KEYS:
        sources = F.broadcast(sources)
    pairs = fingerprint_digests(edited_pairs(docs))
    return pairs.join(sources, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
