"""Near copies by SimHash: long fingerprints of five-word shingles, met at the anchors of covering codes.

Similarity is the cosine of two texts' sets of shingles, which is what equal SimHash bits estimate: of bits that differ
with share p it is cos(pi * p). Texts link if their fingerprints, compared on ``COMPARED`` words of 64 bits, differ in no more bits than the limit ``similarity``
lets expect and ``LEAN`` standard deviations more, so that texts at the limit itself are linked with a chance of 0.9 and not of one half. Sets whose
resemblance (Jaccard) is 0.8 have a cosine of 0.89.

A fingerprint has several blocks of 23 bits, each with the perfect Golay code's words as anchors. Every fingerprint is at home at its
nearest anchor in each block and is replicated to the anchors within one bit more, so within covering radius plus threshold 1. Two texts
at the limit meet in a block with a chance of ``MEET``, so the number of blocks follows from the links that may be missed (``MISS``, at the
limit itself; of texts with a resemblance of 0.8, where a block's chance is 0.4, one in a thousand). Beyond ``AT_ANCHOR``
texts an anchor, bits outside the blocks are appended to the code, with covering radius 0, and the blocks become
more for it: comparisons for a text then grow with the number of blocks, about the cube root of the table, not with the table.

At an anchor homes are compared with homes and visitors, and each class is reported as a star around its least
node, so the same class at many anchors gives the same links. An anchor of more than ``HOT`` homes is dealt into parts by node;
visitors go to all parts and a home visits the parts before its own, so all that meet in the whole meet in one part; its rows are
copied once for each part. What belongs to a class already is not compared with it again, so a large group of copies costs little more than its rows.

Edge cases: a null text counts as empty; texts without words are alike, and a text of fewer words than a shingle is one
shingle; a null id takes part and is the largest; rows equal in id and text are one; of each group the row with the smallest id
stays; columns pass through unread and may have any names; an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored, strings, with_arrow_columns
from tidemark.llm.simhash import BITS, BLOCK, LAST_MIX, combined_hashes, golay, least_of, visits

WORDS, SIMILARITY = 5, 0.8
#: Words of a fingerprint that are compared, and standard deviations by which more bits may differ than at the limit.
COMPARED, LEAN = 6, 1.3
#: The chance that two texts at the limit meet in a block, measured; and the share of such links that no block finds.
MEET, MISS = 0.26, 0.02
#: Mean texts at an anchor beyond which codes take more bits; anchors of a block.
AT_ANCHOR, ANCHORS = 256, 4096
HOT = 20_000
#: Visitors looked at together, fingerprints in a packed row, and cells of a comparison.
CHUNK, PACKED, CELLS = 100_000, 64, 400_000
#: Cells of an anchor that is compared side by side with others, and how many of these at once.
SMALL, SMALL_ONES = 2_000, 500
#: Odd multipliers that derive a shingle's further hashes from its first (fixed values).
MIXES = np.random.default_rng(42).integers(0, 1 << 63, 512, np.uint64) * np.uint64(2) + np.uint64(1)
COUNTED = BITS.astype(np.float32)


def blocks_for(rows: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The number of blocks, and of bits beside each, for a table of so many rows.

    ``MEET`` is the chance at ``SIMILARITY``; a higher similarity makes it higher, a lower one raises ValueError.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"blocks are counted for similarities of {SIMILARITY} or more")
    beside = min(64 - 2 * BLOCK, max(0, ceil(log2(max(1, rows) / (AT_ANCHOR * ANCHORS)))))
    met = MEET * (1 - acos(similarity) / pi) ** beside
    return ceil(log(MISS) / log(1 - met)), beside  # at most 930, of 1,024 that MIXES give


def bits_for(similarity: float = SIMILARITY) -> int:
    """Bits by which linked fingerprints differ at most."""
    n, p = 64 * COMPARED, acos(similarity) / pi
    return int(n * p + LEAN * sqrt(n * p * (1 - p)))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """So many words of 64 bits; a bit is 1 if set in over half of a mix of the hashes. No hashes give zero."""
    n = len(hashes)
    ones = np.zeros((8 * words, 8))
    for at in range(0, n, 4096):
        x = hashes[at : at + 4096, None] * MIXES[:words]
        x = (x ^ x >> np.uint64(31)) * LAST_MIX
        x ^= x >> np.uint64(29)
        lanes = x.view(np.uint8).reshape(len(x), 8 * words) + np.arange(0, 2048 * words, 256)
        ones += np.bincount(lanes.ravel(), minlength=2048 * words).reshape(8 * words, 256).astype(np.float32) @ COUNTED
    return np.packbits(ones.ravel() * 2 > n, bitorder="little").view("<u8")


def with_fingerprint(texts: DataFrame, n_words: int, words: int = WORDS) -> DataFrame:
    """Adds fp (binary, so many words of 64 bits) of the distinct shingles of each text."""

    def make():
        return lambda batch: [pa.array([long_fingerprint(np.unique(combined_hashes(t, words)), n_words).tobytes() for t in strings(batch.column("text"))], pa.binary())]

    return with_arrow_columns(texts, {"fp": T.BinaryType()}, make)


def block_of(fp: np.ndarray, k: int, beside: int) -> tuple[np.ndarray, np.ndarray]:
    """Block k of fingerprints as words whose lowest bits it is; and the key bits that the code and the bits beside it give."""
    word = fp[:, k // 2]
    extra = (word >> np.uint64(2 * BLOCK)).astype(np.int64) & (1 << beside) - 1
    return word >> np.uint64(BLOCK * (k % 2)), np.int64(k) << 48 | extra << BLOCK


def fingerprints_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """node, and fingerprints as rows of words."""
    flat = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64)
    return batch.column("node").to_numpy(), flat.reshape(batch.num_rows, -1)


PACKS = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("visit", pa.int32()), ("packed", pa.binary())])
PACKS_DDL = "key bigint, part int, visit int, packed binary"


def packs(key: np.ndarray, visit: int, rows: np.ndarray, part: int = -1) -> pa.RecordBatch:
    """Rows (node, compared words) of equal keys side by side, ``PACKED`` at most in one."""
    order = np.argsort(key, kind="stable")
    key, data = key[order], np.ascontiguousarray(rows[order])
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    place = np.arange(len(key)) - np.repeat(starts, np.diff([*starts, len(key)]))
    starts = np.flatnonzero(place % PACKED == 0)
    ends = pa.py_buffer((np.array([*starts, len(key)]) * data.strides[0]).astype(np.int32).tobytes())
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(data)])
    fill = lambda x: pa.array(np.full(len(starts), x, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(key[starts]), fill(part), fill(visit), packed], schema=PACKS)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a column of packs, and where each pack ends among them."""
    ends = np.cumsum([0, *map(len, (flat := column.to_pylist()))]) // (8 * (1 + COMPARED))
    return np.frombuffer(b"".join(flat), np.uint64).reshape(-1, 1 + COMPARED), ends


def at_anchors(nodes: DataFrame, n_blocks: int, beside: int) -> DataFrame:
    """Packs of fingerprints at their homes (visit 0) and at the anchors that they visit (1)."""

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = golay()
        for batch in batches:
            if not batch.num_rows:
                continue
            node, fp = fingerprints_of(batch)
            rows = np.column_stack([node.view(np.uint64), fp[:, :COMPARED]])
            for k in range(n_blocks):
                word, key = block_of(fp, k, beside)
                x = word.astype(np.int64) & (1 << BLOCK) - 1
                yield packs(key | x ^ code.leader[code.syndrome(x)], 0, rows)
                at, anchor = visits(word, (0,), 1)
                if len(at):
                    yield packs(key[at] | anchor, 1, rows[at])

    return nodes.mapInArrow(replicate, PACKS_DDL)


def hot_anchors(nodes: DataFrame, n_blocks: int, beside: int) -> DataFrame:
    """key, parts of the anchors of more than ``HOT`` homes."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = golay()
        for batch in batches:
            if not batch.num_rows:
                continue
            _, fp = fingerprints_of(batch)
            for k in range(n_blocks):
                word, key = block_of(fp, k, beside)
                x = word.astype(np.int64) & (1 << BLOCK) - 1
                keys, n = np.unique(key | x ^ code.leader[code.syndrome(x)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    counted = nodes.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    return stored(counted.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "hot")


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Packs with those of hot anchors dealt into parts."""
    if hot.isEmpty():
        return rows
    marked = rows.join(hot, "key", "left")

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = unpacked(batch.column("packed"))
            size = np.diff(ends)
            key, visit, parts = (np.repeat(batch.column(c).to_numpy(), size) for c in ("key", "visit", "parts"))
            own = np.where(visit == 1, parts, ((data[:, 0] * LAST_MIX >> np.uint64(32)) % parts.astype(np.uint64)).astype(np.int64))
            for part in range(int(parts.max(initial=0))):
                for kind, some in ((0, own == part), (1, (own > part) & (parts > part))):
                    if some.any():
                        yield packs(key[some], kind, data[some], part)

    split = marked.where("parts is not null").select("key", "visit", "packed", "parts").mapInArrow(deal, PACKS_DDL)
    return marked.where("parts is null").select(*PACKS.names).unionByName(split)


def join_classes(words: np.ndarray, label: np.ndarray, n_home: int, first: int, bits: int) -> None:
    """Merges labels of linked rows: homes (the first rows) against the rows from ``first`` on. words: a column a row."""
    n = len(label)
    step = max(1, CELLS // n)
    for a in range(0, n_home, step):
        b = min(a + step, n_home)
        start = max(first, a + 1)
        rest = label[start:] != label[a] if (label[a:b] == label[a]).all() else None
        if rest is not None and not rest.any():
            continue
        cols = slice(start, n) if rest is None or rest.all() else start + np.flatnonzero(rest)
        apart = np.bitwise_count(words[0, a:b, None] ^ words[0, cols]).astype(np.uint16)
        for w in words[1:]:
            apart += np.bitwise_count(w[a:b, None] ^ w[cols])
        near = apart <= bits
        if not near.any():
            continue
        others = np.arange(start, n) if isinstance(cols, slice) else cols
        for i in np.flatnonzero(near.any(axis=1)):
            labels = np.unique(label[others[near[i]]])
            labels = labels[labels != label[a + i]]
            if len(labels):
                label[np.isin(label, labels)] = label[a + i]


def with_links(data: np.ndarray, starts: np.ndarray, n_home: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Which of many small anchors (slices of data) have a link; their pairs are compared side by side."""
    home = np.repeat(starts - np.cumsum(n_home) + n_home, n_home) + np.arange(n_home.sum())
    count = np.repeat(starts + sizes, n_home) - home - 1  # a home's pairs: all behind it
    left = np.repeat(home, count)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    apart = np.zeros(len(left), np.uint16)
    for w in data.T[1:]:
        apart += np.bitwise_count(w[left] ^ w[right])
    of = np.repeat(np.repeat(np.arange(len(starts)), n_home), count)
    return np.bincount(of[apart <= bits], minlength=len(starts)) > 0


class Anchor:
    """What is at one anchor: its homes, then its visitors in chunks."""

    def __init__(self, key: tuple, bits: int):
        self.key, self.bits = key, bits
        self.homes: list[np.ndarray] = []
        self.visitors: list[np.ndarray] = []
        self.waiting, self.label = 0, None

    def add(self, rows: np.ndarray, n_home: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if n_home:
            self.homes.append(rows[:n_home])
        if n_home < len(rows):
            self.visitors.append(rows[n_home:])
            self.waiting += len(rows) - n_home
            if self.waiting >= CHUNK:
                yield from self.links()

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Stars of the classes among homes and the visitors that wait; none are waiting afterwards."""
        n_home = sum(map(len, self.homes))
        if n_home and (self.label is None or self.waiting):
            rows = np.concatenate(self.homes + self.visitors)
            node, words = rows[:, 0].view(np.int64), np.ascontiguousarray(rows[:, 1:].T)
            known = self.label is not None
            label = np.arange(len(rows))
            if known:
                label[:n_home] = self.label
            join_classes(words, label, n_home, n_home if known else 0, self.bits)
            self.label = label[:n_home]
            if (label == np.arange(len(rows))).all():
                self.visitors, self.waiting = [], 0
                return
            _, own, size = np.unique(label, return_inverse=True, return_counts=True)
            least = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(least, own, node)
            linked = (size[own] > 1) & (least[own] != node)
            if linked.any():
                yield least[own][linked], node[linked]
        self.visitors, self.waiting = [], 0


def met(rows: DataFrame, bits: int) -> DataFrame:
    """u, v: links that give the classes of each anchor (key, part)."""
    cells = SMALL

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, out = None, []

        def flushed():
            u, v = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "part")])
            visit, (data, ends) = batch.column("visit").to_numpy(), unpacked(batch.column("packed"))
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            starts, sizes = ends[cuts[:-1]], np.diff(ends[cuts])
            n_home = np.add.reduceat(np.where(visit == 0, np.diff(ends), 0), cuts[:-1])
            # Without a home, or alone at its anchor, a row has no link; at the batch's ends an anchor can go on.
            worth = (n_home > 0) & (sizes > 1)
            worth[0] = worth[-1] = False
            small = np.flatnonzero(worth & (n_home * sizes <= cells))
            for at in range(0, len(small), SMALL_ONES):
                some = small[at : at + SMALL_ONES]
                worth[some] = with_links(data, starts[some], n_home[some], sizes[some], bits)
            worth[0] = worth[-1] = True
            for i in np.flatnonzero(worth):
                key = tuple(keys[:, cuts[i]].tolist())
                if anchor is None or anchor.key != key:
                    if anchor is not None:
                        out += anchor.links()
                    anchor = Anchor(key, bits)
                for pair in anchor.add(data[starts[i] : starts[i] + sizes[i]], int(n_home[i])):
                    out.append(pair)
                if len(out) >= 1000 or out and len(out[-1][0]) >= 10_000:
                    yield flushed()
        if anchor is not None:
            out += anchor.links()
        if out:
            yield flushed()

    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "visit")
    return ordered.mapInArrow(meet, "u bigint, v bigint").distinct()


def near_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, beside: int | None = None) -> DataFrame:
    """doc_id, h (text hash), component_id (the least of no_id, doc_id, h) of documents whose fingerprints link them over any path.

    beside: bits that codes take beside a block; by default as many as the number of rows asks for.
    """
    n_blocks, asked = blocks_for(docs.count(), similarity)
    if beside is not None:
        n_blocks, asked = blocks_for(AT_ANCHOR * ANCHORS << beside, similarity)
    bits = bits_for(similarity)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    own = own.withColumn("node", F.xxhash64("text"))
    rows = own.select("node", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h").alias("row"))
    marked = with_fingerprint(own.select("node", "text"), max(COMPARED, -(-n_blocks // 2)), words).select("node", "fp")
    nodes = stored(marked.groupBy("node").agg(F.first("fp").alias("fp")), "fingerprints")
    found = met(dealt(at_anchors(nodes, n_blocks, asked), hot_anchors(nodes, n_blocks, asked)), bits)
    return rows.join(least_of(rows, found, "row"), "node").select("row.doc_id", "row.h", "component_id")


#: Rows of a broadcast table of what goes (id and hash, about 50 bytes each with overhead).
BROADCAST_ROWS = 500_000


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays (a null id is the largest).

    Documents meet the table of those that go; where its counted size allows a broadcast, no text is shuffled.
    """
    found = stored(near_classes(docs, words, similarity), "near")
    kept = F.col("component_id.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("component_id.h") == F.col("h"))
    gone = stored(found.where(~kept).select(F.col("doc_id").alias("tidemark_id"), F.col("h").alias("tidemark_h")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(F.col("tidemark_id")) & (F.xxhash64(docs["text"]) == F.col("tidemark_h"))
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    if not found.where(kept).groupBy("doc_id", "h").count().where("count > 1").isEmpty():  # a row may be there more than once
        left = left.dropDuplicates(["doc_id", "text"])
    return left
