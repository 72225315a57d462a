"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code. Blocks of 23 of the 64 fingerprint bits each take the perfect
binary Golay code: every block value lies within 3 bits of exactly one code word. A code here is a product
of such blocks; the bits outside its blocks don't choose an anchor. Every fingerprint has one home anchor, the
nearest, and is replicated to every anchor that is farther than its home by at most the threshold, which
is within covering radius plus threshold. Of two fingerprints that differ by at most the threshold, the one that
lies farther from its home reaches the home of the other; so each link is met at an anchor. Fingerprints are
compared per anchor, homes against all.

Only distinct fingerprints are compared. An anchor's links are reported as a spanning forest, at most one
link for each row at the anchor, never all pairs. An anchor with more than ``HOT`` homes is split by the bits
outside its blocks: homes keep their value of these bits, the others go to every value within the threshold. A split
group holds at most 4.2 million fingerprints (34 MB), because a Golay word has 2,048 values around it.

Edge cases: a null text counts as empty and has fingerprint zero, which links like any other; a null id
takes part with no id of its own (a component of null ids alone has a null id); repeated rows stay repeated;
only the named columns are read, so extra columns cannot clash; an empty table gives an empty table; texts
of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored, strings, texts_of, with_arrow_columns
from tidemark.llm.components import connected

SEED = 42
#: Homes at one anchor beyond which the anchor is split.
HOT = 20_000
#: Bits of a block, and the Golay code's generator polynomial (fixed values).
BLOCK, GENERATOR = 23, 0b101011100011
#: Bits of each byte value, lowest first.
BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(text: str, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of the shingles of so many words; A-Z lower-cased, shorter texts are one shingle."""
    found = text.encode("utf-8").lower().split()  # at ASCII white space alone
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - words] + 1]).tolist()
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, n - words + 1)
    return np.unique(hashes) if distinct else hashes


#: Odd multipliers of a shingle's words by position, and of the last mix (fixed values).
PLACES = np.random.default_rng(7).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
LAST_MIX = np.uint64(0x94D049BB133111EB)


def combined_hashes(text: str, words: int) -> np.ndarray:
    """As ``shingle_hashes``, but each word is hashed once and a shingle's hash combines those of its words by position."""
    found = text.encode("utf-8").lower().split()
    n = len(found)
    one = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
    if not n:
        return one
    own, wide = np.zeros(max(1, n - words + 1), np.uint64), min(n, words)
    for k in range(wide):
        own += one[k : n - wide + 1 + k] * PLACES[k]
    own = (own ^ own >> np.uint64(32)) * LAST_MIX
    return own ^ own >> np.uint64(29)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.view(np.uint8).reshape(n, 8) + np.arange(0, 2048, 256)
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits(ones.ravel() * 2 > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (bigint, the 64 bits) of every row."""

    def make():
        return lambda batch: [pa.array([signed(majority(shingle_hashes(t, words))) for t in strings(batch.column("text"))], pa.int64())]

    return with_arrow_columns(texts_of(docs, id_col, text_col), {"fp": T.LongType()}, make).select("doc_id", "fp")


class Golay:
    """Nearest code words of 23-bit values, by syndrome."""

    def __init__(self):
        single = [1 << i for i in range(BLOCK)]
        one = [self._remainder(x) for x in single]
        self.tables = [np.zeros(256, np.int64) for _ in range(3)]
        for k, table in enumerate(self.tables):
            for byte in range(256):
                for i in range(8):
                    if byte >> i & 1 and 8 * k + i < BLOCK:
                        table[byte] ^= one[8 * k + i]
        self.leader = np.zeros(2048, np.int64)
        self.weight = np.full(2048, -1)
        self.beyond: dict[tuple[int, int], np.ndarray] = {}
        found: dict[int, dict[int, list[int]]] = {}
        for w in range(6):
            for bits in combinations(range(BLOCK), w):
                x = s = 0
                for b in bits:
                    x |= single[b]
                    s ^= one[b]
                if self.weight[s] < 0:
                    self.weight[s], self.leader[s] = w, x
                if w - self.weight[s] <= 2:
                    found.setdefault(s, {}).setdefault(w - int(self.weight[s]), []).append(x)
        #: By excess over the home's distance: offsets of each syndrome's code words, padded with -1.
        self.offsets = []
        for excess in range(3):
            width = max(len(v.get(excess, ())) for v in found.values())
            grid = np.full((2048, max(width, 1)), -1, np.int64)
            for s, v in found.items():
                grid[s, : len(v.get(excess, ()))] = v.get(excess, ())
            self.offsets.append(grid)

    @staticmethod
    def _remainder(x: int) -> int:
        for i in range(BLOCK - 1, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.tables[0][x & 255] ^ self.tables[1][x >> 8 & 255] ^ self.tables[2][x >> 16]


@lru_cache(maxsize=1)
def golay() -> Golay:
    return Golay()


def homes(fp: np.ndarray, blocks: tuple[int, ...]) -> np.ndarray:
    """The home anchor of each fingerprint: its blocks' nearest code words side by side."""
    code, out = golay(), np.zeros(len(fp), np.int64)
    for k, at in enumerate(blocks):
        x = (fp >> np.uint64(at)).astype(np.int64) & (1 << BLOCK) - 1
        out |= (x ^ code.leader[code.syndrome(x)]) << k * BLOCK
    return out


def visits(fp: np.ndarray, blocks: tuple[int, ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in fp, anchor) of the anchors beyond the home that lie within threshold of its distance."""
    code = golay()
    # Partial anchors of each row: (positions, anchor, excess so far), one block at a time.
    rows, anchors, spent = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    for k, at in enumerate(blocks):
        x = ((fp[rows] >> np.uint64(at)).astype(np.int64)) & (1 << BLOCK) - 1
        s, parts = code.syndrome(x), []
        for excess in range(threshold + 1):
            ok = spent + excess <= threshold
            grid = code.offsets[excess][s[ok]]
            i, j = np.nonzero(grid >= 0)
            parts.append((rows[ok][i], anchors[ok][i] | (x[ok][i] ^ grid[i, j]) << k * BLOCK, spent[ok][i] + excess))
        rows, anchors, spent = (np.concatenate(p) for p in zip(*parts))
    away = spent > 0
    return rows[away], anchors[away]


def outside(blocks: tuple[int, ...]) -> list[int]:
    """Positions of up to 18 bits outside the blocks."""
    return [b for b in range(64) if not any(at <= b < at + BLOCK for at in blocks)][-18:]


def gathered(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)).astype(np.int64) & 1) << k
    return out


ROWS = pa.schema([("code", pa.int32()), ("anchor", pa.int64()), ("part", pa.int32()), ("visit", pa.int32()), ("node", pa.int64()), ("fp", pa.int64())])
ROWS_DDL = "code int, anchor bigint, part int, visit int, node bigint, fp bigint"


def _rows(code, anchor, part, visit, batch, at) -> pa.RecordBatch:
    n = len(at)
    at = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, code, np.int32)), pa.array(anchor), pa.array(np.full(n, part, np.int32) if np.isscalar(part) else part.astype(np.int32)), pa.array(np.full(n, visit, np.int32) if np.isscalar(visit) else visit.astype(np.int32)), *(batch.column(c).take(at) for c in ("node", "fp"))],
        schema=ROWS,
    )


def hot_anchors(home: DataFrame, key: list[str]) -> DataFrame:
    """key, parts: the anchors of more than ``HOT`` homes, and how many parts hold these."""
    counted = home.groupBy(*key).count().where(F.col("count") > HOT)
    return stored(counted.select(*key, F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "hot")


def links(nodes: DataFrame, codes: list[tuple[int, ...]], threshold: int, bits: int) -> DataFrame:
    """u, v: a spanning forest, per anchor, of the links among distinct fingerprints.

    nodes: node (bigint, one for each distinct fingerprint), fp. A link differs in at most ``bits`` bits, no more than
    ``threshold``, which holds on the blocks of a code; one code finds every link.
    """
    if bits > threshold:
        raise ValueError("anchors find links of at most the threshold's bits")

    def at_home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, blocks in enumerate(codes):
                if len(fp):
                    yield _rows(k, homes(fp, blocks), -1, 0, batch, np.arange(len(fp)))

    def on_visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                fp = batch.column("fp").to_numpy().view(np.uint64)
                for k, blocks in enumerate(codes):
                    row, anchor = visits(fp, blocks, threshold)
                    yield _rows(k, anchor, -1, 1, batch, row)

    home = nodes.mapInArrow(at_home, ROWS_DDL)
    rows = home.unionByName(nodes.mapInArrow(on_visit, ROWS_DDL))
    hot = hot_anchors(home, ["code", "anchor"])
    if not hot.isEmpty():
        marked = rows.join(hot, ["code", "anchor"], "left")

        def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    fp, visit = batch.column("fp").to_numpy().view(np.uint64), batch.column("visit").to_numpy()
                    code, anchor = batch.column("code").to_numpy(), batch.column("anchor").to_numpy()
                    for k in np.unique(code):
                        rest = outside(codes[k])
                        near = np.array([sum(1 << b for b in c) for w in range(threshold + 1) for c in combinations(range(len(rest)), w)])
                        i = np.flatnonzero((code == k) & (visit == 0))
                        own = gathered(fp[i], rest)
                        yield _rows(k, anchor[i], own, 0, batch, i)
                        j = np.flatnonzero(code == k)
                        to = gathered(fp[j], rest)[:, None] ^ near
                        keep = (visit[j][:, None] == 1) | (near != 0)  # a home meets other homes as a visitor
                        a, b = np.nonzero(keep)
                        yield _rows(k, anchor[j][a], to[a, b], 1, batch, j[a])

        is_hot = F.col("parts").isNotNull()
        rows = marked.where(~is_hot).select(*ROWS.names).unionByName(
            marked.where(is_hot).select(*ROWS.names).mapInArrow(split, ROWS_DDL)
        )

    return met(rows, ["code", "anchor", "part"], lambda key: Group(key, bits), compared)


def met(rows: DataFrame, key: list[str], make: Callable[[tuple], Group], read: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """u, v: the links that the groups made for each key report; ``read`` gives what a batch's rows are compared by."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = None, []

        def flush():
            u, v = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
            node, visit = batch.column("node").to_numpy(), batch.column("visit").to_numpy()
            words = read(batch)
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            # Without a home, or alone at its anchor, a row has no link; at the batch's ends a group can go on.
            worth = (visit[cuts[:-1]] == 0) & (np.diff(cuts) > 1)
            worth[0] = worth[-1] = True
            for i in np.flatnonzero(worth):
                a, b = int(cuts[i]), int(cuts[i + 1])
                k = tuple(keys[:, a].tolist())
                if group is None or group.key != k:
                    group = make(k)
                n_home = a + int(np.searchsorted(visit[a:b], 1))
                for part in chain(group.add_homes(node[a:n_home], words[a:n_home]), group.add_visits(node[n_home:b], words[n_home:b])):
                    out.append(part)
                    if len(out) >= 1000:
                        yield flush()
            if out:
                yield flush()

    return rows.repartition(*key).sortWithinPartitions(*key, "visit").mapInArrow(meet, "u bigint, v bigint")


def compared(batch: pa.RecordBatch) -> np.ndarray:
    """The fingerprints of a batch's rows."""
    return batch.column("fp").to_numpy().view(np.uint64)[:, None]


class Group:
    """The homes of one anchor, and the classes that links have made among them so far."""

    def __init__(self, key: tuple, bits: int):
        self.key, self.bits = key, bits
        self.node, self.words, self.label = np.empty(0, np.int64), None, np.empty(0, np.int64)

    def near(self, word: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words ^ word).sum(axis=1) <= self.bits

    def add_homes(self, node: np.ndarray, words: np.ndarray) -> list:
        """Links that join classes of homes."""
        if not len(node):
            return []
        first = len(self.node)
        self.node = np.concatenate([self.node, node])
        self.words = words if self.words is None else np.concatenate([self.words, words])
        self.label = np.concatenate([self.label, np.arange(first, first + len(node))])
        out = []
        for i in range(max(first, 1), len(self.node)):
            linked = np.flatnonzero(self.near(self.words[i], self.words[:i]))
            out += self._join(i, linked)
        return out

    def _join(self, i: int, linked: np.ndarray) -> list:
        """Joins home i with the classes of linked homes: one link for each class."""
        if not len(linked):
            return []
        labels, at = np.unique(self.label[linked], return_index=True)
        fresh = labels != self.label[i]
        if not fresh.any():
            return []
        self.label[np.isin(self.label, labels[fresh])] = self.label[i]
        to = self.node[linked[at[fresh]]]
        return [(np.full(len(to), self.node[i]), to)]

    def add_visits(self, node: np.ndarray, words: np.ndarray) -> list:
        """A link from each visitor to a home near it, and links that join classes of homes through visitors."""
        if not len(node) or not len(self.node):
            return []
        out = []
        if len(self.node) == 1:
            hit = node[self.near(self.words[0], words)]
            return [(np.full(len(hit), self.node[0]), hit)] if len(hit) else []
        label = np.full(len(node), -1)
        for i in range(len(self.node)):
            hit = np.flatnonzero(self.near(self.words[i], words))
            if not len(hit):
                continue
            new = hit[label[hit] < 0]
            old = hit[label[hit] >= 0]
            merged, at = np.unique(label[old], return_index=True)
            fresh = merged != self.label[i]
            join = np.concatenate([new, old[at[fresh]]])
            if len(join):
                out.append((np.full(len(join), self.node[i]), node[join]))
            if fresh.any():
                gone = merged[fresh]
                self.label[np.isin(self.label, gone)] = self.label[i]
                label[np.isin(label, gone)] = self.label[i]
            label[new] = self.label[i]
        return out


def least_of(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """node, component_id: the least ``name`` of ``rows`` (node, ``name``) that links ``found`` (u, v) reach over any path."""
    own = stored(rows.groupBy("node").agg(F.min(name).alias("least")), "nodes")
    reached = own.join(connected(found), "node")
    least = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = reached.select("node", "root").join(least, "root").select("node", "component_id")
    whole = own.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return stored(whole, "classes")


def simhash_components(docs: DataFrame, words: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: links are at most ``threshold`` (0 to 2) differing bits."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors' tables cover thresholds from 0 to 2")
    marked = stored(fingerprints(docs, words, id_col, text_col), "fingerprints").withColumn("node", F.col("fp"))
    found = links(stored(marked.select("node", "fp").distinct(), "distinct"), [(0, BLOCK)], threshold, threshold)
    return marked.join(least_of(marked, found, "doc_id"), "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
