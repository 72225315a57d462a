"""Exact top-k search by BM25 over an inverted index in shards, with block-max WAND pruning.

Index. Every task turns its documents into segments: files in the shared folder with sorted term hashes,
their posting lists (document, frequency), document lengths and ids. Segments are grouped into shards of a bounded
size. Document frequencies and lengths are summed over all segments, so every shard scores with global statistics.

Search. Queries are dealt into blocks; a task takes one block and a few shards in turn. Like documents of a shard form a group, and
lie in blocks of ``BLOCK``; every list that is long in a group is also there as a row of scores, with its maximum in each block. Queries that are like
the same group and of like length are answered together: a list that many of them ask for is taken as a row, by a matrix product for all of them, the
others posting by posting. For a query the maxima of its rows and its sum of the other lists bound what a document can score (the weak-and test).
Groups in which few of the queries may find something keep this bound; in groups that the queries are like, where maxima exclude next to nothing,
the product takes the rows themselves, so that the bound is the score. Documents whose bound reaches the threshold are pivots, the others are
skipped. The threshold is the k-th best score so far, also of the shards before; pivots are scored from the highest bound on, in
rounds, and each round raises the threshold until no bound reaches it. The k best of every task are merged by score into the k best of all.

Scores. A term counts once in a query. Its part of a score, ``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) /
(tf + K1 * (1 - B + B * length / mean length))``, is rounded to a multiple of 1 / ``UNIT``; sums are then exact
in any order, ties are true ties and go to the smaller doc_id. Terms are lower-cased runs of letters and digits.
They are told apart by two 64-bit hashes. A score of 0 units is no match.

Edge cases: a null or empty text has no terms: as a document it is never found, as a query it has no rows; a
document that shares no term with a query isn't found; fewer than k matches give fewer rows; rows that share a query id
are one query with the terms of all, as are those with a null one; repeated documents are found each; a null doc_id
comes last in a tie; only the named columns are read, so extra columns cannot clash; empty tables give no rows;
texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stored
from tidemark.llm.files import opened, replaced

K1, B, UNIT = 1.2, 0.75, 1 << 16
TERM_BREAK = r"[^\p{L}\p{N}]+"
#: Size of a segment and of a shard: postings (in a segment still words) and 128 for each document.
SEGMENT, SHARD, PER_DOC = 4_000_000, 10_000_000, 128
#: Queries in a block, queries whose bounds are computed together, documents in a block.
QUERIES, TOGETHER, BLOCK = 16_384, 256, 4
#: Shards that a task takes in turn: at least, and at most where there are so many tasks for each core.
IN_TURN, MOST_IN_TURN, TASKS = 2, 16, 4
#: Documents of a query's first round; each round is twice the one before.
FIRST = 64
#: A list is long in a group if it has one in so many of its documents, or fewer where more scores of long lists than a shard may hold come of it.
LONG, LONG_SCORES = 32, 14_000_000
#: A posting costs as much as so many cells of a product; stretches of fewer postings are copied together.
ROW, FEW = 350, 64
#: A group is scored by a product for so many queries at least, if one in so many may find documents there.
MANY, LIKE = 128, 8
#: Groups of a shard's documents at most, terms that tell them apart, and rounds.
GROUPS, FEATURES, ROUNDS = 16, 256, 5
NO_ID = -(2**63)


def first_hash(term: Column) -> Column:
    return F.xxhash64(term)


def term_hashes(df: DataFrame, id_col: str, text_col: str, out: str, once: bool = False) -> DataFrame:
    """``out``, h, g: two hashes of each term of the text in order, or of each distinct one."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TERM_BREAK), lambda x: x != "")
    cut = df.select(F.col(id_col).alias(out), (F.array_distinct(words) if once else words).alias("w"))
    return cut.select(out, F.transform("w", first_hash).alias("h"), F.transform("w", lambda x: F.xxhash64(F.lit(1), x)).alias("g"))


def distinct_terms(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hashes, in order, and which of them each is."""
    terms, first, at = np.unique(h, return_index=True, return_inverse=True)
    checks = g[first]
    if (checks[at] == g).all():
        return terms, checks, at
    pairs, at = np.unique(np.column_stack([h, g]), axis=0, return_inverse=True)  # two terms with one h
    return pairs[:, 0].copy(), pairs[:, 1].copy(), at.ravel()


def positions(terms: np.ndarray, checks: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where pairs of hashes are in sorted pairs, -1 for those that aren't."""
    at = np.searchsorted(terms, h)
    while True:
        near = np.minimum(at, len(terms) - 1)
        same = (at < len(terms)) & (terms[near] == h)
        other = same & (checks[near] != g)
        if not other.any():
            return np.where(same, at, -1)
        at = at + other


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    with replaced(uri) as out:
        np.savez(out, **arrays)


def get(uri: str) -> dict[str, np.ndarray]:
    files, path = opened(uri)
    with files.open_input_file(path) as f, np.load(f) as found:
        return dict(found)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the length of each list."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)


SEGMENT_ROWS = pa.schema([("segment", pa.string()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("size", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("df", pa.int64())])


def write_segments(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each segment (h null) and each of its terms (n_docs null), as SEGMENT_ROWS says."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            ids, lengths, h, g = (np.concatenate(x) for x in zip(*held))
            terms, checks, at = distinct_terms(h, g)
            pair, tf = np.unique(at * np.int64(len(ids)) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
            term, doc = np.divmod(pair, max(1, len(ids)))
            df = np.bincount(term, minlength=len(terms))
            name = f"{folder}/segment-{TaskContext.get().partitionId():06d}-{number:04d}.npz"
            put(name, {"ids": ids, "lengths": lengths.astype("<i4"), "terms": terms, "checks": checks, "df": df.astype("<i4"), "doc": doc.astype("<i4"), "tf": tf.astype("<i4")})
            yield pa.RecordBatch.from_pydict({"segment": [name], "n_docs": [len(ids)], "n_words": [int(lengths.sum())], "size": [len(pair) + PER_DOC * len(ids)], "h": [None], "g": [None], "df": [None]}, SEGMENT_ROWS)
            none = pa.nulls(len(terms))
            yield pa.RecordBatch.from_arrays([none.cast(pa.string()), *[none.cast(pa.int64())] * 3, pa.array(terms), pa.array(checks), pa.array(df)], schema=SEGMENT_ROWS)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                h, lengths = flat(part.column("h"))
                held.append((part.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(), lengths, h, flat(part.column("g"))[0]))
                size += len(h) + PER_DOC * part.num_rows
                if size >= SEGMENT:
                    yield from flushed()
                    held.clear()
                    size, number = 0, number + 1
        if held:
            yield from flushed()

    hashed = term_hashes(docs, id_col, text_col, "doc_id")
    return hashed.mapInArrow(write, "segment string, n_docs bigint, n_words bigint, size bigint, h bigint, g bigint, df bigint")


class Index:
    """A written index: its shards, document frequencies and global counts."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.folder = scratch(docs.sparkSession, "index")
        rows = stored(write_segments(docs, self.folder, id_col, text_col), "segments")
        segments = rows.where("segment is not null")
        self.n_docs, words = (x or 0 for x in segments.agg(F.sum("n_docs"), F.sum("n_words")).first())
        self.mean = max(words / max(1, self.n_docs), 1e-9)
        # One row a segment; a shard's segments are a bounded list.
        end = F.sum("size").over(W.orderBy("segment").rowsBetween(W.unboundedPreceding, 0))
        shards = segments.withColumn("shard", F.floor((end - 1) / SHARD)).groupBy("shard").agg(F.sort_array(F.collect_list("segment")).alias("segments"))
        self.shards = stored(shards, "shards")
        self.df = rows.where("h is not null").groupBy("h", "g").agg(F.sum("df").alias("df"))

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(float(self.n_docs)) - df + 0.5) / (df + 0.5))


def write_queries(index: Index, queries: DataFrame, folder: str, id_col: str, text_col: str) -> int:
    """Writes each block's queries and its terms' idf; returns the number of blocks."""
    hashed = term_hashes(queries, id_col, text_col, "query_id", once=True).where(F.size("h") > 0)
    hashed = stored(hashed, "queries")
    n = max(1, -(-hashed.count() // QUERIES))
    dealt = hashed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"))

    def write(kind: str):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple]] = {}
            for batch in batches:
                block = batch.column("block").to_numpy()
                for b in np.unique(block):
                    own = batch.filter(pa.array(block == b))
                    if kind == "terms":
                        held.setdefault(b, []).append(tuple(own.column(c).to_numpy() for c in ("h", "g", "idf")))
                    else:
                        h, lengths = flat(own.column("h"))
                        held.setdefault(b, []).append((own.column("query_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(), lengths, h, flat(own.column("g"))[0]))
            for b, parts in held.items():
                put(f"{folder}/{kind}-{b:06d}.npz", {f"a{i}": np.concatenate(x) for i, x in enumerate(zip(*parts))})
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32())})

        return run

    pairs = dealt.select("block", F.explode(F.arrays_zip("h", "g")).alias("term")).select("block", "term.h", "term.g").distinct()
    terms = pairs.join(index.df, ["h", "g"]).select("block", "h", "g", index.idf(F.col("df")).alias("idf"))
    for kind, rows in (("terms", terms), ("queries", dealt.select("block", "query_id", "h", "g"))):
        rows.repartition("block").mapInArrow(write(kind), "block int").write.parquet(f"{folder}/{kind}-written")
    return n


def groups(term: np.ndarray, doc: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """The group of like documents that each is in: spherical k-means on their common terms from documents at even distances, without small groups.

    Postings are in the order of their terms.
    """
    count = np.bincount(term, minlength=len(idf))
    common = np.argsort(-count, kind="stable")[:FEATURES]
    common = common[count[common] * LONG > n]
    ends = np.cumsum(count)
    features = np.zeros((n, len(common)), np.float32)
    for c, t in enumerate(common):
        features[doc[ends[t] - count[t] : ends[t]], c] = idf[t]
    features /= np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-9)
    centres = features[np.linspace(0, n - 1, min(n, GROUPS)).astype(np.int64)]
    for _ in range(ROUNDS):
        group = (features @ centres.T).argmax(axis=1)
        mine = group == np.arange(len(centres))[:, None]
        centres = mine[mine.sum(axis=1) * GROUPS * 4 >= n].astype(np.float32) @ features
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.unique((features @ centres.T).argmax(axis=1), return_inverse=True)[1]


class Shard:
    """A shard's lists for the terms of a block of queries, with scores in units. Its documents lie by group, so that a block has documents of one group."""

    def __init__(self, segments: list[str], terms: np.ndarray, checks: np.ndarray, idf: np.ndarray, mean: float):
        term, doc, score, ids, lengths, n = [], [], [], [], [], 0
        for s in map(get, segments):
            at = positions(terms, checks, s["terms"], s["checks"])
            known = at >= 0
            keep = np.repeat(known, s["df"])
            term.append(np.repeat(at[known].astype(np.int32), s["df"][known]))
            doc.append(s["doc"][keep] + np.int32(n))
            tf, norm = s["tf"][keep], K1 * (1 - B + B * s["lengths"] / mean)
            score.append(np.rint(idf[term[-1]] * (tf * (K1 + 1) / (tf + norm[s["doc"][keep]])) * UNIT).astype(np.float32))
            ids.append(s["ids"])
            lengths.append(s["lengths"])
            n += len(s["ids"])
        term, ids, lengths = map(np.concatenate, (term, ids, lengths))
        order = np.argsort(term, kind="stable")
        term = term[order]
        doc = np.concatenate(doc)[order]
        score = np.concatenate(score)[order]
        del order

        # Like documents become neighbours: by group, then by length. A group begins with a block; the first documents of its blocks come first, then the second ones.
        group = groups(term, doc, idf, n)
        sizes = np.bincount(group)
        self.blocks = -(-sizes // BLOCK)
        self.ends = np.cumsum(self.blocks) * BLOCK
        self.begins = self.ends - self.blocks * BLOCK
        rank = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.empty(n, np.int32)
        place[np.lexsort((lengths, group))] = np.repeat(self.begins, sizes) + rank % BLOCK * np.repeat(self.blocks, sizes) + rank // BLOCK
        self.n, self.ids = n, np.full(self.ends[-1], NO_ID)
        self.ids[place] = ids

        # Each group's long lists, as rows of scores: those with one in so many documents that all fit.
        of = group[doc].astype(np.int16)
        doc = place[doc]
        count = np.bincount(term * np.int64(len(sizes)) + of, minlength=len(terms) * len(sizes)).astype(np.int32).reshape(-1, len(sizes))
        rate = LONG
        while (long := count * rate > sizes).sum(axis=0) @ (self.ends - self.begins) > LONG_SCORES or long.sum(axis=0).max() >= 2**15:
            rate *= 0.8
        self.column = np.where(long, np.cumsum(long, axis=0, dtype=np.int16) - np.int16(1), np.int16(-1))
        #: The documents of the groups in which a list is long.
        self.spread = long @ (self.ends - self.begins)
        self.long, self.maxima = [], []
        column = self.column[term, of]
        inside = column >= 0
        at = np.flatnonzero(inside)
        for g, blocks in enumerate(self.blocks):
            own = at[of[at] == g]
            rows = np.zeros((int(long[:, g].sum()), blocks * BLOCK), np.float32)
            rows[column[own], doc[own] - self.begins[g]] = score[own]
            self.long.append(rows)
            self.maxima.append(rows.reshape(-1, BLOCK, blocks).max(axis=1))
        del count, long, of, column, at
        # All postings, list by list, a document and the bits of its score: first of the groups in which the list isn't long.
        order = np.argsort(term * np.int32(2) + inside, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        self.cuts = self.starts[1:] - np.bincount(term[inside], minlength=len(terms))
        self.postings = np.empty((len(order), 2), np.int32)
        self.postings[:, 0] = doc[order]
        self.postings.view(np.float32)[:, 1] = score[order]
        self.postings = self.postings.view(np.int64).ravel()
        #: Documents scored in full so far, one by one and in products.
        self.scored = 0

    def search(self, queries: list[np.ndarray], k: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's position, ids, scores in units) of the k best that reach the query's known threshold; queries are positions of terms."""
        lengths, likest = np.array([len(q) for q in queries], np.int64), np.zeros(len(queries), np.int64)
        for at in range(0, len(queries), 1024):
            some = queries[at : at + 1024]
            hits = np.add.reduceat(self.column[np.concatenate([*some, [0]])] >= 0, np.cumsum([0, *map(len, some[:-1])]), dtype=np.int32)
            likest[at : at + 1024] = hits.argmax(axis=1)
        order = np.lexsort((lengths, likest))
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            owner, terms = np.repeat(np.arange(len(some)), lengths[some]), np.concatenate([queries[q] for q in some])
            # A list is used as a row where that costs less than its postings, query by query.
            asked, which, times = np.unique(terms, return_inverse=True, return_counts=True)
            rows = times * (self.starts[asked + 1] - self.cuts[asked]) * ROW > len(some) * self.spread[asked]
            asked = asked[rows]
            number = np.cumsum(rows) - 1
            own = rows[which]
            wanted = np.zeros((len(asked), len(some)), np.float32)
            wanted[number[which[own]], owner[own]] = 1
            column = self.column[asked]
            ceilings, parts = np.empty((len(some), len(self.ids)), np.float32), []
            whole = np.zeros(len(self.begins), bool)
            for g, (a, b) in enumerate(zip(self.begins.tolist(), self.ends.tolist())):
                lists = np.flatnonzero(column[:, g] >= 0)
                part, lists = wanted[lists], column[lists, g]
                parts.append((part, lists))
                maxima = self.maxima[g][lists]
                # One product scores all documents of a group if many queries are so like it that they may be found.
                whole[g] = len(some) >= MANY and np.mean(2 * (maxima.max(axis=1, initial=0) @ part) >= known[some]) * LIKE > 1
                if whole[g]:
                    np.matmul(part.T, self.long[g][lists], out=ceilings[:, a:b])
                    self.scored += len(some) * (b - a)
                else:
                    ceilings[:, a:b] = np.tile(part.T @ maxima, BLOCK)
            # A sum of so many float32, none below 0, may differ from the true one by this share.
            error = (max(len(lists) for _, lists in parts) + 8) * 2.0**-23
            whole = np.repeat(whole, self.ends - self.begins)
            start = self.starts[terms]
            size = np.where(rows[which], self.cuts[terms], self.starts[terms + 1]) - start
            for i, (q, sums) in enumerate(zip(some.tolist(), self._sums(owner, start, size, len(some)))):
                ids, units = self._best(sums, ceilings[i], whole, error, lambda g, i=i: parts[g][1][parts[g][0][:, i] > 0], k, known[q])
                if len(ids):
                    yield q, ids, units

    def _sums(self, owner: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """For each query sums of the scores in its stretches of postings, by document."""
        # Short stretches are copied for all queries at once, others one by one.
        few = (size > 0) & (size < FEW)
        count = size[few]
        ends = np.cumsum(count)
        own = self.postings[np.repeat(start[few] - ends + count, count) + np.arange(count.sum())]
        cuts = np.concatenate([[0], ends])[np.searchsorted(owner[few], np.arange(n + 1))].tolist()
        many = size >= FEW
        spans, at = list(zip(start[many].tolist(), (start[many] + size[many]).tolist())), np.searchsorted(owner[many], np.arange(n + 1)).tolist()
        postings = self.postings
        for i in range(n):
            found = np.concatenate([own[cuts[i] : cuts[i + 1]], *[postings[a:b] for a, b in spans[at[i] : at[i + 1]]]])
            yield np.bincount(found.view(np.int32)[::2], found.view(np.float32)[1::2], len(self.ids))

    def _row_sums(self, docs: np.ndarray, lists: Callable[[int], np.ndarray]) -> np.ndarray:
        """Sums of the scores of some documents in some rows of each group."""
        group, out = np.searchsorted(self.ends, docs, side="right"), np.empty(len(docs))
        for g in set(group.tolist()):
            own, rows = np.flatnonzero(group == g), lists(g)[:, None]
            for a in range(0, len(own), 4096):
                some = own[a : a + 4096]
                out[some] = self.long[g][rows, docs[some] - self.begins[g]].sum(axis=0, dtype=np.float64)
        return out

    def _best(self, sums: np.ndarray, bound: np.ndarray, whole: np.ndarray, error: float, lists: Callable[[int], np.ndarray], k: int, known: float) -> tuple[np.ndarray, np.ndarray]:
        """``bound``: the ceilings, to which this adds the sums. Bounds of ``whole`` documents are their scores but for the error."""
        bound += sums
        pivots, size = np.flatnonzero(bound >= known * (1 - error)), FIRST
        if len(pivots) > 2 * k and np.count_nonzero(scored := whole[pivots]) >= k:
            scored = bound[pivots[scored]]
            known = max(known, float(np.partition(scored, len(scored) - k)[len(scored) - k]) * (1 - 2 * error))
            pivots = pivots[bound[pivots] >= known * (1 - error)]
        docs, scores = np.empty(0, np.int64), np.empty(0)
        while len(pivots):
            # Those with the highest bounds.
            if len(pivots) > size:
                high = np.argpartition(bound[pivots], len(pivots) - size)
                some, pivots = pivots[high[len(pivots) - size :]], pivots[high[: len(pivots) - size]]
            else:
                some, pivots = pivots, pivots[:0]
            self.scored += len(some)
            found = sums[some] + self._row_sums(some, lists)
            near = found >= known
            docs, scores = np.concatenate([docs, some[near]]), np.concatenate([scores, found[near]])
            if len(docs) >= k:
                known = np.partition(scores, len(scores) - k)[len(scores) - k]
                docs, scores = docs[scores >= known], scores[scores >= known]
            pivots, size = pivots[bound[pivots] >= known * (1 - error)], 2 * size
        if not len(docs):
            return docs, docs
        ids = self.ids[docs]
        last = np.lexsort((ids, ids == NO_ID, -scores))[:k]
        return ids[last], scores[last].astype(np.int64)


FOUND = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("units", pa.int64())])


def bm25_top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "doc_id",
    query_text_col: str = "text",
) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k documents with the highest BM25 scores of every query."""
    spark = docs.sparkSession
    index = Index(docs, id_col, text_col)
    folder = scratch(spark, "queries")
    n_blocks, mean = write_queries(index, queries, folder, query_id_col, query_text_col), index.mean
    # A stated set of queries against all rows, in blocks: a row for each few shards and block.
    n_shards = index.shards.count()
    in_turn = min(MOST_IN_TURN, max(IN_TURN, n_shards * n_blocks // (TASKS * spark.sparkContext.defaultParallelism)))
    turns = index.shards.groupBy(F.floor(F.col("shard") / in_turn).alias("turn")).agg(F.sort_array(F.collect_list(F.struct("shard", "segments"))).alias("shards"))
    tasks = turns.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tasks = tasks.repartitionByRange(max(1, -(-n_shards // in_turn) * n_blocks), "turn", "block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            files, path = opened(f"{folder}/terms-{row['block']:06d}.npz")
            if not files.get_file_info(path).is_file:
                continue  # no query of the block has a term of any document
            terms, checks, idf = get(f"{folder}/terms-{row['block']:06d}.npz").values()
            order = np.lexsort((checks, terms))
            terms, checks, idf = terms[order], checks[order], idf[order]
            ids, lengths, h, g = get(f"{folder}/queries-{row['block']:06d}.npz").values()
            at = positions(terms, checks, h, g)
            del h, g
            known = at >= 0
            # Rows that share an id are one query.
            owner, row_of = np.unique(ids, return_inverse=True)
            pairs = np.repeat(row_of, lengths)[known] * np.int64(len(terms)) + at[known]
            del at, known
            mine, at = np.divmod(np.unique(pairs), max(1, len(terms)))
            del pairs
            asked = np.split(at.astype(np.int32), np.searchsorted(mine, np.arange(1, len(owner))))
            del mine, at
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(owner)
            threshold = np.ones(len(owner))
            for turn in row["shards"]:
                for query, found, units in Shard(turn["segments"], terms, checks, idf, mean).search(asked, k, threshold):
                    found, units = np.concatenate([best[query][0], found]), np.concatenate([best[query][1], units])
                    last = np.lexsort((found, found == NO_ID, -units))[:k]
                    best[query] = found[last], units[last]
                    if len(last) == k:
                        threshold[query] = units[last[-1]]
            for at in range(0, len(owner), 1024):
                part = best[at : at + 1024]
                query = np.repeat(owner[at : at + 1024], [len(x) for x, _ in part])
                doc, units = (np.concatenate(x) for x in zip(*part))
                yield pa.RecordBatch.from_arrays([pa.array(query, mask=query == NO_ID), pa.array(doc, mask=doc == NO_ID), pa.array(units)], schema=FOUND)

    found = tasks.mapInArrow(search, "query_id bigint, doc_id bigint, units bigint")
    best = W.partitionBy("query_id").orderBy(F.desc("units"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", (F.col("units") / UNIT).alias("score"))


def top_k_sql(k: int = 10) -> str:
    return rf"""
with term as (
  select doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as term
  from documents
), posting as (
  select doc_id, term, count(*) as tf from term group by all
), size as (
  select doc_id, sum(tf) as length from posting group by doc_id
), corpus as (
  select (select count(*) from documents)::double as n, (select sum(length) from size)::double / count(*) as mean from documents
), frequency as (
  select term, count(*)::double as df from posting group by term
), part as (
  select doc_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * length / mean))) * {UNIT})::bigint as units
  from posting join size using (doc_id) join frequency using (term), corpus
), found as (
  select q.doc_id as query_id, d.doc_id, sum(d.units)::bigint as units
  from posting q join part d using (term) where q.doc_id % 20 = 0 group by all having sum(d.units) > 0
)
select query_id, row_number() over (partition by query_id order by units desc, doc_id)::int as rank, doc_id, units / {UNIT}.0::double as score
from found
qualify rank <= {k}
"""
