"""Merkle manifest of a table: subroots by source, one root, a proof for every row and its recomputation.

A row's leaf is the hash of its columns, each with its length; a source's leaves ascend by id, and runs of ``ARITY`` nodes become
one until one is left, the subroot; the subroots, by source, become the root in the same way. A node is the SHA-256 of the lowercase
hexadecimal digests of its run.

Method: the broadcast upper-tree variant. Texts are hashed where they lie and never shuffled. Leaves get their places in their
source from range partitions and prefix sums, so a source with a third of all rows is no single task's. Then each ``BLOCK`` leaves of a
source, a whole subtree, are packed into one row with their root. The few block roots go to the driver, whose upper tree gives every
block the rest of its leaves' paths; these suffixes are broadcast, and executors finish each row's proof and fold from its packed block.
If there are more than ``TOP`` block roots, they are leaves of another distributed round, and so are subroots where sources are that many;
the driver never holds more than ``TOP`` nodes.

Edge cases: a null column counts as ``-``, so it differs from the empty text; null sources are one group, which comes first; within a source a
null id comes first, and rows with one id are ordered by leaf (rows equal in all columns have equal leaves, each with its own place);
texts of any length are hashed whole; extra columns are not read; a lone row is its subroot, and a lone subroot the root; an empty
table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

ARITY, LEVELS = 3, 7
BLOCK = ARITY**LEVELS
#: Nodes of the upper tree, whose suffixes are broadcast; a suffix has at most 2 digests of 32 bytes a level.
TOP = ARITY**9
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of all subroots, where they need rounds of their own; sources' trees are named "" or "=<source>".
JOINT = "joint"


def measured(value: Column) -> Column:
    """A value with its length in bytes, - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**columns: Column) -> Column:
    """The hash of a row."""
    return F.sha2(F.concat(*map(measured, columns.values())).cast("binary"), 256)


def joined(digests: Iterable[bytes]) -> bytes:
    return b"".join(d.hex().encode() for d in digests)


def node(digests: Iterable[bytes]) -> bytes:
    return sha256(joined(digests)).digest()


def levels(nodes: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """The nodes and all levels above them: up to a single one, or so many."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        last = out[-1]
        out.append([node(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return out


def path_of(tree: list[list[bytes]], at: int) -> bytes:
    """A node's siblings, level by level: the number of those on its left and on its right, then their digests."""
    out = []
    for level in tree[:-1]:
        first = at - at % ARITY
        left, right = level[first:at], level[at + 1 : first + ARITY]
        out.append(bytes([len(left), len(right), *b"".join(left), *b"".join(right)]))
        at //= ARITY
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The siblings of each level, those on the left and those on the right, as the hexadecimal text that is hashed."""
    at = 0
    while at < len(path):
        left, right = 32 * path[at], 32 * path[at + 1]
        at += 2
        yield path[at : at + left].hex().encode(), path[at + left : at + left + right].hex().encode()
        at += left + right


def folded(digest: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in siblings:
        digest = sha256(left + digest.hex().encode() + right).digest()
    return digest


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, a row's place within its tree in this order, and ``total``, the tree's number of rows.

    A part of the range partitioning numbers its own rows; the parts' counts, a row for each part and tree, are added up.
    """
    own = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id())
    names = [*own.columns, "within"]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = None, 0
        for batch in batches:
            within = []
            for x in batch.column("tree").to_pylist():
                n, tree = (n + 1 if x == tree else 0), x
                within.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within, pa.int64())], names)

    schema = own.withColumn("within", F.lit(0).cast("long")).schema
    numbered = stored(own.mapInArrow(number, schema), "placed")
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    by_part = W.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("n").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select("tree", "part", before.alias("before"), F.sum("n").over(W.partitionBy("tree")).alias("total"))
    return numbered.join(sums, ["tree", "part"]).withColumn("at", F.col("before") + F.col("within")).drop("part", "before", "within")


PACKED = "tree string, block bigint, total bigint, root binary, ids array<bigint>, leaves binary, changed array<int>, tampered binary"


def packed(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block of nodes (tree, at, total, id, leaf, tampered): its root and what it is made of."""
    height = next(h for h in range(64) if ARITY**h >= block)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def made() -> pa.RecordBatch:
            leaves = [r[1] for r in rows]
            changed = [i for i, r in enumerate(rows) if r[2] is not None]
            root = levels(leaves, height if key[2] > block else None)[-1][0]
            row = (*key, root, [r[0] for r in rows], b"".join(leaves), changed, b"".join(rows[i][2] for i in changed))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds)], schema=kinds)

        for batch in batches:
            for tree, number, total, *rest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "total", "id", "leaf", "tampered"))):
                if (tree, number, total) != key:
                    if rows:
                        yield made()
                    key, rows = (tree, number, total), []
                rows.append(rest)
        if rows:
            yield made()

    kinds = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("root", pa.binary()), ("ids", pa.list_(pa.int64())), ("leaves", pa.binary()), ("changed", pa.list_(pa.int32())), ("tampered", pa.binary())])
    dealt = nodes.withColumn("block", F.floor(F.col("at") / block)).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return stored(dealt.mapInArrow(pack, PACKED), "blocks")


def climbed(nodes: DataFrame, block: int, top: int) -> tuple[list[DataFrame], int | None, DataFrame | None]:
    """The packed rounds from the leaves on, until at most ``top`` blocks remain.

    Also which round begins the tree of subroots, if one does, and the places of sources in it.
    """
    rounds, joint, places = [packed(nodes, block)], None, None
    null = F.lit(None)
    while rounds[-1].count() > top:
        last = rounds[-1]
        if joint is None and last.where(F.col("total") > block).isEmpty():
            joint, places = len(rounds), stored(placed(last.select(F.lit(JOINT).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf")), ["name"]), "subroots")
            above = places
        else:
            above = last.select("tree", F.col("block").alias("at"), F.ceil(F.col("total") / block).alias("total"), F.col("root").alias("leaf"))
        rounds.append(packed(above.select("tree", "at", "total", null.cast("long").alias("id"), "leaf", null.cast("binary").alias("tampered")), block))
    return rounds, joint, places


#: What a block's leaves need of the rest of the tree.
SUFFIX = "tree string, block bigint, path binary, subroot binary, top binary"


def upper_tree(blocks: DataFrame, joint: bool) -> DataFrame:
    """SUFFIX of each block of the last round, from the driver's tree over their roots. ``joint``: they are parts of the subroots' tree."""
    trees: dict[str, list[bytes]] = {}
    for r in sorted(blocks.select("tree", "block", "root").collect(), key=lambda r: (r["tree"].encode(), r["block"])):
        trees.setdefault(r["tree"], []).append(bytes(r["root"]))
    own = {name: levels(roots) for name, roots in trees.items()}
    over = levels([t[-1][0] for t in own.values()]) if own else []
    rows = []
    for place, (name, tree) in enumerate(own.items()):
        rest = b"" if joint else path_of(over, place)
        rows += [(name, i, path_of(tree, i) + rest, None if joint else tree[-1][0], over[-1][0]) for i in range(len(tree[0]))]
    return blocks.sparkSession.createDataFrame(rows, SUFFIX)


def with_suffix(blocks: DataFrame, suffixes: DataFrame, small: bool) -> DataFrame:
    return blocks.join(F.broadcast(suffixes) if small else suffixes, ["tree", "block"])


def descended(blocks: DataFrame, block: int) -> DataFrame:
    """SUFFIX of the blocks that are the leaves of these blocks (with their own suffix): tree, and the leaf's place as block."""
    height = next(h for h in range(64) if ARITY**h >= block)

    def open_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            leaves = [r["leaves"][i : i + 32] for i in range(0, len(r["leaves"]), 32)]
            tree = levels(leaves, height if r["total"] > block else None)
            n = len(leaves)
            paths = [path_of(tree, i) + r["path"] for i in range(n)]
            yield pa.RecordBatch.from_pydict({"tree": [r["tree"]] * n, "block": range(r["block"] * block, r["block"] * block + n), "path": paths, "subroot": pa.array([r["subroot"]] * n, pa.binary()), "top": [r["top"]] * n})

    return blocks.select("tree", "block", "total", "leaves", "path", "subroot", "top").mapInArrow(open_blocks, SUFFIX)


RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def finished(blocks: DataFrame, block: int) -> DataFrame:
    """RESULT of the rows in packed blocks with their suffixes."""
    height = next(h for h in range(64) if ARITY**h >= block)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            leaves = [r["leaves"][i : i + 32] for i in range(0, len(r["leaves"]), 32)]
            tree = levels(leaves, height if r["total"] > block else None)
            shown = dict(zip(r["changed"], (r["tampered"][i : i + 32] for i in range(0, len(r["tampered"]), 32))))
            subroot, root = (r["subroot"] or r["root"]).hex(), r["top"]
            rest, out = list(steps(r["path"])), []
            for i, (id, leaf) in enumerate(zip(r["ids"], leaves)):
                siblings = [*steps(path_of(tree, i)), *rest]
                proof = sha256(b"".join(left + right for left, right in siblings)).hexdigest()
                again = folded(shown.get(i, leaf), siblings)
                out.append((id, leaf.hex(), subroot, root.hex(), proof, again.hex(), again == root))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)], names)

    return blocks.mapInArrow(finish, RESULT)


def blocks_of(docs: DataFrame, shown: DataFrame | None = None, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """PACKED blocks of the rows of ``docs`` with their suffixes; shown as in ``manifest``."""
    own = docs if shown is None else shown
    columns = {c: F.col(c) for c in COLUMNS}
    other = F.lit(None).cast("string") if shown is None else F.when(~F.col("shown").eqNullSafe(F.col("text")), leaf_of(**columns | {"text": F.col("shown")}))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = own.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), F.unhex(leaf_of(**columns)).alias("leaf"), F.unhex(other).alias("tampered"))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = placed(leaves, ["id", "leaf", "row"]).drop("row")  # equal rows are told apart, so that they are dealt out too
    rounds, joint, places = climbed(nodes, block, top)
    suffixes, small = upper_tree(rounds[-1], joint is not None), True
    for k in range(len(rounds) - 1, 0, -1):
        suffixes, small = descended(with_suffix(rounds[k], suffixes, small), block), False
        if k == joint:  # the leaves of this round are the subroots
            at = places.select("tree", F.col("at").alias("block"), "name", F.col("leaf").alias("own"))
            suffixes = suffixes.join(at, ["tree", "block"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("own").alias("subroot"), "top")
        suffixes = stored(suffixes, "suffixes")
    return with_suffix(rounds[0], suffixes, small)


def manifest(docs: DataFrame, shown: DataFrame | None = None, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """RESULT of every row of ``docs`` (COLUMNS).

    shown: ``docs`` with a column ``shown``, the text that is checked against the manifest instead of the row's own; null is the own text.
    """
    return finished(blocks_of(docs, shown, block, top), block)


def write_manifest(docs: DataFrame, folder: str, block: int = BLOCK, top: int = TOP) -> str | None:
    """Writes the manifest of a table: a row a block with its leaves, their ids and the rest of their paths. Returns the root; None of an empty table."""
    made = blocks_of(docs, None, block, top).withColumn("size", F.lit(block)).drop("changed", "tampered")
    made.write.partitionBy("size").parquet(folder)
    return root_of(docs.sparkSession, folder)


def _read(spark: SparkSession, folder: str) -> DataFrame:
    kinds = PACKED.replace(", changed array<int>, tampered binary", "") + ", path binary, subroot binary, top binary, size int"
    return spark.read.schema(kinds).parquet(folder)


def root_of(spark: SparkSession, folder: str) -> str | None:
    """The root of a written manifest."""
    first = _read(spark, folder).select(F.lower(F.hex("top")).alias("root")).first()
    return None if first is None else first["root"]


def proof_of(spark: SparkSession, folder: str, source: str | None, doc_id: int | None) -> list[tuple[str, list[tuple[str, str]]]]:
    """(leaf, siblings) of the rows of an id: level by level the digests on the left and on the right, joined, as ``follows`` takes them."""
    held = F.exists("ids", lambda x: x.eqNullSafe(F.lit(doc_id).cast("long")))
    out = []
    for r in _read(spark, folder).where((F.col("tree") == ("" if source is None else f"={source}")) & held).collect():
        leaves = [r["leaves"][i : i + 32] for i in range(0, len(r["leaves"]), 32)]
        height = next(h for h in range(64) if ARITY**h >= r["size"])
        tree = levels([bytes(x) for x in leaves], height if r["total"] > r["size"] else None)
        for i, id in enumerate(r["ids"]):
            if id == doc_id:
                siblings = [*steps(path_of(tree, i)), *steps(bytes(r["path"]))]
                out.append((bytes(leaves[i]).hex(), [(a.decode(), b.decode()) for a, b in siblings]))
    return out


def follows(leaf: str, siblings: list[tuple[str, str]], root: str) -> bool:
    """Whether a leaf and its siblings lead to a root."""
    return folded(bytes.fromhex(leaf), [(a.encode(), b.encode()) for a, b in siblings]).hex() == root


def differences(spark: SparkSession, before: str, after: str) -> DataFrame:
    """source, doc_id, change (added, removed or changed) between two written manifests.

    Blocks with one root at one place are left out before their leaves are read, so what is alike costs a digest a block; rows meet by id. Of
    rows that repeat an id as many are changed as there are on both sides.
    """
    a, b = (_read(spark, f) for f in (before, after))
    same = a.join(b, ["tree", "block", "total", "root"], "left_semi").select("tree", "block")

    def rows(m: DataFrame) -> DataFrame:
        parts = F.expr("transform(sequence(0, size(ids) - 1), i -> struct(ids[i] as id, substring(leaves, 32 * i + 1, 32) as leaf))")
        return m.join(same, ["tree", "block"], "left_anti").select("tree", F.explode(parts).alias("x")).select("tree", "x.id", "x.leaf").groupBy("tree", "id", "leaf").count()

    key = lambda x, y: x["tree"].eqNullSafe(y["tree"]) & x["id"].eqNullSafe(y["id"]) & x["leaf"].eqNullSafe(y["leaf"])
    x, y = rows(a).alias("x"), rows(b).alias("y")
    names = lambda side: {c: F.col(f"{side}.{c}") for c in ("tree", "id", "leaf")}
    both = x.join(y, key(names("x"), names("y")), "full")
    net = both.select(*(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("tree", "id")), (F.coalesce("y.count", F.lit(0)) - F.coalesce("x.count", F.lit(0))).alias("n"))
    sums = net.groupBy("tree", "id").agg(F.sum(F.greatest("n", F.lit(0))).alias("more"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("less"))
    kinds = F.array(F.struct(F.lit("changed").alias("change"), F.least("more", "less").alias("n")), F.struct(F.lit("added").alias("change"), (F.col("more") - F.least("more", "less")).alias("n")), F.struct(F.lit("removed").alias("change"), (F.col("less") - F.least("more", "less")).alias("n")))
    told = sums.select("tree", "id", F.explode(kinds).alias("k")).where("k.n > 0")
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return told.select(source.alias("source"), F.col("id").alias("doc_id"), "k.change", F.explode(F.array_repeat(F.lit(0), F.col("k.n").cast("int"))).alias("copy")).drop("copy")


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with a text to check as ``shown``: without its line ends where 2 divides the CRC-32 of the decimal id, else its own."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select(*COLUMNS).withColumn("shown", F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def manifest_sql() -> str:
    """The same rows in SQL: levels by recursion, each with all nodes."""
    enc = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in COLUMNS) + ")"
    bits = "list_reduce(list_prepend(xor(c, b), [cast(0 as bigint) for i in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), [cast(ascii(d) as bigint) for d in string_split(cast(doc_id as varchar), '')]), lambda c, b: {bits}), 4294967295)"
    return f"""with recursive doc as (
  select row_number() over () as i, *, coalesce('=' || source, '') as tree, {leaf("text")} as leaf,
    case when {crc} % 2 = 0 then {leaf("replace(text, chr(10), '')")} end as shown
  from documents
), d as (
  select i, doc_id, tree, leaf, coalesce(shown, leaf) as shown, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as total from doc
), own as (
  select 0 as lvl, tree, pos, leaf as digest, total from d
  union all
  select lvl + 1, tree, pos // 3, sha256(string_agg(digest, '' order by pos)), (any_value(total) + 2) // 3 from own where total > 1 group by lvl, tree, pos // 3
), sub as (
  select tree, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as total from own where total = 1
), over_all as (
  select 0 as lvl, pos, digest, total from sub
  union all
  select lvl + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (any_value(total) + 2) // 3 from over_all where total > 1 group by lvl, pos // 3
), top as (select digest as root from over_all where total = 1
), step as (
  select d.i, 0 as part, n.lvl, coalesce(string_agg(s.digest, '' order by s.pos) filter (where s.pos < n.pos), '') as l, coalesce(string_agg(s.digest, '' order by s.pos) filter (where s.pos > n.pos), '') as r
  from d join own n on n.tree = d.tree and n.total > 1 and n.pos = d.pos // cast(pow(3, n.lvl) as bigint)
  join own s on s.tree = n.tree and s.lvl = n.lvl and s.pos // 3 = n.pos // 3
  group by d.i, n.lvl, n.pos
  union all
  select d.i, 1, n.lvl, coalesce(string_agg(s.digest, '' order by s.pos) filter (where s.pos < n.pos), ''), coalesce(string_agg(s.digest, '' order by s.pos) filter (where s.pos > n.pos), '')
  from d join sub on sub.tree = d.tree join over_all n on n.total > 1 and n.pos = sub.pos // cast(pow(3, n.lvl) as bigint)
  join over_all s on s.lvl = n.lvl and s.pos // 3 = n.pos // 3
  group by d.i, n.lvl, n.pos
), numbered as (
  select *, row_number() over (partition by i order by part, lvl) as k from step
), proof as (
  select i, sha256(string_agg(l || r, '' order by k)) as proof_sha256 from numbered group by i
), fold as (
  select i, cast(0 as bigint) as k, shown as digest from d
  union all
  select f.i, n.k, sha256(n.l || f.digest || n.r) from fold f join numbered n on n.i = f.i and n.k = f.k + 1
), last_fold as (
  select i, arg_max(digest, k) as folded_root from fold group by i
)
select d.doc_id, d.leaf, sub.digest as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from d join sub on sub.tree = d.tree cross join top join last_fold on last_fold.i = d.i left join proof on proof.i = d.i"""
