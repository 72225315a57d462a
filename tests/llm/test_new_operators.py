"""Manifest, SentencePiece and divergence against SQL, the library and brute force; long texts and broken archives."""

import gzip
import hashlib
import random
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import rows_of
from pyspark.sql import functions as F
from test_operators import DOCS, ODD

from tidemark.llm import divergence, fingerprints, merkle, near_copies, queries, secret_scan, sentence_pieces, simhash, warc

MODEL = public_tokenizers.path(queries.PIECE_BPE)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 7) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def in_duck(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    return con


# Manifest


def test_manifest_on_odd_tables(spark, odd, none):
    mine = lambda d, *size: rows_of(merkle.manifest(d, merkle.tampered(d), *size).toPandas())
    theirs = rows_of(in_duck(ODD).execute(merkle.manifest_sql()).fetchdf())
    for size in (), (3, 100), (3, 2), (9, 1):
        assert mine(odd, *size) == theirs
    assert mine(none) == []
    one = spark.createDataFrame([(*ODD[3], "clash", 7)], DOCS)
    [row] = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("size", [(3, 4), (9, 10), (27, 2000)], ids=str)
def test_manifest_of_one_large_and_many_small_sources(spark, size):
    """More sources than the driver's tree may have nodes: subroots go through rounds of their own."""
    rows = [(i, f"text {i}\nx", "en", "hot" if i % 3 == 0 else f"s{i % 40}" if i % 3 == 1 else None, i % 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert rows_of(merkle.manifest(docs, merkle.tampered(docs), *size).toPandas()) == rows_of(in_duck(rows).execute(merkle.manifest_sql()).fetchdf())


def test_manifest_finds_any_change(spark):
    rows = [(i, "text", "en", f"s{i % 2}", 4) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    other = docs.withColumn("shown", F.when(F.col("doc_id") == 7, "Text").when(F.col("doc_id") == 8, None).otherwise(F.col("text")))
    found = merkle.manifest(docs, other, 9).where("not verified").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in found) == [7, 8]


# SentencePiece


def odd_texts():
    rnd = random.Random(7)
    letters = [*"abcdeinrst .,\n éß日ü0123()<>_", "▁", "the", "ing", "  ", "\t", "\x00", "🙂"]
    return [
        "", " ", "  ", "   a  b ", "▁", "▁▁ a▁b", "\n\n\t x", "a\x00b", "🙂é日本語", "x" * 3000, " " * 100, "hello<s></s><0x0A> <unk>", "è", "\U0010ffff", "aaaa" * 50,
        *("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(2000)),
    ]


def test_pieces_are_the_librarys():
    own, library = sentence_pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(8)
    names = list(own.id_of)
    texts = odd_texts() + ["".join(rnd.choice(names) for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode(text), text
        assert own.decode([*ids, own.end]) == library.decode([*ids, own.end])
    for _ in range(2000):
        ids = [rnd.randrange(own.size) if rnd.random() < 0.5 else rnd.randrange(262) for _ in range(rnd.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_every_prefix_has_the_token_that_merging_gives():
    """The table against plain merging, also of pieces that merging never makes."""
    own = sentence_pieces.Pieces(MODEL)

    def merged(text):
        symbols = list(text)
        while pairs := [(-own.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in own.score]:
            _, i = min(pairs)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return [i for s in symbols for i in ([own.id_of[s]] if s in own.id_of else [own.byte[b] for b in s.encode()])]

    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choice("▁▁aehilnorst日é") for _ in range(rnd.randrange(1, 40)))
        assert own.part(text) == merged(text)
        assert all(own.part(text[:k]) == merged(text[:k]) for k in range(1, len(text)))


def test_pieces_on_odd_tables(spark, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    clash = odd.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    found = sentence_pieces.encode_and_decode(clash, MODEL)
    assert set(found.columns) == {*odd.columns, "ids", "decoded"}
    rows = found.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "", add_eos=True) and r["decoded"] == library.decode(r["ids"])
    apart = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(odd, MODEL), MODEL)
    assert rows_of(apart.select("doc_id", "decoded").toPandas()) == rows_of(found.select("doc_id", "decoded").toPandas())
    nulls = spark.createDataFrame([(None,), ([],), ([2],)], "ids array<int>")
    assert [r["decoded"] for r in sentence_pieces.decode_pieces(nulls, MODEL).collect()] == ["", "", ""]
    assert sentence_pieces.piece_digests(sentence_pieces.encode_and_decode(none.select("doc_id", "text"), MODEL)).count() == 0
    with pytest.raises(ValueError):
        sentence_pieces.Pieces(MODEL).decode([10**6])


def test_other_models_are_refused(tmp_path):
    model = sentence_pieces.read_model(MODEL)
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="remove_extra_whitespaces"):
        sentence_pieces.read_model(str(path))


# Divergence


def brute(rows, least=3, ranks=200):
    """The contract read literally, with Python's whole numbers."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    import re

    own = [(lang or "", source or "", [t.translate(low) for t in re.findall(divergence.TERM, text or "")]) for _, text, lang, source, _ in rows]
    out = []
    for lang in {x[0] for x in own}:
        docs = Counter(t for x in own if x[0] == lang for t in set(x[2]))
        kept = sorted(t for t, n in docs.items() if n >= least)
        n = {s: Counter() for s in {x[1] for x in own if x[0] == lang}}
        for x in own:
            if x[0] == lang:
                n[x[1]].update(t for t in x[2] if docs[t] >= least)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        share, q = {s: p(c) for s, c in n.items()}, p(sum(n.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in n:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in n if o != s]
            terms = [(-f(share[s][t], q[t]), t.encode(), t) for t in kept if n[s][t] and share[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


def found(docs, *sizes):
    return sorted(tuple(r) for r in divergence.source_divergence(docs, *sizes).collect())


def test_divergence_on_odd_tables(spark, odd, none):
    assert found(odd) == brute(ODD) and found(none) == []
    assert found(odd, 1, 2) == brute(ODD, 1, 2)
    con = in_duck(ODD)
    assert rows_of(con.execute(divergence.SQL).fetchdf()) == rows_of(divergence.source_divergence(odd).toPandas())
    few = spark.createDataFrame([(1, "a", "en", "x", 1), (2, "b", "en", "y", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(few) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_divergence_of_many_sources_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["Über", "über", "ÜBER", *(f"w{'abcdefghij'[i % 10]}{'klmno'[i % 5]}" for i in range(60)), "HOT"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30))) + " hot" * (i % 5), "de" if i % 4 else None, "big" if i % 3 == 0 else f"s{rnd.randrange(25)}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = brute(rows, 3, 5)
    assert found(docs, 3, 5) == wanted
    vectors = divergence.distinct_vectors(divergence.kept_terms(docs), 5)
    groups = divergence.totals(docs, vectors)
    for cells in 60, 200:
        pairs = divergence.ranked(divergence.evaluated(vectors, groups, cells), "pair")
        assert sorted(map(tuple, pairs.collect())) == [r for r in wanted if r[2] == "pair"]
    monkeypatch.setattr(divergence, "GROUPS", 3)
    with pytest.raises(ValueError, match="groups"):
        divergence.evaluated(vectors, groups)


def test_terms_of_a_text_in_steps(monkeypatch):
    text = ("Straße,\x00Über " * 50 + "x" * 500 + " É1é") .encode()
    whole = [t for some in divergence.terms_of(text) for t in some]
    monkeypatch.setattr(divergence, "STEP", 7)
    steps = list(divergence.terms_of(text))
    assert [t for some in steps for t in some] == whole and len(steps) > 20 and b"x" * 500 in whole and "Über".encode() in whole


def test_shares_are_exact_for_large_counts(spark):
    """Counts beyond what a long times 10^9 holds."""
    big = 9_223_372_036_854_775_000
    cases = [(big, big, 1), (3 * 10**17 + 7, big - 5, 900), (0, big - 10**6, 10**6), (5, 20, 3)]
    rows = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // (r["n"] + r["v"]) for r in rows.collect())


# Secrets in long texts


@pytest.mark.parametrize("unit", [" ", "\n", "\\n", "\\r\\n", "\t", "Proc-Type: 4,ENCRYPTED\n", "-----BEGIN PRIVATE KEY-----\n", "-----END PRIVATE KEY-----", "A ", "QUJD"], ids=repr)
def test_a_long_text_behind_a_key_marker_is_scanned_in_linear_time(unit):
    for head, tail in (("-----BEGIN PRIVATE KEY-----", ""), ("-----BEGIN ", ""), ("-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----")):
        began = time.perf_counter()
        assert "pem" not in [k for k, *_ in secret_scan.confirmed_spans(head + unit * (1_000_000 // len(unit)) + tail)]
        assert time.perf_counter() - began < 3


def test_markers_that_do_not_fit_are_no_block():
    from test_operators import RSA
    import base64

    body = base64.b64encode(RSA).decode()
    spans = lambda t: [k for k, *_ in secret_scan.confirmed_spans(t) if k == "pem"]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END RSA PRIVATE KEY-----"
    assert spans(begin + body + end) == ["pem"] and spans(begin + begin + body + end + end + begin + body + end) == ["pem"] * 2
    assert not spans(begin + body + end.replace("RSA", "DSA")) and not spans(begin + body) and not spans(end + body + begin)
    assert not spans(begin + body + "\n-\n" + end)


def test_spans_within_others():
    rnd = random.Random(5)
    for _ in range(200):
        spans = [(a, a + rnd.randrange(1, 20)) for a in (rnd.randrange(40) for _ in range(rnd.randrange(6)))]
        covered = secret_scan.Covered(spans)
        for a in range(42):
            for b in range(a, 60, 3):
                assert covered.has(a, b) == any(s <= a and b <= e for s, e in spans)


# Archives with leftovers


def test_leftovers_and_broken_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i % 3}", f"{'page' * 40}{i % 4}") for i in range(20)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    warc.write_archives(pages, folder)
    before = rows_of(warc.resolve_revisits(warc.read_archives(spark, folder, False)).toPandas())
    assert len(before) == 20
    whole = sorted((tmp_path / "a").glob("*.warc.gz"))[0]
    for cut in len(whole.read_bytes()), 100:  # what attempts that were lost leave behind
        (tmp_path / "a" / f"{whole.name}.{cut:032x}.tmp").write_bytes(whole.read_bytes()[:cut])
    assert rows_of(warc.resolve_revisits(warc.read_archives(spark, folder, False)).toPandas()) == before
    assert warc.read_archives(spark, folder).where("error is not null").count() == 0
    (tmp_path / "a" / "cut.warc.gz").write_bytes(whole.read_bytes()[:-40])
    (tmp_path / "a" / "no.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: seven\r\nX-Target-Text: {\r\nContent-Length: 2\r\n\r\nab\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nab")
    (tmp_path / "a" / "junk.warc.gz").write_bytes(gzip.compress(b"no archive\n"))
    read = warc.read_archives(spark, folder)
    wrong = {r["error"].rpartition("/")[2].split(":")[0] for r in read.where("record_type = 'malformed'").collect()}
    assert wrong == {"cut.warc.gz", "no.warc", "junk.warc.gz"}
    assert read.where("record_type = 'response' and page_id is null").count() == 1


def test_equal_record_ids_resolve_alike(spark):
    """Of responses with one id the least page is meant, in whatever order they come."""
    kinds = "page_id long, payload_bytes long, payload_digest string, stated_digest string, record_id string, record_type string, refers_to_record string, payload binary, error string"
    rows = [(9, 3, "c", "x", "<r>", "response", None, None, None), (4, 1, "a", "y", "<r>", "response", None, None, None), (5, None, None, None, "<s>", "revisit", "<r>", None, None)]
    for order in rows, rows[::-1]:
        [row] = warc.resolve_revisits(spark.createDataFrame(order, kinds)).where("record_type = 'revisit'").collect()
        assert (row["refers_to"], row["payload_bytes"], row["payload_digest"]) == (4, 1, "a")


# Near copies by exact similarity


def exact_pairs(rows, limit):
    """(u, v) -> cosine of all pairs of different texts at the limit or more, by their sets of five-word shingles: a join on each set's rarest
    shingles, of which such pairs share one, then the whole sets."""
    of = {}
    for doc, text in rows:
        of.setdefault(text, doc)
    texts = [t for t in of if len(simhash.combined_hashes(t, 5))]
    sets = [np.unique(simhash.combined_hashes(t, 5)) for t in texts]
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners, at = {}, 0
    for i, own in enumerate(sets):
        mine = code[at : at + len(own)]
        at += len(own)
        for c in mine[np.lexsort((mine, n[mine]))][: len(own) - int(np.ceil(limit**2 * len(own))) + 1].tolist():
            owners.setdefault(c, []).append(i)
    found = {}
    for a, b in {(a, b) for some in owners.values() for k, a in enumerate(some) for b in some[k + 1 :]}:
        cosine = len(np.intersect1d(sets[a], sets[b], assume_unique=True)) / np.sqrt(len(sets[a]) * len(sets[b]))
        if cosine >= limit:
            found[of[texts[a]], of[texts[b]]] = cosine
    return found


def test_near_copies_are_found_in_every_band_from_the_limit_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    pairs = exact_pairs([(r["doc_id"], r["text"] or "") for r in docs.collect()], near_copies.SIMILARITY)
    of = {r["doc_id"]: r["c"] for r in near_copies.near_classes(docs).select("doc_id", F.col("component_id.doc_id").alias("c")).collect()}
    together = np.array([(cosine, of[a] == of[b]) for (a, b), cosine in pairs.items()])
    assert len(together) > 300
    for low, high in (0.80, 0.825), (0.825, 0.85), (0.85, 0.9), (0.9, 1.01):
        band = together[(together[:, 0] >= low) & (together[:, 0] < high), 1]
        assert len(band) >= 20 and band.mean() >= 0.9, (low, band.mean(), len(band))


def test_ids_are_cut_by_a_bounded_sample(spark, none, monkeypatch):
    ids = spark.range(20_000).select((F.col("id") * 7 - 900).alias("doc_id")).union(spark.createDataFrame([(None,)] * 3, "doc_id bigint"))
    monkeypatch.setattr(fingerprints, "SAMPLED", 20)
    for least, rows, most, parts in ((4, 1000, 10**6, 20), (8, 50_000, 10**6, 8), (4, 100, 1000, 50)):
        cuts = fingerprints.cut_ids(ids, least, rows, most)
        sizes = np.bincount(np.searchsorted(cuts, np.arange(20_000) * 7 - 900))
        assert len(cuts) == parts and cuts[-1] == 19_999 * 7 - 900 and sizes.max() < 3 * 20_000 / parts
    assert list(fingerprints.cut_ids(none.select("doc_id"), 4)) == []
    same = spark.createDataFrame([(5,)] * 50, "doc_id bigint")
    assert list(fingerprints.cut_ids(same, 4)) == [5]


# Written manifests


def test_a_written_manifest_proves_rows_and_finds_differences(spark, none, tmp_path):
    rows = [(i, f"text {i}", "en", f"s{i % 3}" if i % 4 else None, i) for i in range(200)] + [(7, "again", "en", "s1", 0), (None, "no id", "en", "s1", 0)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, kinds)
    root = merkle.write_manifest(docs, f"file://{tmp_path}/a", 9, 6)
    shown = {(r["doc_id"], r["leaf"]): r for r in merkle.manifest(docs, None, 9, 6).collect()}
    assert {r["root"] for r in shown.values()} == {root} == {merkle.root_of(spark, f"file://{tmp_path}/a")}
    for source, doc, n in (("s1", 7, 2), ("s2", 5, 1), (None, 8, 1), ("s1", None, 1), ("s1", 5, 0)):
        proofs = merkle.proof_of(spark, f"file://{tmp_path}/a", source, doc)
        assert len(proofs) == n
        for leaf, siblings in proofs:
            assert merkle.follows(leaf, siblings, root) and not merkle.follows(leaf[::-1], siblings, root)
            assert hashlib.sha256("".join(a + b for a, b in siblings).encode()).hexdigest() == shown[doc, leaf]["proof_sha256"]
    other = [r for r in rows if r[0] != 50] + [(1000, "new", "en", "s0", 1), (1001, "new", "en", "s9", 1)]
    other = [(r[0], "changed", *r[2:]) if r[0] in (11, 120) else r for r in other]
    merkle.write_manifest(spark.createDataFrame(other, kinds), f"file://{tmp_path}/b", 9, 6)
    found = sorted(map(str, (tuple(r) for r in merkle.differences(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").collect())))
    of = {r[0]: r[3] for r in rows}
    assert found == sorted(map(str, [(of[11], 11, "changed"), (of[120], 120, "changed"), (of[50], 50, "removed"), ("s0", 1000, "added"), ("s9", 1001, "added")]))
    assert merkle.differences(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/a").count() == 0
    assert merkle.write_manifest(none, f"file://{tmp_path}/none") is None
