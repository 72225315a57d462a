"""Byte-level BPE: exact encoding by backtracking over longest token matches, and decoding.

Encoding. A text is split into pieces by the vocabulary's pattern (special tokens are cut out
first; a text is cut at spaces before that where this cannot part a piece). In a piece, an Aho-Corasick automaton over all tokens gives the longest token that starts at
each byte. The encoder takes the longest match, accepts it if it is compatible with the token before,
else tries the next shorter token that is a prefix of it, and steps back where none is left. Two tokens
are compatible if merging their joined bytes gives just these two; this is decided on the merge table
and kept in a bounded table of pairs. The accepted sequence is the one that the merges make. Every
position is left at most once for good, so a piece takes time linear in its length. Distinct pieces, and what stands between spaces,
are encoded once per worker while a bounded table holds them.

Decoding. All tokens' bytes lie in one buffer; an offset table gives each token's slice.

Edge cases: a null or empty text has no ids and decodes to the empty text; ids that are null decode to
the empty text; repeated rows stay repeated; extra columns stay, and an extra column whose name equals
that of the result is replaced by it; an empty table gives an empty table. Very long texts and pieces
are encoded whole. An id outside the vocabulary raises ``ValueError``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import strings, with_arrow_columns

#: Fixed value: the pattern that cuts a text into pieces before merging, as published with the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's table of what stands between spaces (there are two, and two of pieces an eighth as large), and of pairs; about 250 bytes each.
PIECE_LIMIT, PAIR_LIMIT = 200_000, 100_000


#: The settings of a vocabulary file that the code here is for; what a file leaves out counts as these.
SETTINGS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "post_processor": None,
    "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
#: Settings of added tokens: they are cut out of a text as they stand.
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def read_vocabulary(path: str) -> dict:
    """A vocabulary file's content. Settings that would give other ids than ``SETTINGS`` raise ValueError; truncation and padding don't count."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for part, wanted in SETTINGS.items():
        found = spec.get(part)
        wrong = found is not None if wanted is None else found is None or any(found.get(k, v) != v for k, v in wanted.items())
        if wrong:
            shown = {k: v for k, v in found.items() if k not in ("vocab", "merges")} if isinstance(found, dict) else found
            raise ValueError(f"this encoder isn't for a vocabulary with {part} {shown}")
    for token in spec.get("added_tokens", []):
        if any(token.get(k, v) != v for k, v in ADDED.items()):
            raise ValueError(f"this encoder isn't for an added token like {token}")
    return spec


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceTable(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, filled on demand.

    A full table becomes the one before, from which pieces still in use come back without encoding.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int = PIECE_LIMIT):
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.before.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[piece] = value
        return value


def packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class NotApart(Exception):
    """A text has white space after a space, or ends with one."""


class TextEncoder:
    """Texts to ids through two tables: of what stands between spaces, and of the pattern's pieces.

    A piece never goes on over a space that something other than white space follows: the space begins the
    next piece. So a text is cut at its spaces first, without the pattern; a text with other spaces is cut by the pattern.
    """

    def __init__(self, piece: Callable[[str], list[int]], special: dict[str, int], limit: int = PIECE_LIMIT):
        self.findall, self.space = regex.compile(PIECES).findall, regex.compile(r"\s").match
        self.piece, self.special = piece, special
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if special else None
        self.pieces = PieceTable(lambda x: packed(piece(x)), limit // 8)
        self.between = PieceTable(self._between, limit)

    def _between(self, part: str) -> bytes:
        if part.isalpha():  # one piece
            return packed(self.piece(f" {part}"))
        if not part or self.space(part):
            raise NotApart
        return b"".join(map(self.pieces.__getitem__, self.findall(f" {part}")))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        pieces = self.pieces.__getitem__
        try:
            return b"".join([*map(pieces, self.findall(first)), *map(self.between.__getitem__, rest)])
        except NotApart:
            return b"".join(map(pieces, self.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(pack("<I", self.special[x]) if x in self.special else self._plain(x) for x in self.cut(text))


class ByteBpe:
    """The vocabulary with its automaton, pair table and offset table."""

    def __init__(self, path: str):
        spec = read_vocabulary(path)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(map(alphabet.__getitem__, s))
        self.id_of = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.token = [b""] * size
        for s, i in self.id_of.items():
            self.token[i] = s
        for s, i in self.special.items():
            self.token[i] = s.encode()
        # Merge order: a merged token has the rank of its merge, a byte has none (-1).
        self.rank, self.parts, self.merged = [-1] * size, [None] * size, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, t = self.id_of[left], self.id_of[right], self.id_of[left + right]
            self.merged[a, b] = r
            if self.parts[t] is None:
                self.rank[t], self.parts[t] = r, (a, b)
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.shorter[i] = next((t for k in range(len(s) - 1, 0, -1) if (t := self.id_of.get(s[:k])) is not None), -1)
            self.automaton.add_word(s.decode("latin-1"), (i, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        lengths = np.array([len(t) for t in self.token], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.encode = TextEncoder(self.piece, self.special).encode

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(key := a << 20 | b)
        if known is None:
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            known = self.pairs[key] = self._keeps_apart(a, b)
        return known

    def _keeps_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together never joins across their border.

        Undoes the two tokens' merges from the last to the first. At each moment the two parts that
        touch the border are known; a merge of them that comes before the merge which took the younger
        of them away would have happened. Of equal merges the leftmost is made first.
        """
        before = len(self.merged)  # merges of this rank and later come after the moment looked at
        border_wins_ties = True
        while True:
            r = self.merged.get((a, b))
            if r is not None and (r < before or r == before and border_wins_ties):
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # The left token's last merge is undone. It stands left of the border, so it wins ties;
                # of two last merges with one rank the right token's is the later.
                before, border_wins_ties = ra, False
                a = self.parts[a][1]
            else:
                before, border_wins_ties = rb, True
                b = self.parts[b][0]

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece."""
        raw = piece.encode("utf-8")
        n = len(raw)
        longest = [0] * n
        for end, (t, size) in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - size] = t  # ends come in order, so a longer match replaces a shorter
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while True:
            end = at + len(self.token[t])
            if open_at[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                if end == n:
                    return out
                at, t = end, longest[end]
                continue
            t = self.shorter[t]
            while t < 0:
                if not out:
                    raise ValueError(f"no token sequence for {piece!r}")
                open_at[at] = 0
                last = out.pop()
                at -= len(self.token[last])
                t = self.shorter[last]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, in order."""
        if not len(ids):
            return b""
        ids = np.asarray(ids, np.int64)
        if ids.min() < 0 or ids.max() >= len(self.token):
            raise ValueError("an id is outside the vocabulary")
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of a file; one copy per worker process."""
    return ByteBpe(path)


def id_lists(blobs: list[bytes]) -> pa.Array:
    """Little-endian unsigned 32-bit integers as a list<int32> array."""
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)))


def encode_bpe(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col`` (array<int>), the ids of the whole text."""
    df = df.drop(ids_col) if ids_col != text_col else df

    def make():
        bpe = vocabulary(vocabulary_path)
        return lambda batch: [id_lists([bpe.encode(x) for x in strings(batch.column(text_col))])]

    return with_arrow_columns(df, {ids_col: T.ArrayType(T.IntegerType())}, make)


def encode_and_decode(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode_bpe`` and ``decode_bpe`` of its ids in one pass, so that a worker holds one vocabulary and texts cross once."""
    df = df.drop(*{ids_col, decoded_col} - {text_col})

    def make():
        bpe = vocabulary(vocabulary_path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            blobs = [bpe.encode(x) for x in strings(batch.column(text_col))]
            return [id_lists(blobs), pa.array([bpe.decode(np.frombuffer(b, "<u4")).decode("utf-8", "replace") for b in blobs], pa.string())]

        return work

    return with_arrow_columns(df, {ids_col: T.ArrayType(T.IntegerType()), decoded_col: T.StringType()}, make)


def decode_bpe(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col`` (string), the ids' bytes read as UTF-8; bytes that are none become U+FFFD."""
    df = df.drop(text_col) if ids_col != text_col else df

    def make():
        bpe = vocabulary(vocabulary_path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(ids_col)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())])
            texts = [bpe.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            return [pa.array(texts, pa.string())]

        return work

    return with_arrow_columns(df, {text_col: T.StringType()}, make)


def bpe_digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode(decoded_col, "UTF-8"), 256).alias("decoded_sha256"),
    )
