"""SentencePiece encoding and decoding of models of the merge type: a table of each prefix's last token.

Encoding. Merging joins the best pair of neighbouring symbols that is a piece, by score, then from the left. If t1 ... tn is what a text is merged to, t1 ... tk is
what its prefix up to there is merged to; so every prefix has one last token. The table holds it: of the pieces that end at a place (an automaton over all pieces
finds them), it is the one that is compatible with the last token of the prefix before it. Two tokens are compatible if merging their joined text keeps
their border; this is decided by going through both tokens' own merges side by side, and looking for a merge across the border that would come first. The ids are
recovered backwards from the end. A character that is no piece is a token of its own, written as its bytes. Each place is looked at once, so a text takes time linear in its length.

No piece has a space after another character, or a character of no longer piece beside another one, so no merge crosses these places; a text is cut there,
and what stands between is encoded once for each worker while a bounded table holds it. Models for which this isn't so are cut less.

Decoding. All tokens' bytes lie in one buffer; an offset table gives each token's slice. The space that encoding puts before a text is left out; bytes that are no UTF-8 become U+FFFD.

Edge cases: a null or empty text has the end id alone and decodes to the empty text; null ids decode to the empty text; repeated rows stay repeated; extra columns stay, and one
whose name equals that of a result is replaced by it; an empty table gives an empty table; very long texts are encoded whole; an id
outside the vocabulary, or a model with other settings than ``SETTINGS``, raises ValueError.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm.bpe import PieceTable, id_lists, packed
from tidemark.llm.common import strings, with_arrow_columns

#: Fixed values of the format: what stands for a space, kinds of pieces, the model type that merges.
SPACE, NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = "▁", 1, 2, 3, 6, 2
#: Settings of the models that the code here is for: spaces become ``SPACE``, one is put before a text, nothing else changes.
SETTINGS = {"precompiled_charsmap": b"", "normalization_rule_tsv": "", "add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True}
#: Entries of a worker's tables: of what stands between spaces (there are two, and two of parts an eighth as large), about 200 bytes each; of pairs.
WORDS, PAIRS = 300_000, 400_000


def read_model(path: str):
    """A model file's content; settings that would give other ids raise ValueError."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    found = {k: getattr(model.normalizer_spec, k) for k in SETTINGS}
    wrong = {k: v for k, v in found.items() if v != SETTINGS[k]}
    trainer = model.trainer_spec
    if wrong or trainer.model_type != MERGES or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
        raise ValueError(f"this encoder isn't for a model with {sorted(wrong) or trainer.model_type}")
    other = {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}
    if other:
        raise ValueError(f"this encoder isn't for pieces of the kinds {sorted(other)}")
    return model


class Pieces:
    """The model with its automaton, pair table and offset table."""

    def __init__(self, path: str):
        model = read_model(path)
        self.size = len(model.pieces)
        kinds = [p.type for p in model.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.name = [p.piece for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        longer = [p for p in self.id_of if len(p) > 1]
        inside = "".join(map(regex.escape, sorted({c for p in longer for c in p})))
        self.parts_of = regex.compile(f"[{inside}]+|[^{inside}]").findall if inside else list
        # Whether a text may be cut before each run of spaces.
        self.by_words = not any(p.rpartition(SPACE)[0].strip(SPACE) for p in longer)
        self.words_of = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.merges: dict[int, tuple[list, list, list] | None] = {}
        self.pairs: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.n_pairs = 0
        self.parts = PieceTable(lambda x: packed(self.part(x)), WORDS // 8)
        self.whole = regex.compile(f"[{inside}]+").fullmatch if inside else lambda x: None
        self.words = PieceTable(self._word, WORDS)
        surface = model.trainer_spec.unk_surface
        shown = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), UNKNOWN: lambda p: surface.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        token = [shown[k](p) for k, p in zip(kinds, self.name)]
        self.offsets = np.cumsum([0, *map(len, token)])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.silent = np.array([k == CONTROL for k in kinds])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for k, p in zip(kinds, self.name)])

    def text_of(self, token: int) -> str:
        """A token's characters; characters that are no piece are numbered after the pieces."""
        return self.name[token] if token < self.size else chr(token - self.size)

    def merged(self, token: int) -> tuple[list, list, list] | None:
        """How a token comes about from its characters: the scores of its merges in their order, and before each and at the end
        its first and its last symbol. None if merging its characters gives something else.
        """
        if token not in self.merges:
            symbols = list(self.text_of(token))
            scores, first, last = [], [symbols[0]], [symbols[-1]]
            while True:
                open_ = [(-s, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (s := self.score.get(pair[0] + pair[1])) is not None]
                if not open_:
                    break
                s, i = min(open_)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                scores.append(-s)
                first.append(symbols[0])
                last.append(symbols[-1])
            self.merges[token] = (scores, first, last) if len(symbols) == 1 else None
        return self.merges[token]

    def compatible(self, a: int, b: int) -> bool:
        """Also kept in the table of pairs, which has a row for each first token."""
        if self.n_pairs >= PAIRS:
            for row in self.pairs.values():
                row.clear()  # rows may be in use
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.pairs[a][b] = self._keeps_apart(a, b)
        return known

    def _keeps_apart(self, a: int, b: int) -> bool:
        left, right = self.merged(a), self.merged(b)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            ours = left[0][i] if i < len(left[0]) else None
            theirs = right[0][j] if j < len(right[0]) else None
            across = self.score.get(left[2][i] + right[1][j])
            # Of equal scores the leftmost is first: within a, then across, then within b.
            if across is not None and (ours is None or across > ours) and (theirs is None or across >= theirs):
                return False
            if ours is None and theirs is None:
                return True
            if theirs is None or ours is not None and ours >= theirs:
                i += 1
            else:
                j += 1

    def part(self, text: str) -> list[int]:
        """The ids of a text in which every merge may happen."""
        n = len(text)
        known = self.id_of.get(text)
        if known is not None and self.merged(known) is not None:
            return [known]
        last, start, settled, pairs = [-1] * (n + 1), [0] * (n + 1), 0, self.pairs
        rows: list = [None] * (n + 1)  # of the pair table, for each place's last token
        for at, (token, size) in self.automaton.iter(text):
            end = at + 1
            if end == settled:
                continue
            before = end - size
            if before:
                row = rows[before]
                if row is None:
                    if last[before] < 0:  # no piece ends there that fits, so the character before it is none
                        last[before], start[before] = self.size + ord(text[before - 1]), before - 1
                    row = rows[before] = pairs[last[before]]
                fits = row.get(token)
                if fits is None:
                    fits = self.compatible(last[before], token)
            else:
                fits = self.merged(token) is not None
            if fits:
                last[end], start[end], settled = token, before, end
        out = []
        while n:
            token = last[n]
            if 0 <= token < self.size:
                out.append(token)
                n = start[n]
            else:
                out += [self.byte[b] for b in reversed(text[n - 1].encode())]
                n -= 1
        return out[::-1]

    def _word(self, word: str) -> bytes:
        """The ids of what stands between two spaces, with the first of these."""
        text = SPACE + word
        return packed(self.part(text)) if self.whole(text) else b"".join(map(self.parts.__getitem__, self.parts_of(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, without the end id, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.by_words and SPACE not in text:
            words = text.split(" ")
            if "" not in words:
                return b"".join(map(self.words.__getitem__, words))
        spaced = SPACE + text.replace(" ", SPACE)
        return b"".join(map(self.parts.__getitem__, (x for w in (self.words_of(spaced) if self.by_words else [spaced]) for x in self.parts_of(w))))

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError("an id is outside the vocabulary")
        heard = ids[~self.silent[ids]]
        if not len(heard):
            return ""
        start, size = self.offsets[heard], self.offsets[heard + 1] - self.offsets[heard]
        ends = np.cumsum(size)
        raw = self.bytes[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes()
        return utf8(raw[1:] if self.spaced[heard[0]] else raw)


def utf8(raw: bytes) -> str:
    """Bytes as text; each byte that begins no character becomes U+FFFD."""
    out, at = [], 0
    while True:
        try:
            return "".join([*out, raw[at:].decode()])
        except UnicodeDecodeError as wrong:
            out += [raw[at : at + wrong.start].decode(), "\ufffd"]
            at += wrong.start + 1


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """The model of a file; one copy per worker process."""
    return Pieces(path)


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col`` (array<int>), the ids of the whole text with the end id."""
    df = df.drop(ids_col) if ids_col != text_col else df

    def make():
        own = pieces(model_path)
        end = packed([own.end])
        return lambda batch: [id_lists([own.encode(x) + end for x in strings(batch.column(text_col))])]

    return with_arrow_columns(df, {ids_col: T.ArrayType(T.IntegerType())}, make)


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col`` (string), the ids' text."""
    df = df.drop(text_col) if ids_col != text_col else df

    def make():
        own = pieces(model_path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(ids_col)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())])
            return [pa.array([own.decode(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.string())]

        return work

    return with_arrow_columns(df, {text_col: T.StringType()}, make)


def encode_and_decode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` of its ids in one pass, so that a worker holds one model and texts cross once."""
    df = df.drop(*{ids_col, decoded_col} - {text_col})

    def make():
        own = pieces(model_path)
        end = packed([own.end])

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            blobs = [own.encode(x) + end for x in strings(batch.column(text_col))]
            return [id_lists(blobs), pa.array([own.decode(np.frombuffer(b, "<u4")) for b in blobs], pa.string())]

        return work

    return with_arrow_columns(df, {ids_col: T.ArrayType(T.IntegerType()), decoded_col: T.StringType()}, make)


def piece_digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode(decoded_col, "UTF-8"), 256).alias("decoded_sha256"),
    )
