"""Secret scan with structural confirmation.

Base spans are pattern matches. On top, every base64 or hex run that can hold a secret, also one wrapped in lines, is decoded and reported only if
the bytes have the structure of a secret: a DER key whose nested lengths add up, an OpenSSH key blob, or
text that itself holds a secret, in as many layers as there are; and dotted triples are reported as signed tokens only if the header
decodes to a JSON object that names an algorithm. PEM blocks are reported if their body decodes to one of these keys.

Edge cases: a null or empty text has no spans; offsets are code points, ends exclusive; spans sort by
start, then by kind in the order of ``KINDS``; repeated rows stay repeated; only the two named columns of
the input are read, so extra columns cannot clash; an empty table gives an empty table; texts of any length
are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import strings, texts_of, with_arrow_columns

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)  # whole runs, the short ones dropped
#: Lower-case words without which ASSIGN cannot match.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "signed", "key", "ssh", "nested")

#: A line's end, also as written in JSON and source code.
BREAK = r"(?:\r?\n|(?:\\r)?\\n)"
#: Lines around a key; blocks are found by these first, and what stands between two of them is then read once.
MARKER = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
LEAD = re.compile(r"(?:\s|\\[rn])*")
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*" + BREAK + r"[ \t]*")
BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[rn])+")
#: The base64 of a JSON object begins with e and w or y.
SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: The shortest base secret is an assignment of 12 characters ("token=abcdef"): 16 characters of base64, 24 of hex.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")  # also right after =, as in KEY=value
#: Same letters as CANDIDATE's; a quick test of a whole text.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{16}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{24,}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
GAP = re.compile(BREAK + r"[ \t]*")
PADDING = re.compile(r"={0,2}")
#: Drops what a text file has besides printable characters.
LINE_ENDS = dict.fromkeys(map(ord, "\r\n\t"))
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:" + BREAK + r"[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
#: Object identifiers of encryption by password begin with PKCS 5's or PKCS 12's.
BY_PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; a match that is too short is dropped, not retried."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def der_items(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly, or None."""
    end, items = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """A private key: one SEQUENCE that begins with a small version and holds key material whose nested lengths fit.

    Covers the layouts of RSA and DSA keys (version, then integers), elliptic curve keys (version 1, then
    an octet string) and wrapped keys (version, algorithm sequence with an object identifier, octet string); also keys
    encrypted by a password (no version, an algorithm sequence of PKCS 5 or 12, octet string).
    """
    if len(data) < 24 or data[0] != 0x30:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    inner = der_items(data, *outer[0][1:])
    if inner and [x[0] for x in inner] == [0x30, 4] and inner[1][2] - inner[1][1] >= 16:
        algorithm = der_items(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 6 and data[algorithm[0][1] : algorithm[0][2]].startswith(BY_PASSWORD)
    if not inner or len(inner) < 2 or inner[0][0] != 2 or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 1:
        return False
    tags = [x[0] for x in inner]
    if tags[1] == 2:
        return len(tags) >= 6 and set(tags[1:6]) == {2}
    if tags[1] == 4:
        return data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] >= 16
    if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 4:
        algorithm = der_items(data, *inner[1][1:])
        # What the octet string holds is DER again: a key of the algorithm.
        return bool(algorithm) and algorithm[0][0] == 6 and inner[2][2] - inner[2][1] >= 16 and bool(der_items(data, *inner[2][1:]))
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file: its magic, three length-prefixed fields, a count, so many public keys and the private part, to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False

    def after(at: int, fields: int) -> int:
        for _ in range(fields):
            if at < 0 or at + 4 > len(data):
                return -1
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at if at <= len(data) else -1

    at = after(len(magic), 3)
    if at < 0 or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    return 1 <= count <= len(data) // 4 and after(at + 4, count + 1) == len(data)


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional; None if it isn't any."""
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def kind_of(data: bytes) -> str | None:
    """The kind of secret that decoded bytes are; text is looked through again, whatever is encoded in it."""
    if is_der_key(data):
        return "key"
    if is_ssh_key(data):
        return "ssh"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not text.translate(LINE_ENDS).isprintable():
        return None
    return "nested" if base_spans(text) or confirmed_spans(text) else None


def is_signed_header(text: str) -> bool:
    data = from_base64(text)
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and bool(header["alg"])


def is_pem_key(headers: str, body: str) -> bool:
    """A block's body is a key, or whole blocks of cipher text under headers that say so."""
    data = from_base64(re.sub(r"\\[rn]", "", body))
    if not data:
        return False
    if "Proc-Type:" in headers and "ENCRYPTED" in headers and "DEK-Info:" in headers:
        return len(data) >= 24 and len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """Blocks whose body is a key. A block's markers follow one another, so blocks don't overlap and each is read once."""
    begin = None
    for m in MARKER.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            first = at = LEAD.match(text, begin.end(), m.start()).end()
            while header := HEADER.match(text, at, m.start()):
                at = header.end()
            if begin[2] == m[2] and BODY.fullmatch(text, at, m.start()) and is_pem_key(text[first:at], text[at : m.start()]):
                yield begin.start(), m.end()
            begin = None


class Covered:
    """Spans in order of their starts, and whether one of them has another span within."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            self.add(a, b)

    def add(self, start: int, end: int) -> None:
        self.starts.append(start)
        self.ends.append(max(end, self.ends[-1] if self.ends else 0))  # the furthest end so far

    def has(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end


def run_kind(run: str) -> str | None:
    """The kind of secret that a run of hex or base64 decodes to."""
    data = bytes.fromhex(run) if len(run) % 2 == 0 and HEX_RUN.fullmatch(run) else None
    kind = kind_of(data) if data else None
    if kind is None and (data := from_base64(run)):
        kind = kind_of(data)
    return kind


def after_break(text: str, at: int) -> int:
    """Where a run at ``at`` may begin instead: behind the n of a written line end."""
    return at + (at > 0 and text[at - 1] == "\\" and text[at] in "nrt")


def wrapped_lines(text: str, m: re.Match) -> Iterator[list[tuple[int, int]]]:
    """Lines of a wrapped run that may belong together: of one length, the last one as long or shorter."""
    lines, at = [], after_break(text, m.start())
    while run := LINE.match(text, at, m.end()):
        lines.append(run.span())
        at = run.end()
        gap = GAP.match(text, at, m.end())
        if not gap:
            break
        at = gap.end()
    i, size = 0, [b - a for a, b in lines]
    while i < len(lines):
        j = i + 1
        while j < len(lines) and size[j] == size[i]:
            j += 1
        if j < len(lines) and size[j] < size[i]:
            yield lines[i : j + 1]
        if j > i + 1:
            yield lines[i:j]
        i = j


def confirmed_spans(text: str) -> list[Span]:
    """What decoding confirms."""
    found: list[Span] = []
    if "-----BEGIN" in text:
        found += [("pem", a, b) for a, b in pem_spans(text)]
    if "." in text:
        found += [("signed", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_header(m[1])]
    if not LONG_RUN.search(text):
        return found
    known, wraps = Covered([(a, b) for _, a, b in found]), Covered()
    for m in WRAPPED.finditer(text):
        for lines in wrapped_lines(text, m):
            a, b = lines[0][0], lines[-1][1]
            b += len(PADDING.match(text, b)[0])
            if not known.has(a, b) and not wraps.has(a, b) and (kind := run_kind("".join(text[x:y] for x, y in lines))):
                found.append((kind, a, b))
                wraps.add(a, b)
    for m in CANDIDATE.finditer(text):
        for a in sorted({m.start(), after_break(text, m.start())}):
            if not known.has(a, m.end()) and not wraps.has(a, m.end()) and (kind := run_kind(text[a : m.end()])):
                found.append((kind, a, m.end()))
                break
    return found


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end) in order, for every row."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text in strings(batch.column("text")):
                found = base_spans(text) + confirmed_spans(text)
                found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(rows, kind)]

        return work

    return with_arrow_columns(texts_of(docs, id_col, text_col), {"spans": SPANS}, make).select("doc_id", "spans")


def span_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, base_sha256 and spans (joined) of a scan's rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
