"""Event types: their names, encodings and schemas.

An event type has a key, found in ``registry_key``, and a pair of column functions between its body and
bytes. Matching a row by key and decoding its bytes are separate: a decoder doesn't ask for the key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import EncodeError, ReadError

Codec = Callable[[Column], Column]


def kebab_case(name: Column) -> Column:
    """A type's name as a key: a hyphen before each capital but at the start, then ASCII letters in lower case."""
    return F.translate(F.regexp_replace(name, r"(?<!^)(\p{IsUppercase})", "-$1"), ascii_uppercase, ascii_lowercase)


def kebab(name: str) -> str:
    """The same for one name on the driver."""
    apart = "".join(f"-{c}" if i and c.isupper() else c for i, c in enumerate(name))
    return apart.translate(str.maketrans(ascii_uppercase, ascii_lowercase))


def text_of(body: Column) -> Column:
    """Bytes as UTF-8 text; null if they are none."""
    return F.try_validate_utf8(body.cast("string"))


def json_encode(value: Column) -> Column:
    return F.to_json(value).cast("binary")


def json_decode(schema: str) -> Codec:
    """Bytes of JSON as a value of the schema; null if they are none, or of another shape."""
    kind = schema if "<" in schema.partition(" ")[0] or " " not in schema.strip() else f"struct<{schema}>"
    return lambda body: F.try_variant_get(F.try_parse_json(text_of(body)), "$", kind)


def json_field(path: str, kind: str = "string") -> Codec:
    """One field of a JSON body of no declared schema; null if it isn't there."""
    return lambda body: F.try_variant_get(F.try_parse_json(text_of(body)), path, kind)


@dataclass(frozen=True)
class EventType:
    key: str
    encode: Codec
    decode: Codec

    def __str__(self) -> str:
        return self.key


def event(enc: Codec | None = None, dec: Codec | None = None, key: str | None = None, schema: str | None = None):
    """Class decorator: gives the class ``event_type``. The key is the class's name in kebab case unless given.

    ``schema`` alone stands for JSON both ways; else both ``enc`` and ``dec`` are needed.
    """
    if schema is not None:
        enc, dec = enc or json_encode, dec or json_decode(schema)
    if enc is None or dec is None:
        raise EncodeError("an event type needs enc and dec, or a schema")

    def mark(cls: type) -> type:
        cls.event_type = EventType(key or kebab(cls.__name__), enc, dec)
        return cls

    return mark


def command(cls: type) -> type:
    """Class decorator: marks a command, whose kind is the class's name in kebab case."""
    cls.command_kind = kebab(cls.__name__)
    return cls


def key_of(kind: EventType | type | str) -> str:
    """The key of an event type, of a class that has one, or a key itself."""
    kind = getattr(kind, "event_type", kind)
    return kind.key if isinstance(kind, EventType) else kind


def decoded(journal: DataFrame, kind: EventType | type, strict: bool = True, name: str = "event") -> DataFrame:
    """Adds the decoded body, whatever the rows' keys. Strict: a row that can't be decoded raises ReadError (an action)."""
    out = journal.withColumn(name, getattr(kind, "event_type", kind).decode(F.col("bytes")))
    if strict:
        bad = out.where(F.col(name).isNull()).select("id", "sequence_id").first()
        if bad:
            raise ReadError(f"event {bad['sequence_id']} of {bad['id']} is no {key_of(kind)}")
    return out
