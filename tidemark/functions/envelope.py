"""Journal rows and their texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.codec import EventType


def entity_id(key: Column) -> Column:
    """Any key as an entity id: its text. Ids are equal if their texts are."""
    return key.cast("string")


def payload(id: Column, sequence: Column, kind: EventType | type, value: Column, created_at: Column | None = None) -> list[Column]:
    """The five journal columns of an event; the time is the query's start unless given."""
    kind = getattr(kind, "event_type", kind)
    return [
        entity_id(id).alias("id"),
        sequence.cast("long").alias("sequence_id"),
        F.lit(kind.key).alias("registry_key"),
        kind.encode(value).cast("binary").alias("bytes"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    ]


def payload_label() -> Column:
    """How a row introduces itself."""
    return F.concat(F.lit("Payload#"), F.col("registry_key"))


def payload_size() -> Column:
    """A body's size in words."""
    return F.concat(F.lit("<"), F.octet_length("bytes").cast("string"), F.lit(" bytes>"))


def stream_trace() -> Column:
    """How an event passing a stream is noted."""
    return F.concat_ws("#", "id", "registry_key")


def resolve_type(event: Column, handler: Column) -> Column:
    """The text of a (event type, handler kind) pair."""
    return F.concat_ws("-", event, handler)
