"""The engine's exceptions."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all."""


class EncodeError(EngineError):
    """An event cannot be written as bytes."""


class DecodeError(EngineError):
    """Bytes are not an event of the type asked for."""


class ProtocolError(EngineError):
    """A store failed."""


class SetupError(ProtocolError):
    """A part of the engine is missing, or is set a second time."""


class ReadError(ProtocolError):
    """A row is missing or cannot be decoded."""


class WriteError(ProtocolError):
    """A row cannot be encoded or appended."""


class ResolveError(EngineError):
    """A handler failed, or several fit."""


class ProjectionError(EngineError):
    """A replay failed."""


class NotCompatible(ProjectionError):
    """A replay met event types that no handler is registered for."""

    def __init__(self, keys: list[str]):
        super().__init__(f"no projection handler for: {', '.join(sorted(keys))}")
        self.keys = sorted(keys)


class FirstFormation(ProjectionError):
    """The first event of an entity could not form a state."""


class ApplyEvent(ProjectionError):
    """An event could not be applied to a state."""


class EmptyJournal(ProjectionError):
    """A single entity was asked for and has neither events nor a snapshot."""


class StaleState(EngineError):
    """A column rule for a batch reads the state, which changes within the batch."""

    def __init__(self, kind: str):
        super().__init__(f"the rule for {kind} reads the state")
        self.kind = kind


class AlreadyExist(EngineError):
    """A process with this id runs already."""

    def __init__(self, ids: list[str]):
        super().__init__(f"running already: {', '.join(sorted(ids))}")
        self.ids = sorted(ids)


class NotFound(EngineError):
    """No process has this id."""


class InvalidCast(EngineError):
    """A process has another type than the one asked for."""


class SubscriberMissing(EngineError):
    """An event was published where delivery to someone was asked for, and nobody subscribes."""
