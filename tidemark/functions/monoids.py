"""Changes of a state that combine: two changes, one after the other, are one change, in whatever order they are put together.

With such changes an entity's events need not be folded one by one: segments of them are combined at a time, then the segments. A
change is a column; ``combine`` gives the change that an earlier and a later one are together and must be associative; ``none`` changes nothing;
``act`` applies a change to a state, which is null where there is none yet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    """kind: the SQL type of a change."""

    kind: str
    none: Callable[[], Column]
    combine: Callable[[Column, Column], Column]
    act: Callable[[Column, Column], Column]


def adding(number: str) -> Monoid:
    """The state is a number, a change is added to it."""
    zero = lambda: F.lit(0).cast(number)
    plus = lambda a, b: (a + b).cast(number)
    return Monoid(number, zero, plus, lambda s, c: plus(F.coalesce(s, zero()), c))


def latest(kind: str) -> Monoid:
    """The state is the last change that isn't null."""
    return Monoid(kind, lambda: F.lit(None).cast(kind), lambda a, b: F.coalesce(b, a), lambda s, c: F.coalesce(c, s))


def resetting(number: str) -> Monoid:
    """A change (reset, add) is added to the state, or to zero if it resets."""
    made = lambda reset, add: F.struct(reset.alias("reset"), add.cast(number).alias("add"))
    zero = lambda: F.lit(0).cast(number)
    return Monoid(
        f"struct<reset:boolean,add:{number}>",
        lambda: made(F.lit(False), zero()),
        lambda a, b: made(a["reset"] | b["reset"], F.when(b["reset"], b["add"]).otherwise(a["add"] + b["add"])),
        lambda s, c: (F.when(c["reset"], zero()).otherwise(F.coalesce(s, zero())) + c["add"]).cast(number),
    )


def scaling(number: str) -> Monoid:
    """A change (times, plus) multiplies the state, then adds; the state is zero at first."""
    made = lambda times, plus: F.struct(times.cast(number).alias("times"), plus.cast(number).alias("plus"))
    return Monoid(
        f"struct<times:{number},plus:{number}>",
        lambda: made(F.lit(1), F.lit(0)),
        lambda a, b: made(b["times"] * a["times"], b["times"] * a["plus"] + b["plus"]),
        lambda s, c: (c["times"] * F.coalesce(s, F.lit(0).cast(number)) + c["plus"]).cast(number),
    )


def together(**parts: Monoid) -> Monoid:
    """A state and a change of several fields, each by its own."""
    each = lambda f: F.struct(*(f(k, m).alias(k) for k, m in parts.items()))
    return Monoid(
        "struct<" + ",".join(f"{k}:{m.kind}" for k, m in parts.items()) + ">",
        lambda: each(lambda k, m: m.none()),
        lambda a, b: each(lambda k, m: m.combine(a[k], b[k])),
        lambda s, c: each(lambda k, m: m.act(s[k], c[k])),
    )
