"""Atomic predicates over columns. A selector is immutable, is identified by its key, and gives a two-valued Column.

A missing value is null, or NaN in a floating-point column. Equality and intervals never cover one; the null selector
covers exactly those; a negation covers what its selector does not, missing values included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ("y", "yes", "t", "true", "on", "1")
FALSE_WORDS = ("n", "no", "f", "false", "off", "0")


def str_to_bool(text: str) -> bool:
    """A word for true or false; ValueError for any other."""
    word = text.lower()
    if word in TRUE_WORDS:
        return True
    if word in FALSE_WORDS:
        return False
    raise ValueError(f"no truth value: {text!r}")


def is_missing(value: object) -> bool:
    return isinstance(value, float) and math.isnan(value)


class Selector:
    """Base: ``key`` identifies, ``label`` is shown, ``attributes`` are the columns it reads."""

    key: str
    label: str

    def column(self) -> Column:
        raise NotImplementedError

    @property
    def attributes(self) -> tuple[str, ...]:
        return (self.attribute,)

    def covers(self, df: DataFrame) -> DataFrame:
        """The rows that the selector covers."""
        return df.filter(self.column())

    def __repr__(self) -> str:
        return self.key

    def __str__(self) -> str:
        return self.label

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Selector) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)

    def __lt__(self, other: "Selector") -> bool:
        return self.key < other.key


@dataclass(frozen=True, eq=False, repr=False)
class EqualitySelector(Selector):
    """``attribute == value``; a NaN value selects the missing ones."""

    attribute: str
    value: object
    name: str | None = None

    def __post_init__(self):
        if self.value is None:
            raise TypeError("use NaN to select missing values")
        if isinstance(self.value, bytes):
            object.__setattr__(self, "value", self.value.decode())

    @property
    def key(self) -> str:
        if is_missing(self.value):
            return f"{self.attribute}.isnull()"
        return f"{self.attribute}=='{self.value}'" if isinstance(self.value, str) else f"{self.attribute}=={self.value}"

    @property
    def label(self) -> str:
        return self.name or self.key

    def column(self) -> Column:
        c = F.col(f"`{self.attribute}`")
        if is_missing(self.value):
            text = c.cast("string")  # NaN of any floating type reads so; no other number does
            return c.isNull() | F.coalesce(text == "NaN", F.lit(False))
        return c.eqNullSafe(F.lit(self.value))

    @classmethod
    def from_str(cls, text: str) -> "EqualitySelector":
        """Read a key: ``a.isnull()``, ``a=='text'`` (always text) or ``a==value`` (int, float, bool or text)."""
        text = text.strip()
        if text.endswith(".isnull()"):
            return cls(text[: -len(".isnull()")], math.nan)
        attribute, found, value = text.partition("==")
        if not found:
            raise ValueError(f"no equality: {text!r}")
        attribute, value = attribute.strip(), value.strip()
        if value[:2] in ("'b", 'b\'') and value.endswith("''"):
            return cls(attribute, value[3:-2])
        if len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]:
            return cls(attribute, value[1:-1])
        for kind in (int, float, str_to_bool):
            try:
                return cls(attribute, kind(value))
            except ValueError:
                continue
        return cls(attribute, value)


def _bound(x: float, digits: int | None) -> str:
    return str(x) if digits is None or math.isinf(x) or not x % 1 else f"{x:.{digits}f}"


@dataclass(frozen=True, eq=False, repr=False)
class IntervalSelector(Selector):
    """``low <= attribute < high``; both bounds stay in the predicate, so that NaN and infinity follow it."""

    attribute: str
    low: float
    high: float
    name: str | None = None

    def __post_init__(self):
        if not self.low < self.high:
            raise AssertionError("an interval needs low < high")

    def text(self, digits: int | None) -> str:
        low, high = _bound(self.low, digits), _bound(self.high, digits)
        if self.low == -math.inf:
            return f"{self.attribute} = anything" if self.high == math.inf else f"{self.attribute}<{high}"
        return f"{self.attribute}>={low}" if self.high == math.inf else f"{self.attribute}: [{low}:{high}["

    @property
    def key(self) -> str:
        return self.text(None)

    @property
    def label(self) -> str:
        return self.name or self.text(2)

    def column(self) -> Column:
        c = F.col(f"`{self.attribute}`")
        return F.coalesce((c >= F.lit(float(self.low))) & (c < F.lit(float(self.high))), F.lit(False))

    @classmethod
    def from_str(cls, text: str) -> "IntervalSelector":
        text = text.strip()
        if text.endswith(" = anything"):
            return cls(text[: -len(" = anything")], -math.inf, math.inf)
        if text.endswith("["):
            attribute, _, rest = text.partition(": [")
            low, _, high = rest[:-1].partition(":")
            return cls(attribute, float(low), float(high))
        for sign in (">=", "<"):
            attribute, found, value = text.partition(sign)
            if found:
                return cls(attribute.strip(), float(value), math.inf) if sign == ">=" else cls(attribute.strip(), -math.inf, float(value))
        raise ValueError(f"no interval: {text!r}")


@dataclass(frozen=True, eq=False, repr=False)
class NegatedSelector(Selector):
    """All rows that a selector does not cover."""

    selector: Selector

    @property
    def key(self) -> str:
        return f"(not {self.selector.key})"

    @property
    def label(self) -> str:
        return f"NOT {self.selector.label}"

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.selector.attributes

    def column(self) -> Column:
        return ~F.coalesce(self.selector.column(), F.lit(False))


@dataclass(frozen=True, eq=False, repr=False)
class CustomSelector(Selector):
    """Any boolean Column under a name; null counts as not covered."""

    name: str
    predicate: Column = field(compare=False)
    reads: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return self.name

    label = key

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.reads

    def column(self) -> Column:
        return F.coalesce(self.predicate, F.lit(False))


def parse_selector(text: str) -> Selector:
    """A selector from its key or label: negations, null tests, equalities, then intervals."""
    text = text.strip()
    if text.startswith("NOT "):
        return NegatedSelector(parse_selector(text[4:]))
    if text.startswith("(not ") and text.endswith(")"):
        return NegatedSelector(parse_selector(text[5:-1]))
    return EqualitySelector.from_str(text) if "==" in text or text.endswith(".isnull()") else IntervalSelector.from_str(text)


def remove_target_attributes(selectors: list[Selector], target) -> list[Selector]:
    """The selectors that read none of the target's columns."""
    taken = set(target.attributes)
    return [s for s in selectors if not taken & set(s.attributes)]


def remove_selectors_with_attributes(selectors: list[Selector], attributes) -> list[Selector]:
    taken = {attributes} if isinstance(attributes, str) else set(attributes)
    return [s for s in selectors if not taken & set(s.attributes)]
