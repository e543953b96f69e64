"""Boolean descriptions over selectors: conjunctions, disjunctions, and disjunctions of conjunctions. All immutable."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selectors import Selector, parse_selector


class Description:
    """Base: equality, order and hash go by the key, which does not depend on the order of the parts."""

    parts: tuple

    def column(self) -> Column:
        raise NotImplementedError

    def covers(self, df: DataFrame) -> DataFrame:
        return df.filter(self.column())

    @property
    def selectors(self) -> tuple[Selector, ...]:
        return tuple(s for p in self.parts for s in (p.selectors if isinstance(p, Description) else (p,)))

    @property
    def attributes(self) -> tuple[str, ...]:
        return tuple(a for s in self.selectors for a in s.attributes)

    @property
    def depth(self) -> int:
        return len(self.parts)

    def __len__(self) -> int:
        return len(self.parts)

    def __repr__(self) -> str:
        return self.key

    def __str__(self) -> str:
        return self.label

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Description) and self.key == other.key

    def __lt__(self, other: "Description") -> bool:
        return self.key < other.key

    def __hash__(self) -> int:
        return hash(self.key)


def _parts(of) -> tuple:
    return (of,) if isinstance(of, (Selector, Description)) else tuple(of)


class Conjunction(Description):
    """All selectors hold; without any it covers the whole dataset."""

    def __init__(self, selectors: Selector | Iterable[Selector] = ()):
        self.parts = _parts(selectors)

    @property
    def key(self) -> str:
        return "(" + " and ".join(sorted(s.key for s in self.parts)) + ")" if self.parts else "True"

    @property
    def label(self) -> str:
        return " AND ".join(sorted(s.label for s in self.parts)) or "Dataset"

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (s.column() for s in self.parts), F.lit(True))

    def __and__(self, other) -> "Conjunction":
        if isinstance(other, Selector):
            return Conjunction((*self.parts, other))
        if isinstance(other, Conjunction):
            return Conjunction((*self.parts, *other.parts))
        raise RuntimeError("a conjunction takes selectors and conjunctions")

    def __or__(self, other):
        raise RuntimeError("a conjunction has no OR; use a DNF")

    def without_last(self) -> "Conjunction":
        return Conjunction(self.parts[:-1])

    @classmethod
    def from_str(cls, text: str) -> "Conjunction":
        return cls() if text.strip() == "Dataset" else cls(map(parse_selector, text.split(" AND ")))


class Disjunction(Description):
    """Any selector holds; without any it covers nothing."""

    def __init__(self, selectors: Selector | Iterable[Selector] = ()):
        self.parts = _parts(selectors)

    @property
    def key(self) -> str:
        return "(" + " or ".join(sorted(s.key for s in self.parts)) + ")" if self.parts else "True"

    @property
    def label(self) -> str:
        return " OR ".join(sorted(s.label for s in self.parts)) or "Empty"

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (s.column() for s in self.parts), F.lit(False))

    def __or__(self, other) -> "Disjunction":
        if isinstance(other, Selector):
            return Disjunction((*self.parts, other))
        if isinstance(other, Disjunction):
            return Disjunction((*self.parts, *other.parts))
        raise RuntimeError("a disjunction takes selectors and disjunctions")

    def __and__(self, other):
        raise RuntimeError("a disjunction has no AND; use a DNF")


class DNF(Description):
    """Any of the conjunctions holds."""

    def __init__(self, conjunctions: Iterable[Conjunction | Selector] | Conjunction | Selector = ()):
        self.parts = tuple(c if isinstance(c, Conjunction) else Conjunction(c) for c in _parts(conjunctions))

    @property
    def key(self) -> str:
        return "(" + " or ".join(sorted(c.key for c in self.parts)) + ")" if self.parts else "True"

    @property
    def label(self) -> str:
        return " OR ".join(sorted(c.label for c in self.parts)) or "Empty"

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (c.column() for c in self.parts), F.lit(False))

    def __or__(self, other) -> "DNF":
        return DNF((*self.parts, *DNF(other.parts if isinstance(other, (DNF, Disjunction)) else other).parts))

    def __and__(self, other) -> "DNF":
        if isinstance(other, (Disjunction, DNF)):
            raise NotImplementedError("a DNF can be narrowed by selectors and conjunctions only")
        return DNF(c & other for c in self.parts)

    def without_last(self) -> "DNF":
        """Every conjunction without its last selector, which must be the same in all."""
        if len({c.parts[-1:] for c in self.parts}) > 1:
            raise RuntimeError("the last selectors differ")
        return DNF(c.without_last() for c in self.parts)


def cover_sizes(df: DataFrame, descriptions: list) -> DataFrame:
    """description, size_sg, size_dataset of each description, in one pass."""
    sizes = [F.count_if(d.column()).alias(f"s{i}") for i, d in enumerate(descriptions)]
    one = df.agg(F.count("*").alias("size_dataset"), *sizes)
    each = F.array(*(F.struct(F.lit(str(d)).alias("description"), F.col(f"s{i}").alias("size_sg")) for i, d in enumerate(descriptions)))
    return one.select(F.explode(each).alias("x"), "size_dataset").select("x.description", "x.size_sg", "size_dataset")


def overlap(df: DataFrame, descriptions: list) -> DataFrame:
    """left, right, jaccard of every pair of a short list of descriptions, from one aggregate over the rows."""
    covers = df.select(*(d.column().alias(f"c{i}") for i, d in enumerate(descriptions)))
    n = range(len(descriptions))
    both = [F.count_if(F.col(f"c{i}") & F.col(f"c{j}")).alias(f"b{i}_{j}") for i in n for j in n if i <= j]
    sums = covers.agg(*both)
    b = lambda i, j: F.col(f"b{min(i, j)}_{max(i, j)}")
    rows = [F.struct(F.lit(str(descriptions[i])).alias("left"), F.lit(str(descriptions[j])).alias("right"), F.try_divide(b(i, j).cast("double"), b(i, i) + b(j, j) - b(i, j)).alias("jaccard")) for i in n for j in n]
    return sums.select(F.inline(F.array(*rows)))
