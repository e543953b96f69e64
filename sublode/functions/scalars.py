"""Small scalar helpers, each as a Column, and two driver-side ones."""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def conditional_invert(value: Column, invert: Column | bool) -> Column:
    return F.when(F.lit(invert) if isinstance(invert, bool) else invert, -value).otherwise(value)


def effective_sample_size(weight: Column) -> Column:
    """(sum of w)^2 / sum of w^2."""
    return F.try_divide(F.pow(F.sum(weight), 2), F.sum(weight * weight))


def to_bits(positions: Column) -> Column:
    """A 64-bit word with the bits of an array of positions set."""
    return F.aggregate(positions, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def count_bits(word: Column) -> Column:
    return F.bit_count(word)


def find_set_bits(word: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word, i) == 1)


def intersect_of_ordered_list(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def powerset(values, max_length: int | None = None):
    """All subsets of at most ``max_length`` values, the empty one first."""
    values = list(values)
    most = len(values) if max_length is None else min(max_length, len(values))
    return chain.from_iterable(combinations(values, r) for r in range(most + 1))
