"""The lattice of conjunctions, level by level, over a signature table.

A signature is the sorted array of the selectors that cover a row; rows with equal signatures are added up once, and
every itemset of a level is an extension of one of the level before by a later item of the same signature. Extending is
a map over signatures, so a level costs one aggregation; pruning keeps the itemsets whose estimate can still reach the
result by a semi-join. Items carry the number of their attribute in the high bits, which makes "one selector for each
attribute" a comparison.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Conjunction
from ..functions.selectors import Selector

SHIFT = 20


class Items:
    """The search space with numbered items."""

    def __init__(self, selectors: list[Selector]):
        unique = {s.key: s for s in selectors}
        groups: dict[tuple, int] = {}
        for s in unique.values():
            groups.setdefault(s.attributes or (s.key,), len(groups))
        order = sorted(unique.values(), key=lambda s: groups[s.attributes or (s.key,)])
        self.selectors = order
        self.ids = [groups[s.attributes or (s.key,)] << SHIFT | i for i, s in enumerate(order)]

    def conjunction(self, itemset) -> Conjunction:
        return Conjunction(self.selectors[i & ((1 << SHIFT) - 1)] for i in itemset)

    def keys(self) -> Column:
        return F.array(*(F.lit(s.key) for s in self.selectors)) if self.selectors else F.array().cast("array<string>")

    def key_of(self, itemset: Column) -> Column:
        """The key of an itemset's conjunction."""
        place = lambda i: i.bitwiseAND(F.lit((1 << SHIFT) - 1)) + 1
        names = F.array_sort(F.transform(itemset, lambda i: F.element_at(self.keys(), place(i))))
        return F.when(F.size(itemset) == 0, F.lit("True")).otherwise(F.concat(F.lit("("), F.array_join(names, " and "), F.lit(")")))


def signatures(df: DataFrame, items: Items, qf, target, const: dict) -> DataFrame:
    """items and the sums of the quality's row values (or the target's value ``t`` and ``n`` rows)."""
    covered = F.array_compact(F.array(*(F.when(s.column(), F.lit(i)) for i, s in zip(items.ids, items.selectors)))) if items.ids else F.array().cast("array<int>")
    if qf.keeps_value:
        return df.select(covered.alias("items"), qf.value(target).alias("t")).groupBy("items", "t").agg(F.count("*").alias("n"))
    values = qf.values(target, const)
    return df.select(covered.alias("items"), *(v.alias(k) for k, v in values.items())).groupBy("items").agg(*(F.sum(k).alias(k) for k in values))


def start(sig: DataFrame) -> DataFrame:
    """Members of the empty itemset: every signature."""
    return sig.select(F.array().cast("array<int>").alias("itemset"), *sig.columns)


def grow(members: DataFrame, same_attribute: bool) -> DataFrame:
    """Members of all itemsets with one item more, behind the last one."""
    last = F.when(F.size("itemset") > 0, F.element_at("itemset", -1)).otherwise(F.lit(-1))
    later = lambda i: i > last if same_attribute else (F.shiftright(i, SHIFT) > F.shiftright(last, SHIFT)) & (i > last)
    rest = [c for c in members.columns if c != "itemset"]
    out = members.select(F.col("itemset").alias("_from"), F.explode(F.filter("items", later)).alias("_next"), *rest)
    return out.select(F.array_append("_from", F.col("_next")).alias("itemset"), *rest)


def with_scores(cells: DataFrame, qf, const: dict) -> DataFrame:
    """quality (null where undefined) and estimate (null where the quality has none)."""
    q = qf.quality(const)
    oe = qf.optimistic(const)
    return cells.withColumn("quality", F.when(F.isnan(q), None).otherwise(q)).withColumn("estimate", (F.when(F.isnan(oe), None).otherwise(oe) if oe is not None else F.lit(None)).cast("double"))


def subsets(itemset: Column) -> Column:
    """All itemsets with one item less."""
    return F.transform(itemset, lambda x: F.array_remove(itemset, x))


def condition(items: Items, itemset) -> Column:
    return items.conjunction(itemset).column()


def has_all(itemset) -> Column:
    """Whether a signature holds all items of a given itemset."""
    return reduce(lambda a, b: a & b, (F.array_contains("items", i) for i in itemset), F.lit(True))


def evaluate(sig: DataFrame, itemsets: list[tuple], sums: list[str], any_of: bool = False, chunk: int = 150) -> list[dict]:
    """The sums over the signatures that hold all (or any) items of each given itemset: conditional aggregates in chunks."""
    out: list[dict] = []
    for at in range(0, len(itemsets), chunk):
        part = itemsets[at : at + chunk]
        hold = [reduce(lambda a, b: a | b, (F.array_contains("items", i) for i in s), F.lit(False)) if any_of else has_all(s) for s in part]
        r = sig.agg(*(F.sum(F.when(h, F.col(c))).alias(f"{c}_{j}") for j, h in enumerate(hold) for c in sums)).first()
        out += [{c: r[f"{c}_{j}"] or 0 for c in sums} for j in range(len(part))]
    return out


def table_of(spark, itemsets: list, rows: list[dict]) -> DataFrame:
    """A small DataFrame of itemsets and sums."""
    names = list(rows[0])
    kinds = ", ".join(f"{n} {'bigint' if n in ('n', 'p') else 'double'}" for n in names)
    data = [(list(i), *(int(r[n]) if n in ("n", "p") else float(r[n]) for n in names)) for i, r in zip(itemsets, rows)]
    return spark.createDataFrame(data, f"itemset array<int>, {kinds}")


NEVER = -math.inf
