"""Quality functions as Column factories.

A function names the per-row values that it needs (all of them add up, so that rows, signatures and itemsets can be
summed in any order), and gives its quality and, where there is one, its optimistic estimate as expressions over the
sums. ``const`` holds the dataset's own sums. An undefined quality is null. ``finish`` makes columns that are not sums,
such as a median, for functions that keep the target's value in the signature.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Quality:
    bounded = False
    #: Whether the value of the target stays in the signature, with a count of rows.
    keeps_value = False
    minimal = -math.inf

    def constants(self, df: DataFrame, target) -> dict[str, float]:
        """The dataset's sums under the names of the row values."""
        values = self.values(target.bind(df) if hasattr(target, "bind") else target, {})
        r = df.agg(*(F.sum(v).alias(k) for k, v in values.items())).first()
        return {k: r[k] or 0 for k in values}

    def values(self, target, const: dict) -> dict[str, Column]:
        return {"n": F.lit(1).cast("long")}

    def finish(self, members: DataFrame, const: dict) -> DataFrame:
        """One row per itemset from the rows of members that it covers."""
        return members.groupBy("itemset").agg(*(F.sum(c).alias(c) for c in members.columns if c not in ("items", "itemset")))

    def quality(self, const: dict) -> Column:
        raise NotImplementedError

    def optimistic(self, const: dict) -> Column | None:
        return None


def _d(name: str) -> Column:
    return F.col(name).cast("double")


class SimplePositivesQF(Quality):
    """Rows and positives."""

    def values(self, target, const: dict) -> dict[str, Column]:
        return {"n": F.lit(1).cast("long"), "p": target.selector.column().cast("long")}


class StandardQF(SimplePositivesQF):
    """(n/N)^a * (p/n - P/N)."""

    def __init__(self, a: float):
        if not isinstance(a, (int, float)):
            raise ValueError("a must be a number")
        self.a = a
        self.bounded = 0 <= a <= 1

    def _score(self, n: Column, p: Column, const: dict) -> Column:
        N, P = const["n"], const["p"]
        return F.when(n > 0, F.pow(n / float(max(N, 1)), F.lit(float(self.a))) * (F.try_divide(p, n) - P / max(N, 1)))

    def quality(self, const: dict) -> Column:
        return self._score(_d("n"), _d("p"), const)

    def optimistic(self, const: dict) -> Column:
        return self._score(_d("p"), _d("p"), const)

    def optimistic_generalisation(self, const: dict) -> Column:
        """Bound over all supersets: every remaining positive joins and nothing else."""
        return self._score(_d("n") + (const["p"] - _d("p")), F.lit(float(const["p"])), const)


class LiftQF(StandardQF):
    def __init__(self):
        super().__init__(0.0)


class SimpleBinomialQF(StandardQF):
    def __init__(self):
        super().__init__(0.5)


class WRAccQF(StandardQF):
    def __init__(self):
        super().__init__(1.0)


class ChiSquaredQF(SimplePositivesQF):
    """Chi-squared of the 2x2 table without correction, or its p-value; one-directional results change sign."""

    def __init__(self, direction: str = "both", min_instances: int = 5, stat: str = "chi2"):
        if direction not in ("both", "positive", "negative"):
            raise ValueError("direction is both, positive or negative")
        if stat not in ("chi2", "p"):
            raise KeyError(stat)
        self.direction, self.min_instances, self.stat = direction, min_instances, stat

    def quality(self, const: dict) -> Column:
        N, P, n, p = float(const["n"]), float(const["p"]), _d("n"), _d("p")
        top = N * F.pow(p * (N - n - P + p) - (n - p) * (P - p), 2)
        value = F.coalesce(F.try_divide(top, n * (N - n) * P * (N - P)), F.lit(0.0))
        if self.stat == "p":
            value = _p_value(value)
        if self.direction != "both":
            up = F.try_divide(p, n) > P / max(N, 1.0)
            value = F.when(up if self.direction == "positive" else ~up, value).otherwise(-value)
        small = (n < self.min_instances) | (N - n < self.min_instances)
        return F.when(small, F.lit(-math.inf)).otherwise(value)


def _p_value(chi2: Column) -> Column:
    """Upper tail with one degree of freedom, erfc(sqrt(x / 2)), which neither Spark nor its SQL has."""
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    return tail(chi2)


class CountQF(Quality):
    """Rows."""

    bounded = True

    def quality(self, const: dict) -> Column:
        return _d("n")

    optimistic = quality


class AreaQF(Quality):
    """Rows times the number of selectors."""

    def quality(self, const: dict) -> Column:
        return _d("n") * F.size("itemset")


class StandardQFNumeric(Quality):
    """n^a * (centre - centre of the dataset), by mean or median; three optimistic estimates. ``invert`` has no effect."""

    def __init__(self, a: float, invert: bool = False, estimator: str = "default", centroid: str = "mean"):
        if not isinstance(a, (int, float)):
            raise ValueError("a must be a number")
        if isinstance(invert, str):  # a, estimator, centroid by position
            invert, estimator, centroid = False, invert, centroid if estimator == "default" else estimator
        if centroid not in ("mean", "median", "sorted_median"):
            raise ValueError("centroid is mean, median or sorted_median")
        estimator = {"default": "sum" if centroid == "mean" else "max", "average": "max"}.get(estimator, estimator)
        if estimator not in ("sum", "max", "order"):
            raise ValueError("estimator is sum, max, average or order")
        if centroid != "mean" and estimator == "sum":
            raise AssertionError("a median has no sum estimate")
        if centroid != "mean" and estimator == "order":
            raise NotImplementedError("a median has no order estimate")
        self.a, self.invert, self.estimator, self.centroid = a, invert, estimator, centroid
        self.bounded = estimator != "sum" or 0 <= a <= 1
        self.keeps_value = True

    def constants(self, df: DataFrame, target) -> dict[str, float]:
        v = F.col(f"`{target.variable}`").cast("double")
        r = df.agg(F.count("*").alias("n"), (F.avg(v) if self.centroid == "mean" else F.median(v)).alias("c")).first()
        return {"n": r["n"], "centre": r["c"] or 0.0}

    def value(self, target) -> Column:
        return F.col(f"`{target.variable}`").cast("double")

    def finish(self, members: DataFrame, const: dict) -> DataFrame:
        t, k, c0 = F.col("t"), F.col("n"), F.lit(float(const["centre"]))
        above = F.when(t > c0, k)
        keys = ["itemset"]
        if self.estimator == "order":
            members = order_prefixes(members, keys, const["centre"], self.a)
        out = [
            F.sum(k).alias("n"), (F.try_divide(F.sum(t * k), F.sum(F.when(t.isNotNull(), k))) if self.centroid == "mean" else F.percentile(t, 0.5, k)).alias("centre"),
            F.sum(F.when(t > c0, (t - c0) * k)).alias("over"), F.sum(above).alias("n_over"), F.max(F.when(t > c0, t)).alias("most"),
        ]
        return members.groupBy(*keys).agg(*out, *([F.max("prefix").alias("order_best")] if self.estimator == "order" else []))

    def quality(self, const: dict) -> Column:
        return F.when(F.col("n") > 0, F.pow(_d("n"), F.lit(float(self.a))) * (F.col("centre") - const["centre"]))

    def optimistic(self, const: dict) -> Column:
        if self.estimator == "sum":
            return F.coalesce("over", F.lit(0.0))
        if self.estimator == "max":
            return F.coalesce(F.pow(_d("n_over"), F.lit(float(self.a))) * (F.col("most") - const["centre"]), F.lit(-math.inf))
        return F.coalesce("order_best", F.lit(-math.inf))


def order_prefixes(rows: DataFrame, keys: list[str], centre: float, a: float) -> DataFrame:
    """Quality of every prefix of the target's values in descending order, as ``prefix``; each distinct value stands for
    its last row, and for its first, between which the quality of a prefix with a <= 1 has no higher point."""
    w = Window.partitionBy(*keys).orderBy(F.desc("t"))
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    n, s = F.sum("n").over(upto), F.sum(F.col("t") * F.col("n")).over(upto)
    n0, s0 = F.coalesce(F.sum("n").over(before), F.lit(0)) + 1, F.coalesce(F.sum(F.col("t") * F.col("n")).over(before), F.lit(0.0)) + F.col("t")
    score = lambda k, x: F.pow(k.cast("double"), F.lit(float(a))) * (F.try_divide(x, k.cast("double")) - centre)
    return rows.withColumn("prefix", F.greatest(score(n, s), score(n0, s0)))


class StandardQFNumericMedian(Quality):
    def __init__(self, *args):
        raise NotImplementedError("use StandardQFNumeric with centroid='median'")


class StandardQFNumericTscore(Quality):
    """sqrt(n) * (mean - mean of the dataset) / population deviation of the subgroup; 0 where that is 0. ``invert`` has no effect."""

    def __init__(self, invert: bool = False):
        self.invert = invert

    def constants(self, df: DataFrame, target) -> dict[str, float]:
        v = F.col(f"`{target.variable}`").cast("double")
        r = df.agg(F.count("*").alias("n"), F.avg(v).alias("c")).first()
        return {"n": r["n"], "centre": r["c"] or 0.0}

    def values(self, target, const: dict) -> dict[str, Column]:
        off = F.col(f"`{target.variable}`").cast("double") - const.get("centre", 0.0)
        return {"n": F.lit(1).cast("long"), "off": off, "off2": off * off}

    def quality(self, const: dict) -> Column:
        mean = F.col("off") / _d("n")
        std = F.sqrt(F.greatest(F.col("off2") / _d("n") - mean * mean, F.lit(0.0)))
        return F.when((F.col("n") > 0) & (std > 0), F.sqrt(_d("n")) * mean / std).otherwise(0.0)


class GeneralizationAwareQF(Quality):
    """A quality less the best quality, and at least 0, of any proper generalisation."""

    def __init__(self, qf: Quality):
        self.qf = qf

    def constants(self, df, target):
        return self.qf.constants(df, target)

    def values(self, target, const):
        return self.qf.values(target, const)

    def finish(self, members, const):
        return self.qf.finish(members, const)


class GeneralizationAware_StandardQF(SimplePositivesQF):
    """(n/N)^a * (p/n - highest positive share of the dataset and all generalisations)."""

    def __init__(self, a: float, strategy: str = "difference"):
        if strategy not in ("difference", "max"):
            raise ValueError("strategy is difference or max")
        self.a, self.strategy = a, strategy


class GeneralizationAware_StandardQFNumeric(Quality):
    """(n/N)^a * (mean - highest mean of the dataset and all generalisations)."""

    def __init__(self, a: float):
        self.a = a

    def constants(self, df, target):
        v = F.col(f"`{target.variable}`").cast("double")
        r = df.agg(F.count("*").alias("n"), F.sum(v).alias("s")).first()
        return {"n": r["n"], "s": r["s"] or 0.0}

    def values(self, target, const):
        return {"n": F.lit(1).cast("long"), "s": F.col(f"`{target.variable}`").cast("double")}


class EMM_Likelihood(Quality):
    """Mean density of the residuals of a line fitted on the subgroup, inside less outside it.

    ``compat=True`` gives the sum over all rows by the subgroup's size instead.
    """

    def __init__(self, compat: bool = False):
        self.compat = compat

    def constants(self, df, target):
        x, y = (F.col(f"`{c}`").cast("double") for c in (target.x, target.y))
        r = df.agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y")).first()
        return {"n": r["n"], "x": r["x"] or 0.0, "y": r["y"] or 0.0}

    def values(self, target, const):
        x, y = (F.col(f"`{c}`").cast("double") - const.get(k, 0.0) for c, k in ((target.x, "x"), (target.y, "y")))
        return {"n": F.lit(1).cast("long"), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x}


class CombinedInterestingnessMeasure(Quality):
    """The weighted sum of qualities that score the same sums of a subgroup; its bound is that of its parts."""

    def __init__(self, measures: list[Quality] | None = None, weights: list[float] | None = None):
        if measures is None:
            raise NotImplementedError("give the measures to combine")
        self.measures, self.weights = list(measures), [1.0] * len(measures) if weights is None else [float(w) for w in weights]
        if not self.measures or len(self.weights) != len(self.measures):
            raise ValueError("give a weight for each of one or more measures")
        if any(m.keeps_value or type(m).finish is not Quality.finish for m in self.measures):
            raise ValueError("only measures of plain sums can be combined")
        self.bounded = all(m.bounded and w >= 0 for m, w in zip(self.measures, self.weights))

    def values(self, target, const: dict) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for m in self.measures:
            out |= m.values(target, const)
        return out

    def quality(self, const: dict) -> Column:
        return reduce(lambda x, y: x + y, (m.quality(const) * w for m, w in zip(self.measures, self.weights)))

    def optimistic(self, const: dict) -> Column | None:
        parts = [m.optimistic(const) for m in self.measures]
        return None if any(x is None for x in parts) else reduce(lambda x, y: x + y, (x * w for x, w in zip(parts, self.weights)))


class CountCallsInterestingMeasure(Quality):
    """Another quality that counts the candidates it has scored."""

    def __init__(self, qf: Quality):
        self.qf, self.calls, self.bounded, self.keeps_value = qf, 0, qf.bounded, qf.keeps_value

    def __getattr__(self, name):
        return getattr(self.qf, name)

    def constants(self, df, target):
        return self.qf.constants(df, target)

    def values(self, target, const):
        return self.qf.values(target, const)

    def finish(self, members, const):
        out = self.qf.finish(members, const).persist()
        self.calls += out.count()
        return out

    def quality(self, const):
        return self.qf.quality(const)

    def optimistic(self, const):
        return self.qf.optimistic(const)


class MinSupportConstraint:
    """At least so many rows; it holds for all generalisations of what it holds for."""

    is_monotone = True

    def __init__(self, min_support: int):
        self.min_support = min_support

    def column(self) -> Column:
        return F.col("n") >= self.min_support
