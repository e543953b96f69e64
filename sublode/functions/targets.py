"""Targets: what is measured on a subgroup, and the statistics that are reported."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selectors import EqualitySelector, Selector


def report(df: DataFrame, target, descriptions: list, chunk: int = 100) -> DataFrame:
    """One row per description with the target's statistics; one conditional-aggregate pass for each chunk."""
    out = None
    for at in range(0, len(descriptions), chunk):
        part = descriptions[at : at + chunk]
        covers = [d.column() for d in part]
        names = [f"s{i}" for i in range(len(part))]
        rows = target.inputs(df).select("*", *(c.alias(n) for c, n in zip(covers, names)))
        sums = rows.agg(*(a.alias(f"{n}_{k}") for n in names for k, a in target.aggregates(F.col(n)).items()), *(a.alias(f"d_{k}") for k, a in target.aggregates(F.lit(True)).items()))
        kinds = list(target.aggregates(F.lit(True)))
        each = [F.struct(F.lit(at + i).alias("position"), F.lit(str(d)).alias("description"), *(F.col(f"{n}_{k}").alias(k) for k in kinds)) for i, (d, n) in enumerate(zip(part, names))]
        flat = sums.select(F.inline(F.array(*each)), *(F.col(f"d_{k}") for k in kinds))
        one = flat.select("position", "description", *(c.alias(k) for k, c in target.statistics().items()))
        out = one if out is None else out.unionByName(one)
    return out


class BaseTarget:
    statistic_names: tuple[str, ...] = ()

    @property
    def attributes(self) -> tuple[str, ...]:
        return ()

    def inputs(self, df: DataFrame) -> DataFrame:
        return df

    def all_statistics_present(self, row: dict) -> bool:
        return all(n in row for n in self.statistic_names)

    def calculate_statistics(self, df: DataFrame, *descriptions) -> DataFrame:
        return report(df, self, list(descriptions))


class BinaryTarget(BaseTarget):
    """Rows for which a selector holds. A truth value against a number column is read as 1 or 0."""

    statistic_names = (
        "size_sg", "size_dataset", "positives_sg", "positives_dataset", "size_complement", "relative_size_sg", "relative_size_complement", "coverage_sg",
        "coverage_complement", "target_share_sg", "target_share_complement", "target_share_dataset", "lift",
    )

    def __init__(self, attribute: str | None = None, value: object = None, selector: Selector | None = None):
        if (selector is None) == (attribute is None or value is None):
            raise ValueError("give either attribute and value, or a selector")
        self.selector = selector or EqualitySelector(attribute, value)

    def bind(self, df: DataFrame) -> "BinaryTarget":
        s = self.selector
        if isinstance(s, EqualitySelector) and isinstance(s.value, bool) and dict(df.dtypes).get(s.attribute) != "boolean":
            return BinaryTarget(selector=EqualitySelector(s.attribute, int(s.value), s.name))
        return self

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.selector.attributes

    def inputs(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_positive", self.bind(df).selector.column())

    def aggregates(self, cover: Column) -> dict[str, Column]:
        return {"n": F.count_if(cover), "p": F.count_if(cover & F.col("_positive"))}

    def statistics(self) -> dict[str, Column]:
        n, p, N, P = (F.col(c).cast("double") for c in ("n", "p", "d_n", "d_p"))
        share = F.try_divide(p, n)
        out = (
            F.col("n"), F.col("d_n"), F.col("p"), F.col("d_p"), F.col("d_n") - F.col("n"), F.try_divide(n, N), F.try_divide(N - n, N), F.try_divide(p, P),
            F.try_divide(P - p, P), share, F.try_divide(P - p, N - n), F.try_divide(P, N), F.try_divide(share, F.try_divide(P, N)),
        )
        return dict(zip(self.statistic_names, out))

    def get_base_statistics(self, df: DataFrame, description) -> tuple[int, int, int, int]:
        """N, P, n, p."""
        r = report(df, self, [description]).first()
        return r["size_dataset"], r["positives_dataset"], r["size_sg"], r["positives_sg"]


@dataclass(frozen=True)
class NumericTarget(BaseTarget):
    """A number column; missing values are left out of its statistics but count in the sizes."""

    variable: str
    statistic_names = (
        "size_sg", "size_dataset", "mean_sg", "mean_dataset", "std_sg", "std_dataset", "median_sg", "median_dataset", "max_sg", "max_dataset", "min_sg", "min_dataset", "mean_lift", "median_lift",
    )

    @property
    def attributes(self) -> tuple[str, ...]:
        return (self.variable,)

    def inputs(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_value", F.col(f"`{self.variable}`").cast("double"))

    def aggregates(self, cover: Column) -> dict[str, Column]:
        v = F.when(cover, F.col("_value"))
        return {"n": F.count_if(cover), "mean": F.avg(v), "std": F.stddev_pop(v), "median": F.median(v), "max": F.max(v), "min": F.min(v)}

    def statistics(self) -> dict[str, Column]:
        pairs = {f"{k}_{w}": F.col(k if w == "sg" else f"d_{k}") for k in ("mean", "std", "median", "max", "min") for w in ("sg", "dataset")}
        out = {"size_sg": F.col("n"), "size_dataset": F.col("d_n"), **pairs}
        return out | {"mean_lift": F.try_divide(F.col("mean"), F.col("d_mean")), "median_lift": F.try_divide(F.col("median"), F.col("d_median"))}

    def get_base_statistics(self, df: DataFrame, description) -> tuple[int, float, int, float]:
        """N, mean, n, mean of the subgroup."""
        r = report(df, self, [description]).first()
        return r["size_dataset"], r["mean_dataset"], r["size_sg"], r["mean_sg"]


class FITarget(BaseTarget):
    """Frequent itemsets: the size alone."""

    statistic_names = ("size_sg", "size_dataset")

    def aggregates(self, cover: Column) -> dict[str, Column]:
        return {"n": F.count_if(cover)}

    def statistics(self) -> dict[str, Column]:
        return {"size_sg": F.col("n"), "size_dataset": F.col("d_n")}


@dataclass(frozen=True)
class RegressionTarget(BaseTarget):
    """A straight line of y over x: its size, slope and intercept."""

    x: str
    y: str
    statistic_names = ("size_sg", "size_dataset", "slope", "intercept")

    @property
    def attributes(self) -> tuple[str, ...]:
        return (self.x, self.y)

    def aggregates(self, cover: Column) -> dict[str, Column]:
        x, y = (F.when(cover, F.col(f"`{c}`").cast("double")) for c in (self.x, self.y))
        return {"n": F.count_if(cover), "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x)}

    def statistics(self) -> dict[str, Column]:
        return {"size_sg": F.col("n"), "size_dataset": F.col("d_n"), "slope": F.col("slope"), "intercept": F.col("intercept")}
