"""Results of a search, their sinks, filters over them, and the data behind their plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import overlap

#: Decimals by kind of statistic for automatic rounding.
ROUNDED = {"quality": 3, "relative": 3, "coverage": 3, "target_share": 3, "lift": 3, "mean": 3, "std": 3, "median": 3}


class SubgroupDiscoveryResult:
    """Ranked (quality, description, statistics of the search), best first."""

    def __init__(self, task, rows: list[tuple]):
        self.task = task
        self.results = sorted(rows, key=lambda r: (r[0], r[1].key), reverse=True)

    def __len__(self) -> int:
        return len(self.results)

    def to_descriptions(self, include_stats: bool = False) -> list[tuple]:
        return list(self.results) if include_stats else [r[:2] for r in self.results]

    def to_dataframe(self, statistics_to_show: list[str] | None = None, autoround: bool = False, include_target: bool = False) -> DataFrame:
        """rank, quality, subgroup and the target's statistics, as a DataFrame."""
        task, spark = self.task, self.task.data.sparkSession
        target = task.target
        shown = list(statistics_to_show or target.statistic_names)
        ranked = spark.createDataFrame([(i, float(q), str(d)) for i, (q, d, _) in enumerate(self.results)], "position int, quality double, subgroup string")
        extra = [F.lit(str(target)).alias("target")] if include_target else []
        if not self.results:
            stats = target.calculate_statistics(task.data.limit(0), _empty()).filter("false")
        else:
            stats = target.calculate_statistics(task.data, *(d for _, d, _ in self.results))
        out = ranked.join(F.broadcast(stats.drop("description")), "position").select((F.col("position") + 1).alias("rank"), "quality", "subgroup", *extra, *shown)
        return round_statistics(out) if autoround else out

    def to_table(self, statistics_to_show=None, print_header: bool = True, include_target: bool = False) -> list[list]:
        df = self.to_dataframe(statistics_to_show, include_target=include_target).orderBy("rank").drop("rank")
        return ([df.columns] if print_header else []) + [list(r) for r in df.collect()]

    def to_latex(self, statistics_to_show=None, escape_underscore: bool = True) -> str:
        """A LaTeX table; conjunctions are shown with a wedge."""
        head, *rows = self.to_table(statistics_to_show)
        escape = (lambda s: s.replace("_", r"\_")) if escape_underscore else (lambda s: s)
        cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else escape(str(v).replace(" AND ", r" $\wedge$ "))
        lines = [" & ".join(map(escape, head)) + r" \\"] + [" & ".join(map(cell, r)) + r" \\" for r in rows]
        return "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", *lines, r"\end{tabular}"])


def _empty():
    from ..functions.expressions import Conjunction

    return Conjunction()


def round_statistics(df: DataFrame) -> DataFrame:
    """Round quality and statistics by the kind of each column."""
    digits = lambda c: next((d for k, d in ROUNDED.items() if c.startswith(k)), None)
    return df.select(*(F.round(c, digits(c)).alias(c) if digits(c) is not None and kind == "double" else F.col(c) for c, kind in df.dtypes))


def minimum_quality_filter(df: DataFrame, least: float) -> DataFrame:
    return df.filter(F.col("quality") >= least)


def minimum_statistic_filter(df: DataFrame, statistic: str, least: float) -> DataFrame:
    return df.filter(F.col(statistic) >= least)


def maximum_statistic_filter(df: DataFrame, statistic: str, most: float) -> DataFrame:
    return df.filter(F.col(statistic) <= most)


def unique_attributes(result: SubgroupDiscoveryResult) -> list[tuple]:
    """The best description for each set of attributes; those over text columns alone all stay."""
    kinds, seen, out = dict(result.task.data.dtypes), set(), []
    for r in result.results:
        names = frozenset(r[1].attributes)
        if all(kinds.get(a) in ("string", "boolean") for a in names) or names not in seen:
            out.append(r)
        seen.add(names)
    return out


def overlap_filter(result: SubgroupDiscoveryResult, level: float = 0.9) -> list[tuple]:
    """Go down the ranks and keep what overlaps no kept description by more than ``level``."""
    rows = result.results
    if not rows:
        return []
    shared = {(r["left"], r["right"]): r["jaccard"] or 0.0 for r in overlap(result.task.data, [r[1] for r in rows]).collect()}
    kept: list[tuple] = []
    for r in rows:
        if all(shared[str(r[1]), str(k[1])] <= level for k in kept):
            kept.append(r)
    return kept


def overlaps_list(description, others: list, df: DataFrame, level: float = 0.9) -> bool:
    """Whether a description overlaps any of the others by more than ``level``, from one aggregate over the rows."""
    if not others:
        return False
    covers = df.select(description.column().alias("a"), *(d.column().alias(f"b{i}") for i, d in enumerate(others)))
    both, either = (lambda i: F.count_if(F.col("a") & F.col(f"b{i}"))), (lambda i: F.count_if(F.col("a") | F.col(f"b{i}")))
    return bool(covers.agg(F.greatest(F.lit(0.0), F.lit(0.0), *(F.coalesce(F.try_divide(both(i).cast("double"), either(i)), F.lit(0.0)) for i in range(len(others)))).alias("x")).first()["x"] > level)


def bars(result: SubgroupDiscoveryResult) -> DataFrame:
    """Positive shares and relative sizes of each subgroup and its complement."""
    return result.to_dataframe(["target_share_sg", "target_share_complement", "relative_size_sg", "relative_size_complement"])


def roc(result: SubgroupDiscoveryResult) -> DataFrame:
    """False and true positive rate of each subgroup."""
    df = result.to_dataframe(["size_sg", "size_dataset", "positives_sg", "positives_dataset"])
    fpr = F.try_divide((F.col("size_sg") - F.col("positives_sg")).cast("double"), F.col("size_dataset") - F.col("positives_dataset"))
    return df.select("rank", "subgroup", fpr.alias("fpr"), F.try_divide(F.col("positives_sg").cast("double"), F.col("positives_dataset")).alias("tpr"))


def roc_grid(spark, qf, n: int, p: int, steps: int = 20) -> DataFrame:
    """The quality over a grid of rates, for contours."""
    i, side = F.col("id"), steps + 1
    grid = spark.range(side * side).select(((i % side) / steps).alias("fpr"), ((i / side).cast("long") / steps).alias("tpr"))
    cells = grid.withColumn("p", F.col("tpr") * p).withColumn("n", F.col("p") + F.col("fpr") * (n - p))
    return cells.withColumn("quality", qf.quality({"n": n, "p": p})).select("fpr", "tpr", "quality")


def npspace(result: SubgroupDiscoveryResult) -> DataFrame:
    return result.to_dataframe(["size_sg", "target_share_sg"])


def distribution(df: DataFrame, target, description, bins: int = 10) -> DataFrame:
    """bin, low, density of the subgroup and of the dataset; equal-width bins, the last one closed."""
    v = F.col(f"`{target.variable}`").cast("double")
    r = df.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    low, high = r["low"] or 0.0, r["high"] or 0.0
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((v - low) / width), F.lit(bins - 1))
    counts = df.filter(v.isNotNull()).select(place.cast("int").alias("bin"), description.column().alias("sg")).groupBy("bin").agg(F.count_if("sg").alias("n_sg"), F.count("*").alias("n"))
    total = counts.agg(F.sum("n_sg").alias("t_sg"), F.sum("n").alias("t"))
    both = counts.join(F.broadcast(total))
    return both.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), F.try_divide(F.col("n_sg").cast("double"), F.col("t_sg") * width).alias("density_sg"), F.try_divide(F.col("n").cast("double"), F.col("t") * width).alias("density_dataset"))


def similarity(result: SubgroupDiscoveryResult) -> DataFrame:
    return overlap(result.task.data, [d for _, d, _ in result.results])


def dendrogram(result: SubgroupDiscoveryResult) -> list[tuple[list[str], list[str], float]]:
    """Single-linkage merges on one minus the overlap of the k descriptions: (left, right, distance), nearest first."""
    names = [str(d) for _, d, _ in result.results]
    near = {(r["left"], r["right"]): 1 - (r["jaccard"] or 0.0) for r in similarity(result).collect()}
    groups, out = [[n] for n in names], []
    while len(groups) > 1:
        d, i, j = min((min(near[a, b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        out.append((groups[i], groups[j], d))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return out


def support_matrix(result: SubgroupDiscoveryResult) -> DataFrame:
    """One boolean column for each description over the rows that any covers, most covered first."""
    covers = [d.column().alias(f"s{i}") for i, (_, d, _) in enumerate(result.results)]
    rows = result.task.data.select(*covers)
    return rows.withColumn("covered", sum((F.col(f"s{i}").cast("int") for i in range(len(covers))), F.lit(0))).filter("covered > 0").orderBy(F.desc("covered"))


def perc_formatter(c):
    return F.concat(F.format_string("%.1f", F.col(c) * 100), F.lit("%"))


def float_formatter(c, digits: int = 2):
    return F.format_string(f"%.{digits}f", F.col(c))


def is_finite(q: float) -> bool:
    return not math.isnan(q) and not math.isinf(q)
