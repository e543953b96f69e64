"""Search spaces: one selector per nominal value, and exact equal-frequency bins of numeric columns."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.selectors import EqualitySelector, IntervalSelector, Selector


def stable(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder; in local mode one of our own where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return df.checkpoint()


def is_numerical_attribute(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_categorical_attribute(df: DataFrame, name: str) -> bool:
    return not is_numerical_attribute(df, name)


def _ignored(ignore) -> set[str]:
    return {ignore} if isinstance(ignore, str) else set(ignore or ())


def nominal_columns(df: DataFrame, ignore=None) -> list[str]:
    """Columns that are not numbers; nested and temporal types are refused."""
    out = []
    for f in df.schema:
        if f.name in _ignored(ignore) or isinstance(f.dataType, T.NumericType):
            continue
        if not isinstance(f.dataType, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)):
            raise TypeError(f"{f.name}: derive a text or number column from {f.dataType.simpleString()} first, or ignore it")
        out.append(f.name)
    return out


def nominal_catalog(df: DataFrame, columns: list[str], min_count: int = 1) -> DataFrame:
    """attribute, value (as text), rows of every value of the columns, in one pass."""
    each = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.inline(each)).groupBy("attribute", "value").agg(F.count("*").alias("rows")).filter(F.col("rows") >= min_count)


def create_nominal_selectors(df: DataFrame, ignore=None, min_count: int = 1) -> list[Selector]:
    """One equality for each value, missing ones included, ordered by column and key."""
    columns = nominal_columns(df, ignore)
    if not columns:
        return []
    out: dict[str, list[Selector]] = {c: [] for c in columns}
    for r in nominal_catalog(df, columns, min_count).collect():
        a, v = r["attribute"], r["value"]
        if v is not None and isinstance(df.schema[a].dataType, T.BooleanType):
            v = v == "true"
        out[a].append(EqualitySelector(a, math.nan if v is None else v))
    return [s for c in columns for s in sorted(out[c])]


def create_nominal_selectors_for_attribute(df: DataFrame, attribute: str) -> list[Selector]:
    return create_nominal_selectors(df.select(f"`{attribute}`"))


def value_histogram(df: DataFrame, attribute: str) -> DataFrame:
    """v, rows of the values that are present."""
    v = F.col(f"`{attribute}`")
    kind = df.schema[attribute].dataType
    if isinstance(kind, T.DecimalType):
        v, kind = v.cast("double"), T.DoubleType()
    present = v.isNotNull() & ~F.isnan(v) if isinstance(kind, (T.FloatType, T.DoubleType)) else v.isNotNull()
    return df.select(v.alias("v")).filter(present).groupBy("v").agg(F.count("*").alias("rows"))


def cumulative(histogram: DataFrame) -> DataFrame:
    """v, rows, upto: values in range-partitioned order with the rows up to each; no partition holds all values."""
    n = int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable(histogram.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()))
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    first = dealt.groupBy("part").agg(F.sum("rows").alias("part_rows")).withColumn("first", F.coalesce(F.sum("part_rows").over(sums), F.lit(0)))
    inner = Window.partitionBy("part").orderBy("v")
    return dealt.join(first.select("part", "first"), "part").select("v", "rows", (F.col("first") + F.sum("rows").over(inner)).alias("upto"))


#: Histograms of at most so many values are cut on the driver; longer ones by range-partitioned plans, with equal results.
DRIVER_VALUES = 10_000


def _ranks(total: int, nbins: int) -> list[int]:
    return [i * total // nbins for i in range(1, nbins)]


def _cut(values: list[tuple], nbins: int) -> list:
    """Cut points of a sorted list of (value, rows)."""
    cuts, k, upto, total = [], 0, 0, sum(n for _, n in values)
    for rank in _ranks(total, nbins):
        while k < len(values) and upto + values[k][1] <= rank:
            upto += values[k][1]
            k += 1
        at = k
        while at < len(values) and cuts and values[at][0] <= cuts[-1]:
            at += 1
        if at == len(values):
            break
        cuts.append(values[at][0])
    return cuts


def distributed_cuts(histogram: DataFrame, nbins: int) -> list:
    """Cut points of a histogram of any length: one pass for all ranks, and one more for each rank that falls on a cut already taken."""
    table = cumulative(histogram).persist()
    total = table.agg(F.sum("rows").alias("n")).first()["n"] or 0
    first = table.agg(*(F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"c{i}") for i, r in enumerate(_ranks(total, nbins)))).first()
    cuts: list = []
    for v in first:
        if cuts and v is not None and v <= cuts[-1]:
            v = table.filter(F.col("v") > cuts[-1]).agg(F.min("v").alias("v")).first()["v"]
        if v is None:
            break
        cuts.append(v)
    table.unpersist()
    return cuts


def _few(histogram: DataFrame) -> list[tuple] | None:
    rows = histogram.limit(DRIVER_VALUES + 1).collect()
    return sorted((r["v"], r["rows"]) for r in rows) if len(rows) <= DRIVER_VALUES else None


def equal_frequency_discretization(df: DataFrame, attribute: str, nbins: int = 5) -> list:
    """Cut points: the value at each of nbins - 1 equally spaced ranks, or the next larger one if it is a cut already."""
    histogram = value_histogram(df, attribute)
    values = _few(histogram)
    return _cut(values, nbins) if values is not None else distributed_cuts(histogram, nbins)


def create_numeric_selectors_for_attribute(df: DataFrame, attribute: str, nbins: int = 5, intervals_only: bool = True) -> list[Selector]:
    """A null selector if values are missing; then equalities of at most nbins distinct values, or bins by the cut points."""
    kind = df.schema[attribute].dataType
    v = F.col(f"`{attribute}`")
    missing = v.isNull() | F.isnan(v) if isinstance(kind, (T.FloatType, T.DoubleType)) else v.isNull()
    out: list[Selector] = []
    if not df.filter(missing).isEmpty():
        out.append(EqualitySelector(attribute, math.nan))
    histogram = value_histogram(df, attribute)
    values = _few(histogram)
    if values is not None and len(values) <= nbins:
        return out + [EqualitySelector(attribute, x) for x, _ in values]
    cuts = _cut(values, nbins) if values is not None else distributed_cuts(histogram, nbins)
    if intervals_only:
        edges = [-math.inf, *cuts, math.inf]
        return out + [IntervalSelector(attribute, a, b) for a, b in zip(edges, edges[1:])]
    for c in cuts:
        out += [IntervalSelector(attribute, c, math.inf), IntervalSelector(attribute, -math.inf, c)]
    return out


def create_numeric_selectors(df: DataFrame, nbins: int = 5, intervals_only: bool = True, ignore=None) -> list[Selector]:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in _ignored(ignore)]
    return [s for a in names for s in create_numeric_selectors_for_attribute(df, a, nbins, intervals_only)]


def create_selectors(df: DataFrame, nbins: int = 5, intervals_only: bool = True, ignore=None) -> list[Selector]:
    """Nominal, then numeric selectors of all columns."""
    return create_nominal_selectors(df, ignore) + create_numeric_selectors(df, nbins, intervals_only, ignore)
