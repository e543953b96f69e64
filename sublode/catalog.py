"""Registered queries of the engine over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sublode as S

from .functions import scalars
from .functions.quality import order_prefixes
from .operators import results as R
from .operators import search as A
from .plans import lattice as L
from .plans import searchspace as P

K = 20
LINE = ["l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
FLAG = "l_returnflag"
PART = ["p_brand", "p_type", "p_size"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lineitem(spark, d, *more) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE, FLAG, *more)


def orders(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice")


def line_task(spark, d, qf, **more) -> S.SubgroupDiscoveryTask:
    df = lineitem(spark, d)
    space = S.create_selectors(df, 5, more.pop("intervals_only", True), ignore=[FLAG])
    return S.SubgroupDiscoveryTask(df, S.BinaryTarget(FLAG, "R"), space, qf, more.pop("k", K), more.pop("depth", 2), **more)


def order_task(spark, d, qf, **more) -> S.SubgroupDiscoveryTask:
    df = orders(spark, d)
    space = S.create_nominal_selectors(df)
    return S.SubgroupDiscoveryTask(df, S.NumericTarget("o_totalprice"), space, qf, K, more.pop("depth", 2), **more)


def part_task(spark, d, qf, depth=2) -> S.SubgroupDiscoveryTask:
    df = table(spark, d, "part").select(*PART)
    return S.SubgroupDiscoveryTask(df, S.FITarget(), S.create_selectors(df), qf, K, depth)


def ranked(result: S.SubgroupDiscoveryResult, *stats: str) -> DataFrame:
    spark = result.task.data.sparkSession
    rows = [(i + 1, round(float(q), 9), d.key, *(int(s[k]) for k in stats)) for i, (q, d, s) in enumerate(result.results)]
    return spark.createDataFrame(rows, ", ".join(["rank bigint, quality double, subgroup string", *(f"{k} bigint" for k in stats)]))


def cells(task, depth: int = 1) -> DataFrame:
    """All itemsets of exactly ``depth`` selectors with their sums, quality and estimate."""
    run = A._Run(task)
    members = L.start(run.sig)
    for _ in range(depth):
        members = L.grow(members, False)
    out = L.with_scores(task.qf.finish(members, run.const), task.qf, run.const)
    return out.withColumn("subgroup", run.items.key_of(F.col("itemset")))


# ---- SQL parts


def sql_cuts(source: str, column: str, bins: int = 5) -> str:
    """CTEs h_<column> (values with running counts) and c_<column> (one row of cut points)."""
    parts = [f"h_{column} AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1))"]
    for i in range(1, bins):
        more = f" AND v > (SELECT x FROM k{i - 1}_{column})" if i > 1 else ""
        parts.append(f"k{i}_{column} AS (SELECT min(v) AS x FROM h_{column} WHERE upto > {i} * total // {bins}{more})")
    return ", ".join(parts)


def sql_item(column: str, kind: str, bins: int = 5) -> str:
    if kind == "text":
        return f"'{column}==''' || {column} || ''''"
    x = [f"(SELECT x FROM k{i}_{column})" for i in range(1, bins)]
    out = f"CASE WHEN {column} < {x[0]} THEN '{column}<' || {x[0]}"
    for a, b in zip(x, x[1:]):
        out += f" WHEN {column} < {b} THEN '{column}: [' || {a} || ':' || {b} || '['"
    return out + f" ELSE '{column}>=' || {x[-1]} END"


def sql_cells(depth: int, n_items: int, sums: str, exact: bool = False) -> str:
    """cells(items, ...): groups of every combination of up to ``depth`` items (or exactly so many) over table base."""
    out = []
    for size in range(depth if exact else 0, depth + 1):
        for c in combinations(range(n_items), size):
            names = ", ".join(f"i{k}" for k in c)
            out.append(f"SELECT CAST([{names}] AS VARCHAR[]) AS items, {sums} FROM base" + (f" GROUP BY {names}" if c else ""))
    return " UNION ALL ".join(out)


KEY = "CASE WHEN len(items) = 0 THEN 'True' ELSE '(' || array_to_string(list_sort(items), ' and ') || ')' END"


def sql_line(depth: int = 2, exact: bool = False, bins: bool = True) -> str:
    kinds = {c: "text" if c == "l_linestatus" else "number" for c in LINE}
    cuts = ", ".join(sql_cuts("lineitem", c) for c in LINE if kinds[c] == "number")
    items = ", ".join(f"{sql_item(c, kinds[c])} AS i{k}" for k, c in enumerate(LINE))
    return (
        f"WITH {cuts}, base AS (SELECT {items}, CAST({FLAG} = 'R' AS BIGINT) AS pos FROM lineitem), tot AS (SELECT count(*) AS bn, CAST(sum(pos) AS BIGINT) AS bp FROM base), "
        f"cells AS ({sql_cells(depth, len(LINE), 'count(*) AS n, CAST(sum(pos) AS BIGINT) AS p', exact)})"
    )


def sql_orders(depth: int, sums: str, exact: bool = False, value: str = "o_totalprice") -> str:
    cols = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
    items = ", ".join(f"{sql_item(c, 'text')} AS i{k}" for k, c in enumerate(cols))
    return f"WITH base AS (SELECT {items}, {value} AS t FROM orders JOIN customer ON o_custkey = c_custkey), tot AS (SELECT count(*) AS bn, avg(t) AS bm, median(t) AS bmed, sum(t) AS bs FROM base), cells AS ({sql_cells(depth, 3, sums, exact)})"


def sql_part(depth: int = 2) -> str:
    kinds = {"p_brand": "text", "p_type": "text", "p_size": "number"}
    items = ", ".join(f"{sql_item(c, kinds[c])} AS i{k}" for k, c in enumerate(PART))
    return f"WITH {sql_cuts('part', 'p_size')}, base AS (SELECT {items} FROM part), cells AS ({sql_cells(depth, 3, 'count(*) AS n')})"


def std(a: float, n: str = "n", p: str = "p") -> str:
    return f"pow({n} / CAST(bn AS DOUBLE), {a}) * ({p} / CAST({n} AS DOUBLE) - bp / CAST(bn AS DOUBLE))"


def sql_top(head: str, quality: str, source: str = "cells, tot", stats: str = "n, p", where: str = "TRUE", k: int = K) -> str:
    return (
        f"{head}, scored AS (SELECT *, {quality} AS q, {KEY} AS subgroup FROM {source} WHERE {where}) "
        f"SELECT row_number() OVER (ORDER BY q DESC, subgroup DESC) AS rank, round(q, 9) AS quality, subgroup, {stats} FROM scored ORDER BY rank LIMIT {k}"
    )


QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = " ".join(sql.split())
        return f

    return add


def sizes_sql(source: str, *pairs: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS description, count(*) FILTER (WHERE {cond}) AS size_sg, count(*) AS size_dataset FROM {source}" for label, cond in pairs)


# ---- selectors and descriptions


@register("sel_equality", sizes_sql("lineitem", ("l_returnflag==''R''", "l_returnflag = 'R'"), ("l_linenumber==3", "l_linenumber = 3"), ("l_quantity==10.0", "l_quantity = 10")))
def sel_equality(spark, d):
    return S.cover_sizes(table(spark, d, "lineitem"), [S.EqualitySelector(FLAG, "R"), S.EqualitySelector("l_linenumber", 3), S.EqualitySelector("l_quantity", 10.0)])


@register("sel_isnull", sizes_sql("(SELECT nullif(event_type, 'click') AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)", ("kind.isnull()", "kind IS NULL"), ("v.isnull()", "v IS NULL")))
def sel_isnull(spark, d):
    e = table(spark, d, "events").select(F.nullif("event_type", F.lit("click")).alias("kind"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return S.cover_sizes(e, [S.EqualitySelector("kind", float("nan")), S.EqualitySelector("v", float("nan"))])


@register("sel_not", sizes_sql("(SELECT nullif(event_type, 'click') AS kind FROM events)", ("NOT kind==''view''", "kind IS NULL OR kind <> 'view'"), ("NOT kind.isnull()", "kind IS NOT NULL")))
def sel_not(spark, d):
    e = table(spark, d, "events").select(F.nullif("event_type", F.lit("click")).alias("kind"))
    return S.cover_sizes(e, [S.NegatedSelector(S.EqualitySelector("kind", "view")), S.NegatedSelector(S.EqualitySelector("kind", float("nan")))])


@register("sel_interval", sizes_sql("lineitem", ("l_quantity: [10.0:20.0[", "l_quantity >= 10 AND l_quantity < 20"), ("l_quantity<5.0", "l_quantity < 5"), ("l_tax>=0.05", "l_tax >= 0.05")))
def sel_interval(spark, d):
    inf = float("inf")
    return S.cover_sizes(table(spark, d, "lineitem"), [S.IntervalSelector("l_quantity", 10.0, 20.0), S.IntervalSelector("l_quantity", -inf, 5.0), S.IntervalSelector("l_tax", 0.05, inf)])


def _orders_parts():
    return S.EqualitySelector("o_orderstatus", "F"), S.EqualitySelector("o_orderpriority", "1-URGENT"), S.IntervalSelector("o_totalprice", 100000.0, 200000.0)


@register("expr_conjunction", sizes_sql("orders", ("Dataset", "TRUE"), ("o_orderpriority==''1-URGENT'' AND o_orderstatus==''F''", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")))
def expr_conjunction(spark, d):
    a, b, _ = _orders_parts()
    return S.cover_sizes(table(spark, d, "orders"), [S.Conjunction(), S.Conjunction(a) & b])


@register("expr_disjunction", sizes_sql("orders", ("Empty", "FALSE"), ("o_orderpriority==''1-URGENT'' OR o_orderstatus==''F''", "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")))
def expr_disjunction(spark, d):
    a, b, _ = _orders_parts()
    return S.cover_sizes(table(spark, d, "orders"), [S.Disjunction(), S.Disjunction(a) | b])


@register("expr_dnf", sizes_sql("orders", ("o_orderpriority==''1-URGENT'' AND o_totalprice: [100000.0:200000.0[ OR o_orderstatus==''F'' AND o_totalprice: [100000.0:200000.0[", "(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice >= 100000 AND o_totalprice < 200000")))
def expr_dnf(spark, d):
    a, b, c = _orders_parts()
    return S.cover_sizes(table(spark, d, "orders"), [S.DNF([a, b]) & c])


@register("jaccard_overlap", "WITH b AS (SELECT o_orderstatus = 'F' AS c0, o_orderpriority = '1-URGENT' AS c1 FROM orders) SELECT * FROM (SELECT 'o_orderstatus==''F''' AS \"left\", 'o_orderpriority==''1-URGENT''' AS \"right\", count(*) FILTER (WHERE c0 AND c1) / CAST(count(*) FILTER (WHERE c0 OR c1) AS DOUBLE) AS jaccard FROM b)")
def jaccard_overlap(spark, d):
    a, b, _ = _orders_parts()
    return S.overlap(table(spark, d, "orders"), [a, b]).filter((F.col("left") == str(a)) & (F.col("right") == str(b)))


# ---- search spaces


@register("catalog_nominal", " UNION ALL ".join(f"SELECT '{c}' AS attribute, {c} AS value, count(*) AS \"rows\" FROM lineitem GROUP BY {c}" for c in (FLAG, "l_linestatus")))
def catalog_nominal(spark, d):
    return P.nominal_catalog(table(spark, d, "lineitem"), [FLAG, "l_linestatus"])


@register("catalog_numeric", "SELECT l_tax AS v, count(*) AS \"rows\", CAST(sum(count(*)) OVER (ORDER BY l_tax) AS BIGINT) AS upto FROM lineitem GROUP BY l_tax")
def catalog_numeric(spark, d):
    return P.cumulative(P.value_histogram(table(spark, d, "lineitem"), "l_tax"))


def _cuts_sql(source, column):
    return f"WITH {sql_cuts(source, column)} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST(x AS DOUBLE) AS cut FROM k{i}_{column}" for i in range(1, 5))


@register("eqfreq_bins", _cuts_sql("events", "value"))
def eqfreq_bins(spark, d):
    cuts = S.equal_frequency_discretization(table(spark, d, "events"), "value", 5)
    return spark.createDataFrame([(i + 1, float(c)) for i, c in enumerate(cuts)], "i bigint, cut double")


# ---- target statistics


@register("binary_stats", """WITH t AS (SELECT count(*) AS bn, sum(CAST(l_returnflag = 'R' AS INT)) AS bp, count(*) FILTER (WHERE l_linestatus = 'F') AS n, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS p FROM lineitem)
SELECT n AS size_sg, bn AS size_dataset, p AS positives_sg, CAST(bp AS BIGINT) AS positives_dataset, bn - n AS size_complement, round(n / CAST(bn AS DOUBLE), 9) AS relative_size_sg, round((bn - n) / CAST(bn AS DOUBLE), 9) AS relative_size_complement,
round(p / CAST(bp AS DOUBLE), 9) AS coverage_sg, round((bp - p) / CAST(bp AS DOUBLE), 9) AS coverage_complement, round(p / CAST(n AS DOUBLE), 9) AS target_share_sg, round((bp - p) / CAST(bn - n AS DOUBLE), 9) AS target_share_complement,
round(bp / CAST(bn AS DOUBLE), 9) AS target_share_dataset, round((p / CAST(n AS DOUBLE)) / (bp / CAST(bn AS DOUBLE)), 9) AS lift FROM t""")
def binary_stats(spark, d):
    return rounded(S.BinaryTarget(FLAG, "R").calculate_statistics(lineitem(spark, d), S.Conjunction(S.EqualitySelector("l_linestatus", "F"))).drop("position", "description"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


_AGG = {"mean": "avg({})", "std": "stddev_pop({})", "median": "median({})", "max": "max({})", "min": "min({})"}


@register("numeric_stats", "SELECT size_sg, size_dataset, " + ", ".join(f"round({k}_{w}, 6) AS {k}_{w}" for k in _AGG for w in ("sg", "dataset")) + ", round(mean_sg / mean_dataset, 6) AS mean_lift, round(median_sg / median_dataset, 6) AS median_lift FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS size_sg, count(*) AS size_dataset, "
    + ", ".join(f"{e.format(x)} AS {k}_{w}" for k, e in _AGG.items() for w, x in (("sg", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice END"), ("dataset", "o_totalprice"))) + " FROM orders)")
def numeric_stats(spark, d):
    out = S.NumericTarget("o_totalprice").calculate_statistics(table(spark, d, "orders"), S.Conjunction(S.EqualitySelector("o_orderstatus", "F")))
    return rounded(out.drop("position", "description"), 6)


@register("fi_stats", "SELECT count(*) FILTER (WHERE p_brand = 'Brand#11') AS size_sg, count(*) AS size_dataset FROM part")
def fi_stats(spark, d):
    return S.FITarget().calculate_statistics(table(spark, d, "part"), S.Conjunction(S.EqualitySelector("p_brand", "Brand#11"))).drop("position", "description")


# ---- qualities of single cells


def _line_cells(qf, name, formula):
    sql = f"{sql_line(1, True)} SELECT {KEY} AS subgroup, n, p, round({formula}, 9) AS quality FROM cells, tot"

    @register(name, sql)
    def run(spark, d):
        return cells(line_task(spark, d, qf)).select("subgroup", "n", "p", F.round("quality", 9).alias("quality"))


_line_cells(S.StandardQF(0.0), "qf_standard_a0", std(0))
_line_cells(S.StandardQF(0.5), "qf_standard_a05", std(0.5))
_line_cells(S.StandardQF(1.0), "qf_standard_a1", std(1))
_line_cells(S.ChiSquaredQF(), "qf_chi2_stat", "CASE WHEN n < 5 OR bn - n < 5 THEN -'Infinity'::DOUBLE ELSE bn * pow(p * CAST(bn - n - bp + p AS DOUBLE) - (n - p) * CAST(bp - p AS DOUBLE), 2) / (CAST(n AS DOUBLE) * (bn - n) * bp * (bn - bp)) END")


@register("qf_chi2_p")
def qf_chi2_p(spark, d):
    return cells(line_task(spark, d, S.ChiSquaredQF(stat="p"))).select("subgroup", "n", "p", F.round("quality", 9).alias("quality"))


def _order_cells(qf, name, sums, columns, shown, digits):
    @register(name, f"{sql_orders(1, sums, True)} SELECT {KEY} AS subgroup, n, {columns} FROM cells, tot")
    def run(spark, d):
        return cells(order_task(spark, d, qf)).select("subgroup", "n", F.round(shown, digits).alias(shown))


_order_cells(S.StandardQFNumeric(1.0), "qf_numeric_mean", "count(*) AS n, avg(t) AS m", "round(n * (m - bm), 2) AS quality", "quality", 2)
_order_cells(S.StandardQFNumeric(1.0, centroid="median"), "qf_numeric_median", "count(*) AS n, median(t) AS m", "round(n * (m - bmed), 2) AS quality", "quality", 2)
_order_cells(S.StandardQFNumericTscore(), "qf_tscore", "count(*) AS n, avg(t) AS m, stddev_pop(t) AS s", "round(sqrt(n) * (m - bm) / s, 6) AS quality", "quality", 6)
_over = "(SELECT avg(t) FROM base)"
_order_cells(S.StandardQFNumeric(1.0), "oe_sum", f"count(*) AS n, sum(CASE WHEN t > {_over} THEN t - {_over} ELSE 0 END) AS e", "round(e, 2) AS estimate", "estimate", 2)
_order_cells(S.StandardQFNumeric(1.0, estimator="max"), "oe_max", f"count(*) AS n, count(*) FILTER (WHERE t > {_over}) * (max(t) - {_over}) AS e", "round(e, 2) AS estimate", "estimate", 2)


@register("oe_order", """WITH o AS (SELECT 'o_orderstatus==''' || o_orderstatus || '''' AS g, o_totalprice AS t FROM orders), m AS (SELECT avg(t) AS bm FROM o), r AS (SELECT g, row_number() OVER w AS k, sum(t) OVER (PARTITION BY g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS s FROM o WINDOW w AS (PARTITION BY g ORDER BY t DESC))
SELECT '(' || g || ')' AS subgroup, round(max(sqrt(k) * (s / k - bm)), 4) AS estimate FROM r, m GROUP BY g""")
def oe_order(spark, d):
    o = table(spark, d, "orders")
    centre = o.agg(F.avg("o_totalprice")).first()[0]
    rows = o.groupBy("o_orderstatus", F.col("o_totalprice").alias("t")).agg(F.count("*").alias("n"))
    out = order_prefixes(rows, ["o_orderstatus"], centre, 0.5).groupBy("o_orderstatus").agg(F.max("prefix").alias("e"))
    return out.select(F.concat(F.lit("(o_orderstatus=='"), "o_orderstatus", F.lit("')")).alias("subgroup"), F.round("e", 4).alias("estimate"))


@register("qf_count", sql_top(sql_part(), "CAST(n AS DOUBLE)", "cells", "n"))
def qf_count(spark, d):
    return ranked(S.GpGrowth().execute(part_task(spark, d, S.CountQF())), "n")


@register("qf_area", sql_top(sql_part(), "CAST(n * len(items) AS DOUBLE)", "cells", "n", "len(items) > 0"))
def qf_area(spark, d):
    return ranked(S.SimpleSearch().execute(part_task(spark, d, S.AreaQF())), "n")


# ---- searches


def _search(name, algorithm, root, **more):
    where = "TRUE" if root else "len(items) > 0"
    if "least" in more:
        where += f" AND {std(1)} > {more['least']}"
    if "support" in more:
        where += f" AND n >= {more['support']}"

    @register(name, sql_top(sql_line(more.get("depth", 2)), std(1), where=where))
    def run(spark, d):
        limits = {"min_quality": more["least"]} if "least" in more else {}
        if "support" in more:
            limits["constraints"] = [S.MinSupportConstraint(more["support"])]
        return ranked(algorithm().execute(line_task(spark, d, S.WRAccQF(), depth=more.get("depth", 2), **limits)), "n", "p")


_search("topk_simple", S.SimpleSearch, False)
_search("topk_dfs", S.DFS, True)
_search("topk_simple_dfs", S.SimpleDFS, True)
_search("topk_apriori", S.Apriori, False)
_search("topk_bestfirst", S.BestFirstSearch, False)
_search("topk_growth", S.GpGrowth, True)
_search("topk_growth_top_down", lambda: S.GpGrowth("t_d"), True, support=50)
_search("topk_depth3", S.DFS, True, depth=3)
_search("topk_min_support", S.DFS, True, support=3000)
_search("topk_min_quality", S.DFS, True, least=0.0005)


@register("topk_overlapping", f"WITH {sql_cuts('lineitem', 'l_quantity')}, x AS (" + " UNION ALL ".join(f"SELECT x FROM k{i}_l_quantity" for i in range(1, 5)) + """), s AS (SELECT 'l_quantity<' || x AS item, -1e300 AS a, x AS b FROM x UNION ALL SELECT 'l_quantity>=' || x, x, 1e300 FROM x),
cells AS (SELECT [item] AS items, count(*) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS p FROM lineitem JOIN s ON l_quantity >= a AND l_quantity < b GROUP BY item), tot AS (SELECT count(*) AS bn, sum(CAST(l_returnflag = 'R' AS INT)) AS bp FROM lineitem),
scored AS (SELECT *, """ + std(1) + f" AS q, {KEY} AS subgroup FROM cells, tot) SELECT row_number() OVER (ORDER BY q DESC, subgroup DESC) AS rank, round(q, 9) AS quality, subgroup, n, p FROM scored")
def topk_overlapping(spark, d):
    df = lineitem(spark, d).select("l_quantity", FLAG)
    space = P.create_numeric_selectors(df, 5, intervals_only=False)
    return ranked(S.SimpleSearch().execute(S.SubgroupDiscoveryTask(df, S.BinaryTarget(FLAG, "R"), space, S.WRAccQF(), K, 1)), "n", "p")


_NUM = sql_top(sql_orders(2, "count(*) AS n, avg(t) AS m"), "pow(n, 0.5) * (m - bm)", stats="n").replace("round(q, 9)", "round(q, 4)")


def _numeric(algorithm, d, spark):
    out = ranked(algorithm.execute(order_task(spark, d, S.StandardQFNumeric(0.5))), "n")
    return out.withColumn("quality", F.round("quality", 4))


@register("topk_numeric", _NUM)
def topk_numeric(spark, d):
    return _numeric(S.DFS(), d, spark)


@register("dfs_numeric", _NUM)
def dfs_numeric(spark, d):
    return _numeric(S.DFSNumeric(), d, spark)


@register("beam_search", f"""{sql_line(2)}, sc AS (SELECT items, n, p, {std(1)} AS q, {KEY} AS subgroup FROM cells, tot), b AS (SELECT items FROM sc WHERE len(items) <= 1 ORDER BY q DESC, subgroup DESC LIMIT {K}),
f AS (SELECT * FROM sc WHERE items IN (SELECT items FROM b) OR (len(items) = 2 AND EXISTS (SELECT 1 FROM b WHERE len(b.items) = 1 AND list_contains(sc.items, b.items[1]))))
SELECT row_number() OVER (ORDER BY q DESC, subgroup DESC) AS rank, round(q, 9) AS quality, subgroup, n, p FROM f ORDER BY rank LIMIT {K}""")
def beam_search(spark, d):
    return ranked(S.BeamSearch(K).execute(line_task(spark, d, S.WRAccQF())), "n", "p")


# ---- generalisation-aware qualities

_UP = "(SELECT max(u.{0}) FROM sc u WHERE len(u.items) < len(sc.items) AND list_has_all(sc.items, u.items))"


@register("ga_quality", sql_top(f"{sql_line(2)}, sc AS (SELECT *, {std(1)} AS own FROM cells, tot), ga AS (SELECT items, n, p, own - greatest(0, coalesce({_UP.format('own')}, 0)) AS gq FROM sc)", "gq", "ga"))
def ga_quality(spark, d):
    return ranked(S.DFS().execute(line_task(spark, d, S.GeneralizationAwareQF(S.WRAccQF()))), "n", "p")


@register("ga_standard", sql_top(f"{sql_line(2)}, sc AS (SELECT *, p / CAST(n AS DOUBLE) AS share FROM cells, tot), ga AS (SELECT items, n, p, pow(n / CAST(bn AS DOUBLE), 0.5) * (share - coalesce({_UP.format('share')}, share)) AS gq FROM sc)", "gq", "ga"))
def ga_standard(spark, d):
    return ranked(S.DFS().execute(line_task(spark, d, S.GeneralizationAware_StandardQF(0.5))), "n", "p")


@register("ga_standard_max", SQL["ga_standard"])
def ga_standard_max(spark, d):
    return ranked(S.DFS().execute(line_task(spark, d, S.GeneralizationAware_StandardQF(0.5, "max"))), "n", "p")


@register("ga_numeric", sql_top(f"{sql_orders(2, 'count(*) AS n, avg(t) AS m')}, sc AS (SELECT * FROM cells, tot), ga AS (SELECT items, n, pow(n / CAST(bn AS DOUBLE), 0.5) * (m - coalesce({_UP.format('m')}, m)) AS gq FROM sc)", "gq", "ga", "n").replace("round(q, 9)", "round(q, 4)"))
def ga_numeric(spark, d):
    out = ranked(S.DFS().execute(order_task(spark, d, S.GeneralizationAware_StandardQFNumeric(0.5))), "n")
    return out.withColumn("quality", F.round("quality", 4))


@register("topk_disjunction", sql_top(f"""{sql_line(2)}, one AS (SELECT items[1] AS a, n, p FROM cells WHERE len(items) = 1), two AS (SELECT list_sort(items) AS s, n, p FROM cells WHERE len(items) = 2),
dis AS (SELECT [a] AS items, n, p FROM one UNION ALL SELECT list_sort([x.a, y.a]), x.n + y.n - coalesce(t.n, 0), x.p + y.p - coalesce(t.p, 0) FROM one x JOIN one y ON x.a < y.a LEFT JOIN two t ON t.s = list_sort([x.a, y.a]))""", std(1), "dis, tot").replace(" and ", " or "))
def topk_disjunction(spark, d):
    return ranked(S.Apriori(combination_name="Disjunction").execute(line_task(spark, d, S.WRAccQF())), "n", "p")


@register("topk_disjunction_bfs", SQL["topk_disjunction"])
def topk_disjunction_bfs(spark, d):
    return ranked(S.GeneralisingBFS().execute(line_task(spark, d, S.WRAccQF())), "n", "p")


# ---- model mining


def _emm_sql(compat: bool) -> str:
    pdf = "exp(-pow(y - a * x - b, 2) / 2) / sqrt(2 * pi())"
    q = "e / n" if compat else "i / n - (e - i) / nullif(bn - n, 0)"
    return f"""WITH base AS (SELECT 'l_returnflag==''' || l_returnflag || '''' AS i0, 'l_linestatus==''' || l_linestatus || '''' AS i1, l_quantity AS x, l_extendedprice / 10000.0 AS y FROM lineitem), tot AS (SELECT count(*) AS bn FROM base),
cells AS ({sql_cells(2, 2, 'count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b')}),
sc AS (SELECT c.items, c.n, sum({pdf}) AS e, sum(CASE WHEN list_has_all([i0, i1], c.items) THEN {pdf} ELSE 0 END) AS i FROM cells c, base GROUP BY c.items, c.n)
SELECT {KEY} AS subgroup, n, round({q}, 6) AS quality FROM sc, tot WHERE {q} IS NOT NULL"""


def _emm(spark, d, compat):
    df = table(spark, d, "lineitem").select(FLAG, "l_linestatus", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 10000.0).alias("y"))
    space = P.create_nominal_selectors(df)
    task = S.SubgroupDiscoveryTask(df, S.RegressionTarget("x", "y"), space, S.EMM_Likelihood(compat), K, 2)
    return ranked(S.GpGrowth().execute(task), "n").select("subgroup", "n", F.round("quality", 6).alias("quality"))


@register("emm_regression", _emm_sql(False))
def emm_regression(spark, d):
    return _emm(spark, d, False)


@register("emm_regression_compat", _emm_sql(True))
def emm_regression_compat(spark, d):
    return _emm(spark, d, True)


# ---- filters, exports, plots


def _stats(result) -> DataFrame:
    return result.to_dataframe(["size_sg", "positives_sg", "target_share_sg"]).select("rank", F.round("quality", 9).alias("quality"), "size_sg", "positives_sg", F.round("target_share_sg", 9).alias("target_share_sg"))


def _top(spark, d, **more):
    return S.BestFirstSearch().execute(line_task(spark, d, S.WRAccQF(), **more))


_TOP = sql_top(sql_line(2), std(1), where="len(items) > 0")
_STATS = f"SELECT rank, quality, n AS size_sg, p AS positives_sg, round(p / CAST(n AS DOUBLE), 9) AS target_share_sg FROM ({_TOP})"


@register("filter_quality", f"SELECT * FROM ({_STATS}) WHERE quality >= 0.0005")
def filter_quality(spark, d):
    return R.minimum_quality_filter(_stats(_top(spark, d)), 0.0005)


@register("filter_min_stat", f"SELECT * FROM ({_STATS}) WHERE size_sg >= 5000")
def filter_min_stat(spark, d):
    return R.minimum_statistic_filter(_stats(_top(spark, d)), "size_sg", 5000)


@register("filter_max_stat", f"SELECT * FROM ({_STATS}) WHERE size_sg <= 5000")
def filter_max_stat(spark, d):
    return R.maximum_statistic_filter(_stats(_top(spark, d)), "size_sg", 5000)


def _ranks(k: int) -> str:
    """CTEs: top (the k best descriptions), cov (which row each covers), sim (their overlaps)."""
    return f"""{sql_line(2).replace("WITH ", "WITH RECURSIVE ", 1)}, top AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY {std(1)} DESC, {KEY} DESC) AS rank, round({std(1)}, 9) AS quality, {KEY} AS subgroup, list_sort(items) AS items FROM cells, tot WHERE len(items) > 0) WHERE rank <= {k}),
lines AS (SELECT row_number() OVER () AS line, [i0, i1, i2, i3, i4] AS r FROM base), cov AS (SELECT line, rank FROM lines, top WHERE list_has_all(r, items)), sz AS (SELECT rank, count(*) AS n FROM cov GROUP BY rank),
dual AS (SELECT a.rank AS x, b.rank AS y, count(*) AS n FROM cov a JOIN cov b ON a.line = b.line GROUP BY 1, 2),
sim AS (SELECT a.rank AS x, b.rank AS y, coalesce(dual.n, 0) / CAST(a.n + b.n - coalesce(dual.n, 0) AS DOUBLE) AS j FROM sz a CROSS JOIN sz b LEFT JOIN dual ON dual.x = a.rank AND dual.y = b.rank)"""


@register("filter_unique_attrs", f"""{_ranks(K)}, a AS (SELECT *, list_sort(list_distinct(list_transform(items, lambda x: regexp_extract(x, '^[a-z_]+')))) AS attrs FROM top), k AS (SELECT *, row_number() OVER (PARTITION BY attrs ORDER BY rank) AS nth FROM a)
SELECT row_number() OVER (ORDER BY rank) AS rank, quality, subgroup FROM k WHERE nth = 1 OR attrs = ['l_linestatus']""")
def filter_unique_attrs(spark, d):
    kept = S.unique_attributes(_top(spark, d))
    return spark.createDataFrame([(i + 1, round(q, 9), x.key) for i, (q, x, _) in enumerate(kept)], "rank bigint, quality double, subgroup string")


@register("filter_overlap", f"""{_ranks(K)}, bad AS (SELECT x, list(y) AS ys FROM sim WHERE y < x AND j > 0.5 GROUP BY x), t AS (SELECT rank, coalesce(ys, []) AS ys FROM top LEFT JOIN bad ON x = rank),
kept AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS s UNION ALL SELECT t.rank, CASE WHEN list_has_any(kept.s, t.ys) THEN kept.s ELSE list_append(kept.s, t.rank) END FROM kept JOIN t ON t.rank = kept.k + 1)
SELECT row_number() OVER (ORDER BY rank) AS rank, quality, subgroup FROM top WHERE list_contains((SELECT s FROM kept ORDER BY k DESC LIMIT 1), rank)""")
def filter_overlap(spark, d):
    kept = S.overlap_filter(_top(spark, d), 0.5)
    return spark.createDataFrame([(i + 1, round(q, 9), x.key) for i, (q, x, _) in enumerate(kept)], "rank bigint, quality double, subgroup string")


@register("export_transactions", """WITH s AS (SELECT 'l_returnflag==''' || l_returnflag || '''' AS item, count(*) AS c FROM lineitem GROUP BY 1 UNION ALL SELECT 'l_linestatus==''' || l_linestatus || '''', count(*) FROM lineitem GROUP BY 1), r AS (SELECT item, row_number() OVER (ORDER BY c DESC, item) - 1 AS k FROM s)
SELECT least(a.k, b.k) || ' ' || greatest(a.k, b.k) || ' 1' AS value, count(*) AS "rows" FROM lineitem JOIN r a ON a.item = 'l_returnflag==''' || l_returnflag || '''' JOIN r b ON b.item = 'l_linestatus==''' || l_linestatus || '''' GROUP BY 1""")
def export_transactions(spark, d):
    df = table(spark, d, "lineitem").select(FLAG, "l_linestatus")
    task = S.SubgroupDiscoveryTask(df, S.FITarget(), P.create_nominal_selectors(df), S.CountQF(), K, 2)
    return A.transactions(task).groupBy("value").agg(F.count("*").alias("rows"))


@register("plot_bars", f"SELECT rank, round(p / CAST(n AS DOUBLE), 9) AS target_share_sg, round((bp - p) / CAST(bn - n AS DOUBLE), 9) AS target_share_complement, round(n / CAST(bn AS DOUBLE), 9) AS relative_size_sg, round((bn - n) / CAST(bn AS DOUBLE), 9) AS relative_size_complement FROM ({_TOP}), (SELECT count(*) AS bn, sum(CAST(l_returnflag = 'R' AS INT)) AS bp FROM lineitem)")
def plot_bars(spark, d):
    return rounded(R.bars(_top(spark, d)).drop("quality", "subgroup"))


@register("plot_roc", f"SELECT rank, round((n - p) / CAST(bn - bp AS DOUBLE), 9) AS fpr, round(p / CAST(bp AS DOUBLE), 9) AS tpr FROM ({_TOP}), (SELECT count(*) AS bn, sum(CAST(l_returnflag = 'R' AS INT)) AS bp FROM lineitem)")
def plot_roc(spark, d):
    return rounded(R.roc(_top(spark, d)).drop("subgroup"))


@register("plot_npspace", f"SELECT rank, n AS size_sg, round(p / CAST(n AS DOUBLE), 9) AS target_share_sg FROM ({_TOP})")
def plot_npspace(spark, d):
    return rounded(R.npspace(_top(spark, d)).drop("quality", "subgroup"))


@register("plot_hist", """WITH r AS (SELECT min(o_totalprice) AS a, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - a) / w), 9) AS INT) AS bin, o_orderstatus = 'F' AS sg, w FROM orders, r), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE sg) AS s FROM b)
SELECT bin, round(count(*) FILTER (WHERE sg) / (max(t.s) * max(w)), 12) AS density_sg, round(count(*) / (max(t.n) * max(w)), 12) AS density_dataset FROM b, t GROUP BY bin""")
def plot_hist(spark, d):
    out = R.distribution(table(spark, d, "orders"), S.NumericTarget("o_totalprice"), S.Conjunction(S.EqualitySelector("o_orderstatus", "F")))
    return rounded(out.drop("low"), 12)


@register("similarity_matrix", f"{_ranks(10)} SELECT array_to_string(a.items, ' AND ') AS \"left\", array_to_string(b.items, ' AND ') AS \"right\", round(j, 9) AS jaccard FROM sim JOIN top a ON a.rank = x JOIN top b ON b.rank = y")
def similarity_matrix(spark, d):
    return rounded(R.similarity(_top(spark, d, k=10)))


@register("similarity_dendrogram")
def similarity_dendrogram(spark, d):
    return spark.createDataFrame([(i, ", ".join(a), ", ".join(b), x) for i, (a, b, x) in enumerate(R.dendrogram(_top(spark, d, k=6)))], "step int, left string, right string, distance double")


@register("support_matrix", f"{_ranks(5)}, m AS (SELECT line, list(rank) AS r FROM cov GROUP BY line) SELECT CAST(len(r) AS INT) AS covered, " + ", ".join(f"list_contains(r, {i + 1}) AS s{i}" for i in range(5)) + " , count(*) AS \"rows\" FROM m GROUP BY ALL")
def support_matrix(spark, d):
    return R.support_matrix(_top(spark, d, k=5)).groupBy("covered", *(f"s{i}" for i in range(5))).agg(F.count("*").alias("rows"))


# ---- scalars


@register("scalar_helpers", "SELECT event_type, round(pow(sum(value), 2) / sum(value * value), 6) AS ess, CAST(sum(CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS signs, CAST(max(bit_count(user_id)) AS INT) AS bits FROM events GROUP BY event_type")
def scalar_helpers(spark, d):
    e = table(spark, d, "events")
    sign = scalars.conditional_invert(F.lit(1).cast("long"), F.col("user_id") % 2 == 0)
    return e.groupBy("event_type").agg(F.round(scalars.effective_sample_size(F.col("value")), 6).alias("ess"), F.sum(sign).alias("signs"), F.max(scalars.count_bits(F.col("user_id"))).alias("bits"))


# ---- selectors from text, custom selectors, base statistics

_TEXTS = {"l_linestatus=='F'": "l_linestatus = 'F'", "l_quantity: [10.0:20.0[": "l_quantity >= 10 AND l_quantity < 20", "l_discount>=0.08": "l_discount >= 0.08", "l_tax<0.03": "l_tax < 0.03", "l_linenumber==3": "l_linenumber = 3", "NOT l_tax<0.03": "NOT l_tax < 0.03", "l_tax.isnull()": "l_tax IS NULL"}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@register("parse_selectors", " UNION ALL ".join(f"SELECT {_text(k)} AS given, count(*) FILTER (WHERE {v}) AS size_sg FROM lineitem" for k, v in _TEXTS.items()))
def parse_selectors(spark, d):
    sizes = S.cover_sizes(lineitem(spark, d), [S.Conjunction(S.parse_selector(x)) for x in _TEXTS])
    names = spark.createDataFrame([(str(S.Conjunction(S.parse_selector(x))), x) for x in _TEXTS], "description string, given string")
    return sizes.join(F.broadcast(names), "description").select("given", "size_sg")


@register("parse_conjunction", "SELECT count(*) AS size_sg FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 10 AND l_discount >= 0.02 AND l_discount < 0.05")
def parse_conjunction(spark, d):
    c = S.Conjunction.from_str("l_linestatus=='F' AND l_quantity<10.0 AND l_discount: [0.02:0.05[")
    return c.covers(lineitem(spark, d)).agg(F.count("*").alias("size_sg"))


@register("parse_truth", "SELECT * FROM (VALUES ('true', TRUE), ('Yes', TRUE), ('no', FALSE), ('0', FALSE), ('1', TRUE)) AS v(given, truth)")
def parse_truth(spark, d):
    return spark.createDataFrame([(x, S.str_to_bool(x)) for x in ("true", "Yes", "no", "0", "1")], "given string, truth boolean")


@register("custom_selector", "SELECT 'bulk' AS description, count(*) FILTER (WHERE l_quantity * l_discount > 2) AS size_sg, count(*) AS size_dataset FROM lineitem")
def custom_selector(spark, d):
    bulk = S.CustomSelector("bulk", F.col("l_quantity") * F.col("l_discount") > 2, ("l_quantity", "l_discount"))
    return S.cover_sizes(lineitem(spark, d), [S.Conjunction(bulk)])


@register("base_statistics_binary", "SELECT count(*) AS dataset, count(*) FILTER (WHERE l_returnflag = 'R') AS positives, count(*) FILTER (WHERE l_linestatus = 'F') AS size, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS positives_sg FROM lineitem")
def base_statistics_binary(spark, d):
    found = S.BinaryTarget(FLAG, "R").get_base_statistics(lineitem(spark, d), S.Conjunction(S.EqualitySelector("l_linestatus", "F")))
    return spark.createDataFrame([found], "dataset bigint, positives bigint, size bigint, positives_sg bigint")


@register("base_statistics_numeric", "SELECT count(*) AS dataset, round(avg(o_totalprice), 4) AS mean, count(*) FILTER (WHERE o_orderstatus = 'F') AS size, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean_sg FROM orders")
def base_statistics_numeric(spark, d):
    found = S.NumericTarget("o_totalprice").get_base_statistics(table(spark, d, "orders"), S.Conjunction(S.EqualitySelector("o_orderstatus", "F")))
    return rounded(spark.createDataFrame([found], "dataset bigint, mean double, size bigint, mean_sg double"), 4)


@register("qf_combined", f"{sql_line(1, True)} SELECT {KEY} AS subgroup, n, p, round(2 * {std(1)} + 0.5 * {std(0.5)}, 9) AS quality FROM cells, tot")
def qf_combined(spark, d):
    qf = S.CombinedInterestingnessMeasure([S.WRAccQF(), S.StandardQF(0.5)], [2, 0.5])
    return cells(line_task(spark, d, qf)).select("subgroup", "n", "p", F.round("quality", 9).alias("quality"))


@register("overlaps_list", "WITH c AS (SELECT l_linestatus = 'F' AS a, l_tax < 0.05 AS b, l_linestatus = 'F' AND l_tax < 0.08 AS c FROM lineitem) SELECT (count(*) FILTER (WHERE a AND b)) / CAST(count(*) FILTER (WHERE a OR b) AS DOUBLE) > 0.5 AS low, greatest((count(*) FILTER (WHERE a AND b)) / CAST(count(*) FILTER (WHERE a OR b) AS DOUBLE), (count(*) FILTER (WHERE a AND c)) / CAST(count(*) FILTER (WHERE a OR c) AS DOUBLE)) > 0.5 AS high FROM c")
def overlaps_list(spark, d):
    df = lineitem(spark, d)
    a, b, c = (S.Conjunction.from_str(x) for x in ("l_linestatus=='F'", "l_tax<0.05", "l_linestatus=='F' AND l_tax<0.08"))
    return spark.createDataFrame([(S.overlaps_list(a, [b], df, 0.5), S.overlaps_list(a, [b, c], df, 0.5))], "low boolean, high boolean")


# ---- sources, sinks, formats


def _folder(spark) -> str:
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    shared = shared or "file://" + tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/catalog-{uuid.uuid4().hex[:12]}"


_NATION = "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation"


@register("source_tsv", _NATION.replace("DOUBLE", "INT"))
def source_tsv(spark, d):
    path = _folder(spark)
    table(spark, d, "nation").write.option("sep", "\t").option("header", True).csv(path)
    return S.read_tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("source_arff", _NATION)
def source_arff(spark, d):
    path = _folder(spark)
    head = spark.range(1).select(F.explode(F.array(*map(F.lit, ("@relation nation", "@attribute n_nationkey real", "@attribute n_name {names}", "@attribute n_regionkey numeric", "@data")))).alias("value"))
    rows = table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit("'"), "n_name", F.lit("'")), F.col("n_regionkey").cast("string")).alias("value"))
    head.unionByName(rows).write.text(path)
    return S.read_arff(spark, path)


@register("sink_transactions", SQL["export_transactions"])
def sink_transactions(spark, d):
    df, path = table(spark, d, "lineitem").select(FLAG, "l_linestatus"), _folder(spark)
    task = S.SubgroupDiscoveryTask(df, S.FITarget(), P.create_nominal_selectors(df), S.CountQF(), K, 2)
    S.GpGrowth().to_file(task, path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("rows"))


_SHOWN = f"SELECT rank, quality, array_to_string(list_sort(items), ' AND ') AS subgroup, n AS size_sg, round(p / CAST(n AS DOUBLE), 9) AS target_share_sg FROM (SELECT row_number() OVER (ORDER BY {std(1)} DESC, {KEY} DESC) AS rank, round({std(1)}, 9) AS quality, * FROM cells, tot WHERE len(items) > 0) WHERE rank <= {K}"


@register("sink_table", f"{sql_line(2)} SELECT quality, subgroup, size_sg, target_share_sg FROM ({_SHOWN})")
def sink_table(spark, d):
    head, *rows = _top(spark, d).to_table(["size_sg", "target_share_sg"])
    return rounded(spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} {k}" for c, k in zip(head, ("double", "string", "bigint", "double")))))


@register("sink_descriptions", f"{sql_line(2)} SELECT rank, quality, subgroup FROM ({_SHOWN})")
def sink_descriptions(spark, d):
    return spark.createDataFrame([(i + 1, round(q, 9), str(x)) for i, (q, x) in enumerate(_top(spark, d).to_descriptions())], "rank bigint, quality double, subgroup string")


@register("autoround", f"{sql_line(2)} SELECT rank, round(quality, 3) AS quality, size_sg, round(target_share_sg, 3) AS target_share_sg FROM ({_SHOWN})")
def autoround(spark, d):
    return _top(spark, d).to_dataframe(["size_sg", "target_share_sg"], autoround=True).drop("subgroup")


@register("formatters", "SELECT l_returnflag, format('{:.1f}%', 100 * avg(CAST(l_linestatus = 'F' AS INT))) AS share, format('{:.2f}', avg(l_quantity)) AS quantity FROM lineitem GROUP BY 1")
def formatters(spark, d):
    g = table(spark, d, "lineitem").groupBy(FLAG).agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("s"), F.avg("l_quantity").alias("q"))
    return g.select(FLAG, R.perc_formatter("s").alias("share"), R.float_formatter("q").alias("quantity"))


@register("bit_helpers", "SELECT c_custkey, CAST((1 << (c_custkey % 7)) | (1 << (c_custkey % 11)) AS BIGINT) AS word, array_to_string(list_sort(list_distinct([c_custkey % 7, c_custkey % 11])), ' ') AS bits, array_to_string(list_sort(list_distinct(list_filter([c_custkey % 7, c_custkey % 11], lambda x: x IN (1, 3, 5)))), ' ') AS odd FROM customer")
def bit_helpers(spark, d):
    places = F.array(F.col("c_custkey") % 7, F.col("c_custkey") % 11)
    word = scalars.to_bits(places)
    found, odd = scalars.find_set_bits(word), scalars.intersect_of_ordered_list(F.array_sort(places), F.array(*(F.lit(k).cast("long") for k in (1, 3, 5))))
    return table(spark, d, "customer").select("c_custkey", word.alias("word"), F.array_join(found.cast("array<string>"), " ").alias("bits"), F.array_join(odd.cast("array<string>"), " ").alias("odd"))


@register("powerset", "SELECT unnest(['', 'a', 'b', 'c', 'ab', 'ac', 'bc']) AS subset")
def powerset(spark, d):
    return spark.createDataFrame([("".join(x),) for x in scalars.powerset("abc", 2)], "subset string")


@register("plot_roc_grid", "WITH g AS (SELECT (i % 11) / 10.0 AS fpr, (i // 11) / 10.0 AS tpr FROM range(121) r(i)), t AS (SELECT count(*) AS bn, sum(CAST(l_returnflag = 'R' AS BIGINT)) AS bp FROM lineitem), c AS (SELECT fpr, tpr, tpr * bp AS p, tpr * bp + fpr * (bn - bp) AS n, bn, bp FROM g, t) SELECT CAST(fpr AS DOUBLE) AS fpr, CAST(tpr AS DOUBLE) AS tpr, CASE WHEN n > 0 THEN round(n / CAST(bn AS DOUBLE) * (p / CAST(n AS DOUBLE) - bp / CAST(bn AS DOUBLE)), 9) + 0.0 END AS quality FROM c")
def plot_roc_grid(spark, d):
    r = table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col(FLAG) == "R").alias("p")).first()
    return rounded(R.roc_grid(spark, S.WRAccQF(), r["n"], r["p"], 10)).withColumn("quality", F.col("quality") + 0.0)
