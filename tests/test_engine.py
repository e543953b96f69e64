"""Units: selectors, descriptions, search spaces, targets, qualities, results, and the equality of plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

import sublode as S
from sublode.functions import scalars
from sublode.operators import results as R
from sublode.plans import searchspace as P
from sublode.sources.datasets import arff_schema
from sublode.streaming.statistics import windowed_statistics

NAN = float("nan")


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([(True, "x", 1.0), (None, "y", NAN), (False, None, None), (True, "x", math.inf)], "a boolean, b string, c double")


def test_selectors_are_two_valued(mixed):
    count = lambda s: s.covers(mixed).count()
    assert count(S.EqualitySelector("a", True)) == 2
    assert count(S.NegatedSelector(S.EqualitySelector("a", True))) == 2
    assert count(S.EqualitySelector("b", NAN)) == 1 and count(S.EqualitySelector("c", NAN)) == 2
    assert count(S.IntervalSelector("c", 0.0, math.inf)) == 1  # neither NaN nor infinity
    assert count(S.NegatedSelector(S.IntervalSelector("c", 0.0, math.inf))) == 3
    assert count(S.CustomSelector("has x", F.col("b").contains("x"))) == 2


def test_keys_and_parsing():
    assert S.IntervalSelector("a", 1.234, 5).label == "a: [1.23:5[" and S.IntervalSelector("a", 1.234, 5).key == "a: [1.234:5["
    for text in ("a==1", "a=='x'", "a.isnull()", "a<3.5", "a>=2.0", "a: [1.0:2.5[", "(not a=='x')", "a = anything"):
        assert repr(S.parse_selector(text)) == text
    assert S.EqualitySelector.from_str("a=='1'").value == "1" and S.EqualitySelector.from_str("a==True").value is True
    with pytest.raises(TypeError):
        S.EqualitySelector("a", None)
    with pytest.raises(AssertionError):
        S.IntervalSelector("a", 2, 1)
    assert S.str_to_bool("Yes") and not S.str_to_bool("off")
    with pytest.raises(ValueError):
        S.str_to_bool("perhaps")
    assert S.EqualitySelector("a", 1) != S.EqualitySelector("a", 1.0)


def test_descriptions(mixed):
    a, b = S.EqualitySelector("a", True), S.EqualitySelector("b", "y")
    assert S.Conjunction([a, b]) == S.Conjunction([b, a]) and hash(S.Conjunction([a, b])) == hash(S.Conjunction([b, a]))
    assert repr(S.Conjunction()) == "True" and str(S.Conjunction()) == "Dataset" and str(S.Disjunction()) == "Empty"
    assert [r["size_sg"] for r in S.cover_sizes(mixed, [S.Conjunction(), S.Disjunction(), S.Disjunction([a, b]), S.DNF([a]) & b]).collect()] == [4, 0, 3, 0]
    with pytest.raises(RuntimeError):
        S.Conjunction(a) | b
    with pytest.raises(RuntimeError):
        S.Disjunction(a) & b
    with pytest.raises(NotImplementedError):
        S.DNF([a]) & S.Disjunction(b)
    assert len(S.DNF([S.Conjunction([a, b])]) | S.DNF([b])) == 2
    assert (S.DNF([a, b]) & a).without_last() == S.DNF([a, b])
    assert S.Conjunction.from_str("a==True AND b=='y'") == S.Conjunction([a, b])


def test_spaces(spark, mixed):
    keys = [s.key for s in S.create_selectors(mixed)]
    assert keys == ["a.isnull()", "a==False", "a==True", "b.isnull()", "b=='x'", "b=='y'", "c.isnull()", "c==1.0", "c==inf"]
    assert P.create_nominal_selectors(mixed, ignore="a")[0].attribute == "b"
    df = spark.createDataFrame([(x,) for x in [1, 1, 0, 3, 3, 4, 5]], "v int")
    assert S.equal_frequency_discretization(df, "v", 4) == [1, 3, 4]
    overlapping = P.create_numeric_selectors(df, 4, intervals_only=False)
    assert [s.key for s in overlapping] == ["v>=1", "v<1", "v>=3", "v<3", "v>=4", "v<4"]
    assert S.create_selectors(spark.createDataFrame([], "v double, s string")) == []
    with pytest.raises(TypeError):
        P.create_nominal_selectors(spark.sql("SELECT array(1) AS x"))


def test_cuts_distributed_equals_driver(spark):
    rnd = random.Random(2)
    for top in (4, 60):
        values = [(rnd.randint(0, top),) for _ in range(300)]
        h = P.value_histogram(spark.createDataFrame(values, "v int"), "v")
        for bins in (3, 7):
            assert P.distributed_cuts(h, bins) == P._cut(P._few(h), bins)


def test_binary_target(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 1, 0), (1, 0, 1)], "A int, B int, C int")
    t = S.BinaryTarget("A", True)
    assert t.get_base_statistics(df, S.Conjunction(S.EqualitySelector("C", 1))) == (4, 4, 2, 2)
    row = t.calculate_statistics(df, S.Conjunction()).first()
    assert row["target_share_complement"] is None and row["lift"] == 1.0
    empty = t.calculate_statistics(df, S.Conjunction(S.EqualitySelector("C", 9))).first()
    assert empty["size_sg"] == 0 and empty["target_share_sg"] is None
    with pytest.raises(ValueError):
        S.BinaryTarget("A")
    with pytest.raises(ValueError):
        S.BinaryTarget("A", 1, selector=S.EqualitySelector("A", 1))


def test_numeric_target(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 0), (1, 10), (0, -10), (0, -10), (0, -20)], "A int, t int")
    assert S.NumericTarget("t").get_base_statistics(df, S.Conjunction(S.EqualitySelector("A", 1))) == (7, 0.0, 4, 10.0)


def test_estimates(spark):
    df = spark.createDataFrame([(1, 100), (1, 75), (1, 53), (1, 12), (0, 11), (0, 49)], "A int, T int")
    from sublode import catalog

    for estimator, want in (("sum", 78.0), ("max", 3 * 50.0), ("order", 78.0)):
        task = S.SubgroupDiscoveryTask(df, S.NumericTarget("T"), [S.EqualitySelector("A", 1)], S.StandardQFNumeric(1.0, estimator), 5, 1)
        assert catalog.cells(task).first()["estimate"] == pytest.approx(want)


def test_arguments():
    for bad in (lambda: S.StandardQF("x"), lambda: S.StandardQFNumeric("x"), lambda: S.StandardQFNumeric(1, centroid="mode"), lambda: S.ChiSquaredQF("up"), lambda: S.GeneralizationAware_StandardQF(1, "sum")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        S.ChiSquaredQF(stat="z")
    with pytest.raises(AssertionError):
        S.StandardQFNumeric(1, "sum", "median")
    for bad in (lambda: S.StandardQFNumeric(1, "order", "median"), S.StandardQFNumericMedian, S.CombinedInterestingnessMeasure):
        with pytest.raises(NotImplementedError):
            bad()


def test_beam(spark):
    rows = [(a, b, c, d, int(c and d)) for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, target int")
    space = [S.EqualitySelector(x, 1) for x in "abcd"]
    task = S.SubgroupDiscoveryTask(df, S.BinaryTarget("target", 1), space, S.WRAccQF(), 2, 2)
    assert str(S.BeamSearch(3).execute(task).to_descriptions()[0][1]) == "c==1 AND d==1"
    with pytest.raises(RuntimeError):
        S.BeamSearch(1).execute(task)
    assert len(S.BeamSearch(beam_width_adaptive=True).execute(task)) == 2
    with pytest.raises(RuntimeError):
        S.DFSNumeric().execute(task)


def test_brute_force(spark):
    """Every algorithm finds what scoring all conjunctions by conditional aggregates finds."""
    rnd = random.Random(1)
    rows = [(rnd.choice("xyz"), rnd.choice("pq"), rnd.randint(0, 2), int(rnd.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c int, t int").cache()
    space = S.create_selectors(df, ignore=["t"])
    from itertools import combinations

    every = {}
    for n in (1, 2, 3):
        for c in combinations(space, n):
            hold = [r for r in rows if all({"a": r[0], "b": r[1], "c": r[2]}[s.attribute] == s.value for s in c)]
            if hold:
                every[S.Conjunction(c).key] = len(hold) / 200 * (sum(r[3] for r in hold) / len(hold) - sum(r[3] for r in rows) / 200)
    want = sorted(((q, k) for k, q in every.items()), reverse=True)[:8]
    for algorithm in (S.SimpleSearch(), S.Apriori(), S.BestFirstSearch()):
        task = S.SubgroupDiscoveryTask(df, S.BinaryTarget("t", 1), space, S.WRAccQF(), 8, 3)
        got = algorithm.execute(task).to_descriptions()
        assert [q for q, _ in got] == pytest.approx([q for q, _ in want])
    counted = S.CountCallsInterestingMeasure(S.WRAccQF())
    S.SimpleSearch().execute(S.SubgroupDiscoveryTask(df, S.BinaryTarget("t", 1), space, counted, 8, 3))
    assert counted.calls == len(every)


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, 1), ("u", 2, 1), ("v", 1, 0), ("v", 2, 0), ("v", 2, 1)], "k_k string, n int, t int")
    task = S.SubgroupDiscoveryTask(df, S.BinaryTarget("t", 1), S.create_selectors(df, ignore=["t"]), S.WRAccQF(), 4, 2)
    r = S.SimpleSearch().execute(task)
    frame = r.to_dataframe(include_target=True, autoround=True)
    assert len(frame.columns) == 3 + 13 + 1 and frame.count() == len(r) == 4
    assert r.to_table()[0][0] == "quality" and r"k\_k" in r.to_latex() and len(r.to_descriptions(True)[0]) == 3
    assert len(S.overlap_filter(r, 0.1)) <= 4 and len(S.unique_attributes(r)) <= 4
    assert len(R.dendrogram(r)) == 3 and R.support_matrix(r).count() >= 1 and R.roc_grid(spark, S.WRAccQF(), 5, 3, 4).count() == 25
    S.GpGrowth().to_file(task, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5
    empty = S.SimpleSearch().execute(S.SubgroupDiscoveryTask(df, task.target, task.search_space, S.WRAccQF(), 4, 2, min_quality=9.0))
    assert len(empty) == 0 and empty.to_dataframe().count() == 0


def test_helpers(spark):
    df = spark.createDataFrame([([0, 3, 5],)], "p array<int>")
    w = scalars.to_bits(F.col("p"))
    r = df.select(w.alias("w"), scalars.count_bits(w).alias("c"), scalars.find_set_bits(w).alias("b")).first()
    assert (r["w"], r["c"], r["b"]) == (41, 3, [0, 3, 5])
    assert list(scalars.powerset([1, 2, 3], 2)) == [(), (1,), (2,), (3,), (1, 2), (1, 3), (2, 3)]
    assert arff_schema(["@RELATION x", "@attribute 'a b' REAL", "@attribute c {x,y}", "@data", "@attribute z real"]) == [("a b", "double"), ("c", "string")]


def test_windows(spark):
    df = spark.sql("SELECT timestamp'2020-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 AS k FROM range(10)")
    out = windowed_statistics(df, "ts", "5 minutes", S.BinaryTarget("k", 1), [S.Conjunction()]).orderBy("window").collect()
    assert [(r["rows"], r["p_0"]) for r in out] == [(5, 2), (5, 3)]


def test_entry(spark, tables):
    import __spark_entry__ as e

    found = e.queries()
    assert set(e.oracle_sql()) <= set(found)
    for name in ("topk_dfs", "qf_chi2_p", "export_transactions"):
        assert found[name](spark, tables).count() > 0


def test_entry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0
