"""Searches against plain enumeration in pandas, on a generated table of applicants."""

import math
import random
from itertools import combinations

import pandas as pd
import pytest

import sublode as S

NOMINAL = ["status", "purpose", "housing", "job", "phone"]


def applicants(n=500):
    rnd, rows = random.Random(17), []
    for _ in range(n):
        status, purpose = rnd.choice(["none", "low", "high", None]), rnd.choice(["car", "tv", "study", "other"])
        housing, job, phone = rnd.choice(["own", "rent", "free"]), rnd.choices(["skilled", "unskilled", "manager"], [6, 3, 1])[0], rnd.choice(["yes", "no"])
        bad = rnd.random() < 0.2 + 0.25 * (status == "none") + 0.2 * (purpose == "study" and housing == "rent")
        amount = round(rnd.lognormvariate(7, 0.8) * (1.8 if job == "manager" else 1) * (1.3 if phone == "yes" else 1), 2)
        rows.append((status, purpose, housing, job, phone, amount if rnd.random() < 0.97 else None, "bad" if bad else "good"))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = applicants()
    frame = pd.DataFrame(rows, columns=[*NOMINAL, "amount", "class"])
    return spark.createDataFrame(rows, "status string, purpose string, housing string, job string, phone string, amount double, class string").repartition(3).cache(), frame


@pytest.fixture(scope="module")
def space(data):
    return S.create_nominal_selectors(data[0], ignore=["class"])


def key(attribute, value):
    return f"{attribute}.isnull()" if value is None else f"{attribute}=='{value}'"


def items(frame):
    out = {}
    for a in NOMINAL:
        col = frame[a]
        for v in {None if x is None or x != x else x for x in col}:
            out[key(a, v)] = (a, col.isna() if v is None else col == v)
    return out


def cells(frame, depth, join="and"):
    """Every combination of items of different attributes with its cover."""
    found = items(frame)
    for size in range(depth + 1):
        for names in combinations(sorted(found), size):
            if join == "and" and len({found[x][0] for x in names}) < size:
                continue
            cover = pd.Series(join == "and" or not names, index=frame.index)
            for x in names:
                cover = cover & found[x][1] if join == "and" else cover | found[x][1]
            yield names, cover


def best(scored, k):
    return sorted((round(q, 9) for q in scored if q is not None and not math.isnan(q)), reverse=True)[:k]


def got(result):
    return [round(q, 9) for q, _ in result.to_descriptions()]


@pytest.mark.parametrize("a", [1.0, 0.5, 0.0])
@pytest.mark.parametrize("algorithm", [S.DFS(), S.SimpleDFS(), S.Apriori(), S.BestFirstSearch(), S.GpGrowth(), S.GpGrowth("t_d")], ids=["dfs", "simple", "apriori", "best", "up", "down"])
def test_shares(data, space, algorithm, a):
    df, frame = data
    pos, least = frame["class"] == "bad", 20
    want = best(((c.mean() ** a) * (pos[c].mean() - pos.mean()) for _, c in cells(frame, 3) if c.sum() >= least), 12)
    task = S.SubgroupDiscoveryTask(df, S.BinaryTarget("class", "bad"), space, S.StandardQF(a), 12, 3, constraints=[S.MinSupportConstraint(least)])
    assert got(algorithm.execute(task)) == pytest.approx([q for q in want if q > task.min_quality], abs=1e-8)


@pytest.mark.parametrize("centroid", ["mean", "median"])
def test_numbers(data, space, centroid):
    df, frame = data
    v, use = frame["amount"], frame["amount"].notna()
    centre = getattr(v, centroid)()
    want = best((c.sum() * (getattr(v[c & use], centroid)() - centre) for _, c in cells(frame, 2) if (c & use).any()), 10)
    for algorithm in (S.DFS(), S.DFSNumeric(), S.SimpleDFS()):
        task = S.SubgroupDiscoveryTask(df, S.NumericTarget("amount"), space, S.StandardQFNumeric(1.0, False, "default", centroid), 10, 2)
        assert got(algorithm.execute(task)) == pytest.approx(want, rel=1e-9)


def test_itemsets(data, space):
    df, frame = data
    want = best((float(c.sum()) for _, c in cells(frame, 3)), 15)
    task = S.SubgroupDiscoveryTask(df, S.FITarget(), space, S.CountQF(), 15, 3)
    assert got(S.GpGrowth().execute(task)) == want
    assert got(S.Apriori().execute(task)) == best((float(c.sum()) for n, c in cells(frame, 3) if n), 15)  # without the dataset itself


def test_generalisation_aware(data, space):
    df, frame = data
    pos = frame["class"] == "bad"
    share = {n: pos[c].mean() for n, c in cells(frame, 2) if c.any()}
    size = {n: c.mean() for n, c in cells(frame, 2)}
    want = best((size[n] ** 0.5 * (s - max(share[m] for m in share if set(m) < set(n))) for n, s in share.items() if n), 8)
    task = S.SubgroupDiscoveryTask(df, S.BinaryTarget("class", "bad"), space, S.GeneralizationAware_StandardQF(0.5), 8, 2)
    assert got(S.DFS().execute(task)) == pytest.approx([q for q in want if q > 0], abs=1e-8)


def test_disjunctions(data, space):
    df, frame = data
    pos = frame["class"] == "bad"
    want = best((c.mean() * (pos[c].mean() - pos.mean()) for n, c in cells(frame, 2, "or") if n), 8)
    task = S.SubgroupDiscoveryTask(df, S.BinaryTarget("class", "bad"), space, S.WRAccQF(), 8, 2)
    for algorithm in (S.Apriori(combination_name="Disjunction"), S.GeneralisingBFS()):
        assert got(algorithm.execute(task)) == pytest.approx(want, abs=1e-8)


def test_combined_and_overlaps(data, space):
    df, frame = data
    pos = frame["class"] == "bad"
    lift = lambda c, a: c.mean() ** a * (pos[c].mean() - pos.mean())
    want = best((2 * lift(c, 1) + 3 * lift(c, 0.5) for _, c in cells(frame, 2) if c.any()), 6)
    task = S.SubgroupDiscoveryTask(df, S.BinaryTarget("class", "bad"), space, S.CombinedInterestingnessMeasure([S.WRAccQF(), S.StandardQF(0.5)], [2, 3]), 6, 2)
    assert got(S.DFS().execute(task)) == pytest.approx(want, abs=1e-8)
    one, two = S.Conjunction.from_str("housing=='own'"), S.Conjunction.from_str("housing=='own' AND phone=='yes'")
    a, b = frame["housing"] == "own", (frame["housing"] == "own") & (frame["phone"] == "yes")
    level = (a & b).sum() / (a | b).sum()
    assert S.overlaps_list(one, [two], df, level - 0.01) and not S.overlaps_list(one, [two], df, level + 0.01) and not S.overlaps_list(one, [], df)
    for bad in ([[], None], [[S.WRAccQF()], [1, 2]], [[S.StandardQFNumeric(1)], None]):
        with pytest.raises(ValueError):
            S.CombinedInterestingnessMeasure(*bad)
