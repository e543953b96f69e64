"""Known results on two small public tables."""

import math

import pytest

import sublode as S

A1 = [
    (0.0553, "checking_status=='<0' AND foreign_worker=='yes'"), (0.0528, "checking_status=='<0'"), (0.0523, "checking_status=='<0' AND foreign_worker=='yes' AND other_parties=='none'"),
    (0.0506, "checking_status=='<0' AND other_parties=='none'"), (0.0496, "checking_status=='<0' AND foreign_worker=='yes' AND savings_status=='<100'"),
    (0.0483, "checking_status=='<0' AND savings_status=='<100'"), (0.0466, "checking_status=='<0' AND foreign_worker=='yes' AND other_parties=='none' AND savings_status=='<100'"),
    (0.0455, "checking_status=='<0' AND foreign_worker=='yes' AND job=='skilled'"), (0.0452, "checking_status=='<0' AND other_parties=='none' AND savings_status=='<100'"),
    (0.0444, "checking_status=='<0' AND job=='skilled'"),
]


def check(result, golden):
    got = result.to_descriptions()
    assert [str(d) for _, d in got] == [t for _, t in golden]
    assert [q for q, _ in got] == pytest.approx([q for q, _ in golden], abs=1e-9)


@pytest.fixture(scope="module")
def nominal(credit):
    return S.create_nominal_selectors(credit, ignore=["class"])


@pytest.mark.parametrize("algorithm", [S.DFS(), S.SimpleDFS(), S.Apriori(), S.BestFirstSearch(), S.GpGrowth(), S.BeamSearch()], ids=lambda a: type(a).__name__)
def test_standard(credit, nominal, algorithm):
    depth = 5 if type(algorithm) is S.DFS else 4
    task = S.SubgroupDiscoveryTask(credit, S.BinaryTarget("class", "bad"), nominal, S.StandardQF(1.0), 10, depth)
    check(algorithm.execute(task), A1)


def test_support(credit, nominal):
    task = S.SubgroupDiscoveryTask(credit, S.BinaryTarget("class", "bad"), nominal, S.StandardQF(1.0), 10, 3, constraints=[S.MinSupportConstraint(200)])
    got = S.DFS().execute(task)
    assert [q for q, _ in got.to_descriptions()] == pytest.approx([0.0553, 0.0528, 0.0523, 0.0506, 0.0496, 0.0483, 0.0426, 0.04, 0.0387, 0.0375])
    frame = got.to_dataframe().orderBy("rank")
    assert frame.first()["positives_sg"] == got.task.data.filter("checking_status = '<0' AND foreign_worker = 'yes' AND class = 'bad'").count()


def test_numeric_cuts(credit):
    assert S.equal_frequency_discretization(credit, "age", 5) == [26, 30, 36, 45]
    assert S.equal_frequency_discretization(credit, "duration", 5) == [12, 15, 24, 30]


def test_mean(credit):
    space = S.create_nominal_selectors(credit)
    for algorithm in (S.DFS(), S.DFSNumeric()):
        task = S.SubgroupDiscoveryTask(credit, S.NumericTarget("credit_amount"), space, S.StandardQFNumeric(1.0), 10, 3)
        got = [q for q, _ in algorithm.execute(task).to_descriptions()]
        assert got[:7] == pytest.approx([383476.768, 361710.058, 345352.992, 338205.08, 336857.822, 323586.282, 320306.816])


def test_median(credit):
    space = S.create_nominal_selectors(credit)
    task = S.SubgroupDiscoveryTask(credit, S.NumericTarget("credit_amount"), space, S.StandardQFNumeric(1.0, centroid="median"), 10, 3)
    golden = [
        (316646.0, "job=='high qualif/self emp/mgmt'"), (310615.0, "foreign_worker=='yes' AND job=='high qualif/self emp/mgmt'"),
        (297844.5, "own_telephone=='yes' AND property_magnitude=='no known property'"), (297844.5, "foreign_worker=='yes' AND own_telephone=='yes' AND property_magnitude=='no known property'"),
        (288480.5, "job=='high qualif/self emp/mgmt' AND own_telephone=='yes'"), (283002.0, "own_telephone=='yes'"), (282217.5, "class=='bad' AND own_telephone=='yes'"),
        (282000.0, "other_parties=='none' AND own_telephone=='yes'"), (276312.5, "foreign_worker=='yes' AND job=='high qualif/self emp/mgmt' AND own_telephone=='yes'"),
        (275467.5, "foreign_worker=='yes' AND other_parties=='none' AND own_telephone=='yes'"),
    ]
    check(S.DFS().execute(task), golden)


def test_itemsets(titanic):
    space = S.create_nominal_selectors(titanic, ignore=["Name", "Ticket"])
    task = S.SubgroupDiscoveryTask(titanic, S.FITarget(), space, S.CountQF(), 11, 5)
    for mode in ("b_u", "t_d"):
        task.constraints = [S.MinSupportConstraint(20)]
        got = S.GpGrowth(mode).execute(task)
        assert [q for q, _ in got.to_descriptions()] == [156, 125, 110, 100, 89, 82, 73, 60, 56, 43, 37]
    area = S.SubgroupDiscoveryTask(titanic, S.FITarget(), space, S.AreaQF(), 10, 2)
    assert [q for q, _ in S.SimpleSearch().execute(area).to_descriptions()] == [178, 164, 146, 125, 110, 100, 86, 74, 56, 46]


@pytest.mark.parametrize(
    ("a", "depth", "golden"),
    [
        (0.5, 3, [0.10086921502691486, 0.065, 0.0600832755431992, 0.05300330790951305, 0.046852215652241715, 0.046488822458723086, 0.04436633963967792, 0.043698221718866, 0.04183300132670378, 0.04103779623011525]),
        (1, 3, [0.0528, 0.0361, 0.0243, 0.0208, 0.0188, 0.0184, 0.0163, 0.016, 0.0153, 0.0133]),
        (0, 2, [0.6795580110497237, 0.6666666666666667, 0.6666666666666667, 0.6666666666666667, 0.6554054054054055, 0.6363636363636364, 0.6290322580645161, 0.6089385474860336, 0.6, 0.5957446808510638]),
    ],
)
def test_generalisation_aware(credit, nominal, a, depth, golden):
    task = S.SubgroupDiscoveryTask(credit, S.BinaryTarget("class", "bad"), nominal, S.GeneralizationAware_StandardQF(a), 10, depth)
    assert [q for q, _ in S.DFS().execute(task).to_descriptions()] == pytest.approx(golden)


def test_generalisation_aware_numeric(credit):
    space = S.create_nominal_selectors(credit)
    task = S.SubgroupDiscoveryTask(credit, S.NumericTarget("credit_amount"), space, S.GeneralizationAware_StandardQFNumeric(0.5), 10, 3)
    got = S.DFS().execute(task).to_descriptions()
    assert [q for q, _ in got] == pytest.approx([832.5979220717699, 673.6338022041458, 645.953015714855, 603.3209078187183, 576.235405327832, 540.9390501453018, 537.3010282319029, 440.3787869550485, 407.6428886169854, 406.8834])


def test_generalisation_aware_over_standard(credit, nominal):
    task = S.SubgroupDiscoveryTask(credit, S.BinaryTarget("class", "bad"), nominal, S.GeneralizationAwareQF(S.StandardQF(1.0)), 10, 2)
    got = S.DFS().execute(task).to_descriptions()
    assert got[0][0] == pytest.approx(0.0528) and str(got[0][1]) == "checking_status=='<0'"


def test_disjunctions(credit, nominal):
    task = S.SubgroupDiscoveryTask(credit, S.BinaryTarget("class", "bad"), nominal, S.StandardQF(1.0), 10, 3)
    golden = [0.0779, 0.0774, 0.0771, 0.0768, 0.0767, 0.0767, 0.0766, 0.0765, 0.0765, 0.0760]
    for algorithm in (S.Apriori(combination_name="Disjunction"), S.GeneralisingBFS()):
        got = algorithm.execute(task).to_descriptions()
        assert [q for q, _ in got] == pytest.approx(golden)
        assert str(got[0][1]) == "checking_status=='0<=X<200' OR checking_status=='<0' OR other_payment_plans=='bank'"


def test_model(credit):
    space = S.create_nominal_selectors(credit, ignore=["class"])
    target = S.RegressionTarget("duration", "credit_amount")
    for compat in (True, False):
        task = S.SubgroupDiscoveryTask(credit, target, space, S.EMM_Likelihood(compat), 5, 1, constraints=[S.MinSupportConstraint(100)])
        got = S.GpGrowth().execute(task)
        assert len(got) == 5 and all(not math.isnan(q) for q, _ in got.to_descriptions())


def test_readme_row(titanic):
    task = S.SubgroupDiscoveryTask(titanic, S.BinaryTarget("Survived", True), S.create_selectors(titanic, ignore=["Survived"]), S.WRAccQF(), 5, 2)
    rows = S.BestFirstSearch().execute(task).to_dataframe().orderBy("rank").collect()
    assert rows[0]["quality"] == pytest.approx(0.132150, abs=1e-6)
