"""Subgroup discovery on Spark: descriptions of rows whose target behaves unusually, found by declarative plans."""

from .functions.expressions import DNF, Conjunction, Disjunction, cover_sizes, overlap
from .functions.quality import (
    AreaQF, ChiSquaredQF, CombinedInterestingnessMeasure, CountCallsInterestingMeasure, CountQF, EMM_Likelihood, GeneralizationAware_StandardQF,
    GeneralizationAware_StandardQFNumeric, GeneralizationAwareQF, LiftQF, MinSupportConstraint, SimpleBinomialQF, SimplePositivesQF, StandardQF,
    StandardQFNumeric, StandardQFNumericMedian, StandardQFNumericTscore, WRAccQF,
)
from .functions.selectors import CustomSelector, EqualitySelector, IntervalSelector, NegatedSelector, parse_selector, remove_target_attributes, str_to_bool
from .functions.targets import BinaryTarget, FITarget, NumericTarget, RegressionTarget
from .operators.results import SubgroupDiscoveryResult, overlap_filter, overlaps_list, unique_attributes
from .operators.search import DFS, Apriori, BeamSearch, BestFirstSearch, DFSNumeric, GeneralisingBFS, GpGrowth, SimpleDFS, SimpleSearch, SubgroupDiscoveryTask
from .plans.searchspace import create_nominal_selectors, create_numeric_selectors, create_selectors, equal_frequency_discretization
from .sources.datasets import read_any, read_arff, read_tsv
