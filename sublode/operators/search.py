"""Search algorithms: the k best descriptions of a task, by level-wise plans over the lattice."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions.expressions import Disjunction
from ..functions.selectors import Selector
from ..plans import lattice as L
from .results import SubgroupDiscoveryResult


@dataclass
class SubgroupDiscoveryTask:
    """What to look for: the data, the target, the search space, the quality and the limits."""

    data: DataFrame
    target: object
    search_space: list[Selector]
    qf: Q.Quality
    result_set_size: int = 10
    depth: int = 3
    min_quality: float = -math.inf
    constraints: list = field(default_factory=list)

    def __post_init__(self):
        if hasattr(self.target, "bind"):
            self.target = self.target.bind(self.data)

    @property
    def monotone(self) -> list:
        return [c for c in self.constraints if c.is_monotone]


def _all(conditions) -> object:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


class _Run:
    """State of one search: constants, signatures, and the best rows so far."""

    def __init__(self, task: SubgroupDiscoveryTask):
        self.task, self.items = task, L.Items(task.search_space)
        self.const = task.qf.constants(task.data, task.target)
        self.sig = L.signatures(task.data, self.items, task.qf, task.target, self.const).persist()
        self.best: list[dict] = []

    def offer(self, scored: DataFrame, key=None) -> None:
        """Take the best of a level: quality first, then the larger key."""
        task = self.task
        ok = F.col("quality").isNotNull() & (F.col("quality") >= task.min_quality) & _all(task.constraints)
        named = scored.filter(ok).withColumn("key", self.items.key_of(F.col("itemset")) if key is None else key)
        self.best += [r.asDict() for r in named.orderBy(F.desc("quality"), F.desc("key")).limit(task.result_set_size).collect()]
        self.best = sorted(self.best, key=lambda r: (r["quality"], r["key"]), reverse=True)[: task.result_set_size]

    @property
    def threshold(self) -> tuple[float, bool]:
        """What an estimate must exceed (or, while there is room, reach)."""
        full = len(self.best) >= self.task.result_set_size
        return (max(self.best[-1]["quality"], self.task.min_quality), True) if full else (self.task.min_quality, False)

    def result(self, make=None) -> SubgroupDiscoveryResult:
        self.sig.unpersist()
        rows = [r for r in self.best if r["quality"] > self.task.min_quality]
        return SubgroupDiscoveryResult(self.task, [(r["quality"], (make or self.items.conjunction)(r["itemset"]), {k: v for k, v in r.items() if k not in ("itemset", "key", "quality", "estimate")}) for r in rows])


class _Exhaustive:
    """An exact search. ``root``: the whole dataset counts. ``same``: several selectors of one attribute. ``prune``: by estimates."""

    root, same, prune, support, subset_check = True, True, True, True, False

    def __init__(self, **options):
        self.options = options

    def check(self, task: SubgroupDiscoveryTask) -> None:
        pass

    def execute(self, task: SubgroupDiscoveryTask, use_optimistic_estimates: bool = True) -> SubgroupDiscoveryResult:
        self.check(task)
        if isinstance(task.qf, (Q.GeneralizationAwareQF, Q.GeneralizationAware_StandardQF, Q.GeneralizationAware_StandardQFNumeric)):
            return generalisation_aware(task, self.root, self.same)
        if isinstance(task.qf, Q.EMM_Likelihood):
            return model_mining(task, self.root, self.same)
        run, qf = _Run(task), task.qf
        prune = self.prune and use_optimistic_estimates and qf.bounded
        members, before = L.start(run.sig), None
        if self.root:
            cells = L.with_scores(qf.finish(members, run.const), qf, run.const)
            run.offer(cells)
        kept = []
        for depth in range(1, task.depth + 1):
            members = L.grow(members, self.same)
            if self.subset_check and before is not None and depth > 2:
                for i in range(depth - 2):  # the prefix itself is known to be kept
                    less = F.concat(F.slice("itemset", 1, i), F.slice("itemset", i + 2, depth - i - 1))
                    members = members.withColumn("_less", less).join(before.withColumnRenamed("itemset", "_less"), "_less", "left_semi").drop("_less")
            cells = L.with_scores(qf.finish(members, run.const), qf, run.const).persist()
            kept.append(cells)
            run.offer(cells)
            if depth == task.depth:
                break
            ok = _all(task.monotone) if self.support else F.lit(True)
            if prune:
                least, strict = run.threshold
                ok = ok & (F.col("estimate") > least if strict else F.col("estimate") >= least)
            if prune or (self.support and task.monotone):
                before = cells.filter(ok).select("itemset")
                if before.isEmpty():
                    break
                members = members.join(before, "itemset", "left_semi")
        out = run.result()
        for c in kept:
            c.unpersist()
        return out


class SimpleSearch(_Exhaustive):
    """All combinations of selectors, without the dataset itself, without pruning."""

    root, prune, support = False, False, False


class SimpleDFS(_Exhaustive):
    """All combinations and the dataset; pruned where the quality has an estimate."""


class DFS(_Exhaustive):
    """One selector for each attribute, and the dataset."""

    same = False

    def check(self, task):
        if task.qf.optimistic({k: 1 for k in ("n", "p", "centre")}) is None and not isinstance(task.qf, (Q.GeneralizationAware_StandardQF, Q.GeneralizationAwareQF)):
            warnings.warn("the quality has no estimate: every description is scored", RuntimeWarning, stacklevel=3)


class BestFirstSearch(_Exhaustive):
    """One selector for each attribute; a level is a batch of the frontier."""

    root, same = False, False


class Apriori(_Exhaustive):
    """Level by level; a candidate needs all its subsets. ``combination_name="Disjunction"`` searches disjunctions."""

    root, subset_check = False, True

    def check(self, task):
        if not task.qf.bounded:
            warnings.warn("the quality has no bound: nothing is pruned by it", RuntimeWarning, stacklevel=3)

    def execute(self, task, use_optimistic_estimates: bool = True):
        if self.options.get("combination_name", "Conjunction") == "Disjunction":
            return disjunctions(task)
        return super().execute(task, use_optimistic_estimates)


class DFSNumeric(_Exhaustive):
    """For StandardQFNumeric alone, pruned by the best prefix of the descending target values."""

    support = False

    def execute(self, task, use_optimistic_estimates: bool = True):
        if not isinstance(task.qf, Q.StandardQFNumeric):
            raise RuntimeError("DFSNumeric needs StandardQFNumeric")
        if task.qf.centroid == "mean":
            qf = Q.StandardQFNumeric(task.qf.a, estimator="order")
            task = SubgroupDiscoveryTask(task.data, task.target, task.search_space, qf, task.result_set_size, task.depth, task.min_quality, task.constraints)
        return super().execute(task, use_optimistic_estimates)


class GpGrowth(_Exhaustive):
    """Pattern growth over the signatures: bottom-up with estimates, or top-down without."""

    def __init__(self, mode: str = "b_u"):
        if mode not in ("b_u", "t_d"):
            raise ValueError("mode is b_u or t_d")
        super().__init__()
        self.mode, self.prune = mode, mode == "b_u"

    def check(self, task):
        if self.mode == "t_d" and not task.monotone:
            warnings.warn("top-down growth without a support limit visits every pattern", RuntimeWarning, stacklevel=3)

    def to_file(self, task: SubgroupDiscoveryTask, path: str) -> None:
        """Write one line for each row: the numbers of the covering selectors and the row's values."""
        transactions(task).write.mode("overwrite").text(path)


def transactions(task: SubgroupDiscoveryTask) -> DataFrame:
    """value: the numbers of the selectors that cover a row, by falling support, then the row's values."""
    space = task.search_space
    sizes = task.data.agg(*(F.count_if(s.column()).alias(f"c{i}") for i, s in enumerate(space))).first()
    order = sorted(range(len(space)), key=lambda i: (-sizes[i], space[i].key))
    covered = F.array_compact(F.array(*(F.when(space[i].column(), F.lit(str(k))) for k, i in enumerate(order))))
    values = [v.cast("string") for v in task.qf.values(task.target, {}).values()]
    return task.data.select(F.concat_ws(" ", F.array_join(covered, " "), *values).alias("value"))


class BeamSearch:
    """Keep the best ``beam_width`` descriptions of each level and extend only those."""

    def __init__(self, beam_width: int = 20, beam_width_adaptive: bool = False):
        self.width, self.adaptive = beam_width, beam_width_adaptive

    def execute(self, task: SubgroupDiscoveryTask) -> SubgroupDiscoveryResult:
        width = task.result_set_size if self.adaptive else self.width
        if width < task.result_set_size:
            raise RuntimeError("the beam must be as wide as the result set")
        run, spark = _Run(task), task.data.sparkSession
        key = lambda s: run.items.conjunction(s).key
        beam = [(0.0, key(()), (), {})]
        seen: set[str] = set()
        for _ in range(task.depth):
            new: dict[str, tuple] = {}
            for _, k, itemset, _ in beam:
                if k in seen:
                    continue
                seen.add(k)
                for i in run.items.ids:
                    if i not in itemset:
                        grown = tuple(sorted((*itemset, i)))
                        new.setdefault(key(grown), grown)
            fresh = [s for s in new.values()]
            if not fresh:
                break
            if task.qf.keeps_value:
                rows = self._with_values(run, fresh)
            else:
                sums = [c for c in run.sig.columns if c != "items"]
                cells = L.table_of(spark, fresh, L.evaluate(run.sig, fresh, sums))
                rows = L.with_scores(cells, task.qf, run.const).filter(_all(task.constraints)).collect()
            held = {b[1]: b for b in beam}
            for r in sorted(rows, key=lambda r: key(r["itemset"])):
                q = r["quality"]
                if q is not None and q >= task.min_quality:
                    held.setdefault(key(r["itemset"]), (q, key(r["itemset"]), tuple(r["itemset"]), r.asDict()))
            after = sorted(held.values(), key=lambda b: (b[0], b[1]), reverse=True)[:width]
            if [b[1] for b in after] == [b[1] for b in beam]:
                break
            beam = after
        run.best = [{**b[3], "quality": b[0], "key": b[1], "itemset": b[2]} for b in beam[: task.result_set_size]]
        return run.result()

    @staticmethod
    def _with_values(run: _Run, fresh: list[tuple]):
        task, out = run.task, []
        for at in range(0, len(fresh), 50):
            each = F.array(*(F.when(L.has_all(s), F.array(*map(F.lit, s))) for s in fresh[at : at + 50]))
            members = run.sig.select(F.explode(F.array_compact(each)).alias("itemset"), "t", "n")
            out += L.with_scores(task.qf.finish(members, run.const), task.qf, run.const).filter(_all(task.constraints)).collect()
        return out


def _named_disjunction(items: L.Items, itemset):
    return Disjunction(items.conjunction(itemset).parts)


def disjunction_cells(run: _Run, candidates: DataFrame, conj: DataFrame, sums: list[str]) -> DataFrame:
    """Sums of disjunctions from those of conjunctions: inclusion and exclusion over an itemset's non-empty parts."""
    # parts of an itemset by its bit masks
    n = F.size("itemset")
    part = lambda m: F.filter("itemset", lambda x, i: F.expr("1=1") & (F.getbit(m, i) == 1))
    masks = F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2.0), n.cast("double")) - 1).cast("long"))
    parts = candidates.select("itemset", F.explode(F.transform(masks, part)).alias("part"))
    joined = parts.join(conj.withColumnRenamed("itemset", "part"), "part")
    sign = F.when(F.size("part") % 2 == 1, 1).otherwise(-1)
    return joined.groupBy("itemset").agg(*(F.sum(sign * F.col(c)).alias(c) for c in sums))


def disjunctions(task: SubgroupDiscoveryTask, relax: float = 1.0) -> SubgroupDiscoveryResult:
    """The best disjunctions, level by level; a level joins kept itemsets that differ in the last item."""
    run, qf = _Run(task), task.qf
    sums = [c for c in run.sig.columns if c != "items"]
    members, conj = L.start(run.sig), None
    kept = None
    for depth in range(1, task.depth + 1):
        members = L.grow(members, True)
        level = qf.finish(members, run.const).select("itemset", *sums)
        conj = level.persist() if conj is None else conj.unionByName(level).persist()
        if depth == 1:
            candidates = level.select("itemset")
        else:
            a = kept.select(F.slice("itemset", 1, depth - 2).alias("head"), F.element_at("itemset", -1).alias("left"))
            b = a.withColumnRenamed("left", "right")
            candidates = a.join(b, "head").filter("left < right").select(F.concat("head", F.array("left", "right")).alias("itemset"))
        scored = L.with_scores(disjunction_cells(run, candidates, conj, sums), qf, run.const).persist()
        names = F.array_sort(F.transform("itemset", lambda i: F.element_at(run.items.keys(), i.bitwiseAND(F.lit((1 << L.SHIFT) - 1)) + 1)))
        run.offer(scored, F.concat(F.lit("("), F.array_join(names, " or "), F.lit(")")))
        kept = scored
        if hasattr(qf, "optimistic_generalisation") and qf.bounded:
            least, _ = run.threshold
            kept = scored.filter(qf.optimistic_generalisation(run.const) * relax >= least)
    return run.result(lambda s: _named_disjunction(run.items, s))


class GeneralisingBFS:
    """Disjunctions by batches of the frontier; the bound is relaxed by a tenth."""

    def execute(self, task: SubgroupDiscoveryTask) -> SubgroupDiscoveryResult:
        return disjunctions(task, 1.1)


def ancestor_cells(task: SubgroupDiscoveryTask, same: bool):
    """(level, its cells, run): cells with what they take from their immediate generalisations, from the dataset down.

    A cell meets its parents by a join on the itemset without one item, and reduces them at once.
    """
    run, qf = _Run(task), task.qf
    members, up = L.start(run.sig), None
    for depth in range(task.depth + 1):
        cells = qf.finish(members, run.const).filter(_all(task.monotone))
        if up is not None:
            links = cells.select("itemset", F.explode(L.subsets(F.col("itemset"))).alias("_up"))
            links = links.join(up.select(F.col("itemset").alias("_up"), F.struct(*(F.col(c) for c in up.columns if c != "itemset")).alias("up")), "_up")
            yield depth, cells, links, run
        else:
            yield depth, cells, None, run
        up = run.carried
        if depth < task.depth:
            members = L.grow(members, same)


def generalisation_aware(task: SubgroupDiscoveryTask, root: bool, same: bool) -> SubgroupDiscoveryResult:
    run = None
    for depth, scored, run in generalisation_levels(task, same):
        if depth or root:
            run.offer(scored)
    return run.result()


def generalisation_levels(task: SubgroupDiscoveryTask, same: bool):
    """(level, scored cells, run) of a generalisation-aware quality."""
    qf = task.qf
    for depth, cells, links, run in ancestor_cells(task, same):
        c = run.const
        if isinstance(qf, Q.GeneralizationAwareQF):
            inner = L.with_scores(cells, qf.qf, c).withColumnRenamed("quality", "own")
            if links is None:
                out = inner.withColumn("top", F.lit(0.0))
            else:
                best = links.groupBy("itemset").agg(F.max(F.greatest(F.coalesce("up.own", F.lit(0.0)), F.col("up.top"))).alias("top"))
                out = inner.join(best, "itemset")
            run.carried = out.select("itemset", "own", "top").persist()
            yield depth, out.withColumn("quality", F.col("own") - F.col("top")), run
        elif isinstance(qf, Q.GeneralizationAware_StandardQF):
            yield depth, _standard(qf, cells, links, run), run
        else:
            mean = F.col("s") / F.col("n")
            own = cells.withColumn("mean", mean)
            if links is None:
                out = own.withColumn("top", F.col("mean"))
            else:
                best = links.groupBy("itemset").agg(F.max(F.greatest("up.mean", "up.top")).alias("top"))
                out = own.join(best, "itemset")
            run.carried = out.select("itemset", "mean", "top").persist()
            yield depth, out.withColumn("quality", F.pow(F.col("n") / float(max(c["n"], 1)), F.lit(float(qf.a))) * (F.col("mean") - F.col("top"))).withColumn("estimate", F.lit(None).cast("double")), run


def _standard(qf, cells: DataFrame, links: DataFrame | None, run: _Run) -> DataFrame:
    c, inf = run.const, F.lit(math.inf)
    N, n, p = float(max(c["n"], 1)), F.col("n").cast("double"), F.col("p").cast("double")
    share, gone = p / n, n - p
    if links is None:
        out = cells.withColumn("top", share).withColumn("delta", inf)
    else:
        own = cells.select("itemset", gone.alias("gone"))
        got = links.join(own, "itemset").groupBy("itemset").agg(
            F.max(F.greatest("up.share", "up.top")).alias("top"), F.least(F.min(F.col("up.gone") - F.col("gone")), F.min("up.delta")).alias("delta")
        )
        out = cells.join(got, "itemset")
    run.carried = out.select("itemset", share.alias("share"), "top", gone.alias("gone"), "delta").persist()
    quality = F.pow(n / N, F.lit(float(qf.a))) * (share - F.col("top"))
    if qf.strategy == "max":
        estimate = F.pow(p / N, F.lit(float(qf.a))) * (1 - F.col("top"))
    else:
        d = F.col("delta")
        pos = F.lit(1.0) if qf.a == 0 else p if qf.a == 1 else F.least(F.ceil(qf.a * d / (1 - qf.a)).cast("double"), p)
        tau = F.greatest(F.coalesce(F.try_divide(pos, pos + d), F.lit(0.0)), share, F.col("top"))
        estimate = F.when(d == inf, inf).otherwise(F.pow(p / N, F.lit(float(qf.a))) * (1 - tau))
    return out.withColumn("quality", quality).withColumn("estimate", estimate)


def line(cells: DataFrame, const: dict) -> DataFrame:
    """slope and intercept of the least-squares line of each cell of at least three rows."""
    n, sx, sy = F.col("n").cast("double"), F.col("sx"), F.col("sy")
    slope = F.when(F.col("n") > 2, F.try_divide(F.col("sxy") - sx * sy / n, F.col("sxx") - sx * sx / n))
    out = cells.withColumn("slope", slope)
    return out.withColumn("intercept", const["y"] + sy / n - F.col("slope") * (const["x"] + sx / n))


def model_mining(task: SubgroupDiscoveryTask, root: bool, same: bool, chunk: int = 100) -> SubgroupDiscoveryResult:
    """Score every cell's line on the rows inside and on all rows.

    Lines come to the driver a level at a time, and all rows are scored against a chunk of them in one aggregate over
    the distinct points; rows inside a cell meet its line by a join on the itemset.
    """
    run, target, qf, spark = _Run(task), task.target, task.qf, task.data.sparkSession
    x, y = (F.col(f"`{c}`").cast("double") for c in (target.x, target.y))
    covered = F.array_compact(F.array(*(F.when(s.column(), F.lit(i)) for i, s in zip(run.items.ids, run.items.selectors))))
    rows = task.data.select(covered.alias("items"), x.alias("x"), y.alias("y")).groupBy("items", "x", "y").agg(F.count("*").alias("k")).persist()
    points = rows.groupBy("x", "y").agg(F.sum("k").alias("k")).persist()
    density = lambda a, b: F.exp(-F.pow(F.col("y") - a * F.col("x") - b, 2) / 2) / math.sqrt(2 * math.pi)
    members, inside = L.start(run.sig), L.start(rows)
    for depth in range(task.depth + 1):
        cells = line(qf.finish(members, run.const).filter(_all(task.monotone)), run.const).filter("slope IS NOT NULL").persist()
        if depth or root:
            own = inside.join(cells.select("itemset", "slope", "intercept"), "itemset").groupBy("itemset").agg(F.sum(density(F.col("slope"), F.col("intercept")) * F.col("k")).alias("inside"))
            lines = cells.select("itemset", "slope", "intercept").collect()
            every = []
            for at in range(0, len(lines), chunk):
                part = lines[at : at + chunk]
                r = points.agg(*(F.sum(density(F.lit(v["slope"]), F.lit(v["intercept"])) * F.col("k")).alias(f"d{i}") for i, v in enumerate(part))).first()
                every += [(v["itemset"], r[i]) for i, v in enumerate(part)]
            if every:
                table = spark.createDataFrame(every, "itemset array<int>, every double")
                scored = cells.join(own, "itemset").join(table, "itemset")
                n, N = F.col("n").cast("double"), float(run.const["n"])
                q = F.col("every") / n if qf.compat else F.col("inside") / n - F.try_divide(F.col("every") - F.col("inside"), F.lit(N) - n)
                run.offer(scored.withColumn("quality", q))
        if depth < task.depth:
            keep = cells.select("itemset")
            members, inside = (L.grow(m.join(keep, "itemset", "left_semi"), same) for m in (members, inside))
    return run.result()
