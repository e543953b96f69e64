"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Features are lower-cased words and the first four, five and six characters of longer words; every feature of every
example is indexed. Examples are a bounded sample of labelled rows (``MAX_PER_CLASS`` of each label, in the order of a
hash), whole texts of both labels. A weight is (1 + log tf) * idf * rf: document frequencies are counted over all
documents, and rf, the relevance frequency log2(2 + share of toxic / share of other examples with the feature), is the
supervised factor of tf.rf weighting, so that what marks the label is not drowned by a long text's other words.

The index has posting lists for rare features and, for each block of like examples, the largest weight of each frequent
one. A batch of texts is scored over the rare features first; block maxima of the frequent ones give every block's
bound, blocks are opened from the highest bound on, and a block whose bound cannot reach a text's k-th best example is
not opened for it: the neighbours are exact. They vote with their cosine, times what their class counts for in the
labelled rows. The share of toxic votes is calibrated by a logistic curve fitted to the examples, each scored without
itself.

Defined edge cases: a null or wordless text has no features and gets the score of no evidence; labels that repeat a
doc_id count as toxic if any does; null labels and labels without doc_id are left out; a labelled doc_id that repeats in
the documents gives one example, the row of the smallest text hash; without examples of both labels every score is the
share of toxic labels (0 without any); equal cosines go to the example that stands earlier by content, so ids play no
part in a score; rows that repeat a doc_id, or have none, are scored each; very long texts are taken whole; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, ship, text_bytes

#: The bound of the sample: labelled rows of each label that become examples.
MAX_PER_CLASS = 1000
#: Lengths of the beginnings of longer words that are features too.
BEGINNINGS = (4, 5, 6)
HEAD = max(BEGINNINGS) + 1
K = 15
BLOCK = 64
#: Features on more than this share of the examples are kept as block columns, others as posting lists.
FREQUENT = 0.05
#: More than single precision can err by in a cosine.
SLACK = 1e-4
#: Texts that are searched together, and beginnings of words whose features a worker remembers.
QUERIES = 64
CACHE_WORDS = 300_000
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def features(text: str) -> Counter:
    """Counts of words and of the beginnings of longer words."""
    out = Counter(_WORD.findall(text.lower()))
    for w, n in list(out.items()):
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


class _Known(dict):
    """The feature numbers of words by their first ``HEAD`` characters: of the beginnings, and of a shorter word itself."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, head: str) -> list[int]:
        found = [self.number.get(head[:k] + "*", -1) for k in BEGINNINGS if len(head) > k]
        if len(head) < HEAD:
            found.append(self.number.get(head, -1))
        self[head] = found = [i for i in found if i >= 0]
        return found


class Counted:
    """Feature numbers and counts of texts over a fixed vocabulary; the same features as ``features`` gives."""

    def __init__(self, number: dict[str, int]):
        self.number, self.known = number, _Known(number)

    def words(self, text: str) -> Counter:
        out = Counter(text.lower().replace(".", " ").replace(",", " ").split())
        for w in [w for w in out if not w.isalnum()]:
            n = out.pop(w)
            for x in _WORD.findall(w):
                out[x] += n
        return out

    def flat(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers, some repeated, and the place of the word of each."""
        lists = list(map(self.known.__getitem__, [w[:HEAD] for w in words]))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        own = [(i, k) for i, w in enumerate(words) if len(w) >= HEAD and (k := self.number.get(w)) is not None]
        flat = np.fromiter(chain(chain.from_iterable(lists), [k for _, k in own]), np.int64, int(sizes.sum()) + len(own))
        return flat, np.concatenate([np.repeat(np.arange(len(lists)), sizes), np.array([i for i, _ in own], np.int64)])

    def present(self, text: str) -> set[int]:
        """The feature numbers of a text."""
        self.room()
        words = set(text.lower().replace(".", " ").replace(",", " ").split())
        odd = [w for w in words if not w.isalnum()]
        words.difference_update(odd)
        words.update(x for w in odd for x in _WORD.findall(w))
        out = set().union(*map(self.known.__getitem__, {w[:HEAD] for w in words}))
        out.update(map(self.number.get, [w for w in words if len(w) >= HEAD]))
        out.discard(None)
        return out

    def room(self) -> None:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        self.room()
        words = self.words(text)
        flat, word = self.flat(words)
        ids, where = np.unique(flat, return_inverse=True)
        times = np.fromiter(words.values(), np.int64, len(words))[word]
        return ids, np.bincount(where, times, len(ids)).astype(np.int64)


class BlockMaxIndex:
    """Unit vectors of examples: posting lists of rare features, block columns and block maxima of frequent ones."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_features: int, block: int = BLOCK, frequent: float = FREQUENT):
        self.n, self.block, self.n_blocks = len(vectors), block, -(-len(vectors) // block)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        sizes = np.bincount(term, minlength=n_features)
        common = np.flatnonzero(sizes > frequent * self.n)
        self.column = np.full(n_features, -1, np.int64)
        self.column[common] = np.arange(len(common))
        wide = self.column[term] >= 0
        self.dense = np.zeros((self.n_blocks * block, len(common)))
        self.dense[doc[wide], self.column[term[wide]]] = weight[wide]
        self.short = self.dense.astype(np.float32)  # finds the candidates, which are then scored in full
        self.maxima = self.short.reshape(self.n_blocks, block, len(common)).max(1) if self.n else self.short
        order = np.argsort(term[~wide], kind="stable")
        self.docs, self.weights = doc[~wide][order], weight[~wide][order]
        self.at = np.append(0, np.cumsum(np.bincount(term[~wide], minlength=n_features)))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector the k examples of the highest positive cosine, best first; exact to nine decimals."""
        m, n, width = len(queries), self.n, self.n_blocks * self.block
        if not n or not m:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        who = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        term, weight = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        column = self.column[term]
        wide = column >= 0
        dense = np.zeros((m, self.dense.shape[1]))
        dense[who[wide], column[wide]] = weight[wide]
        first, size = self.at[term[~wide]], np.diff(self.at)[term[~wide]]
        entry = np.repeat(first - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))
        scores = np.bincount(np.repeat(who[~wide] * width, size) + self.docs[entry], self.weights[entry] * np.repeat(weight[~wide], size), m * width).reshape(m, width).astype(np.float64)
        rare, close = scores.copy(), dense.astype(np.float32)
        bound = scores.reshape(m, self.n_blocks, self.block).max(2) + close @ self.maxima.T
        opened, least = np.zeros((m, self.n_blocks), bool), np.zeros(m)
        scored = np.zeros_like(opened)
        order = np.argsort(-bound, axis=1, kind="stable")
        step = 4 * max(1, -(-k // self.block))  # blocks that are sure to hold k examples, then all that can still matter
        for upto in (step, self.n_blocks):
            open_ = np.zeros_like(opened)
            np.put_along_axis(open_, order[:, :upto], True, 1)
            open_ &= ~opened & (bound >= least[:, None] - SLACK) & (bound > 0)
            for b in np.flatnonzero(open_.any(0)):
                own, here = slice(b * self.block, (b + 1) * self.block), np.flatnonzero(open_[:, b] & ~scored[:, b])
                if len(here) * 2 > m and not scored[:, b].any():  # cheaper for all rows at once; a closed block stays unused
                    scores[:, own] += close @ self.short[own].T
                    scored[:, b] = True
                elif len(here):
                    scores[here, own] += close[here] @ self.short[own].T
                    scored[here, b] = True
            opened |= open_
            seen = np.where(np.repeat(opened, self.block, 1), scores, 0.0)
            if without is not None:
                seen[np.arange(m), without] = 0.0
            if width > k:
                least = np.partition(seen, width - k, axis=1)[:, width - k]
        out = []
        for row, low, exact, q in zip(seen, least, rare, dense):
            found = np.flatnonzero((row > 0) & (row >= low - SLACK))
            sims = np.round(exact[found] + (self.dense[found] * q).sum(1), 9)
            best = np.lexsort((found, -sims))[:k]
            best = best[sims[best] > 0]
            out.append((found[best], sims[best]))
        return out


class Model:
    """Vocabulary, weights, examples and calibration; of bounded size, so it can be broadcast. Workers build the index."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], names: list[str], df: np.ndarray, n_docs: int, class_weight: tuple[float, float], prior: float, k: int = K):
        """Examples are doc_id, label, feature numbers (places in ``names``) and counts."""
        self.prior, self.k, self.curve, self.built = prior, k, None, None
        self.number = {f: i for i, f in enumerate(names)}
        total = [sum(y == v for _, y, _, _ in examples) for v in (0, 1)]
        if not names or not all(total):
            return
        counts = np.zeros((2, len(names)))
        for _, y, ids, _ in examples:
            counts[y, ids] += 1
        idf = np.log((1 + n_docs) / (1 + df))
        rf = np.log2(2 + (counts[1] / total[1]) / (np.maximum(counts[0], 1) / total[0]))
        self.weights = np.maximum(idf, 0) * rf
        vectors = [(d, y, *self.vector(t, c)) for d, y, t, c in examples]
        # examples that share their strongest frequent feature stand together, which makes the blocks' bounds tight
        often = np.bincount(np.concatenate([v[2] for v in vectors]), minlength=len(names)) > FREQUENT * len(vectors)
        strong = lambda t, w: int(t[np.argmax(np.where(often[t], w, 0))]) if len(t) else -1
        vectors.sort(key=lambda v: (strong(v[2], v[3]), v[2].tobytes(), v[3].tobytes(), v[1], v[0]))
        self.ids = np.array([v[0] for v in vectors], np.int64)
        self.labels = np.array([v[1] for v in vectors], np.float64)
        self.weight = np.where(self.labels > 0, class_weight[1], class_weight[0])
        self.vectors = [(v[2], v[3]) for v in vectors]
        raw = np.concatenate([self.shares(self.vectors[i : i + QUERIES], np.arange(i, min(i + QUERIES, len(vectors)))) for i in range(0, len(vectors), QUERIES)])
        self.curve = fit_logistic(raw, self.labels, self.weight)

    def __getstate__(self):
        return {**self.__dict__, "built": None}

    @property
    def index(self) -> BlockMaxIndex:
        if self.built is None:
            self.built = BlockMaxIndex(self.vectors, len(self.number))
        return self.built

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit TF-IDF vector over the vocabulary; empty without a feature of it."""
        w = (1 + np.log(counts)) * self.weights[ids]
        norm = math.sqrt(float((w * w).sum()))
        return (ids, w / norm) if norm > 0 else (ids[:0], w[:0])

    def share(self, docs: np.ndarray, sims: np.ndarray) -> float:
        """The toxic share of the votes; the prior counts as one tenth of a vote."""
        votes = sims * self.weight[docs]
        return float(((votes * self.labels[docs]).sum() + 0.1 * self.prior) / (votes.sum() + 0.1))

    def shares(self, vectors: list, without: np.ndarray | None = None) -> np.ndarray:
        return np.array([self.share(*x) if len(v[0]) else 0.0 for x, v in zip(self.index.search(vectors, self.k, without), vectors)])

    def score(self, texts: list[str], counted: Counted) -> list[tuple[float, list[int], list[float]]]:
        """The calibrated score of each text, and the neighbours' doc_ids with their cosines."""
        if self.curve is None:
            return [(self.prior, [], [])] * len(texts)
        out = []
        for i in range(0, len(texts), QUERIES):
            vectors = [self.vector(*counted(t)) for t in texts[i : i + QUERIES]]
            for (docs, sims), v in zip(self.index.search(vectors, self.k), vectors):
                raw = self.share(docs, sims) if len(v[0]) else 0.0
                out.append((float(1 / (1 + math.exp(-(self.curve[0] * raw + self.curve[1])))), self.ids[docs].tolist(), sims.tolist()))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, with a slight pull of the slope towards zero."""
    a, b = 1.0, 0.0
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 0.1 * a, (w * (p - y)).sum()])
        h = w * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """The model from the labelled rows; the examples and their features' document frequencies are all that comes to the driver."""
    ship(docs.sparkSession)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    every = sum(totals.values())
    prior = totals.get(1, 0) / every if every else 0.0
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "_id"))

    def rows(c: dict) -> dict:
        got = [features(b.decode("utf-8", "replace")) for b in c["data"]]
        return {"doc_id": c["doc_id"], "y": c["y"], "names": [list(x) for x in got], "counts": [list(x.values()) for x in got]}

    chosen = docs.select("doc_id", text_bytes().alias("data")).join(sample, F.col("doc_id") == F.col("_id")).drop("_id")
    chosen = chosen.groupBy("doc_id", "y").agg(F.min_by("data", F.struct(F.xxhash64("data"), "data")).alias("data"))
    chosen = materialize(map_rows(chosen, rows, "doc_id long, y int, names array<string>, counts array<int>"), "examples")
    number: dict[str, int] = {}
    examples = []
    for r in chosen.orderBy("doc_id").toLocalIterator():
        ids = np.array([number.setdefault(f, len(number)) for f in r["names"]], np.int64)
        order = np.argsort(ids)
        examples.append((r["doc_id"], r["y"], ids[order], np.array(r["counts"], np.int64)[order]))
    got, names = Counter(y for _, y, _, _ in examples), list(number)
    df, n_docs = document_frequency(docs, names)
    weight = tuple((totals.get(y, 0) / got[y]) if got.get(y) else 1.0 for y in (0, 1))
    return Model(examples, names, df, n_docs, (weight[0] / max(weight), weight[1] / max(weight)), prior)


def document_frequency(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Documents with each of the examples' features, and all documents. Each task sums up before the shuffle."""
    wanted = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches):
        import pyarrow as pa

        counted, sums = Counted(wanted.value), np.zeros(len(wanted.value) + 1, np.int64)
        for batch in batches:
            found: list[int] = []
            for b in batch.column(0).to_pylist():
                found.extend(counted.present(b.decode("utf-8", "replace")))
            sums += np.bincount(np.array(found, np.int64), minlength=len(sums))
            sums[-1] += batch.num_rows
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["f", "n"])

    if not names:
        return np.zeros(0, np.int64), 0
    sums = docs.select(text_bytes().alias("data")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(names) + 1, np.int64)
    for r in sums:
        n[r["f"]] = r["n"]
    return n[:-1], int(n[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, neighbours (doc_ids of examples, nearest first), cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counters: list = []

    def rows(c: dict) -> dict:
        if not counters:
            counters.append(Counted(shared.value.number))
        got = shared.value.score([b.decode("utf-8", "replace") for b in c["data"]], counters[0])
        return {"doc_id": c["doc_id"], "score": [x[0] for x in got], "neighbours": [x[1] for x in got], "cosines": [x[2] for x in got]}

    ship(docs.sparkSession)
    return map_rows(docs.select("doc_id", text_bytes().alias("data")), rows, "doc_id long, score double, neighbours array<long>, cosines array<double>")
