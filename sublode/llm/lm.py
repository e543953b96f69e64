"""Language-model scoring: a causal self-attention model in numpy over subword ids, beside a unigram base score.

Counts of words cover every training document. Frequent words, up to ``HEAD_WORDS``, go to the workers as a broadcast
of bounded size; the other words of a text meet their counts in a join, so base scores are exact. Subword counts follow
from the word counts. The model factors a subword's probability in three: its group's and its class's within the group,
which attention over the preceding subwords gives, and its share of the class's count. Frequent subwords are classes of
their own, the others are grouped by like neighbours. Texts are cut into overlapping windows of ``WINDOW`` ids whose
first ``CONTEXT`` positions are context only, so each id is scored once, in batches.

Everything is learnt from every training text: word and subword counts, the neighbours that make the classes, and the
weights. Texts are encoded once, into a table that training and scoring read. The workers train on all windows of all
training texts: each task goes through its share from the same starting point, and the weights are the mean over tasks,
by windows. The starting point comes from the driver, which fits windows drawn by hash from all places of all training
texts, about ``TRAIN_WINDOWS`` in ``TRAIN_BYTES`` of text, their number growing as the cube root of the text's size:
13 MB for 1 GB of text, 600 MB for 100 TB.

Defined edge cases: a null text is empty, that is one end token; without training documents N and V are 0, every base
term is log10(1 / 1) = 0, and the model is uniform over subwords; rows that repeat a doc_id, or have none, are scored
each; very long texts are taken whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import copy
import ctypes
import math
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, text_bytes, worker_state
from .wavelet import END_ID, CachedEncoder, worker_encoder

HEAD_WORDS = 150_000
TRAIN_WINDOWS = 60_000
TRAIN_BYTES = 25_000_000
IDS = 49_408
#: Groups of classes, and classes: frequent ids alone, rarely seen ids by count, the others by their neighbours.
GROUPS = 32
GROUP_CLASSES = 40
CLASSES = 1024
SINGLE = 384
SPARE = 8
OWN_ROWS = 4096
WIDTH = 32
WINDOW = 32
CONTEXT = 8
STEPS = 400
BATCH = 96
#: Windows of a step of the pass over all texts, its rate, and the windows that are mixed before they are dealt into steps.
PASS_BATCH = 512
PASS_RATE = 0.002
PASS_MIX = 16_384
#: Weights are added up as whole numbers of this unit, so that a sum does not depend on its order.
UNIT = 2.0**-24
#: Frequent ids whose places beside an id make its class.
NEAR = 48
#: What stands in a window where its text has no id.
NONE = 0xFFFF
#: Words between the places where windows may begin.
STRIDE_WORDS = 12


def k_means(x: np.ndarray, weight: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster, and the centres; the heaviest rows are the first centres."""
    centre = x[np.argsort(-weight, kind="stable")[:k]].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(1), axis=1)
        mass = np.bincount(own, weight, len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x * weight[:, None])
        centre[mass > 0] = sums[mass > 0] / mass[mass > 0, None]
    return own, centre


class AttentionModel:
    """One causal attention layer over id embeddings, a residual, and a softmax over groups, then over a group's classes."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.counts = counts.astype(np.float64) + 0.5
        self.cls = np.zeros(len(counts), np.int64)
        top = np.argsort(-self.counts, kind="stable")[:OWN_ROWS]
        self.row = np.full(len(counts), -1, np.int64)  # frequent ids have an embedding of their own, others their class's
        self.row[top] = np.arange(len(top))
        n, s = len(top) + CLASSES + 1, 0.1
        shapes = {"E": (n, WIDTH), "P": (WINDOW, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "U": (WIDTH, GROUPS), "b": (GROUPS,), "W": (WIDTH, CLASSES), "c": (CLASSES,)}
        self.p = {k: rng.normal(0, s, v) for k, v in shapes.items()}
        self.start = n - 1

    def set_classes(self, windows: np.ndarray, rounds: int = 6) -> None:
        """Classes and groups of ids by the frequent ids beside them in windows."""
        self.group_ids(neighbour_table(self.counts, windows), rounds)

    def group_ids(self, beside: np.ndarray, rounds: int = 6) -> None:
        """Classes and groups of ids by their rows of a neighbour table; groups' classes stand together."""
        order = np.argsort(-self.counts, kind="stable")
        single, x = order[:SINGLE], beside.astype(np.float64)
        seen = x.sum(1)
        x = np.sqrt(x / np.maximum(seen[:, None], 1))
        alone = np.isin(np.arange(len(self.counts)), single)
        use = np.flatnonzero((seen >= 10) & ~alone)
        rest = order[~alone[order] & (seen[order] < 10)]
        k = CLASSES - SINGLE - SPARE
        self.cls[single] = np.arange(len(single))
        centres = np.zeros((CLASSES, x.shape[1]))
        centres[: len(single)] = x[single]
        if len(use):
            own, centre = k_means(x[use], np.sqrt(self.counts[use]), k, rounds)
            self.cls[use] = SINGLE + own
            centres[SINGLE : SINGLE + len(centre)] = centre
        if len(rest):
            mass = np.cumsum(np.sqrt(self.counts[rest]))
            self.cls[rest] = CLASSES - SPARE + np.minimum(SPARE - 1, (mass / mass[-1] * SPARE).astype(np.int64))
        size = np.bincount(self.cls, self.counts, CLASSES)
        group = self._deal(centres, size, rounds)
        place = np.argsort(group, kind="stable")
        new = np.empty(CLASSES, np.int64)
        new[place] = np.arange(CLASSES)
        self.cls, self.group, size = new[self.cls], group[place], size[place]
        self.first = np.searchsorted(self.group, np.arange(GROUPS + 1))
        self.log_share = np.log(self.counts / size[self.cls]).astype(np.float32)
        shared = min(OWN_ROWS, len(self.counts))
        self.row = np.where(self.row >= 0, self.row, shared + self.cls)
        in_group = np.bincount(self.group, size, GROUPS)
        self.p["b"] = np.log(np.maximum(in_group, 0.5) / in_group.sum())
        self.p["c"] = np.log(np.maximum(size, 0.5) / np.maximum(in_group[self.group], 0.5))

    @staticmethod
    def _deal(centres: np.ndarray, size: np.ndarray, rounds: int) -> np.ndarray:
        """Groups of like classes, none of more than GROUP_CLASSES: the larger classes choose first."""
        _, middle = k_means(centres, np.sqrt(size), GROUPS, rounds)
        like, room, group = centres @ middle.T - 0.5 * (middle**2).sum(1), np.full(GROUPS, GROUP_CLASSES), np.zeros(CLASSES, np.int64)
        for c in np.argsort(-size, kind="stable").tolist():
            g = int(np.argmax(np.where(room > 0, like[c], -np.inf)))
            group[c], room[g] = g, room[g] - 1
        return group

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target class's probability from its vector. Targets are taken group by group."""
        p, out, group = self.p, np.empty(len(h), h.dtype), self.group[target].astype(np.uint8)
        order = np.argsort(group, kind="stable")
        at = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
        h, target, done = h[order], target[order], np.empty(len(h), h.dtype)
        z = _logits(h, p["U"], p["b"])
        own = z[np.arange(len(z)), group[order]]
        done[:] = own - _log_sum(z)
        for g in range(GROUPS):
            i, j, first = at[g], at[g + 1], self.first[g]
            if i < j:
                z = _logits(h[i:j], self.leaves[g][0], self.leaves[g][1])
                own = z[np.arange(j - i), target[i:j] - first]
                done[i:j] += own - _log_sum(z)
        out[order] = done
        return out

    def gradients(self, rows: np.ndarray, target: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the used positions, and its gradients, in the precision of the weights.

        Logits are kept under 60, as in scoring. Positions are taken group by group.
        """
        p, shape, scale = self.p, rows.shape, 1 / math.sqrt(WIDTH)
        both = np.concatenate([p["Q"] * p["Q"].dtype.type(scale), p["K"], p["V"]], axis=1)
        x = (p["E"][rows] + p["P"]).reshape(-1, WIDTH)
        qkv = (x @ both).reshape(*shape, 3 * WIDTH)
        q, k, v = (qkv[..., i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        a = q @ k.transpose(0, 2, 1)
        a += _MASK.astype(a.dtype)
        np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a /= (a.reshape(-1, shape[1]) @ np.ones(shape[1], a.dtype)).reshape(*shape, 1)
        av = (a @ v).reshape(-1, WIDTH)
        where = np.flatnonzero(use.ravel())
        group = self.group[target.ravel()[where]].astype(np.uint8)
        order = np.argsort(group, kind="stable")
        where, group = where[order], group[order]
        t, at, n = target.ravel()[where], np.searchsorted(group, np.arange(GROUPS + 1)).tolist(), max(1, len(where))
        h = (x + av @ p["O"])[where]

        def softmax(h, weights, bias, own):
            """The loss of the own outputs, and the gradient of each logit."""
            z = _logits(h, weights, bias)
            every = np.arange(len(z))
            loss = -z[every, own].sum(dtype=np.float64)
            np.exp(z, out=z)
            sums = z @ np.ones(z.shape[1], z.dtype)
            z /= sums[:, None]
            z[every, own] -= 1
            z /= n
            return loss + np.log(sums).sum(dtype=np.float64), z

        loss, z = softmax(h, p["U"], p["b"], group)
        g = {"U": h.T @ z, "b": z.sum(0), "W": np.zeros_like(p["W"]), "c": np.zeros_like(p["c"])}
        dh_used = z @ p["U"].T
        for i, j, first, last in zip(at, at[1:], self.first.tolist(), self.first[1:].tolist()):
            if i < j:
                more, z = softmax(h[i:j], p["W"][:, first:last], p["c"][first:last], t[i:j] - first)
                loss += more
                g["W"][:, first:last], g["c"][first:last] = h[i:j].T @ z, z.sum(0)
                dh_used[i:j] += z @ p["W"][:, first:last].T
        dx = np.zeros_like(x)
        dx[where] = dh_used
        g["O"] = av.T @ dx
        dav = dx @ p["O"].T
        ds = dav.reshape(*shape, WIDTH) @ v.transpose(0, 2, 1)
        ds -= np.einsum("ij,ij->i", dav, av).reshape(*shape, 1)
        ds *= a
        back = (ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dav.reshape(*shape, WIDTH))
        d = np.concatenate(back, axis=2).reshape(-1, 3 * WIDTH)
        g["Q"], g["K"], g["V"] = np.split(x.T @ d, 3, axis=1)
        g["Q"] = g["Q"] * g["Q"].dtype.type(scale)
        dx += d @ both.T
        g["P"] = dx.reshape(*shape, WIDTH).sum(0)
        g["E"] = np.zeros_like(p["E"])
        order = np.argsort(rows.ravel().astype(np.uint16), kind="stable")
        own = rows.ravel()[order]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        g["E"][own[at]] = np.add.reduceat(dx[order], at)
        return loss / n, g

    def fit(self, drawn: np.ndarray, steps: int = STEPS, seed: int = 0) -> list[float]:
        """Adam over random batches of drawn windows; the losses."""
        rng, losses = np.random.default_rng(seed), []
        if not len(drawn):
            return losses
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        row = np.append(self.row, np.full(NONE + 1 - len(self.row), self.start))
        step = Adam(self)
        for t in range(1, steps + 1):
            pick = drawn[rng.integers(0, len(drawn), BATCH)]
            target = pick[:, 1:]
            use = (target != NONE) & (np.arange(WINDOW) >= CONTEXT)
            loss, g = self.gradients(row[pick[:, :-1]], self.cls[np.where(use, target, 0)], use)
            losses.append(loss)
            step(g, 0.02 * min(1, t / 20) * (1 - 0.9 * t / steps))
        return losses

    def learn(self, texts, seed: int = 0) -> int:
        """Goes once through all windows of encoded texts, an iterable of ids and lengths; the number of windows.

        Each id is a target once. Windows are mixed within PASS_MIX of them.
        """
        rng, step, done, held, n_held = np.random.default_rng(seed), Adam(self), 0, [], 0

        def steps():
            rows, target, use = (np.concatenate(x) for x in zip(*held))
            order = rng.permutation(len(rows))
            for at in range(0, len(order), PASS_BATCH):
                pick = order[at : at + PASS_BATCH]
                step(self.gradients(rows[pick], self.cls[target[pick]], use[pick])[1], PASS_RATE * len(pick) / PASS_BATCH)
            return len(order)

        for ids, lengths in texts:
            held.append(self._cut(ids, lengths, WINDOW, 0)[:3])
            n_held += len(held[-1][0])
            if n_held >= PASS_MIX:
                done, held, n_held = done + steps(), [], 0
        return done + (steps() if n_held else 0)

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows, target ids and scored positions of all windows of the texts."""
        got = [self._cut(np.concatenate(texts), np.array([len(x) for x in texts]))] if texts else []
        return got[0][:3] if got else (np.zeros((0, WINDOW), np.int64),) * 3

    def _cut(self, ids: np.ndarray, lengths: np.ndarray, stride: int = WINDOW - CONTEXT, lead: int = CONTEXT):
        n = -(-lengths // stride)
        text = np.repeat(np.arange(len(lengths)), n)
        first = np.cumsum(lengths) - lengths
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = (k * stride - lead)[:, None] + np.arange(WINDOW)
        inside = (at >= 0) & (at < lengths[text][:, None])
        place = np.clip(first[text][:, None] + at, 0, max(0, len(ids) - 1))
        before = (at >= 1) & (at <= lengths[text][:, None])
        rows = np.where(before, self.row[ids[np.clip(place - 1, 0, None)]], self.start)
        use = inside & (np.arange(WINDOW) >= lead)
        return rows, ids[place], use, text

    def freeze(self) -> None:
        """Tables for scoring in single precision: what is linear in an id's embedding is looked up."""
        p = self.p
        both = np.concatenate([p["Q"] / math.sqrt(WIDTH), p["K"], p["V"] @ p["O"]], axis=1)
        self.t_qkv, self.t_pos = (p["E"] @ both).astype(np.float32), (p["P"] @ both).astype(np.float32)
        self.row, self.cls, self.group = (x.astype(np.int32) for x in (self.row, self.cls, self.group))
        self.p = {k: p[k].astype(np.float32) for k in ("E", "P", "U", "b", "W", "c")}
        cuts = [slice(i, j) for i, j in zip(self.first.tolist(), self.first[1:].tolist())]
        self.leaves = [(np.ascontiguousarray(self.p["W"][:, x]), self.p["c"][x]) for x in cuts]

    def score(self, ids: np.ndarray, lengths: np.ndarray, chunk: int = 512) -> np.ndarray:
        """log10 probability of each text; each id is scored in one window."""
        rows, target, use, text = self._cut(ids, lengths)
        out, mask = np.zeros(len(text)), _MASK[CONTEXT:].astype(np.float32)
        for i in range(0, len(rows), chunk):
            r, used = rows[i : i + chunk], use[i : i + chunk, CONTEXT:]
            x = self.t_qkv[r]
            x += self.t_pos
            s = x[:, CONTEXT:, :WIDTH] @ x[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
            s += mask
            np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            h = s @ x[..., 2 * WIDTH :]
            h /= (s.reshape(-1, WINDOW) @ _ONES).reshape(*s.shape[:2], 1)
            h += self.p["E"][r[:, CONTEXT:]]
            h += self.p["P"][CONTEXT:]
            t = target[i : i + chunk, CONTEXT:][used]
            logp = np.zeros(used.shape)
            logp[used] = self.log_probabilities(h[used], self.cls[t]) + self.log_share[t]
            out[i : i + chunk] = logp.sum(1)
        return np.bincount(text, out, len(lengths)) / math.log(10)


class Adam:
    """Steps of a model's weights down their gradients."""

    def __init__(self, model: AttentionModel):
        self.model, self.t = model, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def __call__(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        m, s, p = self.m, self.s, self.model.p
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.98 * s[k] + 0.02 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**self.t)) / (np.sqrt(s[k] / (1 - 0.98**self.t)) + 1e-8)


def _logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = h @ weights
    z += bias
    return np.minimum(z, 60, out=z)


def _log_sum(z: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of each row; ``z`` is used up. Logits are kept under 60, which single precision can sum."""
    np.exp(z, out=z)
    return np.log(z @ np.ones(z.shape[1], z.dtype))


_MASK = np.where(np.tri(WINDOW, dtype=bool), 0.0, -1e9)


_ONES = np.ones(WINDOW, np.float32)


def neighbour_table(counts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """How often each of the NEAR most frequent ids, or any other, stands before and after an id in the windows."""
    a, b = windows[:, :-1].ravel().astype(np.int64), windows[:, 1:].ravel().astype(np.int64)
    both = (a != NONE) & (b != NONE)
    return _beside(near_places(counts), a[both], b[both], len(counts))


def near_places(counts: np.ndarray) -> np.ndarray:
    """The number of each id among the NEAR most frequent, from 1; 0 for others."""
    place = np.zeros(NONE + 1, np.int64)
    place[np.argsort(-counts, kind="stable")[:NEAR]] = np.arange(1, min(NEAR, len(counts)) + 1)
    return place


def _beside(place: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Adds the neighbours of pairs to a table; one side's counts at a time, so that one half of a table more is held."""
    cells = NEAR + 1
    sums = np.zeros((size, 2 * cells), np.int64) if sums is None else sums
    sums[:, :cells] += np.bincount(b * cells + place[a], minlength=size * cells).reshape(size, cells)
    sums[:, cells:] += np.bincount(a * cells + place[b], minlength=size * cells).reshape(size, cells)
    return sums


def ids_of(batches, room: int = 1_000_000):
    """All ids and each text's number of ids, of texts of about ``room`` ids at a time; batches have the ids' bytes."""
    held, left = [], room
    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(x)
            left -= len(x) // 2
            if left <= 0:
                yield np.frombuffer(b"".join(held), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in held], np.int64)
                held, left = [], room
    if held:
        yield np.frombuffer(b"".join(held), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in held], np.int64)


def neighbours(ids: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The neighbour table of all encoded texts. Few tasks add up large shares, so that few cells are shuffled."""
    place, size = near_places(counts), len(counts)

    def run(batches):
        worker_state(None)
        sums = np.zeros((size, 2 * (NEAR + 1)), np.int64)
        for flat, lengths in ids_of(batches):
            same = np.ones(len(flat), bool)
            same[np.cumsum(lengths)[:-1]] = False
            same = np.flatnonzero(same[1:])
            _beside(place, flat[same], flat[same + 1], size, sums)
        sums = sums.ravel()
        at = np.flatnonzero(sums)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(sums[at[i : i + 100_000]])], ["cell", "n"])

    parts = ids.rdd.getNumPartitions()
    few = ids.coalesce(max(1, min(parts, max(ids.sparkSession.sparkContext.defaultParallelism, parts // 8))))
    got = few.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * 2 * (NEAR + 1), np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, -1)


def train(model: AttentionModel, ids: DataFrame) -> int:
    """Trains a model on all windows of all encoded texts: the mean of the tasks' weights, by windows. Their number."""
    names = list(model.p)
    weights = lambda m: np.concatenate([m.p[k].ravel() for k in names]).astype(np.float64)
    shared = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark import TaskContext

        worker_state(None)
        hold_memory()
        own = copy.copy(shared.value)
        own.p = {k: x.astype(np.float32) for k, x in own.p.items()}
        done = own.learn(ids_of(batches, 250_000), TaskContext.get().partitionId())
        if done:
            flat = weights(own) - weights(shared.value)
            whole = np.append(np.rint(flat * (done / UNIT)).astype(np.int64), done)
            for i in range(0, len(whole), 100_000):
                part = whole[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part)], ["place", "n"])

    start = weights(model)
    got = ids.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    if not len(got):
        return 0
    sums = np.zeros(len(start) + 1, np.int64)
    sums[got["place"].to_numpy()] = got["n"].to_numpy()
    flat, at = start + sums[:-1] * (UNIT / sums[-1]), 0
    for k in names:
        shape, n = model.p[k].shape, model.p[k].size
        model.p[k] = flat[at : at + n].reshape(shape)
        at += n
    return int(sums[-1])


def draw_places(n_words: int, mark: int, share: float) -> list[int]:
    """The words of a text at which windows begin, drawn by a hash of the text's mark and the word's place."""
    k = np.arange(n_words // STRIDE_WORDS + 1, dtype=np.uint64)
    if share < 1:
        h = np.uint64(mark & (1 << 64) - 1) + k * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        k = k[(h ^ h >> np.uint64(31)) < np.uint64(min(share * 2.0**64, 2.0**64 - 2048))]
    return (k.astype(np.int64) * STRIDE_WORDS).tolist()


def draw_windows(data: bytes, places: list[int], encode) -> list[np.ndarray]:
    """Windows of a text, each the ids from some word on with the id before."""
    words, out = data.split() if places else [], []
    for at in places:
        part = words[at : at + WINDOW + 1]
        ids = encode([b" ".join(part)])[0]
        if at + len(part) < len(words):
            ids = ids[:-1]  # the text goes on: no end id here
        if not at:  # the text's beginning is scored from its first id on
            ids = np.append(np.full(CONTEXT + 1, NONE), ids)
        out.append(np.append(ids, np.full(WINDOW + 1, NONE))[: WINDOW + 1].astype(np.uint16))
    return out


def batches_of(data: list[bytes], room: int = 400_000):
    """Slices of a batch's texts of about ``room`` bytes."""
    i = 0
    while i < len(data):
        j, left = i, room
        while j < len(data) and (j == i or left > 0):
            left -= len(data[j])
            j += 1
        yield i, j
        i = j


def train_share(size: int) -> float:
    """The share of places whose windows the driver starts from, in training texts of so many bytes, at about 6.5 a word."""
    windows = TRAIN_WINDOWS * max(1.0, size / TRAIN_BYTES) ** (1 / 3)
    return min(1.0, windows * STRIDE_WORDS * 6.5 / max(size, 1))


GATHERED = "word binary, n long, drawn binary"


def gather(training: DataFrame, tokenizer: str, limit: int = 300_000) -> DataFrame:
    """Word counts, each task adding up in a table of at most about ``limit`` words, and drawn windows (null words)."""
    size = training.agg(F.sum(F.octet_length(text_bytes()))).first()[0] or 0
    share = train_share(size)

    def row(words, n, drawn):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(drawn, pa.binary())], ["word", "n", "drawn"])

    def run(batches):
        encode, held = worker_encoder(tokenizer).encode_batch, Counter()
        for batch in batches:
            drawn: list = []
            for b, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = b.lower().split()
                held.update(words)
                drawn += draw_windows(b, draw_places(len(words), mark, share), encode)
                if len(held) >= limit:
                    yield row(list(held), list(held.values()), [None] * len(held))
                    held.clear()
            if drawn:
                yield row([None], [len(drawn)], [b"".join(x.tobytes() for x in drawn)])
        if held:
            yield row(list(held), list(held.values()), [None] * len(held))

    return training.select(text_bytes().alias("data"), F.xxhash64("doc_id", "text").alias("h")).mapInArrow(run, GATHERED)


def subword_counts(counts: DataFrame, tokenizer: str) -> np.ndarray:
    """Occurrences of each subword id in the counted words (end ids apart)."""

    def run(batches):
        encoder, sums = worker_encoder(tokenizer), np.zeros(IDS, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(words), 20_000):
                ids, lengths = encoder.encode_words(words[i : i + 20_000])
                sums += np.bincount(ids, np.repeat(n[i : i + 20_000], lengths), IDS).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["id", "n"])

    out = np.zeros(IDS, np.int64)
    for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def head_of(counts: DataFrame, limit: int = HEAD_WORDS) -> dict[bytes, int]:
    """The words whose counts reach the smallest bound that at most ``limit`` words reach."""
    from pyspark.sql import Window

    sizes = counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).count().withColumn("reach", F.sum("count").over(Window.orderBy(F.desc("c"))))
    bound = sizes.filter(F.col("reach") <= limit).agg(F.min("c").alias("c")).first()["c"]
    return {bytes(r["word"]): r["c"] for r in counts.filter(F.col("c") >= bound).collect()} if bound is not None else {}


TEXT = "doc_id long, train boolean, data binary, ids binary"


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """Texts (doc_id, train, data) with the bytes of their 16-bit ids."""

    def run(batches):
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            data, out = batch.column(2).to_pylist(), []
            for i, j in batches_of(data):
                ids, lengths = encoder.encode_batch(data[i:j])
                raw, ends = ids.astype(np.uint16).tobytes(), (2 * np.cumsum(lengths)).tolist()
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], [x.split(" ")[0] for x in TEXT.split(", ")])

    return texts.select("doc_id", "train", "data").mapInArrow(run, TEXT)


def hold_memory() -> None:
    """Lets glibc keep up to 64 MB of freed memory, so that arrays of a few MB are not mapped anew at each step."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library


ROW = "row long, doc_id long, n_tokens long, known long, logs double, score double, rest array<binary>, times array<long>"


def lm_scores(docs: DataFrame, training: DataFrame | Column, tokenizer: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` are the texts to learn from: a table, or a condition on the documents, which are then encoded once.
    """
    spark = docs.sparkSession
    ship(spark)
    own = isinstance(training, Column)
    texts = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("train") if own else F.lit(False).alias("train"), text_bytes().alias("data"))
    if own:
        training = docs.filter(training)
    gathered = materialize(gather(training, tokenizer), "gathered")
    counts = materialize(gathered.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_docs = training.count()
    n, v = (total["n"] or 0) + n_docs, total["v"] + (n_docs > 0)
    head = head_of(counts, head_words)
    sub = subword_counts(counts, tokenizer)
    sub[END_ID] += n_docs
    drawn = sorted(bytes(r["drawn"]) for r in gathered.filter("word IS NULL").select("drawn").toLocalIterator())
    drawn = np.frombuffer(b"".join(drawn), np.uint16).reshape(-1, WINDOW + 1)
    texts = materialize(encoded(texts, tokenizer), "texts")
    learnt = texts.filter("train") if own else materialize(encoded(training.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("train"), text_bytes().alias("data")), tokenizer).select("ids"), "ids")
    model = AttentionModel(sub)
    model.group_ids(neighbours(learnt.select("ids"), model.counts))
    model.fit(drawn, max(STEPS, len(drawn) // BATCH))
    train(model, learnt.select("ids"))
    model.freeze()
    shared = spark.sparkContext.broadcast((model, head, n_docs))

    def run(batches):
        from pyspark import TaskContext

        worker_state(None)
        hold_memory()
        model, head, ends = shared.value
        at = TaskContext.get().partitionId() << 36
        place = {w: i for i, w in enumerate(head)}
        logs_of, get = np.log10(np.fromiter(head.values(), np.float64, len(head)) + 1), place.get
        for batch in batches:
            names, data, raw = (x.to_pylist() for x in batch.columns)
            for i, j in batches_of(data):
                out = []
                ids, lengths = np.frombuffer(b"".join(raw[i:j]), np.uint16), np.array([len(x) // 2 for x in raw[i:j]], np.int64)
                for name, b in zip(names[i:j], data[i:j]):
                    words = b.lower().split()
                    found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    missing = found < 0
                    rest = Counter(compress(words, missing))
                    known = len(words) - int(missing.sum())
                    logs = float(logs_of[found[~missing]].sum()) + math.log10(ends + 1)
                    out.append((at, name, len(words) + 1, known + (ends > 0), logs, list(rest), list(rest.values())))
                    at += 1
                c = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                cols = [pa.array(x, k) for x, k in zip(c, kinds)]
                cols += [pa.array(model.score(ids.astype(np.int64), lengths)), pa.array(c[5], pa.list_(pa.binary())), pa.array(c[6], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in ROW.split(", ")])

    rows = materialize(texts.select("doc_id", "data", "ids").mapInArrow(run, ROW), "scores")
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("k"))
    found = rest.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_logs"))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)
    return rows.drop("rest", "times").join(found, "row", "left").select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
