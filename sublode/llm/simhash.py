"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint's bits are split into three segments, and the rest of each segment's complement again into three: two
fingerprints with at most two differing bits agree in a whole segment and in a whole part of the rest. Each of these
nine masked patterns (35 fixed bits) is an upper node of the index; its members, sorted by the Gray rank of their
permuted bits, stand together. Below an upper node the remaining bits are factored into levels of a few bits: members
that share the pattern of a level share a node. Pairs of nodes are walked from the top, the differences of their
patterns are added up, and a pair of groups is dropped as a whole once the sum passes the limit. Fingerprints are
distinct before they are indexed, so copies cost nothing, and each task returns a spanning forest of its links, not
the links.

Defined edge cases: a null or wordless text has fingerprint zero and links like any other; texts under three words are
one shingle; rows that repeat a ``doc_id`` have a fingerprint each; a null ``doc_id`` has a fingerprint and links like
any other, and its component is null only if no member has a doc_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_null_safe, map_rows, marked, materialize, ship, text_bytes, worker_state
from .components import connected

SEED = 42
SHINGLE = 3
MAX_DIFF = 2
#: What the pipeline's near-duplicate stage links: exact similarity over five-word shingles. Candidates are fingerprints
#: of two-word shingles within so many bits; fingerprints of wider shingles differ by more for the same similarity.
NEAR_SHINGLE = 5
NEAR_MARK = 2
NEAR_DIFF = 9
NEAR_JACCARD = 0.8
#: Buckets of the sketches that rule out pairs before texts are compared.
SKETCH = 512
#: How many candidates in other components a text brings from each upper node, round by round; 0: all that are left.
NEAREST = (4, 32, 0)
#: Bits of the levels under an upper node's 35 fixed bits.
LEVELS = (6, 6, 6, 6, 5)
#: Node pairs that are expanded at once.
CHUNK = 300_000
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, as an unsigned integer."""
    words = data.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, SEED) for s in parts])
    table = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(table[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(table)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: fingerprints as signed 64-bit integers."""

    def rows(c: dict) -> dict:
        got = np.array([fingerprint(b, shingle) for b in c["data"]], np.uint64).astype(np.int64)
        return {"doc_id": c["doc_id"], "fp": pa.array(got)}

    ship(docs.sparkSession)
    return map_rows(docs.select("doc_id", text_bytes().alias("data")), rows, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a bit pattern stands in the reflected Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ x >> np.uint64(k)
    return x


def _masks() -> list[list[tuple[int, int]]]:
    """For each upper node kind, the bit ranges (from the top, length) in permuted order; the first two are fixed."""
    segments, out = [(0, 21), (21, 21), (42, 22)], []
    for j, (at, n) in enumerate(segments):
        rest = [b for i, (a, m) in enumerate(segments) if i != j for b in range(a, a + m)]
        sizes = [35 - n, (len(rest) - 35 + n) // 2]
        cuts = [0, sizes[0], sizes[0] + sizes[1], len(rest)]
        for k in range(3):
            part = rest[cuts[k] : cuts[k + 1]]
            other = [b for b in rest if b not in set(part)]
            bits, runs = [*range(at, at + n), *part, *other], []
            for b in bits:
                if runs and b == runs[-1][0] + runs[-1][1]:
                    runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                else:
                    runs.append((b, 1))
            out.append((runs, n + len(part)))
    return out


MASKS = _masks()


def wide_masks(max_diff: int, same: int = 2) -> list[list[tuple[int, int]]]:
    """As ``_masks`` for any limit: of ``max_diff + same`` segments, two fingerprints within it agree in ``same`` whole ones."""
    n = max_diff + same
    cuts, out = [64 * i // n for i in range(n + 1)], []
    for chosen in combinations(range(n), same):
        part = [b for i in chosen for b in range(cuts[i], cuts[i + 1])]
        bits, runs = part + [b for b in range(64) if b not in set(part)], []
        for b in bits:
            if runs and b == runs[-1][0] + runs[-1][1]:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((b, 1))
        out.append((runs, len(part)))
    return out


def permute(fp: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(fp)
    for at, n in runs:
        out = out << np.uint64(n) | fp >> np.uint64(64 - at - n) & np.uint64((1 << n) - 1)
    return out


def unpermute(p: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    out, left = np.zeros_like(p), 64
    for at, n in runs:
        left -= n
        out |= (p >> np.uint64(left) & np.uint64((1 << n) - 1)) << np.uint64(64 - at - n)
    return out


def first_met(fp: np.ndarray, kind: int, masks: list):
    """A test of pairs of members of an upper node: whether no earlier kind of upper node holds both.

    A pair meets under each kind whose fixed bits it shares; only the first returns it.
    """
    fixed = [unpermute(np.array([(1 << 64) - (1 << 64 - n)], np.uint64), runs)[0] for runs, n in masks[:kind]]

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left, x = np.arange(len(a)), fp[a] ^ fp[b]
        for m in fixed:
            keep = x & m != 0
            left, x = left[keep], x[keep]
        out = np.zeros(len(a), bool)
        out[left] = True
        return out

    return test


def index_rows(reps: DataFrame, masks: list = MASKS) -> DataFrame:
    """kind, head, gray, rep: a distinct fingerprint under each of its upper nodes."""

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for kind, (runs, fixed) in enumerate(masks):
                p = permute(fp, runs)
                cols = [pa.array(np.full(len(p), kind, np.int32)), pa.array((p >> np.uint64(64 - fixed)).astype(np.int64)), pa.array(gray_rank(p).view(np.int64)), batch.column(1)]
                yield pa.RecordBatch.from_arrays(cols, ["kind", "head", "gray", "rep"])

    return reps.select("fp", "rep").mapInArrow(run, "kind int, head long, gray long, rep long")


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs that begin where ``change`` holds, with the end appended; and each element's run."""
    return np.append(np.flatnonzero(change), len(change)), np.cumsum(change) - 1


class Forest:
    """Union-find over array slots, a batch of pairs at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            z = self.up[y]
            if (y == z).all():
                return y
            self.up[x] = z
            x = z

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, high, low)


def nearest(a: np.ndarray, b: np.ndarray, diff: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that are among the ``most`` nearest of either member; ties go to the earlier member."""
    own, other, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([diff, diff])
    order = np.lexsort((other, d, own))
    own = own[order]
    at, run = _runs(np.concatenate([[True], own[1:] != own[:-1]]))
    keep = np.zeros(len(a), bool)
    keep[order[np.arange(len(own)) - at[run] < most] % len(a)] = True
    return a[keep], b[keep], diff[keep]


def linked(group: np.ndarray, low: np.ndarray, bits: int, max_diff: int = MAX_DIFF, part: np.ndarray | None = None, pairs: list | None = None, twins: bool = False, most: int = 0, may=None) -> np.ndarray:
    """Forest roots of members sorted by (group, Gray rank); ``low`` holds their free bits, ``bits`` of them.

    Nodes of each level are runs of members that share a group and the free bits down to that level. With ``pairs``,
    linked pairs of members of different ``part`` are added to it as well: all, or with ``most`` those nearest to either
    member, and only those that ``may`` keeps; nodes whose members are all of one part are then not walked against each
    other. With ``twins``, members may be equal.
    """
    n = len(group)
    forest, change = Forest(n), np.concatenate([[True], group[1:] != group[:-1]])
    starts, levels, left = [_runs(change)[0]], [], bits
    while left:
        step = min(LEVELS[len(levels)] if len(levels) < len(LEVELS) else 6, left)
        left -= step
        head = low >> np.uint64(left)
        change = change | np.concatenate([[True], head[1:] != head[:-1]])
        at, _ = _runs(change)
        starts.append(at)
        levels.append((head[at[:-1]] & np.uint64((1 << step) - 1)).astype(np.uint8))
    if twins:  # a last level of no bits, where each member stands alone
        starts.append(np.arange(n + 1))
        levels.append(np.zeros(n, np.uint8))
    mixed = np.int64(-1)
    alone = None  # by level, the part of each node's members, or -1 if there are several
    if pairs is not None:
        number = np.unique(part, return_inverse=True)[1]
        ends = [(np.minimum.reduceat(number, at[:-1]), np.maximum.reduceat(number, at[:-1])) for at in starts]
        alone = [np.where(x == y, x, mixed) for x, y in ends]
    # first child of each node, by level: children are the nodes of the next level that start inside it
    first = [np.searchsorted(starts[k + 1], starts[k]) for k in range(len(levels))]
    top = np.flatnonzero((np.diff(starts[0]) > 1) & (alone is None or alone[0] < 0))
    found, n_found = [], 0
    stack = [(0, top, top, np.zeros(len(top), np.uint8))]
    while stack:
        k, a, b, diff = stack.pop()
        if k == len(levels):
            at = starts[k]
            if pairs is None:
                forest.join(at[a], at[b])
                continue
            if may is not None:
                fit = may(at[a], at[b])
                a, b, diff = a[fit], b[fit], diff[fit]
            found.append((at[a], at[b], diff))
            n_found += len(a)
            if most and n_found > CHUNK:
                found = [nearest(*(np.concatenate(x) for x in zip(*found)), most)]
                n_found = len(found[0][0])
            continue
        na, nb = first[k][a + 1] - first[k][a], first[k][b + 1] - first[k][b]
        made = np.cumsum(na * nb)
        if len(made) > 1 and made[-1] > CHUNK:
            cut = max(1, int(np.searchsorted(made, CHUNK)))
            cut = min(cut, len(made) - 1)
            stack.append((k, a[cut:], b[cut:], diff[cut:]))
            a, b, diff, na, nb = a[:cut], b[:cut], diff[:cut], na[:cut], nb[:cut]
        size = na * nb
        pair = np.repeat(np.arange(len(a)), size)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        ca, cb = first[k][a][pair] + inside // nb[pair], first[k][b][pair] + inside % nb[pair]
        keep = ca <= cb
        pair, ca, cb = pair[keep], ca[keep], cb[keep]
        d = diff[pair] + np.bitwise_count(levels[k][ca] ^ levels[k][cb])
        keep = d <= max_diff
        if k == len(levels) - 1:
            keep &= ca != cb
        else:  # a leaf alone has no pair with itself
            keep &= (ca != cb) | (starts[k + 1][ca + 1] - starts[k + 1][ca] > 1)
        if alone is not None:
            keep &= (alone[k + 1][ca] < 0) | (alone[k + 1][ca] != alone[k + 1][cb])
        stack.append((k + 1, ca[keep], cb[keep], d[keep]))
    if found:
        every = tuple(np.concatenate(x) for x in zip(*found))
        pairs.append((nearest(*every, most) if most and len(every[0]) else every)[:2])
    return forest.roots(np.arange(n))


def sketch(data: bytes, shingle: int) -> tuple[bytes, int]:
    """A bit for each of SKETCH buckets that holds a shingle of a text, and the number of its distinct shingles."""
    every, bits = shingles(data, shingle), np.zeros(SKETCH, bool)
    bits[[xxhash.xxh64_intdigest(b" ".join(x)) % SKETCH for x in every]] = True
    return np.packbits(bits).tobytes(), len(every)


def possible(sketches: np.ndarray, size: np.ndarray, least: float):
    """A test of pairs of members: whether their Jaccard similarity can be ``least``.

    Common shingles fall into common buckets; beyond one for each of these, there are no more than either has shingles
    that share a bucket.
    """
    extra = size - np.bitwise_count(sketches).sum(1, dtype=np.int64)

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = np.bitwise_count(sketches[a] & sketches[b]).sum(1, dtype=np.int64) + np.minimum(extra[a], extra[b])
        common = np.minimum(common, np.minimum(size[a], size[b]))
        return common >= least * (size[a] + size[b] - common) - 1e-9

    return test


def both(first, second):
    """A test of pairs that two tests keep; the second sees only what the first has kept."""

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = first(a, b)
        at = np.flatnonzero(out)
        out[at] = second(a[at], b[at])
        return out

    return test


def index_links(rows: DataFrame, max_diff: int = MAX_DIFF, masks: list = MASKS, whole: bool = False, twins: bool = False, most: int = 0, least: float = 0.0) -> DataFrame:
    """a, b: spanning forests of the links below each upper node. Tasks hold whole upper nodes, a block at a time.

    With ``whole``, links between members of a different ``part`` instead, each once: all, or with ``most`` only those
    nearest to either member in each upper node. Rows then have part, sketch and size too, and pairs whose sketches rule
    out a similarity of ``least`` are dropped.
    """
    names = ["kind", "head", "gray", "rep"] + ["part", "sketch", "size"] * whole

    def run(batches):
        def solve(kind, head, gray, rep, part=None, sketch=None, size=None):
            p = gray ^ gray >> np.uint64(1)
            for k in np.unique(kind):
                own = np.flatnonzero(kind == k)
                free = 64 - masks[k][1]
                group = np.cumsum(np.concatenate([[0], head[own][1:] != head[own][:-1]]))
                pairs: list | None = [] if whole else None
                may = both(first_met(unpermute(p[own], masks[k][0]), k, masks), possible(sketch[own], size[own], least)) if whole else None
                root = linked(group, p[own] & np.uint64((1 << free) - 1), free, max_diff, part[own] if whole else None, pairs, twins, most, may)
                if whole:
                    for a, b in pairs:
                        yield pa.RecordBatch.from_arrays([pa.array(rep[own][np.minimum(a, b)]), pa.array(rep[own][np.maximum(a, b)])], ["a", "b"])
                    continue
                far = np.flatnonzero(root != np.arange(len(own)))
                if len(far):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[own][root[far]]), pa.array(rep[own][far])], ["a", "b"])

        ready, held, size, last = [], [], 0, None  # whole upper nodes, and the batches of the one not ended
        for batch in batches:
            cols = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64), *(np.asarray(c) for c in batch.columns[3:5])]
            if whole:
                cols += [np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(batch.num_rows, -1), np.asarray(batch.column(6))]
            if not len(cols[0]):
                continue
            new = np.concatenate([[last is not None and last != (cols[0][0], cols[1][0])], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            edge, last = np.flatnonzero(new), (cols[0][-1], cols[1][-1])
            if len(edge):
                ready, held = ready + held + [[c[: edge[-1]] for c in cols]], [[c[edge[-1] :] for c in cols]]
            else:
                held.append(cols)
            size += len(cols[0])
            if ready and size >= 50_000:
                yield from solve(*(np.concatenate(x) for x in zip(*ready)))
                ready, size = [], 0
        if ready or held:
            yield from solve(*(np.concatenate(x) for x in zip(*ready, *held)))

    dealt = rows.select(*names).repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "kind", "head")
    return dealt.sortWithinPartitions("kind", "head", "gray").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_diff: int = MAX_DIFF) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that is reachable over links of at most ``max_diff`` bits."""
    if not 0 <= max_diff <= 2:
        raise ValueError("the index finds links of at most 2 differing bits")
    marks = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "representatives")
    links = materialize(index_links(index_rows(reps.select("fp", F.col("fp").alias("rep"))), max_diff).distinct(), "links")
    node = reps.join(connected(links).withColumnRenamed("rep", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("node"))
    node = materialize(node, "nodes")
    of = node.join(node.groupBy("node").agg(F.min("least").alias("component_id")), "node").select("fp", "component_id")
    return marks.join(of, "fp").select("doc_id", "fp", "component_id")


def hex16(fp):
    """A signed fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_diff: int = MAX_DIFF) -> DataFrame:
    """The documents that are the smallest of their component; of rows that repeat a doc_id all stay."""
    found = near_duplicates(docs, shingle, max_diff)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return join_null_safe(docs, keep, "doc_id").select(*docs.columns)


def shingles(data: bytes, shingle: int) -> set:
    """The distinct word shingles of a text; all its words as one where they are fewer."""
    w = data.lower().split()
    return set(zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else {tuple(w)}


def jaccard(x: bytes, y: bytes, shingle: int) -> float:
    """Jaccard similarity of two texts' sets of word shingles; wordless texts are alike."""
    a, b = shingles(x, shingle), shingles(y, shingle)
    return len(a & b) / len(a | b)


def checked(links: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The links a, b whose texts (key, data) are at least so similar."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.filter(pa.array([jaccard(u, v, shingle) >= least for u, v in zip(x, y)], pa.bool_())).select(["a", "b"])

    links = materialize(links, "pairs")
    keys = links.select(F.col("a").alias("text_key")).union(links.select(F.col("b").alias("text_key")))
    texts = marked(texts, keys, F.col("key"), "_met").filter("_met")  # others need not be shuffled
    a, b = (texts.select(F.col("key").alias(k), F.col("data").alias(f"text_{k}")) for k in "ab")
    return links.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def likely(links: DataFrame, outlines: DataFrame, least: float) -> DataFrame:
    """The links a, b that the sketches of both (rep, sketch, size) do not rule out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in ("sketch_a", "sketch_b"))
                test = possible(np.concatenate([one, two]), np.concatenate([np.asarray(batch.column("size_a")), np.asarray(batch.column("size_b"))]), least)
                at = np.arange(batch.num_rows)
                yield batch.filter(pa.array(test(at, at + batch.num_rows))).select(["a", "b"])

    a, b = (outlines.select(F.col("rep").alias(k), F.col("sketch").alias(f"sketch_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    return links.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, shingle: int = NEAR_SHINGLE, mark: int = NEAR_MARK, max_diff: int = NEAR_DIFF, least: float = NEAR_JACCARD) -> DataFrame:
    """doc_id, key (of the text), fp, component_id (the component's smallest doc_id), stays (whether the row may stand for it).

    Links join texts whose Jaccard similarity is ``least`` or more: all those whose fingerprints (of ``mark``-word
    shingles) differ by at most ``max_diff`` bits, and those met at the ends of a chain of such. Each distinct text is
    a node. The index's spanning forests are checked first, then each text's nearest few candidates in other
    components, then more of them, and at last every candidate between what is still apart: none is missed, and a large
    group, once it is one component, yields no more pairs. A candidate is left over by a round only where both its texts
    have brought as many as the round takes, so the next round holds only such texts.
    """
    masks = wide_masks(max_diff)

    def rows(c: dict) -> dict:
        worker_state(None)
        got = np.array([fingerprint(b, mark) for b in c["data"]], np.uint64).astype(np.int64)
        return {"doc_id": c["doc_id"], "key": c["key"], "fp": pa.array(got), "data": c["data"]}

    ship(docs.sparkSession)
    data = docs.select("doc_id", text_bytes().alias("data")).withColumn("key", F.xxhash64("data"))
    marks = materialize(map_rows(data, rows, "doc_id long, key long, fp long, data binary"), "fingerprints")
    reps = materialize(marks.groupBy("key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least")), "representatives")
    candidates = materialize(index_links(index_rows(reps.withColumn("rep", F.col("key")), masks), max_diff, masks, twins=True).distinct(), "candidates")
    near = candidates.select(F.col("a").alias("key")).union(candidates.select(F.col("b").alias("key"))).distinct()
    texts = materialize(marks.join(near, "key", "left_semi").groupBy("key").agg(F.min("data").alias("data")), "texts")

    def outlines(c: dict) -> dict:
        got = [sketch(b, shingle) for b in c["data"]]
        return {"rep": c["key"], "sketch": [x for x, _ in got], "size": [n for _, n in got]}

    some = reps.join(near, "key", "left_semi").select("fp", F.col("key").alias("rep"))
    outline = map_rows(texts.select("key", "data"), outlines, "rep long, sketch binary, size long")
    some = materialize(some.join(outline, "rep"), "members")
    index = materialize(index_rows(some, masks), "index")
    links = materialize(checked(likely(candidates, some, least), texts, shingle, least), "links")
    found = connected(links).withColumnRenamed("rep", "key")
    for most in NEAREST:
        part = some.select("rep", "sketch", "size").join(found.withColumnRenamed("key", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("part"), "sketch", "size")
        met = materialize(index_links(index.join(part, "rep"), max_diff, masks, whole=True, twins=True, most=most, least=least), "met")
        more = materialize(checked(met.join(candidates, ["a", "b"], "left_anti"), texts, shingle, least), "links")
        if not more.isEmpty():
            links = links.union(more)
            found = connected(links).withColumnRenamed("rep", "key")
        if not most:
            break
        brought = met.select(F.col("a").alias("rep")).union(met.select(F.col("b").alias("rep"))).groupBy("rep").count().filter(F.col("count") >= most)
        some = materialize(some.join(brought.select("rep"), "rep", "left_semi"), "members")
        if some.isEmpty():
            break
        index, candidates = index_rows(some, masks), candidates.union(met)
    node = materialize(reps.join(found, "key", "left").select("key", "least", F.coalesce("component", "key").alias("node")), "nodes")
    first = F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("first")  # a null doc_id comes last
    of = node.join(node.groupBy("node").agg(first), "node").select("key", F.col("first.least").alias("component_id"), (F.col("key") == F.col("first.key")).alias("_own"))
    stays = F.col("_own") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return marks.select("doc_id", "key", "fp").join(of, "key").select("doc_id", "key", "fp", "component_id", stays.alias("stays"))


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """One row of each similarity component: of its smallest doc_id, of one text and row where that repeats.

    Only what goes is joined back, by doc_id and text, with the rows that a bitmap of those texts marks; rows that are
    alike in both are numbered.
    """
    found = materialize(similar_components(docs).groupBy("doc_id", "key", "stays").agg(F.count("*").alias("n")), "found")
    key = F.xxhash64(text_bytes())
    match = F.col("_given.doc_id").eqNullSafe(F.col("_found.doc_id")) & (key == F.col("_found.key"))
    gone, name = found.filter("NOT stays"), f"_hit_{uuid.uuid4().hex}"
    every = marked(docs, gone.select(F.col("key").alias("text_key")), key, name)
    out = every.filter(name).alias("_given").join(gone.alias("_found"), match, "left_anti")
    out = every.filter(~F.col(name)).unionByName(out).select(*docs.columns)
    again = found.filter("stays AND n > 1")
    if again.isEmpty():
        return out
    out = out.alias("_given")
    alike = out.join(again.alias("_found"), match, "left_semi")
    one = Window.partitionBy("doc_id", key).orderBy(key)
    name = f"_row_{uuid.uuid4().hex}"
    return out.join(again.alias("_found"), match, "left_anti").unionByName(alike.withColumn(name, F.row_number().over(one)).filter(F.col(name) == 1).drop(name))
