"""Removal of repeated 200-byte strings, exact, by sorting a content-defined sample of suffixes.

The sample plays the part of a difference cover: two equal windows of 200 bytes always hold sampled positions at equal
offsets. A position is sampled if its 32-byte hash is the smallest (leftmost among equals) of the 169 that fit into
some window; each window start belongs to the sampled position that its own bytes pick. What is sorted and named is
therefore one sampled suffix for about 65 bytes, not every suffix:

1. sampled suffixes are named by their first 32 bytes; unique names end here;
2. the rest are named again by all bytes that their window starts reach; equal neighbours in that order are repeats,
   and all window starts of both are covered at once;
3. suffixes that share the first name but not the second are cut into ranges of 16 starts and named again (recursion);
4. the starts still open are merged as single windows, and neighbours compared by all 200 bytes.

Names are 64-bit hashes, taken together with the name of the step before (128 bits). Counting is a partial aggregate,
rows meet their counts by joins that adaptive execution can split, copies of a text inside a task are named once, and
texts are shuffled once.

Defined edge cases: a null text is empty; texts under 200 bytes lose nothing; rows that repeat a doc_id are documents
of their own, and equal texts of at least 200 bytes remove each other whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize, ship, text_bytes

LENGTH = 200
GRAM = 32
#: Window starts that share a range in the recursion.
RANGE = 16
#: Window starts that are handled at once in a long text.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


_BYTES = _mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at every position."""
    global _powers
    n = len(data)
    if len(_powers[0]) < n:
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up, down = _powers
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)])
    return _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, from running minima inside blocks of that width."""
    blocks = -(-len(h) // width)
    table = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    table[: len(h)] = h
    table = table.reshape(blocks, width)
    upto = np.minimum.accumulate(table, 1).ravel()
    onward = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    k = len(h) - width + 1
    return np.minimum(onward[:k], upto[width - 1 : width - 1 + k])


def samples(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(x, first, last + 1, name) of the sampled positions: x with the window starts that pick it, and its gram's hash."""
    n, width = len(data), length - gram + 1
    for at in range(0, max(0, n - length + 1), CHUNK):
        part = np.frombuffer(data, np.uint8)[at : at + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        low = window_minima(h, width)
        runs = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])).tolist()
        xs, firsts = [], []
        for a, end in zip(runs, [*runs[1:], len(low)]):
            while a < end:
                x = a + int(h[a : a + width].argmin())
                if not xs or xs[-1] != x:
                    xs.append(x)
                    firsts.append(a)
                a = x + 1
        for x, a, b in zip(xs, firsts, [*firsts[1:], len(low)]):
            yield x + at, a + at, b + at, int(h[x])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _name(data) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data))


def text_key(data: bytes) -> tuple[int, int]:
    return _name(data), len(data)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


_COLS = ["th", "nb", "x", "a", "b", "key", "full"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_ROW = "th long, nb long, x long, a long, b long, key long, full long"


def sampled(docs: DataFrame) -> DataFrame:
    """Sampled suffixes of every text: where (th, nb: the text; x, a, b), first name, second name."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            rows: list = []
            for data in batch.column(0).to_pylist():
                where = text_key(data)
                if len(data) < LENGTH or where in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(where)
                view = memoryview(data)
                for x, a, b, name in samples(data):
                    rows.append((*where, x, a, b, _signed(name), _name(view[a : b - 1 + LENGTH])))
                if len(rows) > 50_000:
                    yield _batch(rows, _COLS, _KINDS)
                    rows = []
            if rows:
                yield _batch(rows, _COLS, _KINDS)

    return docs.select(text_bytes().alias("data")).mapInArrow(run, _ROW)


def _split(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covered ranges (th, nb, a, b), and the ranges still open, by text: one for each name of a class with several names.

    Ranges of one name in different places cover each other. A class is what shares ``key``. ``named`` is used up.
    """
    groups = materialize(named.groupBy("key", "full").agg(F.count("*").alias("c"), F.min(F.struct("th", "nb", "x", "a", "b")).alias("rep")), "names")
    covered = materialize(named.join(groups.filter("c > 1").select("key", "full"), ["key", "full"]).select("th", "nb", "a", "b").distinct(), "covered")
    many = groups.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    open_ = materialize(_by_text(groups.join(many, "key").select("key", "rep.*")), "open")
    drop_tables(named, groups)
    return covered, open_


def _cut(ranges: DataFrame, fine: bool) -> DataFrame:
    """Name the parts of open ranges anew: parts of RANGE starts by their common bytes and all bytes, or single windows."""

    def run(batches):
        for batch in batches:
            rows: list = []
            for th, nb, data, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                view = memoryview(data)
                for r in found:
                    x, a, b = r["x"], r["a"], r["b"]
                    if fine:
                        for s in range(a, b):
                            digest = xxhash.xxh3_128_intdigest(view[s : s + LENGTH])
                            rows.append((th, nb, x, s, s + 1, _signed(digest >> 64), _signed(digest & (1 << 64) - 1)))
                        continue
                    for j in range((x - b + 1) // RANGE, (x - a) // RANGE + 1):
                        lo, hi = max(a, x - RANGE * j - RANGE + 1), min(b, x - RANGE * j + 1)
                        common = xxhash.xxh3_64_intdigest(view[x - RANGE * j : x - RANGE * j - RANGE + 1 + LENGTH], seed=j)
                        rows.append((th, nb, x, lo, hi, _signed(common ^ (r["key"] & (1 << 64) - 1)), _signed(xxhash.xxh3_64_intdigest(view[lo : hi - 1 + LENGTH], seed=x - lo))))
                if len(rows) > 50_000:
                    yield _batch(rows, _COLS, _KINDS)
                    rows = []
            if rows:
                yield _batch(rows, _COLS, _KINDS)

    return ranges.select("th", "nb", "data", "ranges").mapInArrow(run, _ROW)


def _by_text(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("th", "nb").agg(F.collect_list(F.struct("key", "x", "a", "b")).alias("ranges"))


def _runs(covered: DataFrame) -> DataFrame:
    """th, nb, cover: the sorted distinct covered ranges of window starts of each text."""
    once = covered.distinct()
    return once.groupBy("th", "nb").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cover"))


def removed_bytes(n: int, cover: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes under ranges of covered window starts, given in order."""
    out: list[tuple[int, int]] = []
    for a, b in cover:
        end = b - 1 + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return [(a, min(e, n)) for a, e in out]


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, data, th, nb, made in the same worker as the sample's keys."""

    def run(batches):
        for batch in batches:
            keys = [text_key(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in keys], pa.int64()), pa.array([n for _, n in keys], pa.int64())], ["doc_id", "data", "th", "nb"])

    return docs.select("doc_id", text_bytes().alias("data")).mapInArrow(run, "doc_id long, data binary, th long, nb long")


def _finish(texts: DataFrame, keep: bool) -> DataFrame:
    """The result from doc_id, data, whole (the text has a copy) and cover."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, data, whole, cover in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = len(data)
                spans = [(0, n)] if whole and n >= LENGTH else removed_bytes(n, [(c["a"], c["b"]) for c in cover or ()])
                left, at = [], 0
                for a, e in spans:
                    left.append(data[at:a])
                    at = e
                left = b"".join([*left, data[at:]])
                rows.append((doc_id, n, n - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if keep else None))
            yield _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])

    return texts.select("doc_id", "data", "whole", "cover").mapInArrow(run, _OUT)


def remove_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept bytes (null unless ``keep``)."""
    spark = docs.sparkSession
    ship(spark)
    dup = materialize(sampled(docs).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "first-names")
    named = materialize(sampled(docs).join(dup, "key"), "named")
    drop_tables(dup)
    first, ranges = _split(named)
    texts = _keys(docs).join(ranges, ["th", "nb"]).select("th", "nb", "data", "ranges").dropDuplicates(["th", "nb"])
    texts = materialize(texts, "open-texts")
    drop_tables(ranges)
    second, ranges = _split(materialize(_cut(texts, False), "ranges"))
    single = materialize(_cut(texts.drop("ranges").join(ranges, ["th", "nb"]), True), "windows")
    drop_tables(texts, ranges)
    equal = single.groupBy("key", "full").agg(F.count("*").alias("c")).filter("c > 1").select("key", "full")
    third = single.join(equal, ["key", "full"]).select("th", "nb", "a", "b")
    cover = materialize(_runs(first.unionByName(second).unionByName(third)), "cover")
    drop_tables(single, first, second)
    copies = materialize(_keys(docs).groupBy("th", "nb").agg(F.count("*").alias("c")).filter("c > 1").select("th", "nb", F.lit(True).alias("whole")), "copies")
    facts = materialize(cover.join(copies, ["th", "nb"], "full"), "facts")
    drop_tables(cover, copies)
    return _finish(_keys(docs).join(facts, ["th", "nb"], "left"), keep)
