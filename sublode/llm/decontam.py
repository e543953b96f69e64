"""Benchmark decontamination with a positional inverted index that is stored shard by shard.

Training texts are tokenised once and every word's positions are written to shared storage, one index shard for each
few hundred documents, with the shard's own word list. The benchmark is taken in blocks of a bounded number of words,
each broadcast and searched in the stored shards. A shard answers all phrases of a block at once: a phrase's rarest term there
gives its candidate places, and the offset-adjusted lists of its other terms are intersected with them, rarest first;
phrases with a term that the shard does not have cost one look-up. The same lists answer proximity questions, where a
share of the terms must lie near their offsets.

Defined edge cases: a null or wordless text has no words; a null or wordless item has no window; equal windows of
several items are looked up once and credited to each; an item_id that occurs twice is one item with the windows of
both rows; a null item_id is ignored; documents keep one row each, also where a doc_id is null or repeats, however
many blocks the benchmark takes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, ship, text_bytes, worker_state

WINDOW = 10
#: Benchmark words that are broadcast at once; larger benchmarks are searched block by block.
BLOCK_WORDS = 500_000
#: Words of training text in one index shard, and documents, at most (a longer document is a shard alone).
SHARD_WORDS = 300_000
SHARD_DOCS = 2_000
#: Candidate places that are intersected at once.
CHUNK = 1 << 20
SHARD = "shard long, doc_ids binary, digests binary, nulls binary, starts binary, n_words binary, words binary, offsets binary, postings binary"

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters, digits and non-ASCII characters, A-Z lowered."""
    return data.translate(_TABLE).split()


class Windows:
    """The windows of one benchmark block: arrays of term numbers by window length, and the items of each window."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = WINDOW):
        terms: dict[bytes, int] = {}
        self.width = width
        found: dict[tuple, set] = {}
        for item, data in items:
            ids = [terms.setdefault(w, len(terms)) for w in words_of(data)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.terms = list(terms)
        self.rows: dict[int, np.ndarray] = {}
        self.items: dict[int, list] = {}
        for size in sorted({len(w) for w in found}):
            own = [(w, sorted(x, key=str)) for w, x in found.items() if len(w) == size]
            self.rows[size] = np.array([w for w, _ in own], np.int64)
            self.items[size] = [x for _, x in own]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, width: int = WINDOW):
    """The benchmark as Windows of bounded size; items come to the driver one partition at a time."""
    held, n = [], 0
    rows = benchmark.select("item_id", text_bytes().alias("data")).filter(F.col("item_id").isNotNull())
    for r in rows.toLocalIterator():
        held.append((r["item_id"], bytes(r["data"])))
        n += len(r["data"]) // 2 + 1
        if n >= 4 * block_words:
            yield Windows(held, width)
            held, n = [], 0
    if held:
        yield Windows(held, width)


def make_shard(shard: int, doc_ids: list, texts: list[bytes], gap: int) -> dict:
    """One index shard: the documents' places on one line of positions, its words, and each word's sorted postings on the line."""
    number: defaultdict = defaultdict(count().__next__)
    ids, starts, counts, at = [], [], [], 0
    get = number.__getitem__
    for data in texts:
        words = words_of(data)
        ids.append(np.fromiter(map(get, words), np.int32, len(words)))
        starts.append(at)
        counts.append(len(words))
        at += len(words) + gap
    pos = np.concatenate([np.arange(n, dtype=np.int32) + s for n, s in zip(counts, starts)]).astype(np.int32)
    term = np.concatenate(ids)
    order = np.argsort(term, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(term, minlength=len(number))))
    return {
        "shard": shard, "doc_ids": np.array([-1 if d is None else d for d in doc_ids], np.int64).tobytes(),
        "digests": b"".join([hashlib.md5(x).digest() for x in texts]), "nulls": np.array([d is None for d in doc_ids], bool).tobytes(), "starts": np.array(starts, np.int64).tobytes(), "n_words": np.array(counts, np.int64).tobytes(),
        "words": b" ".join(number), "offsets": offsets.astype(np.int64).tobytes(), "postings": pos[order].tobytes(),
    }


def build_index(docs: DataFrame, gap: int = WINDOW) -> DataFrame:
    """The index shards of a table of documents."""

    def run(batches):
        from pyspark import TaskContext

        worker_state(None)
        numbers = count(TaskContext.get().partitionId() << 32)

        def flush():
            out = make_shard(next(numbers), held_ids, held, gap)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == "shard" else pa.binary()) for k, v in out.items()], list(out))

        held_ids, held, size = [], [], 0
        for batch in batches:
            for d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held_ids.append(d)
                held.append(data)
                size += len(data)
                if size >= 6 * SHARD_WORDS or len(held) >= SHARD_DOCS:
                    yield flush()
                    held_ids, held, size = [], [], 0
        if held:
            yield flush()

    return docs.select("doc_id", text_bytes().alias("data")).mapInArrow(run, SHARD)


class Shard:
    """A stored index shard, opened for search."""

    def __init__(self, row: dict):
        self.shard = row["shard"]
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.digests = [row["digests"][16 * i : 16 * i + 16] for i in range(len(self.doc_ids))]
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.number = {w: i for i, w in enumerate(row["words"].split())}
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.postings = np.frombuffer(row["postings"], np.int32)
        self.sizes = np.diff(self.offsets)
        self.end = int(self.starts[-1] + self.n_words[-1]) + 1 if len(self.starts) else 1
        # postings of all terms as one ascending list of (term, position)
        self.keys = np.repeat(np.arange(len(self.sizes)), self.sizes) * self.end + self.postings

    def terms_of(self, words: list[bytes]) -> np.ndarray:
        """The shard's numbers of words, -1 for those that it does not have."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def postings_of(self, term: int) -> np.ndarray:
        return self.postings[self.offsets[term] : self.offsets[term + 1]]

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term stands at its place."""
        want = terms * self.end + places
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (places >= 0) & (places < self.end)

    def phrases(self, rows: np.ndarray):
        """(row, start) arrays of the exact places of phrases, given as rows of the shard's term numbers."""
        known = np.flatnonzero((rows >= 0).all(1))
        rows = rows[known]
        order = np.argsort(self.sizes[rows], axis=1, kind="stable")  # rarest term first
        first = np.take_along_axis(rows, order[:, :1], 1)[:, 0]
        n = self.sizes[first] if len(rows) else np.zeros(0, np.int64)
        i = 0
        while i < len(rows):
            j = i + max(1, int(np.searchsorted(np.cumsum(n[i:]), CHUNK)))
            row = np.repeat(np.arange(i, min(j, len(rows))), n[i:j])
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
            start = self.postings[self.offsets[first[row]] + inside] - order[row, 0]
            for k in range(1, rows.shape[1]):
                here = self.has(rows[row, order[row, k]], start + order[row, k])
                row, start = row[here], start[here]
            yield known[row], start
            i = j

    def near(self, terms: np.ndarray, slop: int, share: float) -> np.ndarray:
        """Start positions where at least ``share`` of the terms lie within ``slop`` words of their offsets.

        Every such place has one of the rarest ``(1 - share) * n + 1`` terms, so only their postings are tried.
        """
        need = int(np.ceil(share * len(terms)))
        sizes = np.where(terms >= 0, self.sizes[terms], 0)
        if (sizes > 0).sum() < need:
            return np.zeros(0, np.int64)
        lists = [self.postings_of(t).astype(np.int64) if t >= 0 else np.zeros(0, np.int64) for t in terms]
        tries = [lists[k] - k for k in np.argsort(sizes, kind="stable")[: len(terms) - need + 1]]
        found = np.unique(np.concatenate(tries))
        hits = np.zeros(len(found), np.int64)
        for k, other in enumerate(lists):
            if len(other) and len(found):
                at = np.searchsorted(other, found + k - slop)
                hits += (at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= found + k + slop)
        return found[hits >= need]

    def docs_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def search_shard(row: dict, windows: Windows, slop: int = 0, share: float = 1.0) -> dict[str, list]:
    """shard, place, doc_id, n_words, hit (positions of hit words), items and near (items with only a proximity match)."""
    s = Shard(row)
    n = len(s.starts)
    mark = np.zeros(s.end + 1, np.int32)
    items: list[set] = [set() for _ in range(n)]
    near: list[set] = [set() for _ in range(n)]
    terms = s.terms_of(windows.terms)
    for size, every in windows.rows.items():
        rows = terms[every]
        for which, start in s.phrases(rows):
            np.add.at(mark, start, 1)
            np.add.at(mark, start + size, -1)
            for w, d in set(zip(which.tolist(), s.docs_of(start).tolist())):
                items[d].update(windows.items[size][w])
        if slop and size == windows.width:
            for w, owners in enumerate(windows.items[size]):
                for d in np.unique(s.docs_of(s.near(rows[w], slop, share))):
                    if d >= 0:
                        near[d].update(owners)
    hit = np.cumsum(mark) > 0
    where = [np.flatnonzero(hit[a : a + c]) if items[i] else [] for i, (a, c) in enumerate(zip(s.starts, s.n_words))]
    return {
        "shard": [s.shard] * n, "place": range(n), "doc_id": [None if z else int(d) for d, z in zip(s.doc_ids, s.nulls)], "digest": s.digests, "n_words": s.n_words, "hit": where,
        "items": [sorted(map(str, x)) for x in items], "near": [sorted(map(str, x - y)) for x, y in zip(near, items)],
    }


FOUND = "shard long, place long, doc_id long, digest binary, n_words long, hit array<int>, items array<string>, near array<string>"


def search_index(index: DataFrame, windows, slop: int = 0, share: float = 1.0) -> DataFrame:
    """One row per indexed document with what the block's windows hit."""

    def rows(c: dict) -> dict:
        out: dict[str, list] = {}
        for i in range(len(c["doc_ids"])):
            for k, v in search_shard({k: v[i] for k, v in c.items()}, windows.value, slop, share).items():
                out.setdefault(k, []).extend(v)
        return out

    return map_rows(index, rows, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, slop: int = 0, share: float = 1.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, digest (MD5 of the text), n_words, hit (positions), items (ids as strings), near.

    What several blocks find meets by a document's shard and place in it, which the stored index fixes.
    """
    spark = docs.sparkSession
    ship(spark)
    index, found, n_blocks = materialize(build_index(docs), "postings"), None, 0
    for w in blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(w)
        one = search_index(index, shared, slop, share)
        found = one if found is None else found.unionByName(one)
        n_blocks += 1
    if found is None:
        found = search_index(index, spark.sparkContext.broadcast(Windows([])))
    if n_blocks > 1:
        merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("shard", "place").agg(F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest"), F.max("n_words").alias("n_words"), merge("hit"), merge("items"), merge("near"))
        found = found.withColumn("near", F.array_except("near", "items"))
    return found.drop("shard", "place")


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window.

    Only the digests of contaminated texts are written and joined back, each row being judged on its own text; texts
    are not shuffled while that table is small enough for Spark to broadcast it.
    """
    bad = materialize(decontaminate(docs, benchmark).filter(F.size("items") > 0).select(F.hex("digest").alias("digest")).distinct(), "contaminated")
    return docs.join(bad.alias("_found"), F.upper(F.md5(text_bytes())) == F.col("_found.digest"), "left_anti")
