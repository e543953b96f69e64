"""Token-id output as wavelet matrices: one compressed file per shard that answers access, rank, count and locate.

Texts are encoded with a public tokenizer file, an end id follows each document, and documents are written in
ascending ``doc_id`` order: the table is range-partitioned and sorted by ``doc_id`` and each partition is cut into
shards of a bounded number of ids. A shard file holds the documents' lengths and one bit plane for each bit of the ids,
highest first; within a plane the ids stand in the order that the planes above have given them (zeros before ones, both
in their former order). A plane is compressed in blocks of ``BLOCK_BITS`` bits, and the file stores where each block
lies and how many ones precede it, so a query inflates only the blocks it touches.

Defined edge cases: a null text is empty and gives the end id alone; a null ``doc_id`` sorts first; rows that repeat a
``doc_id`` are documents of their own, in no particular order among themselves; an empty table gives no file and no row;
other columns, whatever their names, play no part; broken UTF-8 is read with U+FFFD.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, read_stream, ship, text_bytes, worker_state, write_once

END_ID = 2
SHARD_IDS = 1_000_000
MAGIC = b"WVM2"
#: Bits of a plane that are compressed together; ones are counted up to each block.
BLOCK_BITS = 1 << 16
#: Distinct words whose ids a worker keeps in each of two generations.
CACHE_WORDS = 320_000
#: Bytes of texts that are encoded at once.
BATCH_BYTES = 1_000_000

#: Letters that the normaliser maps one by one, and that are one piece of the splitter wherever they stand together.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+").fullmatch
#: Plain letters and ASCII marks, but for those of contractions and special tokens: runs of either are pieces.
_MARKED = re.compile("(?:[a-z\u00df-\u00f6\u00f8-\u00ff\u0153]|[!-/:-@\\[-`{-~](?<!['<>|]))+").fullmatch
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+|[^a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+").findall
#: A character outside those of simple texts: letters that normalise one by one, digits, white space, full stop, comma.
_ODD = re.compile("[^a-zA-Z0-9\t-\r .,\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0153]").search
_SIMPLE = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\t\n\x0b\f\r .,"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level alphabets show each byte as a character: printable ones as themselves, the rest from 256 on.
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class _Words(dict):
    """The packed ids of words; a missing word comes from the older generation or is encoded."""

    def __init__(self, model, kind: str, old: dict):
        super().__init__()
        self.model, self.merges, self.kind, self.old = model, model.model.tokenize, kind, old

    def __missing__(self, w: bytes) -> bytes:
        got = self.old.get(w)
        if got is None:
            got = self.make(w)
        self[w] = got
        return got

    def make(self, w: bytes) -> bytes:
        """Plain letters need the merges alone; letters and marks are looked up piece by piece; all else is the library's."""
        low = w.lower()
        if low.isalpha():  # ASCII letters
            return array(self.kind, [t.id for t in self.merges(low.decode())]).tobytes()
        text = w.decode("utf-8", "replace")
        low = text.lower()
        if _PLAIN(low):
            return array(self.kind, [t.id for t in self.merges(low.encode().decode("latin-1").translate(_VISIBLE))]).tobytes()
        if _MARKED(low) and len(pieces := _PIECES(low)) > 1:
            return b"".join([self[x.encode()] for x in pieces])
        return array(self.kind, self.model.encode(text, add_special_tokens=False).ids).tobytes()


def spaced(data: bytes) -> list[bytes]:
    """Words of a text; in simple texts they are lowered, and full stops and commas that end a word are words too.

    In those each mark is a piece of the splitter's own, unless two stand together.
    """
    odd = data.translate(None, _SIMPLE)
    if not any(two in data for two in (b"..", b",,", b".,", b",.")) and (not odd or _ODD(odd.decode("utf-8", "replace")) is None):
        data = data.lower().replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" . ")
    return data.split()


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file has the normaliser, splitter and model for which a text's ids are its words' ids in order."""
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0].get("pattern", {}).get("Regex") == _SPLIT and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges")


#: Fixed value: the splitting pattern of the tokenizer file for which words may be encoded one by one.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class CachedEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    Where the tokenizer file's steps allow it (``splits_at_spaces``), the ids of a text are those of its words between
    ASCII white space: the splitter drops white space, and normalisation never joins characters across it. Other files
    are given whole texts. When the younger generation of the cache is full it becomes the older one, and words still
    in use move on from there.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.end_id = Tokenizer.from_file(path), end_id
        self.size = max(self.model.get_vocab(True).values()) + 1
        if not 0 <= end_id < self.size:
            raise ValueError(f"the tokenizer has no id {end_id}")
        self.kind, self.dtype = ("H", np.uint16) if self.size <= 1 << 16 else ("I", np.uint32)
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_spaces(json.load(f))
        self.cache = _Words(self.model, self.kind, {}) if self.by_word else {}

    @property
    def bits(self) -> int:
        return max(1, (self.size - 1).bit_length())

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words, without end ids, and the number of ids of each. Nothing is remembered."""
        if self.by_word:
            data = list(map(self.cache.make, words))
        else:
            data = [array(self.kind, x.ids).tobytes() for x in self.model.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        return np.frombuffer(b"".join(data), self.dtype), np.array([len(x) // np.dtype(self.dtype).itemsize for x in data], np.int64)

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end id, and the number of ids of each."""
        end = array(self.kind, [self.end_id]).tobytes()
        if self.by_word:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.old = {}
                self.cache = _Words(self.model, self.kind, self.cache)
            get, collects = self.cache.__getitem__, gc.isenabled()
            gc.disable()  # new words make many small objects and no cycles
            try:
                data = [b"".join(map(get, spaced(x))) + end for x in texts]
            finally:
                if collects:
                    gc.enable()
        else:
            found = self.model.encode_batch([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
            data = [array(self.kind, x.ids).tobytes() + end for x in found]
        wide = np.dtype(self.dtype).itemsize
        return np.frombuffer(b"".join(data), self.dtype), np.array([len(x) // wide for x in data], np.int64)


def worker_encoder(path: str) -> CachedEncoder:
    """The encoder that a Python worker keeps between its tasks."""
    return worker_state("words", path, lambda: CachedEncoder(path))


_zstd = pa.Codec("zstd", 1)


def pack(data: bytes) -> bytes:
    """Its length and its Zstandard frame; data that does not shrink follows as it is, with the length negative."""
    small = _zstd.compress(data, asbytes=True)
    return struct.pack("<q", len(data)) + small if len(small) < len(data) else struct.pack("<q", -len(data)) + data


def unpack(data) -> bytes:
    (n,) = struct.unpack("<q", data[:8])
    return _zstd.decompress(data[8:], n, asbytes=True) if n > 0 else bytes(data[8:])


def planes_of(ids: np.ndarray, bits: int):
    """The packed bit planes of a wavelet matrix one by one, highest bit first."""
    now = ids
    for k in range(bits - 1, -1, -1):
        if k == 7:
            now = now.astype(np.uint8)  # what is left of the ids fits a byte
        one = (now & now.dtype.type(1 << k)).astype(bool)
        yield np.packbits(one)
        if k:
            now = np.concatenate([now[~one], now[one]])


def dump_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int = 16) -> bytes:
    """A shard file: magic, header length, header, the documents' ids and lengths, then each plane's blocks.

    The header gives counts and part sizes; before a plane's blocks stand their compressed sizes and the ones before each.
    """
    known = np.array([0 if d is None else d for d in doc_ids], np.int64)
    parts = [pack(x.tobytes()) for x in (known, np.array([d is None for d in doc_ids], bool), lengths.astype(np.int64))]
    step = BLOCK_BITS // 8
    for p in planes_of(ids, bits):
        blocks = [pack(p[i : i + step].tobytes()) for i in range(0, len(p), step)]
        ones = np.add.reduceat(np.bitwise_count(p).astype(np.int64), np.arange(0, len(p), step)) if len(p) else np.zeros(0, np.int64)
        table = np.array([len(b) for b in blocks], "<i8").tobytes() + np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes()
        parts += [table, b"".join(blocks)]
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "block": BLOCK_BITS, "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class _Plane:
    """One bit plane of an opened shard: rank and select over compressed blocks, of which a few are kept inflated."""

    def __init__(self, data: memoryview, table: bytes, n: int, block: int):
        blocks = -(-n // block)
        sizes = np.frombuffer(table, "<i8", blocks)
        self.before = np.frombuffer(table, "<i8", blocks + 1, 8 * blocks)
        self.zeros, self.n, self.bits = n - int(self.before[-1]), n, block
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self.block = lru_cache(4)(lambda b: np.frombuffer(unpack(data[at[b] : at[b + 1]]), np.uint8))

    def bit(self, i: int) -> int:
        return int(self.block(i // self.bits)[i % self.bits // 8]) >> (7 - i % 8) & 1

    def ones(self, i: int) -> int:
        """Ones before position i."""
        b, k = divmod(i, self.bits)
        if not k:
            return int(self.before[b])
        p = self.block(b)
        out = int(self.before[b]) + int(np.bitwise_count(p[: k // 8]).sum())
        return out + (int(p[k // 8]) >> (8 - k % 8)).bit_count() if k % 8 else out

    def select(self, bit: int, want: np.ndarray) -> np.ndarray:
        """Positions of the ``want``-th (ascending, from 0) such bits: the block by its counts, the place inside it."""
        ends = self.before if bit else np.minimum(np.arange(len(self.before)) * self.bits, self.n) - self.before
        where, out = np.searchsorted(ends, want, side="right") - 1, np.empty(len(want), np.int64)
        for b in np.unique(where).tolist():
            own = where == b
            places = np.flatnonzero(np.unpackbits(self.block(b), count=min(self.bits, self.n - b * self.bits)) == bit)
            out[own] = b * self.bits + places[want[own] - ends[b]]
        return out

    def whole(self) -> np.ndarray:
        """All bits."""
        return np.unpackbits(np.concatenate([self.block(b) for b in range(len(self.before) - 1)]), count=self.n).astype(bool) if self.n else np.zeros(0, bool)


class WaveletShard:
    """A shard file, opened: token access, rank, counting and occurrence lookup, and decoding of whole documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", data[4:8])
        head = json.loads(data[8 : 8 + size])
        view, at, parts = memoryview(data), 8 + size, []
        for n in head["sizes"]:
            parts.append(view[at : at + n])
            at += n
        self.n, self.bits = head["n"], head["bits"]
        known, nulls, lengths = (unpack(p) for p in parts[:3])
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(known, np.int64), np.frombuffer(nulls, bool))]
        self.lengths = np.frombuffer(lengths, np.int64)
        self.planes = [_Plane(parts[k + 1], bytes(parts[k]), self.n, head["block"]) for k in range(3, len(parts), 2)]

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in self.planes:
            bit, before = p.bit(i), p.ones(i)
            i = p.zeros + before if bit else i - before
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k, p in enumerate(self.planes):
            a, b = p.ones(lo), p.ones(hi)
            lo, hi = (p.zeros + a, p.zeros + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before position i."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _up(self, token: int, places: np.ndarray) -> np.ndarray:
        for k in range(self.bits - 1, -1, -1):
            p, one = self.planes[k], token >> (self.bits - 1 - k) & 1
            places = p.select(one, places - p.zeros if one else places)
        return places

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence (from 0) of an id."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        return int(self._up(token, np.array([lo + j]))[0])

    def locate(self, token: int) -> list[int]:
        """All positions of an id, ascending: one range, taken up through the planes together."""
        lo, hi = self._range(token, 0, self.n)
        return self._up(token, np.arange(lo, hi)).tolist()

    def ids(self) -> np.ndarray:
        """All ids: the order of the lowest plane, then back up through each plane."""
        now = np.zeros(self.n, np.uint8)
        for k in range(self.bits - 1, -1, -1):
            if self.bits - k in (9, 17):
                now = now.astype(np.uint16 if now.itemsize == 1 else np.uint32)
            kind = now.dtype.type
            one, zeros = self.planes[k].whole(), self.planes[k].zeros
            out = np.empty(self.n, kind)
            out[~one] = now[:zeros]
            out[one] = now[zeros:] | kind(1 << (self.bits - 1 - k))
            now = out
        return now if now.itemsize > 1 else now.astype(np.uint16)


def write_shards(docs: DataFrame, tokenizer: str, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shard files under ``path``; part, shard, file, n_docs, n_ids of each, in document order by (part, shard).

    A task that runs twice writes files with the same names and contents.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder, part, shard = worker_encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, lengths, ids, size, done = [], [], [], 0, []

        def flush():
            name = f"{path}/shard-{part:06d}-{shard:06d}.wvm"
            every = np.concatenate(ids)
            write_once(name, dump_shard(names, np.concatenate(lengths), every, encoder.bits))
            done.append((part, shard, name, len(names), len(every)))

        for batch in batches:
            all_names, texts, sizes = batch.column(0).to_pylist(), batch.column(1), pc.binary_length(batch.column(1)).to_pylist()
            at = 0
            while at < len(sizes):
                end, room = at, BATCH_BYTES
                while end < len(sizes) and (end == at or room > 0):
                    room -= sizes[end]
                    end += 1
                got, n = encoder.encode_batch(texts.slice(at, end - at).to_pylist())
                names += all_names[at:end]
                ids.append(got)
                lengths.append(n)
                size, at = size + len(got), end
                if size >= shard_ids:
                    flush()
                    shard += 1
                    names, lengths, ids, size = [], [], [], 0
        if names:
            flush()
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], ["part", "shard", "file", "n_docs", "n_ids"])

    rows = docs.select("doc_id", text_bytes().alias("data"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "part int, shard int, file string, n_docs long, n_ids long")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the shard files; ``files`` has file and first (ids before the shard)."""

    def run(batches):
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = WaveletShard(read_stream(file).read())
                data = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the documents' ids as wavelet shards and return what reading the files back gives.

    The shards' counts (one small row for each million ids) meet in one running sum over parts, whose rows are as
    many as there are partitions, then in one over each part's shards.
    """
    from pyspark.sql import Window

    from .common import materialize

    spark = docs.sparkSession
    ship(spark)
    path = path or new_path(spark, "wavelet")
    files = materialize(write_shards(docs, tokenizer, path), "shards")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_first"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.join(parts, "part").select("file", (F.col("part_first") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("first"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_shards(firsts.repartition(n))
