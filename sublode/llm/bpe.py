"""Byte-level BPE encoding by a finite-state transducer, and streaming decoding.

Merges are compiled lazily. A prefix of a text has exactly one encoding, and a token sequence is an encoding exactly
when every two neighbours are (the merges of their joined bytes give the pair back) and the first token is its own
encoding. So the transducer reads a byte at a time and follows every start where a token may still be growing: a
hypothesis is the token before that start, with the place in the trie of tokens. The set of hypotheses is determinised
into a state the first time it occurs, and a transition is computed once; its output is the last token of the prefix
read so far. Where all live starts lead back to one place, the tokens before that place are certain and are emitted:
the lookahead is bounded by the longest token. When the tables reach their limit they are emptied and grow again.

Text is first split by the tokenizer's pattern; a worker keeps the ids of frequent pieces. Decoding joins the tokens'
bytes chunk by chunk and turns them into text by an incremental UTF-8 state machine that holds back unfinished
sequences.

Defined edge cases: a null text is empty; an empty text has no ids; broken UTF-8 in a text is read with U+FFFD;
decoding gives U+FFFD for broken sequences; rows and columns beside ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import chain

from pyspark.sql import DataFrame

from .common import map_rows, ship, text_bytes, worker_state

#: Limits of a worker's tables: transitions, neighbour checks, pieces of each of two generations, bytes of a piece that is kept.
MAX_TRANSITIONS = 500_000
MAX_PAIRS = 500_000
MAX_PIECES = 300_000
KEPT_PIECE = 64
#: A third of these for the pipeline's last stage, which shares its executors with heaps that four stages have grown.
SMALL = 3
#: Bits of a token in a transition's number, and bytes after which certain tokens of a long piece are emitted.
TOKEN_BITS = 20
TOKEN_MASK = (1 << TOKEN_BITS) - 1
STREAM = 4096
#: Pieces of a text between two looks at the cache's size.
SLICE = 20_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(data: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[bytes]:
    """The merges of a short byte string, lowest rank first, leftmost first among equals; not the one that makes all of it unless ``whole``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > (1 if whole else 2):
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def pack_state(live: list[tuple[int, int]]) -> bytes:
    """A state's hypotheses, token before and place in the trie, as 32-bit numbers: a tenth of the memory of tuples."""
    return array("i", chain.from_iterable(live)).tobytes()


def live_of(state: bytes):
    """The hypotheses of a packed state."""
    flat = iter(memoryview(state).cast("i"))
    return zip(flat, flat)


class Transducer:
    """The lazily determinised transducer of one rank table."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS, max_pairs: int = MAX_PAIRS):
        self.ranks, self.max_transitions, self.max_pairs = ranks, max_transitions, max_pairs
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.token_at, self.inner, self.depth = [-1], bytearray(1), [0]
        for t, r in ranks.items():
            node = 0
            for b in t:
                self.inner[node] = 1
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            self.token_at[node] = r
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._empty()

    def _empty(self) -> None:
        start = pack_state([(-1, 0)])
        self.states, self.number, self.moves = [start], {start: 0}, {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is the last step of a token's own encoding; the token twice if it has none."""
        found = self.halves.get(token)
        if found is None:
            data = self.bytes_of[token]
            parts = merge(data, self.ranks, False) if len(data) > 1 else [data]
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
            self.halves[token] = found
        return found

    def reachable(self, token: int) -> bool:
        """Whether a token is its own encoding."""
        return len(self.bytes_of[token]) == 1 or self.split(token) != (token, token)

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand after ``left`` (-1: at the beginning) in an encoding.

        The merges inside both tokens are undone from the latest on; the pair fails if, at any time, the two inner
        neighbours would have merged with each other before the merge just undone.
        """
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            found = self.pairs[key] = self.reachable(right) and (left < 0 or self._apart(left, right))
        return found

    def _apart(self, a: int, b: int) -> bool:
        bytes_of, ranks = self.bytes_of, self.ranks
        before = 1 << 60  # a merge across the border counts if its rank is lower
        while True:
            across = ranks.get(bytes_of[a] + bytes_of[b])
            if across is not None and across < before:
                return False
            one_a, one_b = len(bytes_of[a]) == 1, len(bytes_of[b]) == 1
            if one_a and one_b:
                return True
            # merges of equal rank go from left to right: a, across, b
            if one_b or (not one_a and a > b):
                before, a = a, self.split(a)[1]
            else:
                before, b = b + 1, self.split(b)[0]

    def _state(self, live: bytes) -> int:
        k = self.number.get(live)
        if k is None:
            k = self.number[live] = len(self.states)
            self.states.append(live)
        return k

    def _move(self, state: int, byte: int) -> int:
        """The state after a byte, and the last token of the prefix in the low bits."""
        now, whole, child = [], -1, self.child
        for left, node in live_of(self.states[state]):
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            t = self.token_at[node]
            if t >= 0 and whole < 0 and self.follows(left, t):
                whole = t
            if self.inner[node]:
                now.append((left, node))
        if whole < 0:
            raise ValueError(f"no token for byte {byte}")
        now.append((whole, 0))
        found = self.moves[state << 8 | byte] = self._state(pack_state(now)) << TOKEN_BITS | whole
        return found

    def _back(self, last: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes, from the last token of every prefix."""
        out, size = [], self.size
        while end:
            t = last[end - 1]
            out.append(t)
            end -= size[t]
        out.reverse()
        return out

    def _certain(self, state: int, last: list[int]) -> int:
        """The latest place that every live start leads back to."""
        heads = {len(last) - self.depth[node] for _, node in live_of(self.states[state])}
        while len(heads) > 1:
            m = max(heads)
            heads.remove(m)
            heads.add(m - self.size[last[m - 1]])
        return heads.pop()

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece of text."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last: list[int] = []
        state, moves = 0, self.moves
        for b in piece:
            step = moves.get(state << 8 | b)
            if step is None:
                if len(moves) >= self.max_transitions:
                    here = self.states[state]
                    self._empty()
                    moves, state = self.moves, self._state(here)
                step = self._move(state, b)
            state = step >> TOKEN_BITS
            last.append(step & TOKEN_MASK)
            if len(last) >= STREAM:
                sure = self._certain(state, last)
                out += self._back(last, sure)
                del last[:sure]
        return out + self._back(last, len(last)) if out else self._back(last, len(last))


class Encoder:
    """Splits texts by a pattern and encodes the pieces; ids are packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str, part: int = 1):
        import regex

        self.split = regex.compile(pattern).findall
        self.machine = Transducer(load_ranks(path), MAX_TRANSITIONS // part, MAX_PAIRS // part)
        self.max_pieces = MAX_PIECES // part
        self.cache = _Pieces(self.machine, {})

    def encode(self, text: str) -> bytes:
        """The packed ids of a text; frequent pieces move from the older to the younger generation of the cache.

        The cache is looked at between slices of a text's pieces: a text may have any number of new ones.
        """
        pieces, out = self.split(text), []
        for i in range(0, len(pieces), SLICE):
            if len(self.cache) >= self.max_pieces:
                self.cache.old = {}
                self.cache = _Pieces(self.machine, self.cache)
            out.append(b"".join(map(self.cache.__getitem__, pieces[i : i + SLICE])))
        return out[0] if len(out) == 1 else b"".join(out)


class _Pieces(dict):
    """The packed ids of pieces; a missing one comes from the older generation or from the transducer.

    Long pieces are encoded each time: their ids would take memory without a bound.
    """

    def __init__(self, machine: Transducer, old: dict):
        super().__init__()
        self.machine, self.old = machine, old

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            data = piece.encode()
            got = array("I", self.machine.encode(data)).tobytes()
            if len(data) > KEPT_PIECE:
                return got
        self[piece] = got
        return got


class Utf8Stream:
    """Incremental UTF-8 decoding: the state is the bytes of an unfinished sequence, three at most."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that may be the beginning of a longer sequence."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                second = data[-back + 1] if back > 1 else None
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                return back if 0xC2 <= b <= 0xF4 and need > back and (second is None or low <= second <= high) else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode(ids: bytes, bytes_of, chunk: int = 1 << 14):
    """The text of packed ids, as a stream of strings."""
    stream, all_ids = Utf8Stream(), memoryview(ids).cast("I")
    for i in range(0, len(all_ids), chunk):
        yield stream.feed(b"".join([bytes_of[t] for t in all_ids[i : i + chunk]]))
    yield stream.close()


def worker_encoder(path: str, pattern: str, part: int = 1) -> Encoder:
    """The encoder that a Python worker keeps between its tasks; its tables' limits are divided by ``part``."""
    return worker_state("bpe", (path, pattern, part), lambda: Encoder(path, pattern, part))


def roundtrip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed), decoded (text) of every document."""

    def rows(c: dict) -> dict:
        e = worker_encoder(path, pattern)
        ids = [e.encode(b.decode("utf-8", "replace")) for b in c["data"]]
        return {"doc_id": c["doc_id"], "ids": ids, "decoded": ["".join(decode(x, e.machine.bytes_of)) for x in ids]}

    ship(docs.sparkSession)
    return map_rows(docs.select("doc_id", text_bytes().alias("data")), rows, "doc_id long, ids binary, decoded string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) of every document, and the SHA-256 of the text decoded from them."""

    def rows(c: dict) -> dict:
        e, n, all_ids, b = worker_encoder(path, pattern, SMALL), [], [], []
        for data in c["data"]:
            ids, text = e.encode(data.decode("utf-8", "replace")), hashlib.sha256()
            for part in decode(ids, e.machine.bytes_of):
                text.update(part.encode())
            n.append(len(ids) // 4)
            all_ids.append(ids)
            b.append(text.hexdigest())
        return {"doc_id": c["doc_id"], "n_tokens": n, "ids": all_ids, "decoded_sha256": b}

    ship(docs.sparkSession)
    return map_rows(docs.select("doc_id", text_bytes().alias("data")), rows, "doc_id long, n_tokens long, ids binary, decoded_sha256 string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids and decoded texts of ``roundtrip`` by their digests, made in one pass."""

    def rows(c: dict) -> dict:
        e, n, a, b = worker_encoder(path, pattern), [], [], []
        for data in c["data"]:
            ids, text = e.encode(data.decode("utf-8", "replace")), hashlib.sha256()
            for part in decode(ids, e.machine.bytes_of):
                text.update(part.encode())
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(text.hexdigest())
        return {"doc_id": c["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    ship(docs.sparkSession)
    return map_rows(docs.select("doc_id", text_bytes().alias("data")), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
