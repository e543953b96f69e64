"""Quality rules: per-text statistics and the cross-document line frequency of each host.

Every line is normalised (lower case of A-Z, runs of white space as one space) and hashed. For each host (the
``source`` column) the number of distinct documents with that line is counted; documents of equal text are one, so that
a group of exact copies does not make its own lines look like boilerplate. Lines on more than ``MIN_LINE_DOCS``
documents and on more than ``LINE_SHARE`` of the host's are removed, every occurrence of them, and a document that keeps
too few words is depleted and rejected.

Defined edge cases: a null text has no words and fails the base rules; a null host is a host of its own; a text without
words has no lines to count; each row is judged on its own text and host, so rows that repeat a doc_id, or have none,
keep their own verdicts; a line that repeats inside a text is one document's line, and each occurrence of it counts as
removed; other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_rows, materialize, ship, text_bytes, worker_state

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: A line is boilerplate on a host when more distinct documents than both limits have it. The share decides; the floor
#: keeps a few pages of a small host from making each other's lines common.
MIN_LINE_DOCS = 5
LINE_SHARE = 0.05
#: A document is depleted when fewer words or a smaller share of its words than these stay.
MIN_WORDS = 10
MIN_SHARE = 0.1
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = "doc_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", base_failed boolean, kept boolean, removed_words long, removed array<long>"


def repeated_words(words: list) -> int:
    """Words inside 5-word windows that occur at least twice."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 5 - max(i, end)
            end = i + 5
    return total


def text_stats(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    words = data.split()
    in_words = sum(map(len, words))
    chars = len(data.decode("utf-8", "surrogatepass")) - (len(data) - in_words)
    seen: set = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), dup, repeated_words(words)


def line_key(line: bytes) -> int:
    """The hash that ``text_lines`` gives a normalised line."""
    h = xxhash.xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def judge(data: bytes, common: frozenset) -> tuple[tuple, bool, bool, int, list[int], bytes]:
    """Statistics, base_failed, kept, removed words, removed lines (hashes) and what is left of one UTF-8 text."""
    stats, lost, gone, left = text_stats(data), 0, set(), data
    if common:
        lines = []
        for line in data.split(b"\n"):
            words = line.lower().split()
            if words and (key := line_key(b" ".join(words))) in common:
                lost += len(words)
                gone.add(key)
            else:
                lines.append(line)
        left = b"\n".join(lines) if gone else data
    n = stats[0]
    failed = n < MIN_WORDS or 100 * stats[4] > 20 * n
    depleted = lost > 0 and (n - lost < MIN_WORDS or n - lost < MIN_SHARE * n)
    return stats, failed, not failed and not depleted, lost, sorted(gone), left


def host_of() -> Column:
    """The host as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def text_of() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def normal_line(line):
    """A line as it is compared across documents."""
    return F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\n\x0B\f\r]+", " "))


def text_lines() -> Column:
    """Hash and number of words of each line that has a word, in order, repeats included."""
    normal = F.filter(F.transform(F.split(text_of(), "\n", -1), normal_line), lambda x: x != "")
    return F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("long").alias("words")))


def text_table(docs: DataFrame) -> DataFrame:
    """host, text_hash, lines: the distinct texts of each host that have a line."""
    rows = docs.select(host_of().alias("host"), F.xxhash64(text_of()).alias("text_hash"), text_lines().alias("lines")).filter(F.size("lines") > 0)
    return rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))


def common_lines(texts: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """host, line, docs of the lines above the limits; each text counts a line once."""
    per_line = texts.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    per_host = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    return per_line.filter(F.col("docs") > min_docs).join(per_host, "host").filter(F.col("docs") > F.col("host_docs") * share).select("host", "line", "docs")


def with_lines(docs: DataFrame, name: str, min_docs: int, share: float) -> DataFrame:
    """The documents with a column more: the common lines of their host, of which each has at most 1 / ``share`` texts' worth.

    Spark broadcasts that table where it is known to be small; texts are then not shuffled.
    """
    texts = materialize(text_table(docs), "texts")
    found = common_lines(texts, min_docs, share).groupBy("host").agg(F.collect_list("line").alias("lines"))
    found = materialize(found, "common-lines").alias("_found")
    return docs.alias("_given").join(found, host_of() == F.col("_found.host"), "left").select("_given.*", F.col("_found.lines").alias(name))


def quality(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """One row per row: statistics, ``base_failed``, ``removed_words``, ``removed`` line hashes and ``kept``."""
    ship(docs.sparkSession)

    def rows(c: dict) -> dict:
        got = [judge(b, frozenset(x or ())) for b, x in zip(c["data"], c["lines"])]
        stats, failed, kept, lost, gone, _ = zip(*got)
        return {"doc_id": c["doc_id"], **dict(zip(NUMBERS, zip(*stats))), "base_failed": failed, "kept": kept, "removed_words": lost, "removed": gone}

    given = with_lines(docs.select("doc_id", "text", "source"), "lines", min_docs, share)
    return map_rows(given.select("doc_id", "lines", text_bytes().alias("data")), rows, STATS)


def removed(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """One row: lines (a host's each) that are boilerplate, documents and words that lose them, documents depleted by it."""
    lines = common_lines(text_table(docs), min_docs, share).agg(F.count("*").alias("lines"))
    hit = F.col("removed_words") > 0
    rows = quality(docs, min_docs, share).agg(F.count_if(hit).alias("docs"), F.coalesce(F.sum("removed_words"), F.lit(0)).alias("words"), F.count_if(hit & ~F.col("kept") & ~F.col("base_failed")).alias("depleted"))
    return lines.crossJoin(rows)


def clean(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """The documents that pass, without their boilerplate lines; the columns of the input, ``n_chars`` follows the text."""
    ship(docs.sparkSession)
    names, kinds = docs.columns, to_arrow_schema(docs.schema)
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        worker_state(None)
        for batch in batches:
            cols = [batch.column(i).to_pylist() if i in (text, chars) else batch.column(i) for i in range(len(names))]
            keep = []
            for i, (t, lines) in enumerate(zip(cols[text], batch.column(len(names)).to_pylist())):
                *_, kept, _, gone, left = judge((t or "").encode(), frozenset(lines or ()))
                keep.append(kept)
                if gone:
                    cols[text][i] = left.decode()
                    if chars is not None:
                        cols[chars][i] = len(cols[text][i])
            full = [pa.array(c, kinds.field(i).type) if isinstance(c, list) else c for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(full, names).filter(pa.array(keep, pa.bool_()))

    return with_lines(docs, f"_lines_{uuid.uuid4().hex}", min_docs, share).mapInArrow(run, docs.schema)
