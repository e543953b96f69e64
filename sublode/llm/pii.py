"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four base patterns give the seed spans; opaque strings of ``OPAQUE`` hexadecimal digits or more, or of as many letters
and digits with both in them, are the seeds of a fifth kind, secrets, and no spans by themselves. Words beside an
instance are its lexical patterns: the word before with the marks between, the word after, and both. Seeds, and other
tokens with a digit or an at-sign ("candidates"), are instances; with their patterns they form a bipartite graph. In
each round a pattern's confidence for a kind is the share of its instances that belong to the kind so far, and an
instance's is the noisy-or of its high-confidence patterns. Candidates and secret seeds above the threshold are spans of
that kind beside the base ones, so a secret is one by its context.

Positions come from the pieces between matches: a match ends where the pieces and matches up to it do. That running sum
is a window over one document's matches, so it is linear in them; texts themselves are never shuffled.

Defined edge cases: a null text is empty and has no span; a null ``doc_id`` is kept; rows that repeat a ``doc_id`` are
judged each on its own text; words beside a span count up to 64 characters; spans that the method adds never overlap
base spans; instances are compared in lower case, but spans count the text's own code points; other columns, whatever
their names, are ignored and pass through ``redact``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import marked, materialize

KINDS = ("email", "ip", "card", "phone")
#: What the method adds may be a secret too.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "A-Za-z0-9._%+-"
_SPACE = r"\x20\x09-\x0D"
#: Each matches what the plain pattern matches, from left to right, without trying the same run twice.
PATTERNS = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+",
)
SECRET, CANDIDATE = len(KINDS), len(KINDS) + 1
#: Characters from which a string of letters and digits is opaque.
OPAQUE = 32
ROUNDS = 3
#: A pattern speaks for a kind when so many distinct instances of it, and such a share of all the pattern's, are of the kind.
MIN_SEEDS = 3
PATTERN_CONFIDENCE = 0.8
INSTANCE_CONFIDENCE = 0.9
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What is trimmed off a candidate's ends, and what is opaque.
_HEAD, _TAIL = r"^[^\p{L}\p{N}@+_-]+", r"[^\p{L}\p{N}@+_=\]-]+$"
_OPAQUE = rf"^(?:[0-9a-fA-F]{{{OPAQUE},}}|(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{{{OPAQUE},}}=*)$"
#: A character that a text must hold for a pattern to match at all.
_NEEDS = ("@", "[0-9]", "[0-9]", r"\+", "[0-9@]")


def _word(piece: Column, last: bool) -> Column:
    near = F.right(piece, F.lit(64)) if last else F.left(piece, F.lit(64))
    word = F.regexp_extract(near, rf"([^{_SPACE}]+)[{_SPACE}]*$" if last else rf"^[{_SPACE}]*([^{_SPACE}]+)", 1)
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _before(piece: Column) -> Column:
    """The last word before a match, with the marks that stand between, or the bare word."""
    near = F.right(piece, F.lit(64))
    found = F.regexp_extract(near, rf"([\p{{L}}\p{{N}}]+)([^\p{{L}}\p{{N}}]*)$", 0)
    return F.lower(F.rtrim(F.regexp_replace(found, rf"[{_SPACE}]+", " ")))


def _valid(kind: int, m: Column) -> Column:
    if kind == 1:
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == 2:
        d = F.reverse(F.regexp_replace(m, r"[\x20-]", ""))
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        step = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + step(i)) % 10 == 0
        return F.when(F.length(d).between(13, 19), luhn).otherwise(F.lit(False))
    if kind == 3:
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key and found: every match of every pattern with its lengths and the words beside it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_key"), text.alias("t"))
    none = F.array().cast("array<string>")
    for k, (pattern, need) in enumerate(zip(PATTERNS, _NEEDS)):
        able = F.col("t").rlike(need)
        rows = rows.withColumn(f"m{k}", F.when(able, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
        rows = rows.withColumn(f"p{k}", F.when(able, F.split("t", pattern, -1)).otherwise(none))

    def entry(k: int):
        def of(m: Column, i: Column) -> Column:
            before, after = F.get(F.col(f"p{k}"), i), F.get(F.col(f"p{k}"), i + 1)
            valid = _valid(k, m)
            # a candidate is trimmed: marks at its ends belong to the words beside it
            head, kind = (F.length(F.regexp_extract(m, _HEAD, 0)), F.lit(k)) if k >= len(KINDS) else (F.lit(0), F.lit(k))
            own = F.regexp_replace(F.regexp_replace(m, _HEAD, ""), _TAIL, "") if k >= len(KINDS) else m
            if k >= len(KINDS):
                kind = F.when(own.rlike(_OPAQUE), SECRET).otherwise(CANDIDATE)
            left = _before(F.concat(before, F.left(m, head))) if k >= len(KINDS) else _before(before)
            right = _word(F.concat(F.substring(m, head + F.length(own) + 1, F.length(m)), after), False) if k >= len(KINDS) else _word(after, False)
            return F.struct(
                kind.alias("kind"), F.lit(k).alias("pattern"), i.alias("i"), (F.length(before) + F.length(m)).cast("long").alias("step"), F.length(m).cast("long").alias("size"),
                valid.alias("valid"), head.cast("long").alias("head"), F.length(own).cast("long").alias("own"), F.when(valid, F.lower(own)).alias("instance"),
                F.when(valid, left).alias("left"), F.when(valid, right).alias("right"),
            )

        return of

    found = F.concat(*(F.transform(f"m{k}", entry(k)) for k in range(len(PATTERNS))))
    return rows.select("row", "doc_id", "text_key", found.alias("found"))


def occurrences(table: DataFrame) -> DataFrame:
    """row, kind, start, end, instance, left, right of the valid base spans and of candidates that touch none of them."""
    flat = table.select("row", F.inline("found"))
    order = Window.partitionBy("row", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("start", F.sum("step").over(order) - F.col("size") + F.col("head")).withColumn("end", F.col("start") + F.col("own")).filter("valid AND own > 0")
    place = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < SECRET
    before = F.max(F.when(base, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after >= F.col("end"), F.lit(True)))
    return flat.withColumn("free", free).filter(base | F.col("free")).select("row", "kind", "start", "end", "instance", "left", "right")


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance, found_kind of the candidates and secret seeds that high-confidence patterns speak for.

    The graph's edges are distinct (instance, pattern) pairs; both sides are reduced by partial aggregates.
    """
    every = range(len(ALL_KINDS))
    left, right = F.nullif(F.col("left"), F.lit("")), F.nullif(F.col("right"), F.lit(""))
    names = F.filter(F.array(F.concat(F.lit("L "), left), F.concat(F.lit("R "), right), F.concat(F.lit("B "), left, F.lit(" "), right)), lambda x: x.isNotNull())
    edges = materialize(found.select("instance", "kind", F.explode(names).alias("pattern")).filter("instance <> ''").distinct(), "edges")
    seeds = edges.filter(F.col("kind") < CANDIDATE)
    known = seeds.select("pattern", *((F.col("kind") == k).cast("double").alias(f"w{k}") for k in every), F.lit(1).alias("seed"))
    open_ = edges.filter(F.col("kind") == CANDIDATE).drop("kind")
    weights = open_.select("instance").distinct().select("instance", *(F.lit(0.0).alias(f"w{k}") for k in every))
    judged = edges.filter(F.col("kind") >= SECRET).drop("kind")
    for _ in range(rounds):
        guessed = open_.join(weights, "instance", "left").select("pattern", *(F.coalesce(f"w{k}", F.lit(0.0)).alias(f"w{k}") for k in every), F.lit(0).alias("seed"))
        sums = known.unionByName(guessed).groupBy("pattern").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"), *(F.sum(f"w{k}").alias(f"w{k}") for k in every))
        sure = lambda k: F.when((F.col("seeds") >= MIN_SEEDS) & (F.col(f"w{k}") / (F.col("n") + 1) >= PATTERN_CONFIDENCE), F.col(f"w{k}") / (F.col("n") + 1)).otherwise(0.0)
        strong = sums.select("pattern", *(sure(k).alias(f"c{k}") for k in every)).filter(reduce(lambda a, b: a | b, (F.col(f"c{k}") > 0 for k in every)))
        strong = materialize(strong, "patterns")
        grown = judged.join(strong, "pattern").groupBy("instance").agg(*((1 - F.exp(F.sum(F.log(1 - F.col(f"c{k}"))))).alias(f"w{k}") for k in every))
        weights = materialize(grown, "weights")
    top = F.greatest(*(F.col(f"w{k}") for k in every))
    kind = F.coalesce(*(F.when(F.col(f"w{k}") == top, F.lit(k)) for k in every))
    return weights.filter(top >= INSTANCE_CONFIDENCE).select("instance", kind.alias("found_kind"))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of rows (row, doc_id, text_key), and their spans (row, kind, start, end, base)."""
    table = materialize(matches(docs), "matches")
    found = materialize(occurrences(table), "occurrences")
    more = found.filter(F.col("kind") >= SECRET).join(discover(found), "instance")
    more = more.select("row", F.col("found_kind").alias("kind"), "start", "end", F.lit(False).alias("base"))
    base = found.filter(F.col("kind") < SECRET).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    return table.select("row", "doc_id", "text_key"), base.unionByName(more)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, and spans, an array of (kind, start, end, base) in order; empty if none."""
    rows, found = spans(docs)
    each = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("_spans"))
    none = F.array().cast(each.schema["_spans"].dataType)
    return rows.join(each, "row", "left").select("doc_id", "text_key", F.coalesce("_spans", none).alias("spans"))


def span_text(found: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, ALL_KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, of the first kind.

    Only documents that a bitmap of the changed ones marks are joined with their spans.
    """
    rows, found = spans(docs)
    place = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    one = found.withColumn("fresh", (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("int")).withColumn("part", F.sum("fresh").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    one = one.groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    one = one.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0)))
    each = one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "from", "end", "kind"))).alias("_cuts"))
    keys = materialize(rows.join(each, "row").groupBy("doc_id", "text_key").agg(F.first("_cuts").alias("cuts")), "cuts")
    name = f"_hit_{uuid.uuid4().hex}"
    every = marked(docs, keys, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), name)
    given, text, cuts = every.filter(name).alias("_given"), F.col("_given.text").cast("string"), F.col("_found.cuts")
    word = lambda k: F.element_at(F.array(*(F.lit(f"[{x.upper()}]") for x in ALL_KINDS)), k + 1)
    part = F.transform(cuts, lambda c: F.concat(F.substring(text, (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")), word(c["kind"])))
    tail = F.substring(text, (F.element_at(cuts, -1)["end"] + 1).cast("int"), F.length(text))
    match = F.col("_given.doc_id").eqNullSafe(F.col("_found.doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_found.text_key"))
    changed = F.concat(F.array_join(part, ""), tail)
    new = {"text": F.when(cuts.isNull(), F.col("_given.text")).otherwise(changed).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cuts.isNull(), F.col("_given.n_chars")).otherwise(F.length(changed).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    changed_rows = given.join(keys.alias("_found"), match, "left").select(*(new.get(c, F.col(f"_given.`{c}`")) for c in docs.columns))
    return every.filter(~F.col(name)).select(*docs.columns).unionByName(changed_rows)
