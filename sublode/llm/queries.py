"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sql import SQL


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from .simhash import hex16, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that are not held out."""
    from .toxicity import THRESHOLD, fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = score(docs, fit(docs, labels.filter(~held())))
    return out.select("doc_id", held().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the text decoded from them, as digests."""
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    from .pii import KINDS, find_pii, span_text

    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, F.lit(k))).cast("long") for k in range(len(KINDS))]
    counts = [(F.size(kinds) - n).alias(f"n_{name}") for n, name in zip(counts, KINDS)]
    return out.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to and read back from WARC archives."""
    from .warc import roundtrip

    return roundtrip(table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention-model scores of every document, learnt from those that are not held out."""
    import public_tokenizers

    from .lm import lm_scores

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = lm_scores(docs, ~held, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document."""
    from .quality import quality

    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows inside every document."""
    from .decontam import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet shards and read back."""
    import public_tokenizers

    from .wavelet import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that occur elsewhere too."""
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_simhash, op2_toxicity, op3_byte_bpe, op4_pii, op5_warc, op6_lm_scoring, op7_quality_rules, op8_decontamination, op9_wavelet_output, op10_repeated_substrings, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
