"""The corpus pipeline's stages against a brute-force version, on the smallest driver table."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from sublode.llm import simhash  # noqa: E402

from .test_operators import base_spans, brute_fingerprint, brute_hits  # noqa: E402


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    seen, columns = {}, docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r["doc_id"]: r for r in docs.collect()}
        seen[name] = len(rows)
        if k < 4:
            assert docs.columns == columns and set(rows) <= set(before)
        if k == 1:  # five words, similarity 0.8; the index promises the pairs within its bit limit
            data = {i: (t or "").encode() for i, t in before.items()}
            fps = {i: brute_fingerprint(t, simhash.NEAR_MARK) for i, t in before.items()}
            every, surely = {i: i for i in data}, {i: i for i in data}
            sets = {i: simhash.shingles(d, 5) for i, d in data.items()}
            alike = [(i, j, (fps[i] ^ fps[j]).bit_count()) for i in data for j in data if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
            for _ in range(5):
                for i, j, bits in alike:
                    every[i] = every[j] = min(every[i], every[j])
                    if bits <= simhash.NEAR_DIFF:
                        surely[i] = surely[j] = min(surely[i], surely[j])
            assert set(every.values()) <= set(rows) <= set(surely.values()) and len(set(every.values())) < len(before)
        if k == 2:
            assert set(rows) == {i for i, t in before.items() if not brute_hits(t, items)[1]}
        if k == 3:
            assert set(rows) == set(before) and all(not base_spans(r["text"]) for r in rows.values())
            assert all(r["text"] == before[i] for i, r in rows.items() if not base_spans(before[i]) and "[" not in r["text"])
        if k == 4:
            assert set(rows) == set(before) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows.values())
    assert seen["quality rules"] > 0.7 * spark.read.parquet(f"{tables}/documents.parquet").count()
    assert pipeline.run(spark, tables).count() == seen["token ids"]


CLASHES = "host string, text_hash long, kept boolean, removed string, digest string, key long, component_id long, cuts string, row long, _kept int, _found int"


def odd_rows():
    same = "the very same words stand here twice over and nobody minds it at all today"
    long = " ".join(f"word{k}" for k in range(60_000))
    texts = [(1, same), (1, same), (2, same), (None, same), (None, "without a number but with quite enough words to pass the rules easily"), (3, None), (4, ""), (5, " \n "), (6, long), (7, "Ünïcode İi wörds ärë fine to keep and mail joe@example.org at any time of day"), (7, "another text of the same number that has quite enough words to be kept alone")]
    return [(i, t, None, None if k % 2 else "s", None, "h", k, True, "r", "d", k, 9, "c", k, k, k) for k, (i, t) in enumerate(texts)]


def test_odd_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and names that the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
    folder = str(tmp_path / "odd")
    docs = spark.createDataFrame(odd_rows(), schema).repartition(3)
    spark.createDataFrame([(1, "another text of the same number that has quite enough words"), (2, None), (None, "nobody minds it")], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    passed = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == [x.split(" ")[0] for x in schema.split(", ")]
            passed.append(sorted(((r["doc_id"] or 0, (r["text"] or "")[:12]) for r in docs.collect())))
    kept = [(0, "the very sam"), (0, "without a nu"), (1, "the very sam"), (1, "the very sam"), (2, "the very sam"), (6, "word0 word1 "), (7, "another text"), (7, "Ünïcode İi w")]
    assert passed[0] == sorted(kept)
    assert passed[1] == sorted([(0, "without a nu"), (1, "the very sam"), (6, "word0 word1 "), (7, "another text"), (7, "Ünïcode İi w")])
    assert passed[2] == sorted(x for x in passed[1] if x[1] != "another text") == passed[3]
    text = next(r["text"] for r in spark.read.parquet(f"{folder}/3").collect() if r["doc_id"] == 7)
    assert text == "Ünïcode İi wörds ärë fine to keep and mail [EMAIL] at any time of day"
    assert docs.count() == 4


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
