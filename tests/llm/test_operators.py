"""Training-data operators against brute force, exact round trips and held-out accuracy, on small and odd tables."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from sublode.llm import bpe, common, components, decontam, lm, pii, quality, simhash, substrings, toxicity, warc, wavelet  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, removed int, kept int, row int, data int, spans int, word int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    """Odd texts: null, empty, spaces, copies, near copies, shared passages, repeated lines, a long one, identifiers."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["the", "on", "er", "ß", "in", "É", "ti", "at"]) for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(80), "all rights reserved by nobody in particular today"
    out = [None, "", "  \n\t ", "one", "two words", "a b c", "a b c", "x" * 3000, "ab" * 400, "a\x0bb\x0cc d", "😀 中文 naïve <|endoftext|>"]
    for i in range(25):
        out.append(f"{prose(40)}\n{line}\n{prose(30)}" if i % 3 else f"{prose(30)} {passage} {prose(20)}")
    out += [out[12], out[12], out[12] + " more"] + [out[15].replace(" ", "  ", 1)] + [" ".join(["again and again we say it"] * 9), "\n".join([line] * 5)]
    out.append(prose(15000))
    out.append("mail a.b+c@d-e.f.g or x@y..z, 1.2.3.4.5 and 256.1.1.1; 4111 1111-1111 1111, +1 (234) 567-8901 and + 1; a@b.c_d@e.f")
    out += [f"customer id {rnd.choice('kqz')}{rnd.randint(1000, 9999)} mailbox u{i}@host{i % 3}.example.org writes" for i in range(8)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None, 1, 1, 1, 1, 1, 1) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s0", 1, 1, 1, 1, 1, 1, 1), (3, texts[3], "en", "s0", 1, 1, 1, 1, 1, 1, 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def brute_fingerprint(text, k=3):
    w = WORDS.findall(lower(text))
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts, empty):
    got = by_id(simhash.near_duplicates(docs))
    fps = [brute_fingerprint(t or "") for t in texts]
    assert all(got[i]["fp"] % (1 << 64) == f for i, f in enumerate(fps))
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    assert all(got[i]["component_id"] == label[i] for i in range(len(fps)))
    kept = {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert kept - {None} == set(label) and simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, max_diff=3)


def test_gray_index_finds_every_link(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 300, dtype=np.uint64)
    near = base.repeat(6)
    for k in range(len(near)):
        for b in rnd.integers(0, 64, rnd.integers(0, 4)):
            near[k] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, near, np.array([0, 1, 3], np.uint64)]))
    reps = spark.createDataFrame([(int(f) - (1 << 64) if f >> np.uint64(63) else int(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r["rep"]: r["component"] for r in components.connected(simhash.index_links(simhash.index_rows(reps))).collect()}
    up = simhash.Forest(len(fps))
    for i in range(len(fps)):
        near_to = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)
        up.join(np.full(len(near_to), i), near_to)
    want = up.roots(np.arange(len(fps)))
    assert all(got.get(i, i) == want[i] for i in range(len(fps)))


def test_similar_texts_beyond_two_bits(spark):
    """Every pair within the bit limit whose exact similarity suffices is linked, also when it differs by more than 2 bits."""
    rnd = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randint(0, 9999)}" for _ in range(150)]
        for k in range(6):
            w = list(base)
            for _ in range(k):
                w[rnd.randrange(150)] = "changed"
            texts.append(" ".join(w))
    texts += ["", texts[1].upper()]
    fps = [brute_fingerprint(t, simhash.NEAR_MARK) for t in texts]
    near, like, wide = list(range(len(texts))), list(range(len(texts))), 0
    for _ in range(5):
        for i in range(len(texts)):
            for j in range(i):
                if simhash.jaccard(texts[i].encode(), texts[j].encode(), 5) >= 0.8:
                    like[i] = like[j] = min(like[i], like[j])
                    if (bits := (fps[i] ^ fps[j]).bit_count()) <= simhash.NEAR_DIFF:
                        near[i] = near[j] = min(near[i], near[j])
                        wide += bits > 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = by_id(simhash.similar_components(docs))
    got = [rows[i]["component_id"] for i in range(len(texts))]
    assert wide and all(got[i] == got[near[i]] and like[i] == like[got[i]] for i in range(len(texts)))
    assert got[3 * 6 + 1] == got[3 * 6] and got[-1] == got[1]
    assert {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()} == set(got)


def test_pairs_of_different_parts_come_once(spark):
    """Every pair within the limit, under one upper node only; and with texts of many like ones nothing is lost."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [(base[k % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for k in range(240)]
    masks = simhash.wide_masks(9)
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    rows = simhash.index_rows(reps, masks).selectExpr("*", "rep AS part", f"unhex('{'ff' * (simhash.SKETCH // 8)}') AS sketch", "600L AS size")
    got = [(min(r), max(r)) for r in simhash.index_links(rows, 9, masks, whole=True, twins=True, least=0.8).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for j in range(240) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 9}


def test_marks_of_changed_texts(spark):
    """A bitmap marks every text that it was made from, and few others."""
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    keys = docs.filter("doc_id % 50 = 0 OR doc_id = 3").select(F.col("h").alias("text_key"))
    keys = keys.unionByName(spark.createDataFrame([(0,), (-1,), (1 << 62,), (common.MARKED,)], "text_key long"))
    got = common.marked(docs.unionByName(keys.selectExpr("-1L AS doc_id", "text_key AS h")), keys, F.col("h"), "_x").collect()
    assert all(r["_x"] for r in got if r["doc_id"] == -1 or r["doc_id"] % 50 == 0 or r["doc_id"] == 3) and len(got) == 20_405
    assert sum(r["_x"] for r in got) < 2 * 405 + 60


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(260, 259), (5, 5)]
    got = {r["rep"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 7 for k in range(200, 261)}}


def test_toxicity(spark, empty):
    rnd = random.Random(2)
    plain, rude = [f"w{i}" for i in range(300)], ["scoundrel", "wretch", "villain"]
    rows, labels = [], []
    for i in range(600):
        words, y = [rnd.choice(plain) for _ in range(40)], int(i % 5 == 0)
        if y:
            words[3:3] = rnd.sample(rude, 2)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, y))
    rows += [(600, None), (601, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, 1, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known.filter("doc_id % 3 <> 1 OR doc_id IS NULL"))
    got = by_id(toxicity.score(docs, model))
    held = [i for i in range(600) if i % 3 == 1]
    assert all((got[i]["score"] >= 0.7) == (i % 5 == 0) for i in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[600]["score"] == got[601]["score"] < 0.5
    assert got[10]["neighbours"] and all(n % 3 != 1 for n in got[10]["neighbours"])
    none = toxicity.fit(docs, known.limit(0))
    assert none.prior == 0 and by_id(toxicity.score(docs, none))[0]["score"] == 0
    assert toxicity.score(empty, model).count() == 0


def test_features_by_number(texts):
    vocabulary = sorted({f for t in texts[10:30] for f in toxicity.features(t)})
    counted = toxicity.Counted({f: i for i, f in enumerate(vocabulary)})
    for t in [*texts, "under_score x__y _ a.b,c'd É́tude ΑΣ. ²³½ longestwords longestworded"]:
        want = {f: n for f, n in toxicity.features(t or "").items() if f in counted.number}
        ids, n = counted(t or "")
        assert {vocabulary[i]: k for i, k in zip(ids, n.tolist())} == want and counted.present(t or "") == set(ids.tolist())


def test_block_max_search_is_exact():
    rnd = random.Random(4)
    unit = lambda v: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    vectors = [unit({t: rnd.random() + 0.1 for t in rnd.sample(range(50), rnd.randint(1, 6))}) for _ in range(500)]
    arrays = lambda v: (np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)]))
    for frequent in (0.0, 0.08, 1.0):  # all block columns, some, all posting lists
        index = toxicity.BlockMaxIndex([arrays(v) for v in vectors], 50, frequent=frequent)
        queries = [unit({t: rnd.random() + 0.1 for t in rnd.sample(range(50), 4)}) for _ in range(50)] + [{}]
        for q, (docs, got) in zip(queries, index.search([arrays(q) if q else (np.zeros(0, np.int64), np.zeros(0)) for q in queries], 15)):
            sims = [(round(sum(w * v.get(t, 0) for t, w in q.items()), 9), -i) for i, v in enumerate(vectors)]
            want = sorted((s for s in sims if s[0] > 0), reverse=True)[:15]
            assert [(round(s, 9), -i) for s, i in zip(got, docs)] == want
        own = index.search([arrays(v) for v in vectors[:70]], 3, np.arange(70))
        assert all(i not in docs for i, (docs, _) in enumerate(own))


def test_bpe(docs, texts, empty):
    import tiktoken

    ranks = bpe.load_ranks(BPE)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digests(docs, BPE, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        ids = np.array(model.encode_ordinary(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert by_id(bpe.roundtrip(docs, BPE, public_tokenizers.PATTERN))[10]["decoded"] == texts[10]
    assert bpe.digests(empty, BPE, public_tokenizers.PATTERN).count() == 0


def test_transducer_with_small_tables():
    import tiktoken

    ranks = bpe.load_ranks(BPE)
    model, machine = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}), bpe.Transducer(ranks, 300, 100)
    rnd, tokens = random.Random(1), list(ranks)
    for n in range(1500):
        text = b"".join(rnd.choice(tokens) for _ in range(1 + n % 9)).decode("utf-8", "ignore")
        assert not text or machine.encode(text.encode()) == model.encode_ordinary(text)
    assert machine.encode(b"") == [] and machine.encode(b"a" * 5000) == model.encode_ordinary("a" * 5000)


def test_encoder_tables_are_bounded(monkeypatch):
    """The piece cache keeps its limit inside one text, long pieces are not kept, and a state is a packed string."""
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bpe, "MAX_PIECES", 600)
    monkeypatch.setattr(bpe, "SLICE", 50)
    encoder = bpe.Encoder(BPE, public_tokenizers.PATTERN, 3)
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.machine.ranks, special_tokens={})
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdeé漢") for _ in range(6)) for _ in range(3000)) + " " + "xy" * 3000
    assert encoder.encode(text) == np.array(model.encode_ordinary(text), "<u4").tobytes()
    assert len(encoder.cache) < 250 and len(encoder.cache.old) < 250 and max(map(len, [*encoder.cache, *encoder.cache.old])) <= 64
    assert (encoder.machine.max_transitions, encoder.machine.max_pairs) == (bpe.MAX_TRANSITIONS // 3, bpe.MAX_PAIRS // 3)
    assert all(type(x) is bytes for x in encoder.machine.states)


def test_utf8_stream():
    rnd, data = random.Random(6), "añ中😀\u0000é".encode() * 5 + b"\xff\xe4\xb8" + b"ok\xf0\x9f"
    for _ in range(50):
        stream, at, out = bpe.Utf8Stream(), 0, ""
        while at < len(data):
            n = rnd.randint(1, 5)
            out += stream.feed(data[at : at + n])
            at += n
        assert out + stream.close() == data.decode("utf-8", "replace")


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, x, ok in kinds for m in re.finditer(x, text) if ok(m[0])]


def test_pii(docs, texts, empty):
    got = by_id(pii.find_pii(docs))
    for i, t in enumerate(texts):
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in got[i]["spans"] if s["base"]] == base_spans(t or "")
    clean = by_id(pii.redact(docs))
    mail = clean[len(texts) - 1]["text"]
    assert "[EMAIL]" in mail and "@" not in mail and clean[len(texts) - 1]["n_chars"] == len(mail) and clean[0]["text"] is None
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0


def test_pii_discovers_by_context(spark):
    rows = [(i, f"please write to mailbox user{i}@site{i}.org quickly now") for i in range(20)] + [(99, "please write to mailbox joe77[at]home quickly now"), (98, "chapter 12 verse 3 of something else")]
    got = by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")))
    found = [s for s in got[99]["spans"]]
    assert len(found) == 1 and not found[0]["base"] and rows[20][1][found[0]["start"] : found[0]["end"]] == "joe77[at]home" and got[98]["spans"] == []


def test_warc(spark):
    rows = [(1, "http://a/é x", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "ü" * 50_000), (None, "u", "same"), (6, "u\r\nX: y", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.roundtrip(pages).collect()}
    for p, _, h in rows:
        b = (h or "").encode()
        assert got[p]["payload_bytes"] == len(b) and got[p]["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    again = warc.roundtrip(pages, min_bytes=10)
    assert all(r["record_type"] == "response" for r in again.collect())
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.make_record(1, "u", b"x" * 200_000) + warc.make_record(2, "v", b"y")
    assert [h["x-page-id"] for h, _, _ in warc.read_records(io.BytesIO(good), 100)] == ["1", "2"]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-9])))
    raw = zlib.decompress(warc.make_record(1, "u", b"abc"), 31)
    for bad in (raw.replace(b"abc", b"abd"), raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabcd")):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(pack.compress(bad) + pack.flush())))


def test_lm(docs, texts, empty):
    training = docs.filter("doc_id % 7 <> 2 OR doc_id IS NULL")
    got = by_id(lm.lm_scores(docs, training, WORD, head_words=20))
    count, tokens = Counter(), lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    for r in training.collect():
        count.update(tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        w, r = tokens(t), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r["score"] < 0
    none = by_id(lm.lm_scores(docs, empty, WORD))
    assert none[0]["train_tokens"] == 0 and none[0]["base_score"] == 0 and none[0]["n_known"] == 0
    assert lm.lm_scores(empty, training, WORD).count() == 0


def test_attention_model():
    rng = np.random.default_rng(0)
    texts = [np.tile(rng.permutation(900)[:60] if k % 2 else np.arange(60), 6) for k in range(6)]
    model = lm.AttentionModel(np.bincount(np.concatenate(texts), minlength=lm.IDS))
    drawn = np.concatenate([np.lib.stride_tricks.sliding_window_view(t, lm.WINDOW + 1) for t in texts])
    model.set_classes(drawn)
    assert (np.bincount(model.group, minlength=lm.GROUPS) == np.diff(model.first)).all() and model.cls.max() < lm.CLASSES
    share = np.bincount(model.cls, np.exp(model.log_share))
    assert share[share > 0] == pytest.approx(1, rel=1e-4)  # an id's shares of its class add up to one
    rows, ids, use = model.windows(texts)
    loss, g = model.gradients(rows[:4], model.cls[ids[:4]], use[:4])
    for name in g:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        held, h = model.p[name][at], 1e-5
        model.p[name][at] = held + h
        more = model.gradients(rows[:4], model.cls[ids[:4]], use[:4])[0]
        model.p[name][at] = held - h
        less = model.gradients(rows[:4], model.cls[ids[:4]], use[:4])[0]
        model.p[name][at] = held
        assert g[name][at] == pytest.approx((more - less) / (2 * h), rel=1e-3)
    losses = model.fit(drawn, 60)
    assert losses[-1] < losses[0]
    flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    want = brute_scores(model, texts)
    assert use.sum() == len(flat)  # every id is scored once
    model.freeze()
    assert model.score(flat, lengths) == pytest.approx(want, rel=1e-4)
    assert model.score(flat, lengths) == pytest.approx(model.score(flat, lengths, chunk=3), rel=1e-5)


def brute_scores(model, texts):
    """log10 probabilities id by id: attention over the window's ids before it, all groups, all classes of the group."""
    p, out, stride = model.p, [], lm.WINDOW - lm.CONTEXT
    for ids in texts:
        total = 0.0
        for i, t in enumerate(ids.tolist()):
            first = i // stride * stride - lm.CONTEXT  # the window that scores position i
            x = []
            for j in range(first, i + 1):
                before = model.start if j < 1 else model.row[ids[j - 1]]
                x.append(p["E"][before] + p["P"][j - first])
            x = np.array(x)
            a = np.exp((x[-1] @ p["Q"]) @ (x @ p["K"]).T / math.sqrt(lm.WIDTH))
            h = x[-1] + (a / a.sum()) @ (x @ p["V"]) @ p["O"]
            g = model.group[model.cls[t]]
            z, own = h @ p["U"] + p["b"], np.flatnonzero(model.group == g)
            y = h @ p["W"][:, own] + p["c"][own]
            total += z[g] - np.log(np.exp(z).sum()) + y[model.cls[t] - own[0]] - np.log(np.exp(y).sum()) + model.log_share[t]
        out.append(total / math.log(10))
    return np.array(out)


def test_lm_learns_from_whole_texts(spark):
    """Word counts are whole, and windows are drawn from every part of every text, in proportion to the share."""
    rows = [(i, "common words come first " * 400 + f"quaint zebra {i} " * 300) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.gather(train, WORD).collect()
    counts = Counter()
    for r in got:
        if r["word"] is not None:
            counts[bytes(r["word"])] += r["n"]
    assert counts == Counter(w for _, t in rows for w in t.encode().split())
    drawn = np.frombuffer(b"".join(bytes(r["drawn"]) for r in got if r["word"] is None), np.uint16).reshape(-1, lm.WINDOW + 1)
    encoder = wavelet.CachedEncoder(WORD)
    late, end = encoder.encode_batch([b"zebra"])[0].tolist()
    assert len(drawn) == sum(len(t.split()) // lm.STRIDE_WORDS + 1 for _, t in rows) and (drawn == late).any() and (drawn == end).sum() >= 40
    data = rows[0][1].encode()
    words, ids = data.split(), encoder.encode_batch([rows[0][1].encode()])[0].tolist()
    for share in (1 / 8, 1 / 2):
        some = [x for m in range(30) for x in lm.draw_windows(data, lm.draw_places(len(words), 12345 * m, share), encoder.encode_batch)]
        assert 0.7 * share < len(some) / (30 * (len(words) // lm.STRIDE_WORDS + 1)) < 1.3 * share and any(late in x for x in some)
    text = " ".join(map(str, ids))
    assert all(" ".join(str(t) for t in x if t != lm.NONE) in text for x in lm.draw_windows(data, lm.draw_places(len(words), 1, 1.0), encoder.encode_batch))
    assert lm.train_share(10) == 1 and lm.train_share(10**12) * 10**12 > 8 * lm.train_share(10**9) * 10**9


def test_lm_trains_on_every_window(spark, monkeypatch):
    """Neighbours and weights come from all training texts, also where the driver starts from no window at all."""
    from pyspark.sql import functions as F

    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(words[(i + k) % 40] for k in range(90)) + " ünï" * (i % 3)) for i in range(600)]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    ids = lm.encoded(train.selectExpr("doc_id", "true AS train", "CAST(text AS binary) AS data"), WORD).select("ids").localCheckpoint()
    flat = [np.frombuffer(bytes(r["ids"]), np.uint16).astype(np.int64) for r in ids.collect()]
    encoder = wavelet.CachedEncoder(WORD)
    assert sorted(map(tuple, flat)) == sorted(tuple(encoder.encode_batch([t.encode()])[0].tolist()) for _, t in rows)
    counts = np.bincount(np.concatenate(flat), minlength=lm.IDS)
    want = sum(lm.neighbour_table(counts, x[None, :]) for x in flat[:20])
    some = spark.createDataFrame([(bytes(x.astype(np.uint16).tobytes()),) for x in flat[:20]], "ids binary").repartition(3)
    assert (lm.neighbours(some, counts) == want).all()
    model = lm.AttentionModel(counts)
    model.group_ids(lm.neighbours(ids, counts))
    before, texts = {k: x.copy() for k, x in model.p.items()}, model.windows(flat[:5])
    loss = lambda: model.gradients(texts[0], model.cls[texts[1]], texts[2])[0]
    first = loss()
    assert lm.train(model, ids) == sum(-(-len(x) // lm.WINDOW) for x in flat)
    assert loss() < first - 0.01 and all((model.p[k] != before[k]).any() for k in before)
    assert lm.train(model, ids.limit(0)) == 0
    monkeypatch.setattr(lm, "train_share", lambda size: 0.0)
    trained = lm.lm_scores(train, train, WORD)
    same = lm.lm_scores(train, F.col("doc_id") >= 0, WORD)
    monkeypatch.setattr(lm, "train", lambda model, ids: 0)
    start = lm.lm_scores(train, train, WORD)
    total = lambda t: t.agg(F.sum("score")).first()[0]
    assert total(trained) > total(start) + 100 and total(same) > total(start) + 100


def test_lm_neighbours_in_bounded_memory():
    """Adding a batch's neighbours takes less than two tables of the table's own size, and gives the same counts."""
    import tracemalloc

    rng = np.random.default_rng(3)
    counts, a, b = rng.integers(0, 90, lm.IDS), rng.integers(0, lm.IDS, 5000), rng.integers(0, lm.IDS, 5000)
    place, want = lm.near_places(counts), np.zeros((lm.IDS, 2 * (lm.NEAR + 1)), np.int64)
    np.add.at(want, (b, place[a]), 1)
    np.add.at(want, (a, lm.NEAR + 1 + place[b]), 1)
    tracemalloc.start()
    got = lm._beside(place, a, b, lm.IDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 2 * got.nbytes


def test_quality(docs, texts, empty):
    got = by_id(quality.quality(docs, min_docs=5, share=0.0))
    for i, t in enumerate(texts):
        t = t or ""
        w, where, seen, dup, cov = WORDS.findall(t), {}, set(), 0, set()
        for k in range(len(w) - 4):
            where.setdefault(tuple(w[k : k + 5]), []).append(k)
        for v in where.values():
            if len(v) > 1:
                for k in v:
                    cov.update(range(k, k + 5))
        for x in t.split("\n"):
            if WORDS.search(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cov) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    line = next(i for i, t in enumerate(texts) if t and "all rights" in t and len(t) < 500)
    assert got[line]["removed_words"] == 8 and got[line]["kept"]
    assert quality.quality(empty).count() == 0 and quality.clean(empty).count() == 0
    assert quality.clean(docs).columns == docs.columns


def test_boilerplate_by_share_on_small_hosts(spark):
    """A line on a fifth of a small host's pages is boilerplate for the pipeline, whatever the size of the table."""
    line = "all rights reserved by nobody in particular"
    text = lambda h, i: " ".join(f"{h}w{i}x{k}" for k in range(20)) + (f"\n{line}" if i % 5 == 0 else "")
    for n in (60, 240):
        docs = spark.createDataFrame([(1000 * h + i, text(h, i), f"h{h}") for h in range(2) for i in range(n)], "doc_id long, text string, source string")
        assert all(line not in r["text"] for r in quality.clean(docs).collect())
        assert quality.removed(docs).first().asDict() == {"lines": 2, "docs": 2 * n // 5, "words": 2 * n // 5 * 7, "depleted": 0}


def test_depleted(spark):
    boiler = "this line is on every page of the site forever"
    rows = [(i, f"{boiler}\nanother footer that nobody reads but all pages show\nown words {i}", "h") for i in range(30)] + [(99, boiler + "\n" + " ".join(f"w{k}" for k in range(40)), "h")]
    got = by_id(quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10, 0.1))
    assert not got[0]["kept"] and not got[0]["base_failed"] and got[99]["kept"] and got[99]["removed_words"] == 10


BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    w, hit, found = BENCH_WORDS.findall(lower(text or "")), set(), set()
    for item, t in items:
        q = BENCH_WORDS.findall(lower(t or ""))
        for k in range(max(1, len(q) - 9) if q else 0):
            win = q[k : k + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def test_decontamination(spark, docs, texts, empty):
    a, b = texts[11].split(), texts[14].split()
    items = [(1, " ".join(a[5:25])), (2, " ".join(b[0:9])), (10, None), (11, "..."), (12, "again"), (3, " ".join(a[5:25]).upper()), (None, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 1):
        got = by_id(decontam.decontaminate(docs, bench, block_words=block))
        for i, t in enumerate(texts):
            n, hit, found = brute_hits(t, [x for x in items if x[0] is not None])
            assert (got[i]["n_words"], list(got[i]["hit"]), list(got[i]["items"])) == (n, hit, found)
    assert all(not r["items"] for r in decontam.decontaminate(docs, bench.limit(0)).collect())
    assert decontam.decontaminate(empty, bench).count() == 0 and decontam.clean(docs, bench).columns == docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "a b c d zz e f g h i j"), (3, "j i h g f e d c b a")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    got = by_id(decontam.decontaminate(docs, bench, slop=1, share=0.8))
    assert (got[1]["items"], got[1]["near"], got[2]["items"], got[2]["near"], got[3]["near"]) == (["7"], [], [], ["7"], [])


def test_wavelet_output(docs, texts, empty):
    from tokenizers import Tokenizer

    model, at = Tokenizer.from_file(WORD), 0
    rows = wavelet.token_output(docs, WORD).collect()
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))
    for r in order:
        t = "no id here" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert wavelet.token_output(empty, WORD).count() == 0


def test_wavelet_matrix():
    rnd = np.random.default_rng(1)
    ids = rnd.choice(np.array([2, 3, 700, 49_407, 65_535], np.uint16), 3000)
    s = wavelet.WaveletShard(wavelet.dump_shard([5, None], np.array([1000, 2000]), ids))
    assert (s.ids() == ids).all() and s.doc_ids == [5, None]
    assert all(s.access(i) == ids[i] for i in range(0, 3000, 37))
    for t in (2, 700, 65_535, 9):
        where = np.flatnonzero(ids == t)
        assert s.count(t) == len(where) and s.rank(t, 1234) == (where < 1234).sum()
        assert s.locate(t)[:40] == where[:40].tolist() if t == 9 else s.select(t, 5) == where[5]
    with pytest.raises(IndexError):
        s.select(9, 0)
    with pytest.raises(ValueError):
        wavelet.WaveletShard(b"nothing")


def brute_removed(blobs, n=200):
    count = Counter(b[i : i + n] for b in blobs for i in range(len(b) - n + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def test_repeats(spark, docs, texts, empty):
    more = docs.collect()
    blobs = [(r["text"] or "").encode() for r in more]
    want = Counter((r["doc_id"], len(b), int(g.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for r, b, g in zip(more, blobs, brute_removed(blobs)))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect())
    assert got == want
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_at_every_offset(spark):
    """Near copies whose differences stand at all distances, periodic texts, and passages of just under and over 200 bytes."""
    rnd = random.Random(9)
    raw = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    base, p199, p200 = raw(900), raw(199), raw(200)
    texts = [base[:k] + "#" + base[k + 1 :] for k in range(0, 900, 61)] + [raw(50) + p199 + raw(60), raw(70) + p199 + raw(9), p200 + raw(300), raw(300) + p200, raw(5) + p200 + "!"]
    texts += ["xy" * 200, "z" * 450, "xy" * 150 + raw(100), base[100:420] + base[300:620]]
    blobs = [t.encode() for t in texts]
    got = by_id(substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, (b, g) in enumerate(zip(blobs, brute_removed(blobs))):
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept"]) == (int(g.sum()), spans, bytearray(np.frombuffer(b, np.uint8)[~g].tobytes()))


def test_samples_in_long_texts(monkeypatch):
    """Every window start belongs to one sample, whatever the size of a chunk."""
    rnd = random.Random(3)
    data = bytes(rnd.choice(b"abc ") for _ in range(5000))
    for chunk in (1 << 20, 700):
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        starts = [s for x, a, b, _ in substrings.samples(data) for s in range(a, b)]
        assert starts == list(range(len(data) - 199)) and all(a <= x and b - 1 <= x < a + 169 for x, a, b, _ in substrings.samples(data))
