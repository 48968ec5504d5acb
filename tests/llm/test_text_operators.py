"""PII, pieces, packing, SimHash, licences and languages against brute force on odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from silt.llm import langid, licenses, packing, pieces, pii, quality, queries, simhash
from silt.llm.common import hash_sample

ODD = [None, "", " ", "  a", "a  b ", "\n", "\n\nfoo\n", "▁x ▁", "é😀 ö", "<s> </s>", "x" * 3000, " " * 50, "\x00a b", "Σ ΑΣ. İx", "'S don't IT'S", "\ue000 a"]
PRIVATE = [
    "a@b.c_d@e.f x@y..z @no a@b one.two@three.example.com, a@b.c@d.e",
    "1.2.3.4.5 256.1.1.1 0001.2.3.4 1.2.3 10.0.0.255 99999999999.1.1.1 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 x 4111111111111112 4111-1111-1111-1111 0000000000000 " + "1" * 400,
    "+1 (555) 010-9999 +49 30 1234567 +1 +123456789012345678 tel +1.2.3.4.5.6.7.8.9",
    "iban DE89 3704 0044 0532 0130 00 and DE88370400440532013000, ssn 123-45-6789 or 000-45-6789",
    'token = "24be64439e3e49cf46b2d7c90f3602a3" ' + "a" * 5000 + "@" + "b" * 10,
    "😀 a@b.co 😀 +12345678901",
]


def rows_of(spark, texts):
    schema = "doc_id long, text string, kept string, id long, pos int"
    return spark.createDataFrame([(i, t, "k", -i, 1) for i, t in enumerate(texts)], schema).repartition(3)


def brute_base(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0

    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_base_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = ODD + PRIVATE + [r["text"] for r in docs.collect()]
    found = pii.find(rows_of(spark, texts))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii.listing(F.col("pii"), queries.BASE_KINDS).alias("s")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute_base(t), (t or "")[:80]


def test_pii_own_kinds_and_redaction(spark):
    out = {r["doc_id"]: r for r in pii.redact(rows_of(spark, PRIVATE + [None, ""])).collect()}
    kinds = lambda i: [s["kind"] for s in out[i]["pii"]]
    assert kinds(4).count("iban") == 1 and kinds(4).count("ssn") == 1
    assert "secret" in kinds(5)
    assert out[7]["text"] is None and out[8]["text"] == ""
    assert out[6]["text"] == "😀 <email> 😀 <phone>"
    again = pii.find(rows_of(spark, [out[i]["text"] for i in range(7)]))
    left = again.select(F.explode("pii.kind").alias("kind")).collect()
    assert not [r for r in left if r["kind"] in ("email", "card", "iban", "secret")]
    assert pii.find(rows_of(spark, [])).count() == 0


def test_ibans_before_words(spark):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 500 EUR", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "DE8937040044053201300", "XX89370400440532013000"]
    got = {r["doc_id"]: r["text"] for r in pii.redact(rows_of(spark, texts)).collect()}
    assert [got[i] for i in range(5)] == ["<iban> BIC COBADEFF", "<iban> 500 EUR", "<iban> <iban>", texts[3], texts[4]]
    after = pii.find(rows_of(spark, ["123-45-6789 is my SSN", "123-45-6789 is my number"])).select("doc_id", F.size("pii").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in after} == {0: 1, 1: 0}


def test_very_many_spans(spark):
    """A hundred thousand addresses in one text, and overlapping spans across blocks and parts."""
    text = " ".join(f"é{i} u{i}@x{i}.org +4930{i:07d}" for i in range(100_000))
    small = " ".join(f"😀 u{i}@x.org +49 30 {i:07d} 10.0.0.{i % 300} 4111 1111 1111 1111" for i in range(700))
    out = {r["doc_id"]: r for r in pii.redact(rows_of(spark, [text, small])).select("doc_id", "text", F.size("pii").alias("n"), pii.listing(F.col("pii"), queries.BASE_KINDS).alias("s")).collect()}
    assert out[0]["n"] == 200_000 and out[0]["text"] == " ".join(f"é{i} <email> <phone>" for i in range(100_000))
    assert out[1]["s"] == brute_base(small)
    spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in out[1]["s"].split(",")))
    want, at = "", 0
    for a, b, k in spans:
        if a >= at:
            want += small[at:a] + f"<{k}>"
        at = max(at, -b)
    assert out[1]["text"] == want + small[at:]


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ▁ab\n😀é<s>") for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    got = {r["doc_id"]: r for r in pieces.encode_decode(rows_of(spark, texts), queries.PIECE_MODEL).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == model.decode(ids), t
    assert pieces.encode_decode(rows_of(spark, []), queries.PIECE_MODEL).count() == 0


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["same words here"] * 50
    out = packing.pack(rows_of(spark, texts), queries.WORD_TOKENIZER, 2, 512).collect()
    sums = packing.pack(rows_of(spark, texts), queries.WORD_TOKENIZER, 2, 512, "crc32").collect()
    docs, sequences = {}, {}
    for r in out:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(docs[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids and {r["doc_tokens"] for r in own} == {len(ids)}
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in out)
    assert len(sequences) <= total / 512 * 1.02 + 1
    assert sorted(r["crc32"] for r in sums) == sorted(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)


def test_plan_uses_every_length():
    rng = random.Random(2)
    for window in (16, 64, 257):
        histogram = {}
        for _ in range(rng.randrange(1, 400)):
            n = rng.randrange(1, window + 1)
            histogram[n] = histogram.get(n, 0) + 1
        plan, used = packing.plan_windows(histogram, window), {}
        for repeats, items in plan:
            assert sum(n * c for n, c in items) <= window
            for n, c in items:
                used[n] = used.get(n, 0) + repeats * c
        assert used == histogram
    assert packing.plan_windows({}, 8) == []


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {ids[i]: low[find(i)] for i in range(len(fps))}


@pytest.mark.parametrize("group", [256, 2])
def test_simhash_groups(spark, sf, group):
    texts = [t for t in ODD if t != "x" * 3000] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(rows_of(spark, texts), group=group).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert {i: got[i]["component_id"] for i in got} == brute_components(fps, list(range(len(texts))), 2)


@pytest.mark.parametrize("group", [256, 3])
def test_simhash_links_lose_nothing(spark, group):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from silt.llm.common import components

    got = {r["node"]: r["root"] for r in components(simhash.link_edges(df, 2, group)).collect()}
    want = brute_components(fps, signed, 2)
    assert {f: got.get(f, f) for f in signed} == want


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


def test_license_phrases(spark, sf):
    texts = ODD + ["Under the MIT license, under the mit license", "cc by nc cc by nc cc by-nc", "the Apache License, Version 2", "under the mit", "CC_BY_NC été cc by nc" + " x" * 5000 + " Apache License Version 2", licenses.NOTICES["bsd"].replace("binary", "the binary")]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in licenses.scan(rows_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, places = brute_phrases(t)
        assert got[i]["n_words"] == n
        assert sorted((s["first"], s["label"]) for s in got[i]["spans"] if s["phrase"]) == places, t
    assert [s["label"] for s in got[len(ODD) + 5]["spans"]] == ["bsd"]


def brute_language(model, text):
    """Language and score of one text, word by word."""
    words = re.findall(r"[^\W\d_]+", pc.utf8_lower(text or "").as_py())  # letter by letter, no final sigma
    words = [w for w in ("".join(c if c.isalpha() else " " for c in w) for w in words) for w in w.split()]
    if not words or not model.langs:
        return "und", 0.0
    total = np.zeros(len(model.langs))
    for w in words:
        if w in model.words:
            total += model.logs[model.words[w]]
            continue
        for n in range(5, 0, -1):
            marked = f"<{w}>"
            found = [model.grams[g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in model.grams]
            if found:
                total += model.logs[found].mean(axis=0)
                break
    odds = np.exp((total - total.max()) / np.sqrt(len(words)))
    return model.langs[int(odds.argmax())], odds.max() / odds.sum()


@pytest.fixture(scope="module")
def many(spark, sf):
    """Documents and labels of a larger table, if the driver has one beside this."""
    import os

    at = next(d for d in (sf.replace("sf0.001", "sf0.01"), sf) if os.path.isdir(d))
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_language_held_out(spark, many):
    df = many[0].select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.fit(df.filter(~held))
    out = langid.identify(df.filter(held), model, keep=["lang", "text"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    for r in out[:150]:
        lang, score = brute_language(model, r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6
    texts = [None, "", "123 $$", "½ ² ① Ⅷ", "the", "the ½", "x" * 2_000_000, "the of " * 300_000]
    odd = {r["doc_id"]: r for r in langid.identify(rows_of(spark, texts), model).collect()}
    assert [odd[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[7]["lang_pred"] == "en"
    twice = spark.createDataFrame([(None, "the"), (1, "the"), (1, "the")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(twice, model).collect()] == ["en"] * 3
    assert langid.identify(twice.limit(0), model).count() == 0
    empty = langid.fit(df.filter("false"))
    assert {r["lang_pred"] for r in langid.identify(df.limit(3), empty).collect()} == {"und"}


def test_languages_of_equal_odds(spark):
    model = langid.fit(spark.createDataFrame([("aa bb", "y"), ("aa bb", "x")], "text string, lang string"))
    out = langid.identify(spark.createDataFrame([(1, "aa zz")], "doc_id long, text string"), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("x", 0.5)]


def test_a_table_of_one_text_still_gives_a_sample(spark):
    """Five sixths of the rows have one text: it counts once, the others are sampled as if it weren't there."""
    rows = [(f"text number {i}",) for i in range(2000)] + [("the common one",)] * 10_000
    df = spark.createDataFrame(rows, "text string").repartition(7)
    got = hash_sample(df, 500, "text")
    names = [r["text"] for r in got.collect()]
    assert 350 <= len(names) <= 500 and len(set(names)) == len(names)
    assert sorted(names) == sorted(r["text"] for r in hash_sample(df.repartition(3), 500, "text").collect())
    assert hash_sample(df, 3000, "text").count() == 2001 and hash_sample(df.limit(0), 10, "text").count() == 0


def brute_grade(model, text):
    """Expected grade and tail probability of one text, token by token."""
    tokens = (text or "").split()
    ends = quality._ENDS
    score = 0.0
    if tokens:
        words = [t.strip(ends) for t in tokens]
        places = {int(b) for w in set(words) for b in quality.hashed(pa.array([w.lower()]), *quality.OPENINGS)[0]}
        traits = [3 if not w else 2 if len(t) - len(t.rstrip(ends)) >= 2 else 1 if len(w) > 1 and w.isupper() else 0 for t, w in zip(tokens, words, strict=True)]
        lows = quality.hashed(pa.array([w.lower() for w in words]))[:, 0].tolist()
        again = sum(a == b for a, b in zip(lows, lows[1:], strict=False)) / max(1, len(lows) - 1)
        score = 0.5 * model.weights[sorted(places)].sum(dtype=np.float64)
        score += float(np.dot(model.weights[list(quality.TRAITS)], [4 * traits.count(k) / len(tokens) for k in (1, 2, 3)] + [4 * again, 0.5]))
    if not len(model.thresholds):
        return 0.0, 1.0
    above = 1 / (1 + np.exp(model.thresholds - score))
    return above.sum(), above[-1]


def test_quality_held_out(spark, many):
    docs, labels = many[0].select("doc_id", "text"), many[1]
    graded = queries.grades(labels)
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = quality.fit(docs, graded.filter(~fold), 3)
    assert (np.diff(model.thresholds) > 0).all()
    out = quality.score(docs.join(graded.filter(fold), "doc_id"), model).toPandas()
    share = out.groupby("grade")["accepted"].mean()
    assert share[0] < 0.1 and share[2] > 0.95
    assert out["expected_grade"].between(0, 2).all()
    for r in out.itertuples():
        assert np.allclose(brute_grade(model, r.text), (r.expected_grade, r.tail_prob), atol=1e-5)
    odd = quality.score(rows_of(spark, ODD + ["word! " * 400_000]).withColumn("none", F.lit(1)), model)
    assert odd.filter("kept = 'k' and none = 1 and id = -doc_id").count() == len(ODD) + 1 and odd.columns[:6] == ["doc_id", "text", "kept", "id", "pos", "none"]
    assert quality.score(docs.limit(0), model).count() == 0
    twice = quality.fit(docs.union(docs), graded.filter(~fold).union(graded.filter(~fold)), 3)
    assert np.allclose(twice.weights, model.weights)
    none = quality.fit(docs, graded.filter("false"), 3)
    assert quality.score(docs.limit(5), none).filter("accepted").count() == 5


def test_hash_is_stable():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
    assert brute_fingerprint("") == 0
