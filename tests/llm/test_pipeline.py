"""The pipeline's stages against a plain version of each."""

import re

import pyarrow as pa
from pyspark.sql import functions as F
from test_similar import brute_roots, word_sets
from test_text_operators import ODD, PRIVATE, brute_base, brute_grade, brute_language

import corpus_pipeline
from silt.llm import langid, packing, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10_000 + i, t, None if i % 2 else "en", "odd", None) for i, t in enumerate(ODD + PRIVATE)] + [(None, "the of and is", "en", None, 1), (10_001, "the of and is", "en", None, 1)]
    return docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, SCHEMA)).repartition(4, "text").cache()


def ids(df):
    return sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.select("doc_id").collect())


def test_quality_stage(spark, sf):
    docs = documents(spark, sf)
    model = quality.fit(docs, queries.grades(spark.read.parquet(f"{sf}/labels.parquet")), 3)
    want = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.collect() if brute_grade(model, r["text"])[1] >= 0.5)
    got = corpus_pipeline.quality_stage(spark, docs, sf)
    assert got.columns == docs.columns and ids(got) == want


def test_language_stage(spark, sf):
    docs = documents(spark, sf)
    model = langid.fit(docs)
    named = [(-1 if r["doc_id"] is None else r["doc_id"], *brute_language(model, r["text"])) for r in docs.collect()]
    got = corpus_pipeline.language_stage(spark, docs, sf)
    assert got.columns == docs.columns and ids(got) == sorted(i for i, lang, s in named if lang != "und" and s >= 0.5)
    assert ids(corpus_pipeline.language_stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf)) == ids(docs)


def test_near_duplicate_stage(spark, sf):
    docs = documents(spark, sf).filter("doc_id is null or doc_id <> 10001 or text = 'the of and is'")
    _, roots = brute_roots(word_sets([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]))
    got = corpus_pipeline.near_duplicate_stage(spark, docs.union(docs.filter("doc_id = 3")), sf)
    assert ids(got) == sorted([i for i, low in roots.items() if i == low] + [-1])


def test_personal_data_stage(spark, sf):
    docs = documents(spark, sf)
    got = corpus_pipeline.personal_data_stage(spark, docs, sf)
    assert ids(got) == ids(docs) and got.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.collect():
        assert (r["text"] is None) == (r["doc_id"] is not None and r["doc_id"] != 10_001 and before[r["doc_id"]] is None)
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"]) and not re.search(r"(email|card):", brute_base(r["text"]))


def test_packing_stage(spark, sf):
    docs = documents(spark, sf)
    got = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    table = packing.word_table(queries.WORD_TOKENIZER)
    texts = [r["text"] or "" for r in docs.collect()]
    flat, _ = packing.token_ids(pa.array(texts, pa.large_string()), table)
    assert sum(r["length"] for r in got) == len(flat) + len(texts)
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096 and len(used) <= sum(used.values()) / 4096 * 1.02 + 1


def test_run_on_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").filter("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_worker_keeps_few_words():
    """More distinct words than a worker keeps: ids as by the tokenizer, and the table stays small."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from silt.llm import packing
    from silt.llm.queries import WORD_TOKENIZER

    known = packing.word_table(WORD_TOKENIZER)
    known.clear()
    texts = [" ".join(f"w{i * 3000 + k:x}" for k in range(3000)) for i in range(50)]
    for text in texts:
        ids, bounds = packing.token_ids(pa.array([text], pa.large_string()), known)
        assert len(known.at) <= 100_000
    assert ids.tolist() == Tokenizer.from_file(WORD_TOKENIZER).encode(texts[-1], add_special_tokens=False).ids
