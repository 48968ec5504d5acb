"""Queries over memories in every language, and without a language."""

from silt.plans.catalogue import QUERIES


def test_every_language_is_searched(spark, tmp_path):
    rows = [(1, "Der gelbe Zug steht", "de", "s"), (2, "der gelbe Zug steht.", None, "s"), (3, "a red train", "en", "s"), (4, "nothing here", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "gelbe Zug red")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {q: QUERIES[q](spark, str(tmp_path)).collect() for q in ("content_hash_dups", "scratch_clusters", "bm25_search", "recall_score")}
    assert [(r["n"], r["first_id"]) for r in got["content_hash_dups"]] == [(2, 1)]
    assert [(r["n_sessions"], r["n_sources"]) for r in got["scratch_clusters"]] == [(2, 2)]
    assert {r["id"] for r in got["bm25_search"]} == {r["id"] for r in got["recall_score"]} == {1, 2, 3}
