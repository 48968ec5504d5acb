"""Queries asked from every row of their query side."""

import duckdb
from pyspark.sql import functions as F

from silt.plans.catalogue import ORACLE, QUERIES


def test_every_row_asks(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    n = orders.count()
    assert QUERIES["slot_asof_join"](spark, sf).select("ask_id").distinct().count() == n
    sizes = orders.groupBy("o_custkey").count().agg(F.sum(F.expr("count * (count + 1) div 2"))).first()[0]
    assert QUERIES["derived_closure"](spark, sf).count() == sizes
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    asks = {r["vec_id"] for r in vectors.filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r["qid"] for r in QUERIES["cosine_topk"](spark, sf).collect()} == asks and max(asks) >= 20
    spark.createDataFrame([(7, "only the last word tells, whatever came long before: zeppelin", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "b1 b2 b3 b4 b5 b6 b7 b8 b9 zeppelin")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("bm25_search", "recall_score"):
        assert [(r["qid"], r["id"]) for r in QUERIES[name](spark, str(tmp_path)).collect()] == [(3, 7)]


def test_every_word_of_a_long_query_asks(spark, tmp_path):
    """The hundredth word of a query counts like its first, as in SQL."""
    words = [f"q{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(100)]
    held = [(1, words[-1]), (2, words[0]), (3, f"{words[80]} {words[3]}"), *((n, "nothing of it") for n in range(4, 12))]
    spark.createDataFrame([(i, t, "en", "s") for i, t in held], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, " ".join(words))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("bm25_search", "recall_score"):
        got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert {r[2] for r in got} == {1, 2, 3} and got == sorted(con.sql(ORACLE[name]).fetchall())
