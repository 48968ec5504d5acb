"""The corpus pipeline: quality, language, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silt.llm import langid, packing, pii, quality, simhash
from silt.llm.common import cut, small, table
from silt.llm.queries import WORD_TOKENIZER, grades

#: A document stays if its language has at least this share of the odds.
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likelier than not."""
    model = quality.fit(docs, grades(table(spark, sf_dir, "labels")), grades=3)
    return quality.score(docs, model).filter("accepted").select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter go. All stay if no document says its language."""
    model = langid.fit(docs)
    if not model.langs:
        return docs
    numbered = docs.toDF(*[f"{c}" if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)])
    named = langid.identify(numbered, model, keep=[c for c in numbered.columns if c != "doc_id"])
    stays = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return named.filter(stays).select(numbered.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of 0.8 or more: that with the smallest id.

    Texts without a word are one group. Rows of one id are told apart by their
    text; of rows with equal id and text the first by its other columns stays.
    Documents without an id can't be named and stay.
    """
    groups = simhash.similar_documents(docs, shingle=5, tenths=8).groupBy("doc_id", F.col("text_hash").alias("__hash"))
    groups = cut(groups.agg(F.max("leads").alias("leads"), F.count("*").alias("n")))
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    kept = hashed.join(small(groups.filter("not leads or n > 1").select("doc_id", "__hash")), ["doc_id", "__hash"], "left_anti")
    again = groups.filter("leads and n > 1").select("doc_id", "__hash")
    if not again.isEmpty():  # rows of equal id and text are brought together, no others
        others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        first = F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy(*others, F.lit(0)))
        kept = kept.union(hashed.join(small(again), ["doc_id", "__hash"], "left_semi").withColumn("__first", first).filter("__first = 1").select(kept.columns))
    return kept.select(docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    out = pii.redact(docs, "text", "__pii")
    length = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(length).select(docs.columns) if length else out.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in windows of 4,096 ids."""
    out = packing.pack(docs, WORD_TOKENIZER, end_id=2, window=4096, payload="crc32")
    return out.select("doc_id", "start", "length", F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]
#: No stage can be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
