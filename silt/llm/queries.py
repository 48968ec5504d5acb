"""The opN queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm import bandjoin, embdedup, langid, licenses, linededup, packing, pieces, pii, quality, simhash, topk, urlfilter, whitening
from silt.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: The rules of the url query: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
BASE_KINDS = ["email", "ip", "card", "phone"]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base counts, the base spans' digest, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(pii.listing(F.col("pii"), BASE_KINDS), 256).alias("base_sha256"),
        pii.listing(F.col("pii")).alias("spans"),
    )


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labels: 0 poor, 1 sound but toxic, 2 sound."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, grades(table(spark, sf_dir, "labels")), grades=3)
    return quality.score(docs, model).drop("text")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text and their decoding, as digests."""
    out = pieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in windows of 4,096 ids."""
    out = packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2, window=4096, payload="crc32")
    return out.select("doc_id", "start", "length", F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at cosine 0.95."""
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at two or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by a model of four fifths of the documents; a document without an id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model, keep=["held_out"])


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every text."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["phrase"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["first"].cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document of a smaller id holds, as a digest."""
    out = linededup.kept_lines(table(spark, sf_dir, "documents"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the sale lines of other items at nearly its price."""
    return bandjoin.price_neighbours(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"), k=5)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 whitened components of all distinct ones."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, most=16))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_pieces": op3_pieces,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_topk": op6_topk,
    "op7_simhash": op7_simhash,
    "op8_urls": op8_urls,
    "op9_language": op9_language,
    "op10_licenses": op10_licenses,
    "op11_line_dedup": op11_line_dedup,
    "op12_price_band": op12_price_band,
    "op13_whitening": op13_whitening,
}
