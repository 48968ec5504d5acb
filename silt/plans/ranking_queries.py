"""Full-text, vector and graph retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.functions import words as W
from silt.operators import context, fts, relations, search, slots
from silt.plans.registry import array, query
from silt.sources import tables
from silt.sources.tables import NOW

_STEM = "CASE WHEN length(w) > 5 AND w LIKE '%ing' AND w NOT LIKE '%ss' THEN left(w, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
_TOKENS = f"list_transform(list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {_STEM})"
_ASKED = f"""asked AS (SELECT item_id AS qid, text AS query FROM benchmark),
 terms AS (SELECT DISTINCT qid, unnest(list_transform(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({array(W.STOPWORDS)}, w)), lambda w: {_STEM})) AS term FROM asked)"""
_BM25 = f"""{_ASKED}, d AS (SELECT doc_id AS id, {_TOKENS} AS ws FROM (SELECT doc_id, text AS t FROM documents)), st AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
 e AS (SELECT id, len(ws) AS l, unnest(ws) AS term FROM d), tf AS (SELECT id, l, term, count(*) AS f FROM e WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
 sc AS (SELECT qid, id, round(-sum(greatest(ln((st.n - df.n + 0.5) / (df.n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 5) AS rank FROM terms JOIN tf USING (term) JOIN df USING (term), st GROUP BY qid, id),
 top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS place FROM sc)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage, whole, as a query."""
    return tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(f"WITH {_BM25} SELECT qid, place, id, rank FROM top WHERE place <= 10")
def bm25_search(spark, sf_dir):
    """The ten best memories of each query by bm25."""
    return fts.bm25(tables.memories(spark, sf_dir), asked(spark, sf_dir), 10).select("qid", F.col("place").cast("long").alias("place"), "id", "rank")


_BARE = "lower(regexp_replace(w, '[^\\p{L}\\p{N}./_\\-]', '', 'g'))"
_LEX = f"""{_BM25}, wanted AS (SELECT qid, list_transform(list_distinct(list_filter(list_transform(string_split_regex(query, '[ \\n]+'), lambda w: {_BARE}), lambda w: w <> '' AND NOT list_contains({array(W.STOPWORDS)}, w))), lambda w: {_STEM}) AS ws FROM asked),
 words_ AS (SELECT doc_id AS id, list_distinct(list_filter(list_transform(list_transform(string_split_regex(text, '[ \\n]+'), lambda w: {_BARE}), lambda w: {_STEM}), lambda w: w <> '')) AS held FROM documents),
 best AS (SELECT *, min(rank) OVER (PARTITION BY qid) AS best FROM top WHERE place <= 500),
 lex AS (SELECT b.qid, b.id, CASE WHEN best >= 0 THEN 0.5 ELSE greatest(0, least(1, rank / best)) END * len(list_filter(w.ws, lambda t: len(list_filter(d.held, lambda h: contains(h, t))) > 0)) / len(w.ws) AS lexical FROM best b JOIN wanted w USING (qid) JOIN words_ d ON d.id = b.id)"""
RATE = "CASE WHEN pinned THEN 0.0 ELSE CASE importance WHEN 'critical' THEN 0.005 WHEN 'high' THEN 0.01 WHEN 'low' THEN 0.1 ELSE 0.05 END / (1 + ln(1.0 + access_count)) END::DOUBLE * CASE tier WHEN 'fact' THEN 0.25 WHEN 'habit' THEN 0.35 WHEN 'episode' THEN 1.4 WHEN 'scratch' THEN 2.0 ELSE 1.0 END::DOUBLE"
_AGE = "greatest(0, ($NOW - observed_at) / 86400.0)"


@query(f"""WITH $MEMORY, {_LEX}, sig AS (SELECT l.qid, l.id, lexical, (m.id % 10) / 10.0 AS conf, exp(-{RATE} * {_AGE}) AS strong, ((1 - exp(-access_count / 8.0)) + exp(-{_AGE} / 7)) / 2 AS frec, scope <> 'src0' AS near FROM lex l JOIN memory m ON m.id = l.id),
 blend AS (SELECT qid, id, lexical, round(lexical * 0.48 + frec * 0.13 + conf * 0.13 + strong * 0.08 + CASE WHEN near THEN 0.04 ELSE 0 END, 6) AS score FROM sig WHERE lexical >= 0.0),
 p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM blend) SELECT qid, place, id, round(lexical, 6) AS lexical, 0.0::DOUBLE AS entity, score FROM p WHERE place <= 20""")
def recall_score(spark, sf_dir):
    """The blended recall of each query: twenty memories."""
    held = tables.memories(spark, sf_dir).withColumns({"confidence": F.col("id") % 10 / 10.0, "near": F.col("scope") != "src0"})
    out = fts.recall(held, asked(spark, sf_dir), F.lit(NOW), 20)
    return out.withColumn("place", F.col("place").cast("long"))


@query("""WITH q AS (SELECT item_id AS qid, list_distinct(list_filter(string_split_regex(lower(array_to_string(string_split(text, ' ')[1:2], ' ')), '[^a-z0-9]+'), lambda w: w <> '')) AS terms FROM benchmark),
 t AS (SELECT conv_id AS session, turn AS cursor, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM conversations)
 SELECT qid, session, cursor FROM q, t WHERE len(terms) > 0 AND len(list_filter(terms, lambda x: len(list_filter(ws, lambda w: starts_with(w, x))) > 0)) = len(terms)""")
def prefix_and_match(spark, sf_dir):
    """Turns in which both opening words of a benchmark passage start some word."""
    queries = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("query"))
    return fts.prefix_matches(tables.turns(spark, sf_dir), queries)


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id AS qid, b.id, round((list_cosine_similarity(a.e, b.e) + 1) / 2, 5) AS cosine FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS place FROM p) SELECT qid, id, cosine, place FROM r WHERE place <= 10""")
def cosine_topk(spark, sf_dir):
    """The ten nearest vectors of each whose id is divisible by 50."""
    vectors = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return fts.cosine_top(vectors, vectors.filter("id % 50 = 0"), 10).withColumn("place", F.col("place").cast("long"))


_EDGES = """l AS (SELECT o_orderkey AS id, o_custkey AS c, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders),
 e AS (SELECT id AS src, nx AS dst, (0.2 + (id % 8) / 10.0)::DOUBLE AS w FROM l WHERE nx IS NOT NULL UNION ALL SELECT nx, id, (0.2 + (id % 8) / 10.0)::DOUBLE FROM l WHERE nx IS NOT NULL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring orders of a customer, both ways, weighted by id."""
    from pyspark.sql import Window

    raw = tables.table(spark, sf_dir, "orders")
    nx = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    one = raw.select(F.col("o_orderkey").alias("src"), nx.alias("dst"), F.lit("before").alias("kind"), (F.lit(0.2) + F.col("o_orderkey") % 8 / 10.0).alias("weight")).filter("dst is not null")
    return relations.mirrored(one)


@query(f"WITH {_EDGES}, s AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0) SELECT s.id AS seed, e.dst AS node, 1 AS hop, round(max(w) * 0.5, 6) AS score FROM s JOIN e ON e.src = s.id GROUP BY s.id, e.dst")
def traverse_1hop(spark, sf_dir):
    """One step from every fiftieth order."""
    seeds = tables.slots(spark, sf_dir).filter("id % 50 = 0").select("id")
    return relations.traverse(edges(spark, sf_dir), seeds, 1).select("seed", "node", "hop", F.round("score", 6).alias("score"))


@query(f"""WITH {_EDGES}, s AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0), h1 AS (SELECT s.id AS seed, e.dst AS node, max(w) AS w FROM s JOIN e ON e.src = s.id GROUP BY ALL),
 h2 AS (SELECT h1.seed, e.dst AS node, max(e.w) AS w FROM h1 JOIN e ON e.src = h1.node GROUP BY ALL), f AS (SELECT * FROM h2 WHERE node <> seed AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = h2.seed AND h1.node = h2.node))
 SELECT seed, node, 1 AS hop, round(w * 0.5, 6) AS score FROM h1 UNION ALL SELECT seed, node, 2, round(w * 0.5, 6) FROM f""")
def traverse_2hop(spark, sf_dir):
    """Two steps from every fiftieth order, each node once."""
    seeds = tables.slots(spark, sf_dir).filter("id % 50 = 0").select("id")
    return relations.traverse(edges(spark, sf_dir), seeds, 2).select("seed", "node", "hop", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE l AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders),
 d AS (SELECT o_orderkey AS root, o_orderkey AS node FROM orders UNION SELECT d.root, l.child FROM d JOIN l ON l.parent = d.node) SELECT root, node FROM d""")
def derived_closure(spark, sf_dir):
    """Everything derived from every order."""
    from pyspark.sql import Window

    raw = tables.table(spark, sf_dir, "orders")
    parent = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    links = raw.select(F.col("o_orderkey").alias("src"), F.lit("derived_from").alias("rel"), parent.alias("dst")).filter("dst is not null")
    return relations.descendants(links, raw.select(F.col("o_orderkey").alias("id")))


@query("""WITH $MEMORY, r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY observed_at DESC, id DESC) AS place FROM memory WHERE valid_to IS NULL AND archived_at IS NULL AND tier IN ('fact', 'habit') AND (id % 10) / 10.0 >= 0.35)
 SELECT scope, place, id, '- [' || lpad(id::VARCHAR, 8, '0') || '] ' || left(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'), 72) AS line FROM r WHERE place <= 120""")
def catalog_page(spark, sf_dir):
    """One line for each of a scope's newest facts and habits."""
    held = tables.memories(spark, sf_dir).withColumn("confidence", F.col("id") % 10 / 10.0)
    return context.catalog(held, 0.35).withColumn("place", F.col("place").cast("long"))


@query()
def dispute_fixpoint(spark, sf_dir):
    """Confidence of contradicting answers, each pressed by all others of its slot."""
    held = tables.slots(spark, sf_dir)
    return slots.slot_fixpoint(held, held.select(F.col("id").alias("memory"), ((F.col("id") % 10 + 1) / 10.0).alias("confidence")))


@query()
def porter_search(spark, sf_dir):
    """The ten best memories of each query by bm25 over folded, Porter-stemmed words."""
    return fts.bm25(tables.memories(spark, sf_dir), asked(spark, sf_dir), 10, stemmer="porter").select("qid", F.col("place").cast("long").alias("place"), "id", "rank")


@query()
def recall_full(spark, sf_dir):
    """Benchmark passages asked of two stores each, in shapes that walk and read the archive, with vectors where there are any."""
    vectors = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    held = tables.memories(spark, sf_dir).withColumns({"store": F.col("scope"), "confidence": F.col("id") % 10 / 10.0})
    shapes = F.array(*[F.lit(s) for s in ("", "why ", "what do we know of ", "like this ")])
    passages = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.element_at(shapes, (F.col("item_id") % 4 + 1).cast("int")), "text").alias("query"))
    questions = passages.join(vectors.withColumnRenamed("id", "qid"), "qid", "left")
    stores = passages.select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("store"), F.lit(True).alias("near")).union(passages.select("qid", F.lit("src0"), F.lit(False)))
    near = relations.mirrored(relations.temporal(tables.memories(spark, sf_dir).withColumnRenamed("observed_at", "at")))
    out = search.recall(held, questions, stores, near, F.lit(NOW), 20, vectors=vectors)
    return out.withColumn("place", F.col("place").cast("long"))
