"""Full-text retrieval: postings, bm25, and the blended recall over a batch of queries.

Everything is set-oriented: many queries against all memories at once. Query
terms are few and counted before they are sent to every executor; with more than
MOST_SENT rows they are joined by shuffle instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.functions import score, stems, text
from silt.functions.words import STOPWORDS
from silt.operators.graph import cut

K1, B = 1.2, 0.75
#: Rows of query terms, and of their forms in the table, that are broadcast at most; candidates kept for each query.
MOST_SENT, MOST_FORMS, CANDIDATES = 10_000, 100_000, 500
#: Texts whose matches a task sums.
TASK_TEXTS = 5_000
#: Vectors in a block, and queries of a block that meet it in one step.
BLOCK_ROWS, STEP = 16_384, 128
TOKEN = "[^a-z0-9]+"


def _crude_words(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), TOKEN, -1), lambda w: w != "")


#: How words are found: the crude rule takes ASCII words and cuts suffixes; Porter's takes those of any script, folded and stemmed.
WORDS = {"crude": _crude_words, "porter": stems.raw_words}


def query_terms(queries: DataFrame, stemmer: str = "crude") -> DataFrame:
    """Rows (qid, term): the distinct stemmed terms of each query, stopwords dropped."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    kept = F.filter(WORDS[stemmer](F.col("query")), lambda w: ~F.array_contains(stop, w))
    if stemmer == "crude":
        return queries.select("qid", F.explode(F.array_distinct(F.transform(kept, text.search_stem))).alias("term"))
    asked = queries.select("qid", F.explode(kept).alias("word"))
    forms = asked.select("word").distinct().withColumn("term", stems.stem_of("word"))
    return asked.join(forms, "word").select("qid", "term").distinct()


def occurrences(memories: DataFrame, wanted: DataFrame, stemmer: str, more: list[str] | None = None) -> DataFrame:
    """Rows (id, len, term, tf, and the columns ``more``) of the terms wanted: (term).

    Words are parted once. With Porter's rule each distinct word of the table is
    stemmed once, and the forms that no query asks for are gone before the texts'
    own words meet them. Up to MOST_FORMS forms are sent to every executor, so
    only matches are shuffled; more are met by shuffle.
    """
    key = ["id", *(more or [])]
    words = memories.select(*key, WORDS[stemmer](F.col("text")).alias("words")).select(*key, F.size("words").alias("len"), F.explode_outer("words").alias("word")).filter("word is not null")  # an inner one would part the texts again for a filter
    if stemmer == "crude":
        held = words.withColumn("term", text.search_stem(F.col("word"))).join(wanted, "term")
    else:
        distinct = cut(words.select("word").distinct())  # else the join's filter on stems moves below, to every word of every text
        forms = cut(cut(distinct.withColumn("term", stems.stem_of("word"))).join(wanted, "term"))
        held = words.join(F.broadcast(forms) if forms.count() <= MOST_FORMS else forms, "word")
    # dealt by text alone: what is summed by query and text later stays where it is, and a task's texts don't grow with the table
    tasks = max(int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-memories.count() // TASK_TEXTS))
    return held.repartition(tasks, "id").groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))


def gain() -> Column:
    """What one term adds to a memory's rank, of the columns idf, tf, len and avg_len."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("avg_len", F.lit(1e-9))))


def bm25(memories: DataFrame, queries: DataFrame, candidates: int = CANDIDATES, stemmer: str = "crude") -> DataFrame:
    """Rows (qid, id, rank): every memory that holds a term of a query; rank is negative, smaller is better.

    Tokens that no query asks for are dropped before anything is shuffled, so the
    shuffle carries matches, not the corpus, and each match once: those of a text
    are summed for every query in the task it was dealt to, and of each task only a
    query's first are ranked with others. How many memories there are and how
    long they are on average is one row beside the plan. A null text holds nothing.
    """
    terms = query_terms(queries, stemmer)
    sent = F.broadcast if terms.count() <= MOST_SENT else (lambda d: d)
    stats = memories.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size(WORDS[stemmer](F.coalesce("text", F.lit(""))))), F.lit(1.0)).alias("avg_len"))
    held = occurrences(memories, sent(terms.select("term").distinct()), stemmer)
    df = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = terms.join(sent(df.select("term", idf.alias("idf"), "avg_len")), "term")
    ranked = held.join(sent(weighed), "term").groupBy("qid", "id").agg(F.round(-F.sum(gain()), 5).alias("rank"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))
    return ranked.withColumn("place", place).filter(F.col("place") <= candidates)


def lexical(memories: DataFrame, queries: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """Rows (qid, id, lexical): relative bm25 times the share of the query's terms that the text covers."""
    hits = bm25(memories, queries, candidates)
    best = F.min("rank").over(Window.partitionBy("qid"))
    asked = queries.select("qid", F.transform(text.terms_of(F.col("query")), text.search_stem).alias("wanted"))
    # the words of a candidate are split once, below the join, not for every query and term
    held = memories.join(hits.select("id").distinct(), "id", "left_semi").select("id", text.held_words(F.col("text")).alias("held"))
    covered = hits.withColumn("best", best).join(held, "id").join(asked, "qid")
    return covered.select("qid", "id", (score.relative(F.col("rank"), F.col("best")) * text.covered(F.col("wanted"), F.col("held"))).alias("lexical"))


def recall(memories: DataFrame, queries: DataFrame, now: Column, limit: int = 20, least_relevance: float = 0.0, entity: DataFrame | None = None) -> DataFrame:
    """Ranked answers for a batch of queries: seven signals blended, gated by relevance, ties to the smaller id.

    ``memories`` has confidence, importance, access_count, pinned, observed_at,
    tier and near; ``entity`` (qid, id, entity) adds what query and memory are
    both about.
    """
    found = lexical(memories, queries)
    if entity is not None:
        found = found.join(entity, ["qid", "id"], "full").withColumns({"lexical": F.coalesce("lexical", F.lit(0.0)), "entity": F.coalesce("entity", F.lit(0.0))})
    else:
        found = found.withColumn("entity", F.lit(0.0))
    held = found.join(memories.drop("text"), "id")
    rate = score.decay_rate(F.col("importance"), F.col("access_count"), F.col("pinned"))
    strong = score.strength(F.lit(1.0), rate, F.col("observed_at"), now, F.col("tier"))
    frec = score.frecency(F.col("access_count"), F.col("observed_at"), now)
    none = F.lit(None).cast("double")
    total = score.recall_score(none, F.col("lexical"), F.col("entity"), frec, F.col("confidence"), strong, F.col("near"))
    gated = held.withColumn("score", F.round(total, 6)).filter(score.relevance(none, F.col("lexical"), F.col("entity")) >= least_relevance)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return gated.withColumn("place", place).filter(F.col("place") <= limit).select("qid", "place", "id", F.round("lexical", 6).alias("lexical"), F.round("entity", 6).alias("entity"), "score")


def prefix_matches(turns: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (qid, session, cursor): turns in which every term of a query starts some word; at most 32 terms a query."""
    split = lambda c: F.filter(F.split(F.lower(c), TOKEN, -1), lambda w: w != "")
    asked = queries.select("qid", F.slice(F.array_distinct(split("query")), 1, 32).alias("terms")).filter("size(terms) > 0")
    words = turns.select("session", "cursor", F.explode(F.array_distinct(split("text"))).alias("word"))
    heads = asked.select("qid", F.size("terms").alias("n"), F.explode("terms").alias("term")).withColumn("head", F.substring("term", 1, 2))
    hit = words.withColumn("head", F.substring("word", 1, 2)).join(heads.filter("length(term) >= 2"), "head").filter(F.col("word").startswith(F.col("term")))
    short = words.withColumn("head", F.substring("word", 1, 1)).join(heads.filter("length(term) < 2"), "head")
    both = hit.select("qid", "session", "cursor", "n", "term").union(short.select("qid", "session", "cursor", "n", "term"))
    return both.groupBy("qid", "session", "cursor", "n").agg(F.countDistinct("term").alias("hits")).filter("hits = n").select("qid", "session", "cursor")


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, blocks: int | None = None) -> DataFrame:
    """Rows (qid, place, id, cosine): the k nearest vectors of each query vector, by cosine in 0..1.

    Both sides are cut into blocks by id, and a block of vectors meets each block of
    queries of its length: a task holds a part of either, however many there are. A
    matrix product tells which of a block may be among a query's first k, rounding
    allowed for; only those are summed in order and go on to the ranking of all.
    Vectors that are empty, zero or hold a null compare with nothing.
    """
    vb = blocks or max(16, -(-vectors.count() // BLOCK_ROWS))
    qb = blocks or max(1, -(-queries.count() // BLOCK_ROWS))
    whole = lambda c: (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull()) & F.exists(c, lambda x: x != 0)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.filter(whole("vector")).select(F.col("id").alias("qid"), F.col("vector").alias("wanted"), F.size("vector").alias("dim"), dealt(qb).alias("qb")).withColumn("vb", every(vb))
    held = vectors.filter(whole("vector")).select("id", "vector", F.size("vector").alias("dim"), dealt(vb).alias("vb")).withColumn("qb", every(qb))

    def rows(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).astype(np.float64).reshape(len(column), -1)

    def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for i in range(x.shape[1]):
            out += x[:, i] * y[:, i]
        return out

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", right.schema.field("qid").type), ("id", left.schema.field("id").type), ("cosine", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        left = left.sort_by("id")
        ids, qids = left["id"].to_numpy(), right["qid"].to_numpy()
        x, y = rows(left["vector"]), rows(right["wanted"])
        a, b = np.sqrt(fold(x, x)), np.sqrt(fold(y, y))
        out = []
        with np.errstate(all="ignore"):
            unit = (x / a[:, None]).T
            for at in range(0, len(y), STEP):
                near = ((y[at : at + STEP] / b[at : at + STEP, None]) @ unit + 1) / 2
                near = np.where(np.isnan(near), 2, near)  # not a number comes before all
                near[qids[at : at + STEP, None] == ids[None, :]] = -1
                most = min(k, len(ids))
                least = np.partition(near, len(ids) - most, axis=1)[:, len(ids) - most]
                q, v = np.nonzero((near >= least[:, None] - 2.1e-5) & (near >= 0 - 1e-6))
                # places after rounding, at worst and at best: who is behind k others in any case goes
                low, high = (np.rint((near[q, v] + by) * 1e5).astype(np.int64) for by in (-1e-9, 1e-9))
                order = np.lexsort((v, -low, q))
                begin = np.searchsorted(q, np.arange(len(near)))
                last = order[np.minimum(begin[q] + most, np.searchsorted(q, np.arange(len(near)), side="right")[q]) - 1]
                may = (high > low[last]) | ((high == low[last]) & (v <= v[last]))
                q, v = q[may] + at, v[may]
                out.append((q, v, (fold(y[q], x[v]) / (b[q] * a[v]) + 1) / 2))
        q, v, cosine = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([right["qid"].take(pa.array(q)), left["id"].take(pa.array(v)), pa.array(cosine)], schema=schema)

    key, kind = ["vb", "qb", "dim"], lambda df: df.schema["id"].dataType.simpleString()
    met = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, f"qid {kind(queries)}, id {kind(vectors)}, cosine double")
    scored = met.select("qid", "id", F.round("cosine", 5).alias("cosine"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("cosine").desc(), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)
