"""Recall in full: words, entities and vectors over several stores, wider where words find little, and walks as the query's policy allows.

Everything is done for a batch of queries at once. Only the thin queries of a store -
those whose words and entities found fewer than eight memories there - and that have
a vector take the wider path, over the store's most trusted memories; all others never
meet a memory that shares nothing with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.functions import score, text
from silt.functions import words as W
from silt.operators import fts, relations
from silt.operators.graph import cut

#: A query with fewer hits in a store is thin; the most trusted memories of a store it then meets; answers that a walk starts from.
THIN, WIDE, SEEDS = 8, 500, 5


def policies(queries: DataFrame) -> DataFrame:
    """``queries`` (qid, query, ...) with what their shape asks for: families, kinds, hops, candidates, archive."""
    rows = [(shape, p["families"], [k for f in p["families"] for k in W.FAMILIES[f]], p["hops"], p["candidates"], p["archive"]) for shape, p in W.POLICIES.items()]
    table = queries.sparkSession.createDataFrame(rows, "shape string, families array<string>, kinds array<string>, hops int, candidates int, archive boolean")
    return queries.withColumn("shape", text.query_shape(F.coalesce("query", F.lit("")))).join(F.broadcast(table), "shape")  # a row for each shape


def by_words(memories: DataFrame, asked: DataFrame, stemmer: str) -> DataFrame:
    """Rows (qid, store, id, lexical) of each store as if it stood alone: its own lengths, frequencies and best rank; ``candidates`` a query and store at most.

    ``asked`` has (qid, store, query, candidates, archive): a row for each store a
    query asks. Live memories and the archive are two indexes: what a query may
    not see doesn't count in its statistics. Both are counted in one pass.
    """
    questions = asked.select("qid", "query").distinct()
    terms = cut(fts.query_terms(questions, stemmer))
    held = cut(fts.occurrences(memories, terms.select("term").distinct(), stemmer, ["store", "live"]))
    length = F.size(fts.WORDS[stemmer](F.coalesce("text", F.lit(""))))
    both = [("", F.lit(True)), ("live_", F.col("live"))]
    stats = memories.groupBy("store").agg(*[F.count(F.when(c, 1)).alias(f"{n}docs") for n, c in both], *[F.avg(F.when(c, length)).alias(f"{n}len") for n, c in both])
    df = held.groupBy("store", "term").agg(*[F.count(F.when(c, 1)).alias(f"{n}df") for n, c in both]).join(stats, "store")
    weighed = terms.join(df, "term").join(asked.select("qid", "store", "candidates", "archive"), ["qid", "store"])
    seen = {c: F.when(F.col("archive"), F.col(c)).otherwise(F.col(f"live_{c}")) for c in ("docs", "df", "len")}
    idf = F.greatest(F.log((seen["docs"] - seen["df"] + 0.5) / (seen["df"] + 0.5)), F.lit(1e-6))
    weighed = weighed.select("qid", "store", "term", "candidates", "archive", idf.alias("idf"), seen["len"].alias("avg_len"))
    ranked = held.join(weighed, ["store", "term"]).filter("live or archive").groupBy("qid", "store", "id").agg(F.round(-F.sum(fts.gain()), 5).alias("rank"), F.first("candidates").alias("candidates"))
    along = Window.partitionBy("qid", "store").orderBy("rank", "id")
    top = cut(ranked.withColumn("place", F.row_number().over(along)).filter(F.col("place") <= F.col("candidates")))
    best = F.min("rank").over(Window.partitionBy("qid", "store"))
    wanted = questions.select("qid", F.transform(text.terms_of(F.coalesce("query", F.lit(""))), text.search_stem).alias("wanted"))
    said = memories.join(top.select("store", "id").distinct(), ["store", "id"], "left_semi").select("store", "id", text.held_words(F.coalesce("text", F.lit(""))).alias("held"))
    covered = top.withColumn("best", best).join(said, ["store", "id"]).join(wanted, "qid")
    return covered.select("qid", "store", "id", (score.relative(F.col("rank"), F.col("best")) * text.covered(F.col("wanted"), F.col("held"))).alias("lexical"))


def recall(memories: DataFrame, queries: DataFrame, asks: DataFrame, edges: DataFrame, now: Column, limit: int = 20, floor: float = 0.0, least_relevance: float = 0.0, stemmer: str = "porter", vectors: DataFrame | None = None) -> DataFrame:
    """Rows (qid, place, id, store, via, lexical, semantic, entity, score): the best ``limit`` answers of each query.

    ``memories``: (id, store, scope, text, tier, importance, access_count, pinned,
    confidence, observed_at), and perhaps valid_to, archived_at, vector; ids are
    unique over all stores. ``queries``: (qid, query) and perhaps vector. ``asks``:
    (qid, store, near): the stores a query asks, and whether their answers are near.
    ``edges``: (src, dst, kind, weight). ``vectors`` (id, vector), one an id, may hold the
    memories' vectors in place of their column: only what is scored meets them, no text does.

    In each store a query meets what shares words with it, up to its policy's number
    of candidates, and all that is about the same as it; memories that ended are met only
    where the policy reads the archive. A thin query that has a vector meets the
    store's 500 most trusted as well. Scores blend seven signals; answers under
    ``floor`` in confidence or ``least_relevance`` go. From the five best of all
    stores a query's policy may walk one step along edges of its families,
    the strongest eight of a memory, and what that adds scores half the edge's weight.
    Ties go to the smaller id. Null queries ask nothing but by vector; null vectors compare with nothing.
    """
    has = lambda df, c, kind: df if c in df.columns else df.withColumn(c, F.lit(None).cast(kind))
    held = has(has(has(memories, "vector", "array<double>"), "valid_to", "long"), "archived_at", "long")
    held = held.withColumn("live", F.col("valid_to").isNull() & F.col("archived_at").isNull())
    told = policies(has(queries, "vector", "array<double>"))
    asked = cut(asks.select("qid", "store", F.coalesce("near", F.lit(False)).alias("near")).dropDuplicates(["qid", "store"]).join(told, "qid"))
    lexical = by_words(held, asked, stemmer)
    entity = relations.entities(held.select(F.col("store").alias("scope"), "id", "text"))
    about = relations.by_entity(entity, asked.select("qid", F.col("store").alias("scope"), F.coalesce("query", F.lit("")).alias("text")))
    about = about.join(held.select("id", "store", "live"), "id").join(asked.select("qid", "store", "archive"), ["qid", "store"]).filter("live or archive").select("qid", "store", "id", "entity")
    both = cut(lexical.join(about, ["qid", "store", "id"], "full").select("qid", "store", "id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("entity", F.lit(0.0)).alias("entity")))
    # the wider path: thin queries with a vector only
    hits = both.groupBy("qid", "store").agg(F.count("*").alias("hits"))
    thin = asked.filter("vector is not null").join(hits, ["qid", "store"], "left").filter(F.coalesce("hits", F.lit(0)) < THIN).select("qid", "store", "archive")
    trusted = Window.partitionBy("store", "live").orderBy(F.col("confidence").desc(), "id")
    few = held.select("store", "id", "live", "confidence").withColumn("place", F.row_number().over(trusted)).filter(F.col("place") <= WIDE)
    seen = Window.partitionBy("qid", "store").orderBy(F.col("confidence").desc(), "id")
    wide = thin.join(few, "store").filter("live or archive").withColumn("place", F.row_number().over(seen)).filter(F.col("place") <= WIDE).join(both.select("qid", "store", "id"), ["qid", "store", "id"], "left_anti")
    every = both.withColumn("via", F.lit("words")).union(wide.select("qid", "store", "id", F.lit(0.0), F.lit(0.0), F.lit("vector")))
    # signals
    signals = every.join(held.drop("text", "scope", *([] if vectors is None else ["vector"])), ["store", "id"])
    signals = signals if vectors is None else signals.join(vectors.select("id", "vector"), "id", "left")
    rows = signals.join(asked.select("qid", "store", "near", F.col("vector").alias("asked_vector")), ["qid", "store"])
    rate = score.decay_rate(F.col("importance"), F.col("access_count"), F.col("pinned"))
    strong = score.strength(F.lit(1.0), rate, F.col("observed_at"), now, F.col("tier"))
    frequent = score.frecency(F.col("access_count"), F.col("observed_at"), now)
    rows = rows.filter(F.col("confidence") >= floor).withColumn("semantic", score.cosine01(F.col("asked_vector"), F.col("vector")))
    total = score.recall_score(F.col("semantic"), F.col("lexical"), F.col("entity"), frequent, F.col("confidence"), strong, F.col("near"))
    told_by = F.when((F.col("lexical") == 0) & (F.col("entity") > 0), "entity").otherwise(F.col("via"))
    gate = score.relevance(F.col("semantic"), F.col("lexical"), F.col("entity")) >= least_relevance
    direct = cut(rows.filter(gate).select("qid", "id", "store", told_by.alias("via"), "lexical", "semantic", "entity", F.round(total, 6).alias("score")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    # walks from the five best, as far as the policy goes
    walking = told.filter("hops > 0 and size(families) > 0").select("qid", "kinds", "archive")
    seeds = direct.withColumn("place", place).filter(F.col("place") <= SEEDS).join(walking, "qid").select("qid", F.col("id").alias("src"), "kinds", "archive")
    strongest = F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst", "kind"))
    fan = edges.join(seeds.select("src").distinct(), "src", "left_semi").filter(F.col("weight") >= relations.LEAST_WEIGHT).withColumn("nth", strongest).filter(F.col("nth") <= relations.FAN_OUT)
    step = seeds.join(fan, "src").filter(F.array_contains("kinds", F.col("kind"))).groupBy("qid", F.col("dst").alias("id")).agg(F.max("weight").alias("weight"), F.first("archive").alias("archive"))
    step = step.join(direct.select("qid", "id"), ["qid", "id"], "left_anti").join(held.select("id", "store", "live", "confidence"), "id").filter((F.col("live") | F.col("archive")) & (F.col("confidence") >= floor))
    budget = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("weight").desc(), "id"))
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    walked = step.withColumn("nth", budget).filter(F.col("nth") <= relations.BUDGET).select("qid", "id", "store", F.lit("walk").alias("via"), zero.alias("lexical"), none.alias("semantic"), zero.alias("entity"), F.round(F.col("weight") * 0.5, 6).alias("score"))
    return direct.union(walked).withColumn("place", place).filter(F.col("place") <= limit).select("qid", "place", "id", "store", "via", *[F.round(c, 6).alias(c) for c in ("lexical", "semantic", "entity")], "score")
