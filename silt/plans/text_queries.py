"""Text rules over memories and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.functions import text
from silt.functions import words as W
from silt.operators import context, evidence, relations, remember
from silt.operators.graph import cut
from silt.plans.registry import array, query
from silt.sources import tables

EDGE_SQL = W.EDGE.replace("'", "''")
#: DuckDB: normalised words, content words and the claim stem of a text column t.
NORMAL = f"list_filter(list_transform(list_filter(string_split_regex(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''), lambda w: lower(trim(w, '{EDGE_SQL}'))), lambda w: w <> '')"
BARE = "regexp_replace(w, '^[^\\p{L}\\p{N}''’]+|[^\\p{L}\\p{N}''’]+$', '', 'g')"
NEGATES = f"(list_contains({array(W.NEGATORS + W.CONTRACTED)}, {BARE}) OR {BARE} LIKE '%n''t' OR {BARE} LIKE '%n’t')"
_CUT = "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
CONTENT = f"list_transform(list_transform(list_filter({NORMAL}, lambda w: NOT list_contains({array(W.GRAMMAR)}, w) AND NOT {NEGATES}), lambda w: {_CUT}), lambda s: CASE WHEN length(s) >= 2 AND s[-1] = s[-2] THEN left(s, length(s) - 1) ELSE s END)"
DOC = "doc AS (SELECT doc_id AS id, source AS scope, doc_id % 50 AS session, 1704067200 + doc_id * 3600 AS observed_at, text AS t FROM documents)"


@query(f"WITH {DOC}, h AS (SELECT id, sha256(array_to_string({NORMAL}, ' ')) AS content_hash FROM doc) SELECT content_hash, count(*) AS n, min(id) AS first_id FROM h GROUP BY content_hash HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    """Texts that are one claim however typed, by content hash."""
    hashed = tables.memories(spark, sf_dir).select("id", text.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query(f"WITH {DOC}, h AS (SELECT *, sha256(array_to_string({NORMAL}, ' ')) AS content_hash FROM doc) SELECT content_hash, min(observed_at) AS first_seen, count(DISTINCT session) AS n_sessions, count(*) AS n_sources FROM h GROUP BY content_hash HAVING count(DISTINCT session) >= 2")
def scratch_clusters(spark, sf_dir):
    """Texts that two sessions or more have said."""
    return evidence.scratch_clusters(tables.memories(spark, sf_dir), text.content_hash(F.col("text"))).drop("text")


@query(f"WITH {DOC}, c AS (SELECT id, list_sort(list_distinct({CONTENT})) AS ws FROM doc) SELECT id, len(list_filter(ws, lambda x: x <> ''))::INT AS n_content, sha256(array_to_string(list_filter(ws, lambda x: x <> ''), ' ')) AS content FROM c")
def claim_content(spark, sf_dir):
    """What each text is about: its distinct content words."""
    ws = F.array_sort(text.content_words(F.col("text")))
    return tables.memories(spark, sf_dir).select("id", F.size(ws).alias("n_content"), F.sha2(F.array_join(ws, " "), 256).alias("content"))


def _flag_sql(parts: list[str], column: str = "t") -> str:
    return " OR ".join("contains({}, '{}')".format(column, p.replace("'", "''")) for p in parts)


@query(f"SELECT conv_id AS session, turn AS cursor, ({_flag_sql(W.DIRECTIVES + W.EXECUTABLE, 'lower(text)')} OR ((contains(lower(text), 'curl') OR contains(lower(text), 'wget')) AND (contains(lower(text), '| sh') OR contains(lower(text), '|sh')))) AS injection FROM conversations UNION ALL SELECT -doc_id, 0, ({_flag_sql(W.DIRECTIVES + W.EXECUTABLE, 'lower(text)')} OR ((contains(lower(text), 'curl') OR contains(lower(text), 'wget')) AND (contains(lower(text), '| sh') OR contains(lower(text), '|sh')))) FROM documents")
def injection_flags(spark, sf_dir):
    """Stored content that reads like an instruction: turns, and documents under negative numbers."""
    said = tables.turns(spark, sf_dir).select("session", "cursor", text.looks_like_injection(F.col("text")).alias("injection"))
    held = tables.table(spark, sf_dir, "documents").select(-F.col("doc_id"), F.lit(0).cast("long"), text.looks_like_injection(F.col("text")))
    return said.union(held)


_SECRET = " OR ".join([_flag_sql(W.SECRET_MARKERS, "text"), *[f"(contains(text, '{p}') AND regexp_matches(substr(text, instr(text, '{p}') + {len(p)}, 16), '^[A-Za-z0-9_-]{{16}}'))" for p in W.SECRET_PREFIXES]])


@query(f"SELECT doc_id AS id, ({_SECRET}) AS secret FROM documents")
def secret_flags(spark, sf_dir):
    """Texts that hold what is probably a credential."""
    return tables.memories(spark, sf_dir).select("id", text.looks_like_secret(F.col("text")).alias("secret"))


_SHAPE = "CASE " + " ".join(f"WHEN {_flag_sql(m, 'q')} THEN '{s}'" for s, m in W.SHAPES.items()) + " ELSE 'plain' END"


@query(f"SELECT shape, count(*) AS n FROM (SELECT {_SHAPE} AS shape FROM (SELECT ' ' || lower(trim(text, ' ')) || ' ' AS q FROM conversations WHERE role = 'user')) GROUP BY shape")
def query_shape(spark, sf_dir):
    """What kinds of questions users ask."""
    return tables.turns(spark, sf_dir).filter("role = 'user'").groupBy(text.query_shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))


@query("SELECT conv_id AS session, turn AS cursor, length(text) AS n_chars, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    """Tokens of every turn, roughly."""
    return tables.turns(spark, sf_dir).select("session", "cursor", F.char_length("text").cast("long").alias("n_chars"), "tokens")


_DISTINCTIVE = f"list_sort(list_distinct(list_filter(list_transform(list_filter(string_split_regex(t, '[^\\p{{L}}\\p{{N}}\\-_./]+'), lambda w: strlen(w) > 2), lambda w: lower(w)), lambda w: NOT list_contains({array(W.NOISE)}, w))))"
PAIRS = f"""{DOC}, s AS (SELECT id, scope, {_DISTINCTIVE} AS ws FROM doc),
 e AS (SELECT id, scope, len(ws) AS n, unnest(ws) AS w FROM s), p AS (SELECT a.scope, a.id AS src, b.id AS dst, count(*) AS shared, min(a.n) AS na, min(b.n) AS nb FROM e a JOIN e b ON a.scope = b.scope AND a.w = b.w AND a.id < b.id GROUP BY ALL)"""


@query(f"WITH {PAIRS} SELECT src, dst, shared::INT AS shared, round(shared / least(na, nb)::DOUBLE, 6) AS weight FROM p WHERE 5 * shared >= 3 * least(na, nb)")
def word_overlap_edges(spark, sf_dir):
    """Similar-to edges: distinctive words of two texts overlap by three fifths of the smaller."""
    return relations.alike(tables.memories(spark, sf_dir), text.distinctive(F.col("text")), jaccard=False).select("src", "dst", "shared", F.round("weight", 6).alias("weight"))


@query(f"WITH {PAIRS} SELECT src, dst, shared::INT AS shared, round(shared / (na + nb - shared)::DOUBLE, 6) AS weight FROM p WHERE 5 * shared >= 3 * (na + nb - shared)")
def claim_overlap_pairs(spark, sf_dir):
    """Texts whose distinctive words overlap by three fifths of their union."""
    return relations.alike(tables.memories(spark, sf_dir), text.distinctive(F.col("text")), jaccard=True).select("src", "dst", "shared", F.round("weight", 6).alias("weight"))


@query("""WITH $MEMORY, p AS (SELECT id AS src, lead(id) OVER w AS dst, observed_at AS at, lead(observed_at) OVER w AS then_ FROM memory WINDOW w AS (PARTITION BY scope ORDER BY observed_at, id))
 SELECT src, dst, CASE WHEN abs(then_ - at) <= 300 THEN 'overlaps' ELSE 'before' END AS kind, 0.5::DOUBLE AS weight FROM p WHERE dst IS NOT NULL""")
def temporal_edges(spark, sf_dir):
    """Neighbours in time within a scope."""
    return relations.temporal(tables.memories(spark, sf_dir).withColumnRenamed("observed_at", "at"))


_FOUND = """found AS (SELECT doc_id AS id, source AS scope, unnest(list_distinct(list_transform(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+[a-z]|token|[Ll]icense'), lambda x: lower(x)))) AS name FROM documents)"""


def entities(spark, sf_dir):
    """Addresses and marked words as the entities of memories."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@[a-z0-9.]+[a-z]|token|[Ll]icense"), F.lit(0)), F.lower))
    return tables.memories(spark, sf_dir).select("scope", "id", F.explode(names).alias("name"))


@query(f"WITH {_FOUND} SELECT scope, name, count(*) AS n, round(1 / (1 + ln(1.0 + count(*))), 6) AS rarity FROM found GROUP BY ALL")
def entity_rarity(spark, sf_dir):
    """How many memories mention an entity, and what sharing it is worth."""
    return relations.entity_rarity(entities(spark, sf_dir)).select("scope", "name", "n", F.round("rarity", 6).alias("rarity"))


@query(f"WITH {_FOUND}, r AS (SELECT scope, name, count(*) AS n, 1 / (1 + ln(1.0 + count(*))) AS rarity FROM found GROUP BY ALL) SELECT a.id AS src, b.id AS dst, 'same-entity' AS kind, round(max(rarity), 6) AS weight FROM found a JOIN found b ON a.scope = b.scope AND a.name = b.name AND a.id < b.id JOIN r ON r.scope = a.scope AND r.name = a.name GROUP BY a.id, b.id")
def same_entity_edges(spark, sf_dir):
    """Memories of a scope that share an entity; the rarest carries the weight."""
    return relations.same_entity(entities(spark, sf_dir)).select("src", "dst", "kind", F.round("weight", 6).alias("weight"))


@query()
def entities_full(spark, sf_dir):
    """What texts are about, by the reader's rules."""
    held = tables.memories(spark, sf_dir)
    return relations.entities(held)


@query()
def hashed_embedding(spark, sf_dir):
    """Hashed vectors of turns."""
    rows = tables.turns(spark, sf_dir).select((F.col("session") * 1000 + F.col("cursor")).alias("id"), "text")
    return context.hashed_embedding(rows, "id", "text")


@query("SELECT conv_id AS session, turn AS cursor, regexp_extract(trim(text), '^[^\\n!?]*') AS opening FROM conversations WHERE role = 'user'")
def opening_lines(spark, sf_dir):
    """A user turn up to its first line end, ! or ?."""
    return tables.turns(spark, sf_dir).filter("role = 'user'").select("session", "cursor", F.regexp_extract(F.trim("text"), r"^[^\n!?]*", 0).alias("opening"))


@query("""SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, 'ext:' || left(sha256(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 12) AS domain FROM pages""")
def external_domains(spark, sf_dir):
    """The trust domain of each page: a digest of its host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), host.alias("host"), F.concat(F.lit("ext:"), F.substring(F.sha2(host, 256), 1, 12)).alias("domain"))


_NEGATIVE = f"len(list_filter({NORMAL}, lambda w: {NEGATES})) > 0"


@query(f"""WITH {DOC}, c AS (SELECT scope, {_NEGATIVE} AS denied, list_sort(list_distinct(list_filter({CONTENT}, lambda s: s <> ''))) AS ws, min(id) AS id, count(*) AS copies FROM doc GROUP BY ALL)
 SELECT a.scope, a.id AS a, b.id AS b, len(a.ws)::INT AS na, len(b.ws)::INT AS nb, a.copies * b.copies AS pairs FROM c a JOIN c b ON a.scope = b.scope AND a.denied = b.denied AND a.id <> b.id AND len(a.ws) > 0 AND 5 * len(a.ws) >= 3 * len(b.ws) AND len(a.ws) <= len(b.ws) AND list_has_all(b.ws, a.ws)""")
def restated_contents(spark, sf_dir):
    """Contents of texts that hold another's whole, three fifths at least: what may restate a claim. Texts about the same are one, by their smallest id."""
    said = tables.memories(spark, sf_dir).select("scope", "id", text.negative(F.col("text")).alias("denied"), F.array_sort(text.content_words(F.col("text"))).alias("words"))
    once = cut(said.groupBy("scope", "denied", "words").agg(F.min("id").alias("id"), F.count("*").alias("copies")))  # texts are parted once
    part = F.concat_ws("|", "scope", F.col("denied").cast("string"))
    pairs = remember.containing(once.select(part.alias("part"), "id", "words"))
    named = once.select("scope", "id", "copies")
    both = pairs.join(named.toDF("scope", "a", "ca"), "a").join(named.select(F.col("id").alias("b"), F.col("copies").alias("cb")), "b")
    return both.select("scope", "a", "b", "na", "nb", (F.col("ca") * F.col("cb")).alias("pairs"))
