"""Changes to what is held, the ledger's own tables, sessions, and how memories are offered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.functions import offered, text
from silt.functions import words as W
from silt.operators import relations, sessions, usage, writes
from silt.plans.registry import array, query
from silt.plans.text_queries import _SHAPE
from silt.sources import tables
from silt.sources.tables import NOW

BEFORE = 1_706_745_600


def _cases(field: str) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "CASE shape " + " ".join(f"WHEN '{s}' THEN {quoted(p[field])}" for s, p in W.POLICIES.items()) + " END"


@query(f"SELECT session, cursor, {_cases('name')} AS policy, {_cases('hops')} AS hops, {_cases('candidates')} AS candidates, {_cases('archive')} AS archive FROM (SELECT session, cursor, {_SHAPE} AS shape FROM (SELECT conv_id AS session, turn AS cursor, ' ' || lower(trim(text, ' ')) || ' ' AS q FROM conversations WHERE role = 'user'))")
def recall_policy(spark, sf_dir):
    """How far the search for each user turn may go, by its shape."""
    shaped = tables.turns(spark, sf_dir).filter("role = 'user'").withColumn("shape", text.query_shape(F.col("text")))
    shape = F.col("shape")
    return shaped.select("session", "cursor", offered.policy(shape, "name").alias("policy"), offered.policy(shape, "hops").alias("hops"), offered.policy(shape, "candidates").alias("candidates"), offered.policy(shape, "archive").alias("archive"))


def ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``events`` as a ledger: a hundred make a search, ten an injection, one an action; every second outcome is known."""
    rows = tables.actions(spark, sf_dir).withColumns({"recall": F.floor(F.col("id") / 100), "injection": F.floor(F.col("id") / 10)})
    acted = rows.filter("outcome is not null").select("id", "injection", "attribution", "at", F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("tool"))
    return {
        "recall": rows.groupBy(F.col("recall").alias("id")).agg(F.min("at").alias("at")),
        "candidate": rows.groupBy("recall", "memory").agg(F.bool_or(F.coalesce(F.col("outcome") == "succeeded", F.lit(False))).alias("selected")),
        "injection": rows.groupBy(F.col("injection").alias("id"), "recall").agg(F.min("at").alias("at")),
        "shown": rows.select("injection", "memory").distinct(),
        "action": acted,
        "cited": rows.filter("outcome is not null").select(F.col("id").alias("action"), "memory"),
        "outcome": rows.filter("outcome is not null and id % 2 = 0").select("id", F.col("id").alias("action"), F.col("outcome").alias("kind")),
    }


_LEDGER = """$ACTION, rows_ AS (SELECT *, id // 100 AS recall, id // 10 AS injection FROM action_),
 recall_ AS (SELECT recall AS id, min(at) AS at FROM rows_ GROUP BY ALL), candidate AS (SELECT recall, memory, bool_or(coalesce(outcome = 'succeeded', false)) AS selected FROM rows_ GROUP BY recall, memory),
 injection_ AS (SELECT injection AS id, recall, min(at) AS at FROM rows_ GROUP BY injection, recall), shown AS (SELECT DISTINCT injection, memory FROM rows_),
 act AS (SELECT id, injection, attribution, at, 't' || (id % 5)::VARCHAR AS tool FROM rows_ WHERE outcome IS NOT NULL), cited AS (SELECT id AS action, memory FROM rows_ WHERE outcome IS NOT NULL),
 outcome_ AS (SELECT id, id AS action, outcome AS kind FROM rows_ WHERE outcome IS NOT NULL AND id % 2 = 0)"""


@query(f"WITH {_LEDGER} SELECT memory, count(*) AS n, count(*) FILTER (selected) AS n_selected FROM candidate GROUP BY memory")
def times_retrieved(spark, sf_dir):
    """How often searches considered each memory, and chose it."""
    return usage.times_retrieved(ledger(spark, sf_dir)["candidate"])


@query(f"WITH {_LEDGER} SELECT i.recall, a.id AS action, a.tool, a.attribution, coalesce(o.kind, 'unknown') AS outcome, a.at FROM injection_ i JOIN act a ON a.injection = i.id LEFT JOIN outcome_ o ON o.action = a.id")
def recall_trace(spark, sf_dir):
    """What was done with the context of every search."""
    return usage.trace(ledger(spark, sf_dir))


@query(f"""WITH {_LEDGER} SELECT 'recall' AS "table", count(*) AS n FROM recall_ WHERE at >= {BEFORE} UNION ALL SELECT 'injection', count(*) FROM injection_ WHERE at >= {BEFORE} UNION ALL SELECT 'action', count(*) FROM act WHERE at >= {BEFORE}
 UNION ALL SELECT 'candidate', count(*) FROM candidate WHERE recall NOT IN (SELECT id FROM recall_ WHERE at < {BEFORE}) UNION ALL SELECT 'shown', count(*) FROM shown WHERE injection NOT IN (SELECT id FROM injection_ WHERE at < {BEFORE})
 UNION ALL SELECT 'cited', count(*) FROM cited WHERE action NOT IN (SELECT id FROM act WHERE at < {BEFORE}) UNION ALL SELECT 'outcome', count(*) FROM outcome_ WHERE action NOT IN (SELECT id FROM act WHERE at < {BEFORE})""")
def ledger_forget(spark, sf_dir):
    """What each table of the ledger keeps once all before a time is forgotten."""
    out = None
    for name, rows in usage.forget_before(ledger(spark, sf_dir), BEFORE).items():
        one = rows.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).withColumns({"confirmed_at": F.lit(None).cast("long"), "last_accessed": F.col("observed_at"), "strength": F.lit(0.5)})


@query("""WITH $MEMORY, $WITNESS, runs AS (SELECT DISTINCT memory, session FROM witness WHERE id % 40 >= 10), f AS (SELECT memory, session, min_by(at, id) AS at FROM witness WHERE id % 40 < 10 GROUP BY memory, session),
 said AS (SELECT memory, max(at) AS at FROM f ANTI JOIN runs USING (memory, session) GROUP BY memory)
 SELECT m.id, CASE WHEN s.at IS NOT NULL THEN greatest(observed_at, s.at) END AS confirmed_at, CASE WHEN s.at IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS strength FROM memory m LEFT JOIN said s ON s.memory = m.id""")
def witness_attach(spark, sf_dir):
    """Memories after a quarter of the witnesses, those of other runs, is attached to the rest."""
    said = tables.witnesses(spark, sf_dir)
    return writes.attach(_held(spark, sf_dir), said.filter("id % 40 >= 10"), said.filter("id % 40 < 10"))[0].select("id", "confirmed_at", "strength")


@query("""WITH $MEMORY, gone_runs AS (SELECT * FROM (VALUES ('0'), ('3')) t(session)), $WITNESS, left_ AS (SELECT memory FROM witness ANTI JOIN gone_runs USING (session)),
 touched AS (SELECT memory AS id FROM witness SEMI JOIN gone_runs USING (session) UNION SELECT id FROM memory WHERE session IN (0, 3))
 SELECT id FROM touched WHERE id NOT IN (SELECT memory FROM left_)""")
def purged_runs(spark, sf_dir):
    """Memories that go with two runs: nothing else witnesses them."""
    held = tables.memories(spark, sf_dir).withColumn("session", F.col("session").cast("string"))
    runs = spark.createDataFrame([("0",), ("3",)], "session string")
    return writes.purge_sessions(held, tables.witnesses(spark, sf_dir), runs, {})["gone"]


@query("WITH $WITNESS, w AS (SELECT id // 2 AS memory, domain FROM witness) SELECT DISTINCT memory AS id FROM w WHERE domain = 'ext:1' AND memory NOT IN (SELECT memory FROM w WHERE domain IS NULL OR domain <> 'ext:1')")
def purged_domain(spark, sf_dir):
    """Memories that only one outside domain witnessed; here two witnesses in a row make one memory's."""
    said = tables.witnesses(spark, sf_dir).withColumn("memory", F.floor(F.col("id") / 2))
    return writes.purge_domain(tables.memories(spark, sf_dir), said, "ext:1")["gone"]


@query("WITH $MEMORY SELECT id::VARCHAR AS id, scope, CASE WHEN tier = 'scratch' AND archived_at IS NULL AND id % 3 = 0 THEN 'archive' ELSE tier END AS tier FROM memory UNION ALL SELECT 'project:' || id::VARCHAR, 'project', 'fact' FROM memory WHERE tier = 'scratch' AND archived_at IS NULL AND id % 3 = 0")
def carried_scratch(spark, sf_dir):
    """All memories after some scratch ones were carried into a project's facts."""
    held = tables.memories(spark, sf_dir)
    return writes.carry(held, held.filter("id % 3 = 0").select("id"), "project", "fact", NOW).select("id", "scope", "tier")


@query("""WITH l AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders), p AS (SELECT id AS keep, was AS dropped FROM l WHERE was IS NOT NULL AND id % 3 = 0)
 SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT keep FROM p) THEN NULL WHEN o_orderkey IN (SELECT dropped FROM p) THEN coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 7 END, $NOW) ELSE CASE WHEN o_orderkey % 5 = 0 THEN 7 END END::BIGINT AS valid_to FROM orders""")
def settled_claims(spark, sf_dir):
    """When each claim ended, after a third was chosen over the claim before it."""
    from pyspark.sql import Window

    held = tables.slots(spark, sf_dir).withColumn("valid_to", F.when(F.col("id") % 5 == 0, F.lit(7).cast("long")))
    was = F.lag("id").over(Window.partitionBy("subject").orderBy("valid_from", "id"))
    pairs = held.select(F.col("id").alias("keep"), was.alias("drop")).filter("drop is not null and keep % 3 = 0")
    links = spark.createDataFrame([], "src long, rel string, dst long")
    return writes.settle(held, links, pairs, NOW)[0].select("id", "valid_to")


@query("""SELECT o_orderkey AS id, floor(epoch(o_orderdate))::BIGINT AS opened, strftime(o_orderdate, '%m%d') || '-' || right(o_orderkey::VARCHAR, 4) AS name FROM orders WHERE o_orderkey % 9 <> 0 ORDER BY opened DESC, id DESC LIMIT 50""")
def session_list(spark, sf_dir):
    """The fifty sessions opened last, by name."""
    held = tables.slots(spark, sf_dir).select("id", F.col("valid_from").alias("opened"), F.when(F.col("id") % 9 == 0, 1).alias("archived_at"))
    return sessions.listed(held, 50).select("id", "opened", "name")


_LAYOUT = "lay AS (SELECT o_custkey AS session, o_orderkey AS n, CASE WHEN o_orderkey % 7 <> 0 THEN floor(epoch(o_orderdate))::BIGINT END AS applied FROM orders)"


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.slots(spark, sf_dir).select(F.col("subject").alias("session"), F.col("id").alias("n"), F.when(F.col("id") % 7 != 0, F.col("valid_from")).alias("applied"))


@query(f"WITH {_LAYOUT} SELECT session, n, applied FROM lay l WHERE applied IS NULL OR applied >= 820454400 OR n IN (SELECT max(n) FROM lay GROUP BY session) OR n % 22 = 11")
def layout_prune(spark, sf_dir):
    """Layouts that stay: recent, newest of their session, or with effects still waiting."""
    held = layouts(spark, sf_dir)
    effects = held.filter("n % 11 = 0").select(F.col("n").alias("layout"), (F.col("n") % 22 == 0).alias("done"))
    return sessions.prune_layouts(held, effects, 820_454_400)


@query(f"WITH {_LAYOUT}, g AS (SELECT session, n AS id, row_number() OVER (PARTITION BY session, n % 4 <> 0 ORDER BY n DESC) AS p FROM lay) SELECT session, id FROM g WHERE id % 4 = 0 OR p <= 2")
def generation_trim(spark, sf_dir):
    """Generations with but the two newest retired ones of each session."""
    held = layouts(spark, sf_dir).select("session", F.col("n").alias("id"), F.col("n").alias("made_at"), F.when(F.col("n") % 4 == 0, "ready").otherwise("retired").alias("state"))
    return sessions.trim_generations(held, 2).select("session", "id")


@query("""WITH p AS (SELECT l_orderkey AS session, ((l_linenumber - 1) * 100)::BIGINT AS o, ((l_linenumber - 1) * 100 + (l_quantity::BIGINT) * 6)::BIGINT AS e FROM lineitem),
 r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY session ORDER BY o, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM p), g AS (SELECT session, min(o) AS gap FROM r WHERE o > reach GROUP BY session)
 SELECT r.session, coalesce(max(e) FILTER (gap IS NULL OR o < gap), 0) AS through FROM r LEFT JOIN g ON g.session = r.session GROUP BY r.session""")
def covered_bytes(spark, sf_dir):
    """How much of each long row its pieces cover from the start."""
    raw = tables.table(spark, sf_dir, "lineitem")
    pieces = raw.select(F.col("l_orderkey").alias("session"), ((F.col("l_linenumber") - 1) * 100).cast("long").alias("offset"), (F.col("l_quantity").cast("long") * 6).alias("length"))
    return sessions.covered(pieces, ["session"])


@query()
def text_chunks(spark, sf_dir):
    """Whole texts in pieces of at most 4,096 bytes."""
    held = tables.memories(spark, sf_dir)
    return sessions.chunks(held, 4096, ["id"]).select("id", "offset", F.octet_length("text").alias("length"), "revision")


@query()
def recurring_runs(spark, sf_dir):
    """Texts that two or more runs hold, all of them taken for scratch."""
    held = tables.memories(spark, sf_dir).withColumns({"tier": F.lit("scratch"), "archived_at": F.lit(None).cast("long")})
    return sessions.recurring(held, held.groupBy("session").agg(F.min("observed_at").alias("opened")), 0)


@query("""WITH $MEMORY, l AS (SELECT id, lead(id) OVER w AS nx, observed_at, lead(observed_at) OVER w AS nat FROM memory WINDOW w AS (PARTITION BY scope ORDER BY observed_at, id)), live AS (SELECT id FROM memory WHERE valid_to IS NULL AND archived_at IS NULL AND tier <> 'archive')
 SELECT CASE WHEN nat - observed_at <= 300 THEN 'overlaps' ELSE 'before' END AS kind, count(*) AS n FROM l WHERE nx IS NOT NULL AND id IN (SELECT id FROM live) AND nx IN (SELECT id FROM live) GROUP BY ALL""")
def relation_census(spark, sf_dir):
    """Relations in time between live memories, by kind."""
    from silt.operators import evidence

    held = tables.memories(spark, sf_dir)
    return relations.census(relations.temporal(held.withColumn("at", F.col("observed_at"))), evidence.live(held))


@query()
def entity_recall(spark, sf_dir):
    """Live memories about what each benchmark passage is about, in the scope it is asked in."""
    from silt.operators import evidence

    held = tables.memories(spark, sf_dir)
    asked = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"), "text")
    return relations.by_entity(relations.entities(held), asked, evidence.live(held)).select("qid", "id", F.round("entity", 6).alias("entity"))


@query("""WITH $MEMORY, $WITNESS, w AS (SELECT memory, arg_max(kind, weight::DOUBLE * 1e12 + at * 10.0 + id / 1e7) AS kind, count(DISTINCT session) AS runs FROM witness GROUP BY memory)
 SELECT id, '- [' || right(id::VARCHAR, 8) || '] ' || trim(text, ' ') || ' (' || CASE kind """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.ORIGIN.items()) + """ ELSE 'on record' END || ', ' || strftime(make_timestamp(observed_at * 1000000), '%Y-%m-%d') || CASE WHEN runs > 1 THEN ', ' || runs::VARCHAR || ' runs' ELSE '' END || ')' AS line
 FROM memory m LEFT JOIN w ON w.memory = m.id WHERE text IS NOT NULL""")
def offered_lines(spark, sf_dir):
    """Every memory as it is offered: its text, where it comes from, since when, and how many runs say so."""
    said = tables.witnesses(spark, sf_dir).groupBy(F.col("memory").alias("id")).agg(F.max_by("kind", F.struct("weight", "at", "id")).alias("kind"), F.countDistinct("session").alias("runs"))
    held = tables.memories(spark, sf_dir).filter("text is not null").join(said, "id", "left")
    return held.select("id", offered.line(F.col("id").cast("string"), F.col("text"), F.col("kind"), F.col("observed_at"), F.coalesce("runs", F.lit(0)), F.lit(None).cast("string")).alias("line"))


@query("WITH $WITNESS, k AS (SELECT channel, kind, CASE WHEN kind IN ('imperative', 'correction') AND (id % 2 = 0 OR channel NOT IN ('user-instruction', 'user-correction', 'manual-write')) THEN 'distillation' ELSE kind END AS counts_as FROM witness) SELECT channel, kind, counts_as, count(*) AS n FROM k GROUP BY ALL")
def witness_downgrade(spark, sf_dir):
    """What witnesses count as, had every second come from outside."""
    said = tables.witnesses(spark, sf_dir)
    through = F.when(F.col("id") % 2 == 0, "external-content").otherwise(F.col("channel"))
    return said.select("channel", "kind", offered.witness_kind(through, F.col("kind")).alias("counts_as")).groupBy("channel", "kind", "counts_as").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id AS session, turn AS cursor, len(list_distinct(list_transform(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: strlen(w) >= 3 AND NOT list_contains({array(W.COMMON)}, w)), lambda w: regexp_replace(w, 's$', '')))) AS n FROM conversations WHERE text IS NOT NULL")
def about_words(spark, sf_dir):
    """How many things each turn is about."""
    return tables.turns(spark, sf_dir).filter("text is not null").select("session", "cursor", F.size(offered.about(F.col("text"))).cast("long").alias("n"))
