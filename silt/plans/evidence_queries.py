"""Evidence, lifecycle, slots and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silt.functions import score, text
from silt.operators import evidence, landing, ledger, remember, slots
from silt.plans.registry import query
from silt.sources import tables
from silt.sources.tables import NOW

CONFIDENCE = """$WITNESS, valued AS (SELECT memory, session, kind, coalesce(domain, 'session:' || session) AS domain,
  weight * (0.25 + 0.75 * exp(-greatest(0, ($NOW - at) / 86400.0) / 365)) AS v FROM witness),
 per_domain AS (SELECT memory, domain, max(v) * (1 + 0.25 * (1 - 1.0 / count(*))) AS e, count(*) AS n, bool_and(kind = 'repetition') AS rep FROM valued GROUP BY ALL),
 sess AS (SELECT memory, count(DISTINCT session) AS n_sessions FROM valued GROUP BY ALL),
 total AS (SELECT memory, sum(e) AS evidence, count(*) AS n_domains, sum(n)::BIGINT AS n_witnesses, bool_and(rep) AS rep FROM per_domain GROUP BY ALL),
 raw AS (SELECT memory, n_witnesses, n_sessions, n_domains, rep, greatest(0, least(1, evidence / (evidence + 0.5) *
   CASE WHEN least(n_sessions, n_domains) <= 1 THEN 0.75 ELSE 1 - 0.25 * exp(-(least(n_sessions, n_domains) - 1)) END)) AS c FROM total JOIN sess USING (memory)),
 confidence AS (SELECT memory, n_witnesses, n_sessions, n_domains, rep AS only_repetition, CASE WHEN rep THEN least(c, 0.3) ELSE c END AS confidence FROM raw)"""


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.confidence_by_memory(tables.witnesses(spark, sf_dir), F.lit(NOW))


@query(f"WITH {CONFIDENCE} SELECT memory, n_witnesses, n_sessions, n_domains, only_repetition, round(confidence, 6) AS confidence FROM confidence")
def confidence_by_memory(spark, sf_dir):
    """The flagship: what every memory is worth on its witnesses' account."""
    out = confidences(spark, sf_dir)
    return out.select("memory", "n_witnesses", F.col("n_sessions").cast("long").alias("n_sessions"), "n_domains", "only_repetition", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {CONFIDENCE} SELECT memory, CASE WHEN round(confidence, 6) >= 0.5 THEN 'promote' WHEN round(confidence, 6) >= 0.3 THEN 'hold' ELSE 'refuse' END AS verdict FROM confidence")
def verdicts(spark, sf_dir):
    """Promote, hold or refuse."""
    return confidences(spark, sf_dir).select("memory", score.verdict(F.round("confidence", 6)).alias("verdict"))


RATE = "CASE WHEN pinned THEN 0.0 ELSE CASE importance WHEN 'critical' THEN 0.005 WHEN 'high' THEN 0.01 WHEN 'low' THEN 0.1 ELSE 0.05 END / (1 + ln(1.0 + access_count)) END::DOUBLE"
TEMPO = "CASE tier WHEN 'fact' THEN 0.25 WHEN 'habit' THEN 0.35 WHEN 'episode' THEN 1.4 WHEN 'scratch' THEN 2.0 ELSE 1.0 END::DOUBLE"
AGE = "greatest(0, ($NOW - observed_at) / 86400.0)"


@query(f"WITH $MEMORY SELECT id, tier, round(exp(-{RATE} * {AGE}), 6) AS strength, round(exp(-{RATE} * {TEMPO} * {AGE}), 6) AS tier_strength FROM memory")
def strength_decay(spark, sf_dir):
    """Strength of every memory now, plain and at its tier's tempo."""
    out = evidence.decayed(tables.memories(spark, sf_dir), F.lit(NOW))
    return out.select("id", "tier", F.round("strength", 6).alias("strength"), F.round("tier_strength", 6).alias("tier_strength"))


@query(f"""WITH $MEMORY, d AS (SELECT tier, round(exp(-{RATE} * {TEMPO} * {AGE}), 6) AS s FROM memory WHERE NOT pinned AND archived_at IS NULL)
 SELECT tier, count(*) AS n, count(*) FILTER (s < 0.05) AS archives FROM d WHERE s <> 1 GROUP BY ALL""")
def decay_sweep_report(spark, sf_dir):
    """What a sweep would change and archive, by tier."""
    held = evidence.decayed(tables.memories(spark, sf_dir).filter("not pinned and archived_at is null"), F.lit(NOW))
    rounded = held.select("tier", F.round("tier_strength", 6).alias("s")).filter("s <> 1")
    return rounded.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("s") < score.FLOOR["spent"]).alias("archives"))


@query("""WITH u AS (SELECT user_id AS memory, count(*) AS n, max(floor(epoch(ts)))::BIGINT AS last FROM events GROUP BY ALL),
 f AS (SELECT memory, n, round(((1 - exp(-n / 8.0)) + exp(-greatest(0, ($NOW - last) / 86400.0) / 7)) / 2, 6) AS frecency FROM u)
 SELECT * FROM f ORDER BY frecency DESC, memory LIMIT 100""")
def frecency_rank(spark, sf_dir):
    """The hundred memories needed most often and most recently."""
    used = tables.actions(spark, sf_dir).groupBy("memory").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    out = used.select("memory", "n", F.round(score.frecency(F.col("n"), F.col("last"), F.lit(NOW)), 6).alias("frecency"))
    return out.orderBy(F.col("frecency").desc(), "memory").limit(100)


@query("WITH $MEMORY SELECT tier, count(*) AS n FROM memory WHERE valid_to IS NULL AND archived_at IS NULL AND tier <> 'archive' GROUP BY ALL")
def live_view_census(spark, sf_dir):
    """Live memories by tier."""
    return evidence.live(tables.memories(spark, sf_dir)).groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH $MEMORY SELECT id FROM memory WHERE archived_at IS NULL AND valid_to IS NULL AND NOT (NOT pinned AND $NOW - observed_at > 365 * 86400)
 AND round(exp(-""" + RATE + " * " + TEMPO + " * " + AGE + """), 6) >= 0.05""")
def assertable_memories(spark, sf_dir):
    """Memories that may be asserted now, all held at full confidence."""
    held = tables.memories(spark, sf_dir).withColumn("confidence", F.lit(1.0))
    return evidence.assertable(held, F.lit(NOW)).filter(F.round("tier_strength", 6) >= 0.05).select("id")


@query("WITH $WITNESS SELECT memory, min(CASE channel WHEN 'external-content' THEN 2 WHEN 'distiller-summary' THEN 1 ELSE 0 END)::INT AS ceiling, count(*) AS n, count(DISTINCT session) AS n_sessions, count(DISTINCT coalesce(domain, 'session:' || session)) AS n_domains, bool_or(channel = 'external-content') AS external, bool_and(channel = 'distiller-summary') AS inferred_only, count(DISTINCT coalesce(domain, 'session:' || session)) < count(DISTINCT session) AS fewer_domains FROM witness GROUP BY memory")
def trust_report(spark, sf_dir):
    """Where each memory's evidence comes from."""
    return evidence.trust(tables.witnesses(spark, sf_dir))


@query("""WITH $WITNESS, sus AS (SELECT doc_id AS memory, contains(lower(text), 'the') AS s FROM documents),
 d AS (SELECT memory, count(DISTINCT coalesce(domain, 'session:' || session)) AS nd FROM witness GROUP BY ALL),
 w AS (SELECT w.memory, CASE WHEN coalesce(s, false) AND channel NOT IN ('user-instruction', 'user-correction') THEN 4
   WHEN channel = 'external-content' THEN CASE WHEN nd > 1 THEN 1 ELSE 2 END WHEN channel = 'distiller-summary' THEN 1 ELSE 0 END AS o
   FROM witness w JOIN d USING (memory) LEFT JOIN sus ON w.memory = sus.memory)
 SELECT memory, ['asserted', 'advisory', 'evidence', 'listed', 'quarantined'][min(o) + 1] AS presentation FROM w GROUP BY memory""")
def presentation_mode(spark, sf_dir):
    """How each memory may be shown; here a text with a common word stands in for a suspicious one."""
    suspicious = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory"), F.contains(F.lower("text"), F.lit("the")).alias("suspicious"))
    return evidence.presentation(tables.witnesses(spark, sf_dir), suspicious)


@query("WITH $SLOT SELECT subject, predicate, id, object, valid_from FROM slot QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, id DESC) = 1")
def slot_current(spark, sf_dir):
    """The live answer of every slot."""
    return slots.current(tables.slots(spark, sf_dir)).select("subject", "predicate", "id", "object", "valid_from")


@query("WITH $SLOT SELECT subject, predicate, id, object, valid_from FROM slot WHERE valid_from <= 820454400 QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, id DESC) = 1")
def slot_asof(spark, sf_dir):
    """What every slot answered at the start of 1996."""
    return slots.as_of(tables.slots(spark, sf_dir), F.lit(820_454_400)).select("subject", "predicate", "id", "object", "valid_from")


@query("""WITH $SLOT, ask AS (SELECT subject, predicate, valid_from + 43200 AS at, id AS ask_id FROM slot)
 SELECT a.ask_id, a.subject, a.predicate, a.at, s.id, s.object FROM ask a JOIN slot s ON a.subject = s.subject AND a.predicate = s.predicate AND s.valid_from <= a.at
 QUALIFY row_number() OVER (PARTITION BY a.ask_id ORDER BY s.valid_from DESC, s.id DESC) = 1""")
def slot_asof_join(spark, sf_dir):
    """Half a day after every answer: what its slot then says. Asks and answers merge in time order."""
    held = tables.slots(spark, sf_dir)
    asks = held.select("subject", "predicate", (F.col("valid_from") + 43_200).alias("at"), F.col("id").alias("ask_id"))
    return slots.as_of_join(asks, held, slots.SLOT).select("ask_id", "subject", "predicate", "at", "id", "object")


@query("""WITH $SLOT SELECT id, subject, predicate, object, valid_from, lead(valid_from) OVER w AS valid_to, row_number() OVER w AS version FROM slot
 WINDOW w AS (PARTITION BY subject, predicate ORDER BY valid_from, id)""")
def slot_scd2(spark, sf_dir):
    """Every answer with the time it was superseded."""
    out = slots.history(tables.slots(spark, sf_dir))
    return out.select("id", "subject", "predicate", "object", "valid_from", "valid_to", F.col("version").cast("long").alias("version"))


@query("""WITH $SLOT, l AS (SELECT id AS src, lag(id) OVER w AS dst, lag(object) OVER w AS was, object, valid_from AS at FROM slot WINDOW w AS (PARTITION BY subject, predicate ORDER BY valid_from, id))
 SELECT src, 'supersedes' AS rel, dst, at FROM l WHERE dst IS NOT NULL AND was <> object""")
def slot_supersessions(spark, sf_dir):
    """Links of answers to those they replaced."""
    return slots.supersessions(tables.slots(spark, sf_dir))


LINKS = """c AS (SELECT a.id AS src, b.id AS dst FROM slot a JOIN slot b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object),
 settled AS (SELECT src, dst FROM c WHERE (src + dst) % 5 = 0)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions among all answers of each slot; every fifth pair reconciled."""
    found = slots.contradictions(tables.slots(spark, sf_dir))
    return found.union(found.filter((F.col("src") + F.col("dst")) % 5 == 0).withColumn("rel", F.lit("reconciled")))


@query(f"WITH $SLOT, {LINKS} SELECT src, dst FROM c WHERE src < dst AND (src + dst) % 5 <> 0")
def open_disagreements(spark, sf_dir):
    """Contradicting answers that nothing has reconciled, once each."""
    return slots.open_disagreements(links(spark, sf_dir))


@query(f"WITH $SLOT, {LINKS} SELECT c.dst AS memory, round(sum((c.src % 10) / 10.0), 6) AS pressure FROM c WHERE (c.src + c.dst) % 5 <> 0 GROUP BY c.dst")
def contradiction_pressure(spark, sf_dir):
    """Summed confidence of each answer's open contradictors; an answer's confidence is a tenth of its id's last digit."""
    held = tables.slots(spark, sf_dir).select("id", (F.col("id") % 10 / 10.0).alias("confidence"))
    return slots.pressure(links(spark, sf_dir), held).select("memory", F.round("pressure", 6).alias("pressure"))


@query("""WITH $ACTION, last AS (SELECT memory, id AS outcome_id, outcome, at AS outcome_at FROM action_ WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory ORDER BY at DESC, id DESC) = 1),
 n AS (SELECT memory, count(*) AS n_actions FROM action_ GROUP BY ALL) SELECT memory, n_actions, outcome_id, outcome, outcome_at FROM n LEFT JOIN last USING (memory)""")
def latest_outcome(spark, sf_dir):
    """Each memory's actions with the latest outcome."""
    return ledger.latest_outcome(tables.actions(spark, sf_dir))


@query("""WITH $ACTION, u AS (SELECT memory, count(*) FILTER (attribution <> 'proximal' AND outcome = 'succeeded') AS helpful, count(*) FILTER (attribution <> 'proximal' AND outcome IN ('failed', 'corrected', 'reverted')) AS harmful,
  count(*) FILTER (outcome = 'ignored') AS ignored, count(*) FILTER (outcome IS NULL) AS unknown, count(*) FILTER (attribution = 'proximal' AND outcome IS NOT NULL) AS proximal,
  max(at) FILTER (attribution <> 'proximal' AND outcome IS NOT NULL) AS last_verified_at FROM action_ GROUP BY ALL)
 SELECT *, CASE WHEN helpful + harmful > 0 THEN round(helpful / (helpful + harmful)::DOUBLE, 6) END AS helpfulness FROM u""")
def utility(spark, sf_dir):
    """What using each memory has led to."""
    return ledger.utility(tables.actions(spark, sf_dir))


@query("""WITH shown AS (SELECT event_id // 10 AS injection, user_id AS memory FROM events), used AS (SELECT DISTINCT event_id // 10 AS injection, user_id AS memory FROM events WHERE event_type IN ('purchase', 'error'))
 SELECT memory, count(*) AS n_unused FROM shown s WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.injection = s.injection AND u.memory = s.memory) GROUP BY memory""")
def shown_unused(spark, sf_dir):
    """How often each memory was shown and not used."""
    shown = tables.actions(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("injection"), "memory", "outcome")
    return ledger.shown_unused(shown.drop("outcome"), shown.filter("outcome in ('succeeded', 'failed')"))


TRAINING = """$ACTION, cand AS (SELECT event_id // 100 AS run, user_id AS memory, count(*) AS rank, round(avg(value), 4) AS score FROM events GROUP BY ALL),
 first AS (SELECT id // 100 AS run, memory, outcome FROM action_ QUALIFY row_number() OVER (PARTITION BY id // 100, memory ORDER BY at, id) = 1),
 rows_ AS (SELECT c.run, c.memory, c.rank, c.score, CASE WHEN outcome = 'succeeded' THEN 1 WHEN outcome IN ('failed', 'corrected', 'reverted') THEN 0 END AS label FROM cand c JOIN first USING (run, memory)),
 training AS (SELECT * FROM rows_ WHERE label IS NOT NULL)"""


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = tables.actions(spark, sf_dir).withColumn("run", F.floor(F.col("id") / 100))
    candidates = acts.groupBy("run", "memory").agg(F.count("*").alias("rank"), F.round(F.avg("value"), 4).alias("score"))
    return ledger.training_rows(candidates, acts)


@query(f"WITH {TRAINING} SELECT run, memory, rank, label FROM training")
def training_rows(spark, sf_dir):
    """Candidates with the first action citing them and its label."""
    return training(spark, sf_dir).select("run", "memory", "rank", "label")


@query("""WITH s AS (SELECT event_type AS kind, value, event_type IN ('purchase') OR value > 50 AS pos FROM events),
 r AS (SELECT pos, avg_rank FROM (SELECT pos, rank() OVER (ORDER BY round(value, 1)) + (count(*) OVER (PARTITION BY round(value, 1)) - 1) / 2.0 AS avg_rank FROM (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS pos, value FROM events WHERE event_type IN ('purchase', 'error'))))
 SELECT sum(pos)::BIGINT AS n_pos, sum(1 - pos)::BIGINT AS n_neg, round((sum(avg_rank) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(1 - pos)), 6) AS auc FROM r""")
def auc(spark, sf_dir):
    """How well an event's value tells purchases from errors, ties one half."""
    rows = tables.actions(spark, sf_dir).filter("outcome in ('succeeded', 'failed')").select(F.round("value", 1).alias("s"), (F.col("outcome") == "succeeded").cast("int").alias("y"))
    return ledger.auc(rows, "s", "y")


@query("""WITH n AS (SELECT event_type AS kind, round(value, 2) AS v, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 2)) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT kind, n, v AS value FROM n WHERE i = floor((n - 1) * 0.95 + 0.5)""")
def nearest_rank_p95(spark, sf_dir):
    """The nearest-rank 95th percentile of values by kind."""
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.round("value", 2).alias("v"))
    return ledger.nearest_rank(rows, ["kind"], "v", 0.95)


@query()
def logistic_gd(spark, sf_dir):
    """A ranker fitted by gradient steps on the training rows: its weights."""
    rows = training(spark, sf_dir).withColumn("row", F.col("run") * 1000 + F.col("memory") % 1000)
    model = ledger.fit_logistic(rows, ["rank", "score"], "label", passes=5)
    made = [(f, float(w), float(model["bias"])) for f, w in zip(model["features"], model["weights"], strict=True)]
    return spark.createDataFrame(made, "feature string, weight double, bias double")


@query("""WITH o AS (SELECT o_custkey AS key, max(floor(epoch(o_orderdate))::BIGINT) AS at FROM orders GROUP BY ALL), e AS (SELECT user_id AS key, max(floor(epoch(ts))::BIGINT) AS at FROM events GROUP BY ALL),
 a AS (SELECT * FROM o UNION ALL SELECT * FROM e) SELECT key, max(at) AS last_at FROM a GROUP BY key HAVING max(at) < 900000000""")
def session_idle(spark, sf_dir):
    """Keys without activity in two sources since July 1998."""
    from silt.operators import transcripts

    first = tables.slots(spark, sf_dir).select(F.col("subject").alias("key"), F.col("valid_from").alias("at"))
    return transcripts.idle([first, tables.actions(spark, sf_dir).select(F.col("memory").alias("key"), "at")], 900_000_000)


@query("WITH $WITNESS SELECT memory, count(*) FILTER (domain = 'ext:1') AS tainted, count(*) AS n, count(*) FILTER (domain = 'ext:1') = count(*) AS wholly FROM witness GROUP BY memory HAVING count(*) FILTER (domain = 'ext:1') > 0")
def domain_taint(spark, sf_dir):
    """Memories that one outside domain witnesses."""
    return landing.domain_taint(tables.witnesses(spark, sf_dir), "ext:1")


@query("WITH $WITNESS SELECT session, count(DISTINCT memory) AS n_memories FROM witness GROUP BY session")
def session_yield(spark, sf_dir):
    """How many memories each session has witnessed."""
    return tables.witnesses(spark, sf_dir).groupBy("session").agg(F.countDistinct("memory").alias("n_memories"))


@query("""SELECT o_custkey AS k, min_by(o_orderpriority, o_orderkey) AS bound, count(*) FILTER (o_orderpriority <> first_) AS refused FROM
 (SELECT *, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_ FROM orders) GROUP BY o_custkey""")
def binding_first_wins(spark, sf_dir):
    """Bindings decided once; later differing ones are counted as refused."""
    rows = tables.slots(spark, sf_dir).select(F.col("subject").alias("k"), "id", "predicate")
    return landing.first_wins(rows, ["k"], "id", "predicate")


@query("""WITH $MEMORY, $WITNESS SELECT 'memories without text' AS "check", count(*) FILTER (text IS NULL OR text = '') AS n FROM memory
 UNION ALL SELECT 'memories without a witness', count(*) FROM memory WHERE id NOT IN (SELECT memory FROM witness)
 UNION ALL SELECT 'witnesses without a memory', count(*) FROM witness WHERE memory NOT IN (SELECT id FROM memory)
 UNION ALL SELECT 'repeated witnesses', count(*) FROM (SELECT 1 FROM witness GROUP BY memory, id HAVING count(*) > 1)
 UNION ALL SELECT 'links to nothing', count(*) FROM witness WHERE memory NOT IN (SELECT id FROM memory)
 UNION ALL SELECT 'self links', count(*) FROM witness WHERE id = memory""")
def health_checks(spark, sf_dir):
    """Integrity counts over memories, witnesses and links (a witness id standing in for a link's source)."""
    held = tables.witnesses(spark, sf_dir)
    edges = held.select(F.col("id").alias("src"), F.lit("about").alias("rel"), F.col("memory").alias("dst"))
    return landing.health(tables.memories(spark, sf_dir), held, edges)


@query("""WITH c AS (SELECT o_orderkey AS cid, o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS object FROM orders WHERE o_orderkey % 4 = 0),
 h AS (SELECT o_orderkey AS mid, o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS object, o_orderdate FROM orders WHERE o_orderkey % 4 <> 0),
 m AS (SELECT c.cid, h.mid, lower(c.object) = lower(h.object) AS same FROM c JOIN h USING (subject, predicate) QUALIFY row_number() OVER (PARTITION BY c.cid ORDER BY h.o_orderdate DESC, h.mid DESC) = 1)
 SELECT cid, mid, CASE WHEN mid IS NULL THEN 'added' WHEN same THEN 'reinforced' ELSE 'superseded' END AS action FROM c LEFT JOIN m USING (cid)""")
def landing_actions(spark, sf_dir):
    """How a quarter of the slot facts would land on the rest."""
    facts = tables.slots(spark, sf_dir).select(F.col("id"), F.lit("all").alias("scope"), F.lit("fact").alias("tier"), F.concat_ws(" ", "subject", "predicate", "object").alias("text"), F.col("subject").cast("string").alias("subject"), "predicate", "object", F.col("valid_from").alias("observed_at"), F.lit(None).cast("long").alias("valid_to"))
    new = facts.filter("id % 4 = 0").withColumnRenamed("id", "cid").withColumn("weight", F.lit(1.0))
    return landing.resolve(new, facts.filter("id % 4 <> 0")).select("cid", "mid", "action")


@query("""WITH c AS (SELECT change_id AS cid, min(source) AS scope, min(client_id)::VARCHAR AS subject, min(floor(epoch(valid_at)))::BIGINT AS at, min(city) AS city FROM client_changes WHERE change_id IS NOT NULL GROUP BY change_id),
 h AS (SELECT -1 - client_id AS id, min(source) AS scope, client_id::VARCHAR AS subject, min(city) AS city FROM clients WHERE client_id IS NOT NULL GROUP BY client_id),
 r AS (SELECT id, 0 AS new_, NULL::BIGINT AS at, scope, subject, city FROM h UNION ALL SELECT cid, 1, at, scope, subject, city FROM c),
 k AS (SELECT *, CASE WHEN subject IS NULL THEN concat('none ', scope, lower(city)) ELSE concat(scope, '|', subject) END AS slot, lower(coalesce(city, '')) AS said FROM r),
 p AS (SELECT *, said IS DISTINCT FROM lag(said) OVER w AS head, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY slot, scope ORDER BY new_, at NULLS FIRST, id)),
 m AS (SELECT *, max(CASE WHEN head OR n = 1 THEN n END) OVER (PARTITION BY slot, scope ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met FROM p)
 SELECT m.id AS cid, CASE WHEN met IS NULL THEN 'added' WHEN m.head THEN 'superseded' ELSE 'reinforced' END AS action, o.id AS mid, CASE WHEN met IS NULL OR m.head THEN m.id ELSE o.id END AS landed
 FROM m LEFT JOIN p o ON o.slot = m.slot AND o.scope IS NOT DISTINCT FROM m.scope AND o.n = m.met WHERE m.new_ = 1""")
def landing_batch(spark, sf_dir):
    """Every client's changes of city landing in one batch on the city held, in order of time: runs of one answer reinforce it."""
    sent = tables.table(spark, sf_dir, "client_changes").filter("change_id is not null").groupBy(F.col("change_id").alias("cid")).agg(F.min("source").alias("scope"), F.min("client_id").cast("string").alias("subject"), F.min(F.unix_timestamp(F.col("valid_at").cast("timestamp"))).alias("at"), F.min("city").alias("object"))
    held = tables.table(spark, sf_dir, "clients").filter("client_id is not null").groupBy("client_id").agg(F.min("source").alias("scope"), F.min("city").alias("object")).select((-1 - F.col("client_id")).alias("id"), "scope", F.col("client_id").cast("string").alias("subject"), "object", F.lit(None).cast("long").alias("observed_at"))
    said = lambda df: df.withColumns({"tier": F.lit("fact"), "predicate": F.lit("city"), "text": F.concat_ws(" ", "subject", F.lit("city"), "object")})
    return remember.actions(said(sent).withColumn("weight", F.lit(1.0)), said(held)).select("cid", "action", "mid", "landed")


@query()
def landing_claims(spark, sf_dir):
    """Three quarters of the memories of each tier landing in one batch on the open ones of the rest: texts, restatements, revisions."""
    rows = tables.memories(spark, sf_dir).withColumn("held", F.expr("id div 4 % 4 = 0"))  # the tier goes by id % 4
    new = rows.filter("not held").select(F.col("id").alias("cid"), F.col("observed_at").alias("at"), "scope", "tier", "text", F.when(F.col("access_count") < 4, 0.25).otherwise(1.0).alias("weight"), F.when(F.col("tier") == "habit", F.col("text")).alias("trigger"))
    return remember.actions(new, rows.filter("held").withColumn("trigger", F.when(F.col("tier") == "habit", F.col("text"))))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderstatus, lag(o_orderkey) OVER w AS was, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR before = o_orderstatus THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY n) AS island FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY (SELECT o_orderdate FROM orders o WHERE o.o_orderkey = s.id), id) AS n FROM s))
 SELECT id AS memory, min(id) OVER (PARTITION BY c, island) AS dispute, count(*) OVER (PARTITION BY c, island) AS members FROM g QUALIFY members > 1""")
def dispute_groups(spark, sf_dir):
    """The groups in which memories contradict each other, through however many others: an order and the customer's next of another status."""
    raw = tables.table(spark, sf_dir, "orders")
    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    next_ = raw.select(F.col("o_orderkey").alias("src"), "o_orderstatus", F.lead("o_orderkey").over(along).alias("dst"), F.lead("o_orderstatus").over(along).alias("then"))
    return slots.dispute_groups(next_.filter("then <> o_orderstatus").select("src", F.lit("contradicts").alias("rel"), "dst"))
