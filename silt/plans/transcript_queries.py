"""Transcripts, window plans, extraction over tool calls, streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from silt.operators import consolidation, context, landing, notes, transcripts
from silt.plans.registry import query
from silt.sources import journals, tables
from silt.streaming import observe


@query("""WITH $TURN, s AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY cursor DESC) AS spent, row_number() OVER (PARTITION BY session ORDER BY cursor DESC) AS nth FROM turn_)
 SELECT session, cursor, tokens FROM s WHERE nth <= 50 AND (spent <= 200 OR nth = 1)""")
def scroll_tail_budget(spark, sf_dir):
    """The newest turns of every session within 200 tokens."""
    return transcripts.tail(tables.turns(spark, sf_dir), 200, 50).select("session", "cursor", "tokens")


@query("""WITH $TURN, d AS (SELECT *, abs(cursor - 2) AS far, CASE WHEN cursor >= 2 THEN 0 ELSE 1 END AS side FROM turn_), r AS (SELECT *, row_number() OVER (PARTITION BY session, side ORDER BY far) AS rank FROM d),
 s AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY rank, side) AS spent FROM r) SELECT session, cursor FROM s WHERE spent <= 150 OR (rank = 1 AND side = 0)""")
def scroll_around(spark, sf_dir):
    """Turns around each session's third, balanced, within 150 tokens."""
    return transcripts.around(tables.turns(spark, sf_dir), F.lit(2), 150).select("session", "cursor")


def rows(spark, sf_dir):
    calls = tables.tool_rows(spark, sf_dir)
    return calls.select("session", "cursor", "tokens", (F.col("tool") != "N").alias("is_tool"), (F.col("tool") == "N").alias("is_user"), (F.col("cursor") % 7 == 0).alias("pinned"), F.lit(40).cast("long").alias("stub_tokens"))


@query("WITH $TOOL SELECT session, sum(tokens)::BIGINT AS used, count(*) AS live, sum(CASE WHEN tool <> 'N' THEN tokens ELSE 0 END)::BIGINT AS tools, CASE WHEN sum(tokens) = 0 THEN 0.0 ELSE round(sum(CASE WHEN tool <> 'N' THEN tokens ELSE 0 END) / sum(tokens)::DOUBLE, 6) END AS tool_share FROM tool_row GROUP BY session")
def window_shape(spark, sf_dir):
    """What each session's window holds."""
    return transcripts.window_shape(rows(spark, sf_dir))


PLAN = """r AS (SELECT session, cursor, tokens, tool <> 'N' AS is_tool, cursor % 7 = 0 AS pinned FROM tool_row),
 a AS (SELECT *, sum(tokens) OVER (PARTITION BY session) AS used, row_number() OVER (PARTITION BY session ORDER BY cursor DESC) <= 2 OR pinned AS fixed FROM r),
 b AS (SELECT *, NOT fixed AND is_tool AND tokens >= 600 AS may, CASE WHEN NOT fixed AND is_tool AND tokens >= 600 THEN greatest(tokens - 40, 0) ELSE 0 END AS gain FROM a),
 c AS (SELECT *, may AND used - coalesce(sum(gain) OVER (PARTITION BY session ORDER BY cursor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 3000 AS masked FROM b),
 d AS (SELECT *, CASE WHEN masked THEN least(tokens, 40) ELSE tokens END AS cost FROM c),
 e AS (SELECT *, sum(cost) OVER (PARTITION BY session) AS after_mask, coalesce(sum(cost) OVER (PARTITION BY session ORDER BY cursor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before, max(fixed::INT) OVER (PARTITION BY session ORDER BY cursor) AS blocked FROM d),
 f AS (SELECT *, after_mask > 3000 AND blocked = 0 AND freed_before < after_mask - 3000 + 160 AS span FROM e),
 g AS (SELECT *, coalesce(sum(cost) FILTER (span) OVER (PARTITION BY session), 0) AS freed FROM f)"""


@query(f"""WITH $TOOL, {PLAN} SELECT session, cursor, CASE WHEN span AND freed > 160 THEN 'drop' WHEN masked THEN 'mask' ELSE 'keep' END AS action, used::BIGINT AS was,
 (after_mask - CASE WHEN freed > 160 THEN freed - 160 ELSE 0 END)::BIGINT AS used, 3000 AS target, after_mask - CASE WHEN freed > 160 THEN freed - 160 ELSE 0 END <= 3000 AS fits FROM g""")
def window_plan(spark, sf_dir):
    """What to send of each session in 3,000 tokens: masks, then a summary."""
    return transcripts.plan(rows(spark, sf_dir), 4000, 800, 200, 600, 2, 40)


@query()
def lay_out(spark, sf_dir):
    """A full layout of each session in 4,000 tokens."""
    return context.lay_out(rows(spark, sf_dir), 4000)


@query()
def pack_memories(spark, sf_dir):
    """Turns packed greedily into 120 tokens a session, those too large skipped."""
    ranked = tables.turns(spark, sf_dir).select("session", F.col("cursor").alias("rank"), F.col("tokens").alias("cost"))
    return context.pack(ranked, "session", 120)


@query("""WITH $TOOL, h AS (SELECT *, list(CASE WHEN NOT ok THEN {'cursor': cursor, 'tool': tool, 'command': command} END) OVER (PARTITION BY session ORDER BY cursor ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS back FROM tool_row),
 l AS (SELECT *, list_filter(back, lambda x: x IS NOT NULL AND x.tool = tool)[-1] AS last FROM h WHERE ok)
 SELECT session, cursor, last.cursor AS failed_cursor, last.command AS attempted, command AS worked FROM l WHERE last IS NOT NULL AND last.command <> command""")
def repair_lookback(spark, sf_dir):
    """Calls that worked after the same tool had failed shortly before."""
    return transcripts.repairs(tables.tool_rows(spark, sf_dir))


@query("WITH $TOOL SELECT session, path, cursor FROM tool_row WHERE ok QUALIFY row_number() OVER (PARTITION BY session, path ORDER BY cursor) = 3")
def third_read(spark, sf_dir):
    """The third successful read of a file."""
    return transcripts.central_files(tables.tool_rows(spark, sf_dir))


@query("WITH $TOOL SELECT session, cursor, command || ' (~' || (ms // 1000)::VARCHAR || 's)' AS object FROM tool_row WHERE ok AND ms >= 30000")
def slow_commands(spark, sf_dir):
    """Commands worth warning about."""
    return transcripts.slow_commands(tables.tool_rows(spark, sf_dir))


@query("WITH $TOOL SELECT session, cursor, command FROM tool_row QUALIFY row_number() OVER (PARTITION BY session ORDER BY cursor DESC) = 1 AND NOT ok")
def failed_before_end(spark, sf_dir):
    """Sessions whose last call failed."""
    return transcripts.failed_before_end(tables.tool_rows(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS at FROM events), f AS (SELECT *, CASE WHEN at - lag(at) OVER (PARTITION BY key ORDER BY at) <= 3600 THEN 0 ELSE 1 END AS fresh FROM e),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY at) AS island FROM f) SELECT key, island::BIGINT AS island, min(at) AS first, max(at) AS last, count(*) AS n FROM i GROUP BY ALL""")
def quiet_sessions(spark, sf_dir):
    """Runs of activity ended by an hour of quiet."""
    acts = tables.actions(spark, sf_dir).select(F.col("memory").alias("key"), "at")
    return transcripts.islands(acts, "key", "at", 3600).withColumn("island", F.col("island").cast("long"))


@query("""WITH r AS (SELECT l_orderkey AS session, (l_linenumber - 1) * 10 AS first, (l_linenumber - 1) * 10 + l_quantity::BIGINT % 14 AS last FROM lineitem),
 g AS (SELECT *, coalesce(max(last) OVER (PARTITION BY session ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM r),
 b AS (SELECT *, sum((first > reach + 1)::INT) OVER (PARTITION BY session ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM g)
 SELECT session, coalesce(max(last) FILTER (broken = 0), -1)::BIGINT AS through FROM b GROUP BY session""")
def coverage_islands(spark, sf_dir):
    """How far acknowledged ranges reach without a gap."""
    raw = tables.table(spark, sf_dir, "lineitem")
    first = (F.col("l_linenumber").cast("long") - 1) * 10
    ranges = raw.select(F.col("l_orderkey").alias("session"), first.alias("first"), (first + F.rint("l_quantity").cast("long") % 14).alias("last"))
    return transcripts.coverage(ranges)


@query("""SELECT conv_id AS session, left(trim(min_by(text, turn), ' '), 72) AS title, min(turn) AS cursor FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def session_titles(spark, sf_dir):
    """A session's first user text, cut."""
    return transcripts.titles(tables.turns(spark, sf_dir))


@query("""WITH $TURN, b AS (SELECT session, cursor, coalesce(sum(strlen(text)) OVER (PARTITION BY session ORDER BY cursor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turn_)
 SELECT session, cursor, (before // 1000)::BIGINT AS page FROM b""")
def replay_pages(spark, sf_dir):
    """Replay in pages of a thousand bytes."""
    return transcripts.pages(tables.turns(spark, sf_dir), 1000).select("session", "cursor", "page")


@query("""WITH $TURN, stamp AS (SELECT session, max(cursor) - 1 AS through FROM turn_ WHERE session % 2 = 0 GROUP BY session)
 SELECT t.session, t.cursor FROM turn_ t LEFT JOIN stamp s ON t.session = s.session WHERE t.cursor > coalesce(s.through, -1)""")
def undistilled_turns(spark, sf_dir):
    """Turns beyond their session's watermark; every second session has one."""
    held = tables.turns(spark, sf_dir)
    stamps = held.filter("session % 2 = 0").groupBy("session").agg((F.max("cursor") - 1).alias("through"))
    return journals.since(held, stamps).select("session", "cursor")


@query("""WITH $TURN, last AS (SELECT session, max(at) AS last_at FROM turn_ GROUP BY session), gone AS (SELECT t.session, t.cursor FROM turn_ t JOIN last l ON t.session = l.session WHERE last_at < 2000000 AND t.cursor % 4 <> 0)
 SELECT session, cursor FROM turn_ EXCEPT SELECT session, cursor FROM gone""")
def retention_kept(spark, sf_dir):
    """Turns that stay when old sessions lose what nothing cites; every fourth turn is cited."""
    held = tables.turns(spark, sf_dir)
    last = held.groupBy("session").agg(F.max("at").alias("last_at"))
    return landing.retained(held, held.filter("cursor % 4 = 0"), last, 2_000_000).select("session", "cursor").distinct()


@query("""SELECT conv_id AS session, turn AS cursor, replace(text, 'the', '[redacted]') AS text FROM conversations""")
def redact_literal(spark, sf_dir):
    """Turns with a literal replaced."""
    return landing.redact(tables.turns(spark, sf_dir), "the").select("session", "cursor", "text")


@query("""WITH RECURSIVE v AS (SELECT user_id AS model, floor(value / 40 * 1000 + 0.5) / 1000 AS ratio, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE floor(value / 40 * 1000 + 0.5) / 1000 BETWEEN 0.25 AND 3.0),
 r AS (SELECT model, 1.0::DOUBLE AS factor, 0::BIGINT AS n FROM (SELECT DISTINCT user_id AS model FROM events)
 UNION ALL SELECT r.model, greatest(0.5, least(8.0, 0.7 * r.factor + 0.3 * v.ratio)), r.n + 1 FROM r JOIN v ON v.model = r.model AND v.n = r.n + 1)
 SELECT model, round(max_by(factor, n), 6) AS factor FROM r GROUP BY model""")
def fold_factor_ewma(spark, sf_dir):
    """A model's token factor folded over its measured ratios in order."""
    from silt.functions import score

    raw = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), "event_id", (F.floor(F.col("value") / 40 * 1000 + 0.5) / 1000).alias("ratio"))
    ordered = raw.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "ratio"))), lambda x: x["ratio"]).alias("ratios"))
    return ordered.select("model", F.round(score.fold_factor(F.col("ratios")), 6).alias("factor"))


@query("SELECT DISTINCT conv_id AS session, turn AS cursor FROM conversations")
def stream_observe_dedup(spark, sf_dir):
    """Turns observed as a stream, each (session, cursor) once."""
    path = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "conversations.parquet").parquet(sf_dir)
    turns = stream.select(F.col("conv_id").alias("session"), F.col("turn").alias("cursor"), "role", "text")
    name = "observed_" + next(tempfile._get_candidate_names()).replace("-", "_")
    run = observe.deduplicated(turns).select("session", "cursor").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("SELECT conv_id AS session, turn AS cursor, NOT ends_with(rtrim(text, ' '), '?') AND (len(list_intersect(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['must', 'shall', 'always', 'never'])) > 0 OR contains(lower(text), 'from now on') OR contains(lower(text), 'do not ') OR contains(lower(text), 'don''t ') OR contains(lower(text), 'standing rule')) AS obliges FROM conversations")
def obliging_turns(spark, sf_dir):
    """Turns that lay something down."""
    return tables.turns(spark, sf_dir).select("session", "cursor", notes.obliges(F.col("text")).alias("obliges"))


@query("""WITH j AS (SELECT o_custkey AS session, o_orderkey AS id, ['curate', 'extract', 'summarise', 'working', 'contradict', 'retitle', 'tidy'][o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderstatus = 'F' THEN 'issued' ELSE 'queued' END AS state, o_orderkey % 19 = 0 AS blocking, o_orderkey % 7 + 1 AS rank FROM orders),
 r AS (SELECT *, count(*) FILTER (state = 'issued') OVER (PARTITION BY session) AS running FROM j), q AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY id) AS nth FROM r WHERE state = 'queued'),
 p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rank, id) AS place FROM q WHERE nth = 1 OR blocking) SELECT session, id, kind, place FROM p WHERE place + running <= 3 OR blocking""")
def job_schedule(spark, sf_dir):
    """Background work to hand out, orders standing in for jobs."""
    kinds = F.array(*[F.lit(k) for k in notes.JOB_ORDER])
    raw = tables.table(spark, sf_dir, "orders")
    jobs = raw.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"), F.element_at(kinds, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("kind"), F.when(F.col("o_orderstatus") == "F", "issued").otherwise("queued").alias("state"), (F.col("o_orderkey") % 19 == 0).alias("blocking"))
    return notes.schedule(jobs).withColumn("place", F.col("place").cast("long"))


@query()
def eligible_lines(spark, sf_dir):
    """Lines of turns in a person's own words."""
    return notes.eligible_lines(tables.turns(spark, sf_dir), ["session", "cursor"], "text")


@query()
def consolidated_facts(spark, sf_dir):
    """Facts that recurring texts of a scope become."""
    return consolidation.consolidate(tables.memories(spark, sf_dir))


@query("""SELECT event_type AS arm, count(*) AS encounters, round(count(*) FILTER (value > 30) / count(*)::DOUBLE, 6) AS hit_rate, round(count(*) FILTER (value > 60) / count(*) FILTER (value > 60 OR value < 5)::DOUBLE, 6) AS precision, round(count(*) FILTER (value > 20) / count(*)::DOUBLE, 6) AS relevance,
 round((count(*) FILTER (value > 60 OR value < 5) - count(*) FILTER (value < 1)) / count(*) FILTER (value > 60 OR value < 5)::DOUBLE, 6) AS assertion_accuracy, count(*) FILTER (value < 1) AS stale_served, sum(floor(value))::BIGINT AS injected_tokens FROM events GROUP BY event_type""")
def evaluation_measures(spark, sf_dir):
    """Measures of evaluation arms, events standing in for encounters."""
    v = F.col("value")
    rows_ = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (v > 30).alias("known"), (v > 60).alias("right"), (v < 5).alias("wrong"), (v > 20).alias("found"), (v < 1).alias("stale"), (v < 1).alias("old"), F.floor(v).alias("tokens"))
    return consolidation.measures(rows_, ["arm"])
