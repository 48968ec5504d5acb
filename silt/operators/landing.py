"""Landing: how candidates join what is held, and how memories leave again.

Each landing is a join by priority against the held snapshot; only the choice
among a candidate's few matches is ranked. Callers write the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.functions import text
from silt.operators import remember, slots
from silt.operators.graph import cut, reached


def revising(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Pairs whose second clause (columns of words) only changes the value of the first; built up in steps of plain columns."""
    a, b = F.col(before), F.col(after)
    common = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int"), F.lit(0))
    step = pairs.withColumn("_same", common(a, b)).withColumn("_head", F.when(F.col("_same") == 0, F.size(a)).otherwise(F.col("_same") - 1))
    step = step.withColumns({"_ra": F.reverse(F.slice(a, F.col("_head") + 1, F.size(a))), "_rb": F.reverse(F.slice(b, F.col("_head") + 1, F.size(b)))})
    step = step.withColumn("_tail", common(F.col("_ra"), F.col("_rb"))).withColumn("_end", F.when(F.col("_tail") == 0, F.size("_ra")).otherwise(F.col("_tail") - 1))
    step = step.withColumns({"_ma": F.size("_ra") - F.col("_end"), "_mb": F.size("_rb") - F.col("_end")})
    sides = F.when((F.col("_ma") == 0) | (F.col("_mb") == 0), F.greatest("_ma", "_mb") <= 3).otherwise((F.col("_ma") <= 2) & (F.col("_mb") <= 2))
    fits = (F.size(a) >= 2) & (F.size(b) >= 2) & (F.col("_head") >= 2) & ((F.col("_head") + F.col("_end")) * 2 >= F.least(F.size(a), F.size(b)))
    return step.filter(fits & (F.col("_ma") + F.col("_mb") > 0) & sides).drop("_same", "_head", "_ra", "_rb", "_tail", "_end", "_ma", "_mb")


def resolve(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """What each candidate (cid, scope, tier, text, subject, predicate, object, weight) would meet by itself: action and the memory met.

    Nothing is written and no candidate meets another; ``land`` does both.
    Only live memories are met: neither closed nor archived. A single-valued slot
    decides by its live fact; else equal content of the same tier, then the newest
    of eight facts with the same lead whose value it revises. Equal
    objects or texts reinforce; a weaker revision of a many-valued claim
    disputes; any other supersedes; nothing met is added.
    """
    marks = {"_hash": text.content_hash(F.col("text")), "_lead": text.lead(F.col("text")), "_clause": text.clause(F.col("text"))}
    for ended in ("valid_to", "archived_at"):
        held = held.filter(F.col(ended).isNull()) if ended in held.columns else held
    held = held.withColumns(marks)
    new = candidates.withColumns(marks | {"_single": F.coalesce(text.single_valued(F.col("predicate")), F.lit(False))})
    m = held.select("scope", F.col("id").alias("mid"), F.col("subject").alias("ms"), F.col("predicate").alias("mp"), F.col("object").alias("mo"), F.col("_clause").alias("mc"), F.col("_hash").alias("mh"), F.col("_lead").alias("ml"), F.col("tier").alias("mtier"), F.col("observed_at").alias("mat"))
    by_slot = new.filter("_single and subject is not null").join(m, (new.scope == m.scope) & (F.col("subject") == F.col("ms")) & (F.col("predicate") == F.col("mp")) & (F.col("mtier") == "fact")).select(new["*"], "mid", "mo", "mat", F.lit(1).alias("via"))
    by_hash = new.filter("not _single").join(m, (new.scope == m.scope) & (F.col("_hash") == F.col("mh")) & (F.col("tier") == F.col("mtier"))).select(new["*"], "mid", "mo", "mat", F.lit(2).alias("via"))
    newest = m.filter("mtier = 'fact' and ml <> ''").withColumn("_p", F.row_number().over(Window.partitionBy("scope", "ml").orderBy(F.col("mat").desc(), F.col("mid").desc()))).filter("_p <= 8")
    # the clauses are columns of their own before they are compared: the rule names them many times
    pairs = new.filter("not _single").join(newest, (new.scope == newest.scope) & (F.col("_lead") == F.col("ml"))).select(new["*"], "mid", "mo", "mat", "mc")
    by_lead = revising(pairs, "mc", "_clause").drop("mc").withColumn("via", F.lit(3))
    met = slots.latest(by_slot.union(by_hash).union(by_lead), ["cid"], [F.col("via"), F.col("mat").desc(), F.col("mid").desc()])
    same = F.when(F.col("via") == 1, F.lower("object").eqNullSafe(F.lower("mo"))).when(F.col("via") == 2, F.lit(True)).otherwise(F.lit(False))
    action = F.when(same, "reinforced").when((F.col("via") != 1) & (F.col("weight") < 0.5), "disputed").otherwise("superseded")
    return candidates.join(met.select("cid", "mid", action.alias("action")), "cid", "left").withColumn("action", F.coalesce("action", F.lit("added")))


def land(candidates: DataFrame, held: DataFrame, now: int) -> dict[str, DataFrame]:
    """The next snapshot and what changed: memories, links and new witnesses.

    Candidates land in order, each on what the former left (``remember.actions``);
    a memory closes when the candidate that supersedes it was seen, or ``now``.
    """
    met = cut(candidates.join(remember.actions(candidates, held), "cid"))
    at = next((F.col(c) for c in ("at", "observed_at") if c in candidates.columns), F.lit(None))
    closing = met.filter("action = 'superseded'").select(F.col("mid").alias("id"), F.coalesce(at, F.lit(now)).cast("long").alias("closed_at"))
    added = met.filter("action <> 'reinforced'")
    as_held = {"id": "cid", "observed_at": "at"} if "observed_at" not in added.columns else {"id": "cid"}
    column = lambda c: F.col(as_held.get(c, c)) if as_held.get(c, c) in added.columns else F.lit(None)
    fresh = added.select(*[column(c).cast(held.schema[c].dataType).alias(c) for c in held.columns])
    kept = held.unionByName(fresh).join(closing, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "closed_at")).select(held.columns)
    one = lambda rel, src, dst, rows: rows.select(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))
    replaced, disputed = added.filter("action = 'superseded'"), added.filter("action = 'disputed'")
    links = one("supersedes", "cid", "mid", replaced).union(one("contradicts", "mid", "cid", replaced)).union(one("contradicts", "cid", "mid", disputed)).union(one("contradicts", "mid", "cid", disputed))
    seen = met.select(F.col("landed").alias("memory"), F.col("cid").alias("witness"), "weight")
    return {"memories": kept, "links": links, "witnesses": seen, "actions": met.select("cid", "mid", "via", "action", "landed")}


def _derived(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots and all derived from them."""
    down = links.filter("rel = 'derived_from'").select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    return reached(down, roots.select(F.col("id").alias("root"))).select(F.col("node").alias("_gone"))


def purge(roots: DataFrame, links: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Every table without the rows of the roots and of all derived from them; tables are (rows, memory column)."""
    gone = _derived(roots, links)
    return {name: rows.join(gone, F.col(column) == F.col("_gone"), "left_anti") for name, (rows, column) in tables.items()}


def purge_preview(roots: DataFrame, links: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """How many rows of each table a purge of the roots would reach."""
    gone = _derived(roots, links)
    counts = [rows.join(gone, F.col(column) == F.col("_gone"), "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, (rows, column) in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.union(other)
    return out


def domain_taint(witnesses: DataFrame, domain: str) -> DataFrame:
    """Memories that a domain witnesses, and whether nothing else does."""
    mine = F.count_if(F.coalesce(F.col("domain") == domain, F.lit(False)))
    return witnesses.groupBy("memory").agg(mine.alias("tainted"), F.count("*").alias("n")).filter("tainted > 0").withColumn("wholly", F.col("tainted") == F.col("n"))


def retained(turns: DataFrame, cited: DataFrame, last_seen: DataFrame, before: int) -> DataFrame:
    """Turns that stay: those of sessions active since, and cited ones."""
    quiet = last_seen.filter(F.col("last_at") < before).select("session")
    uncited = turns.join(quiet, "session", "left_semi").join(cited.select("session", "cursor").distinct(), ["session", "cursor"], "left_anti").select("session", "cursor")
    return turns.join(uncited, ["session", "cursor"], "left_anti")


def redact(turns: DataFrame, literal: str, mask: str = "[redacted]") -> DataFrame:
    """Turns with a literal, plain or JSON-escaped, replaced."""
    import json

    escaped = json.dumps(literal)[1:-1]
    out = F.replace(F.col("text"), F.lit(literal), F.lit(mask))
    out = F.replace(out, F.lit(escaped), F.lit(mask)) if escaped != literal else out
    return turns.withColumn("text", F.when(F.contains("text", F.lit(literal)) | F.contains("text", F.lit(escaped)), out).otherwise(F.col("text")))


def quoting(turns: DataFrame, literal: str) -> DataFrame:
    """Turns whose text holds a literal."""
    return turns.filter(F.contains("text", F.lit(literal))).select("session", "cursor")


def move_scope(memories: DataFrame, source: str, target: str, now: int) -> DataFrame:
    """Memories of one scope moved to another; a moved single-valued fact is closed where the target's slot is live."""
    live = memories.filter((F.col("scope") == target) & F.col("valid_to").isNull() & F.col("subject").isNotNull()).select("subject", "predicate").distinct().withColumn("_taken", F.lit(True))
    moved = memories.filter(F.col("scope") == source).join(live, ["subject", "predicate"], "left")
    clash = F.coalesce("_taken", F.lit(False)) & text.single_valued(F.col("predicate"))
    moved = moved.withColumns({"valid_to": F.when(clash & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to")), "scope": F.lit(target)})
    return memories.filter(F.col("scope") != source).unionByName(moved.drop("_taken"))


def first_wins(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Bindings decided once: the first value of a key, and how many later ones differ."""
    first = rows.groupBy(*keys).agg(F.min_by(value, order).alias("bound"))
    return rows.join(first, keys).groupBy(*keys, "bound").agg(F.count_if(F.col(value) != F.col("bound")).alias("refused"))


def handle(memories: DataFrame, suffix: str) -> DataFrame:
    """The memory that an exact id or a unique suffix names; none if several fit."""
    name = F.col("id").cast("string")
    found = memories.filter((name == suffix) | name.endswith(suffix)).withColumn("_exact", name == suffix).orderBy(F.col("_exact").desc(), "id").limit(2)
    n = F.count("*").over(Window.partitionBy())
    return found.withColumn("_n", n).filter("_exact or _n = 1").drop("_exact", "_n")


def health(memories: DataFrame, witnesses: DataFrame, links: DataFrame) -> DataFrame:
    """Integrity counts, one row a check."""
    checks = {
        "memories without text": memories.filter("text is null or text = ''"),
        "memories without a witness": memories.join(witnesses.select(F.col("memory").alias("id")).distinct(), "id", "left_anti"),
        "witnesses without a memory": witnesses.join(memories.select(F.col("id").alias("memory")), "memory", "left_anti"),
        "repeated witnesses": witnesses.groupBy("memory", "id").count().filter("count > 1"),
        "links to nothing": links.join(memories.select(F.col("id").alias("dst")), "dst", "left_anti"),
        "self links": links.filter("src = dst"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def section(scored: DataFrame, tiers: list[str], importance: list[str] | None, floor: Column) -> DataFrame:
    """Memories that a section of the context may show."""
    out = scored.filter(F.col("tier").isin(tiers) & (F.col("confidence") >= floor))
    return out.filter(F.col("importance").isin(importance)) if importance else out
