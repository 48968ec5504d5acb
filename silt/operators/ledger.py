"""The use-and-outcome ledger: utility, training rows, evaluation metrics and the ranker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HELPFUL, HARMFUL = ["succeeded"], ["failed", "corrected", "reverted"]
#: Rows that a ranker is fitted on at least.
LEAST_ROWS = 200


def latest_outcome(actions: DataFrame) -> DataFrame:
    """The last action with an outcome of each memory, ties to the larger id, beside all of its actions."""
    newest = F.max(F.struct("at", "id", "outcome"))
    last = actions.filter("outcome is not null").groupBy("memory").agg(newest.alias("l")).select("memory", F.col("l.id").alias("outcome_id"), F.col("l.outcome").alias("outcome"), F.col("l.at").alias("outcome_at"))
    counts = actions.groupBy("memory").agg(F.count("*").alias("n_actions"))
    return counts.join(last, "memory", "left")


def utility(actions: DataFrame) -> DataFrame:
    """Verified helpful and harmful uses, those merely proximal, unknown ones; helpfulness is null without a verdict."""
    verified = F.col("attribution").isin("structural", "explicit")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = actions.groupBy("memory").agg(
        count(verified & F.col("outcome").isin(HELPFUL)).alias("helpful"),
        count(verified & F.col("outcome").isin(HARMFUL)).alias("harmful"),
        count(F.col("outcome") == "ignored").alias("ignored"),
        count(F.col("outcome").isNull()).alias("unknown"),
        count(~verified & F.col("outcome").isNotNull()).alias("proximal"),
        F.max(F.when(verified & F.col("outcome").isNotNull(), F.col("at"))).alias("last_verified_at"),
    )
    judged = F.col("helpful") + F.col("harmful")
    return out.withColumn("helpfulness", F.when(judged > 0, F.round(F.col("helpful") / judged, 6)))


def shown_unused(shown: DataFrame, used: DataFrame) -> DataFrame:
    """For each memory, how often it was shown and no action cited the injection."""
    return shown.join(used.select("injection", "memory").distinct(), ["injection", "memory"], "left_anti").groupBy("memory").agg(F.count("*").alias("n_unused"))


def training_rows(candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """Candidates with the first action that cites them and its label; rows without a verdict are dropped.

    The first action is a minimum per memory and run, not a correlated lookup.
    """
    first = actions.groupBy("run", "memory").agg(F.min(F.struct("at", "id", "outcome")).alias("f")).select("run", "memory", F.col("f.outcome").alias("outcome"))
    label = F.when(F.col("outcome").isin(HELPFUL), 1).when(F.col("outcome").isin(HARMFUL), 0)
    return candidates.join(first, ["run", "memory"], "left").withColumn("label", label).filter("label is not null")


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The nearest-rank percentile of each group: the value at index round((n - 1) p) of the sorted values.

    Equal values are counted first, so a group's window holds its distinct values.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(*keys))
    at = F.floor((F.col("n") - 1) * p + 0.5)
    held = counts.withColumns({"upto": up_to, "n": total}).filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at))
    return held.select(*keys, F.col("n"), F.col(value).alias("value"))


def auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties one half; 0.5 where one class is missing.

    Scores are counted by value first; the window then runs over distinct scores.
    """
    keys = keys or []
    per = df.groupBy(*keys, score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    total = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    area = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), 0.5).otherwise(F.col("won") / (F.col("n_pos") * F.col("n_neg")))
    return total.select(*keys, "n_pos", "n_neg", F.round(area, 6).alias("auc"))


def fit_logistic(df: DataFrame, features: list[str], label: str, passes: int = 20, rate: float = 0.1, holdout: float = 0.2) -> dict:
    """Standardised logistic regression by full-batch gradient steps; each step is one aggregation over all rows.

    Every k-th row (k = round(1 / holdout), by ``row``) is held out. Needs
    LEAST_ROWS rows of both classes. Returns means, deviations, weights and bias.
    """
    k = max(2, round(1 / holdout))
    train = df.filter(F.col("row") % k != 0)
    stats = train.agg(F.count("*").alias("n"), F.sum(label).alias("pos"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    if stats["n"] < LEAST_ROWS or not 0 < stats["pos"] < stats["n"]:
        raise ValueError(f"{LEAST_ROWS} rows of both classes are needed")
    means, devs = [stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] or 1.0 for f in features]
    scaled = train.select(F.col(label).cast("double").alias("y"), *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, means, devs, strict=True)]).persist()
    weights, bias = [0.0] * len(features), 0.0
    for _ in range(passes):
        z = sum((F.col(f) * w for f, w in zip(features, weights, strict=True)), F.lit(bias))
        error = 1 / (1 + F.exp(-z)) - F.col("y")
        step = scaled.agg(F.avg(error).alias("b"), *[F.avg(error * F.col(f)).alias(f) for f in features]).first()
        weights = [w - rate * step[f] for w, f in zip(weights, features, strict=True)]
        bias -= rate * step["b"]
    scaled.unpersist()
    return {"features": features, "means": means, "devs": devs, "weights": weights, "bias": bias, "every": k}


def predict(model: dict) -> Column:
    """Probability of a helpful outcome."""
    parts = zip(model["features"], model["means"], model["devs"], model["weights"], strict=True)
    z = sum(((F.col(f) - m) / s * w for f, m, s, w in parts), F.lit(model["bias"]))
    return 1 / (1 + F.exp(-z))


def accepted(area: float, baseline: float, rows: int) -> bool:
    """Whether a fitted ranker may serve."""
    return rows >= LEAST_ROWS and area > baseline + 0.02 and area > 0.55 and not math.isnan(area)


def shadow_overlap(served: Column, shadow: Column) -> Column:
    """Share of the served ids that a shadow run also found."""
    return F.when(F.size(served) == 0, 0.0).otherwise(F.size(F.array_intersect(served, shadow)) / F.size(served))


def judge_experiment(changes: DataFrame) -> DataFrame:
    """Per experiment: reject if a safety metric regresses or the primary does not gain, revise if a guardrail loses over 5 %."""
    worse = F.col("after") < F.col("before")
    flags = changes.groupBy("experiment").agg(
        F.bool_or((F.col("role") == "safety") & worse).alias("unsafe"),
        F.bool_or((F.col("role") == "primary") & (F.col("after") > F.col("before"))).alias("gained"),
        F.bool_or((F.col("role") == "guardrail") & (F.col("after") < F.col("before") * 0.95)).alias("slipped"),
    )
    return flags.select("experiment", F.when(F.col("unsafe") | ~F.col("gained"), "reject").when("slipped", "revise").otherwise("accept").alias("decision"))
