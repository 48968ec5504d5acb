"""Walks over edge tables: components, and everything below given roots."""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component is walked in one task if its links times its roots are no more than this.
LOCAL = 2_000_000


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the folder that ``spark.checkpoint.dir`` names and read back, so that its lineage ends there.

    Without that setting it is a folder in the warehouse, or a temporary one where
    the driver is the only executor.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        conf = df.sparkSession.conf
        own = tempfile.mkdtemp(prefix="cut") if sc.master.startswith("local[") or sc.master == "local" else f"{conf.get('spark.sql.warehouse.dir')}/_cut"
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): each node with an edge (a, b), and the smallest node it is connected with.

    Every round links a node's larger neighbours to the smallest it knows, then
    does the same among the smaller ones; both are a minimum per node and a join.
    The number of rounds grows with the logarithm of the longest path. Null ends
    and loops count for nothing.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        around = now.union(now.select("low", "high"))
        least = around.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("root"))
        linked = around.join(least, "high").filter("low > high and low <> root").select(F.col("low").alias("high"), F.col("root").alias("low")).distinct()
        least = linked.groupBy("high").agg(F.min("low").alias("root"))
        down = linked.join(least, "high").filter("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low"))
        now = cut(down.union(least.select("high", F.col("root").alias("low"))).distinct())
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(now.select("low", "low").distinct())


def below(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (root, node): each root and all that links (parent, child) lead to from it; cycles are walked once.

    Only components that hold a root are looked at. Those with few links are
    walked in one task each, many of them together, however deep they are; the
    others level by level, from what the last level added.
    """
    links = cut(links.filter("parent <> child").select("parent", "child").distinct())
    roots = cut(roots.filter("root is not null").select("root").distinct())
    named = components(links.toDF("a", "b"))
    asked = cut(roots.withColumnRenamed("root", "node").join(named, "node").select(F.col("root").alias("part"), F.col("node").alias("root")))
    mine = cut(links.join(named.withColumnRenamed("root", "part"), F.col("parent") == F.col("node")).join(asked.select("part").distinct(), "part", "left_semi").select("part", "parent", "child"))
    sizes = mine.groupBy("part").agg(F.count("*").alias("links")).join(asked.groupBy("part").agg(F.count("*").alias("roots")), "part")
    few = cut(sizes.select("part", (F.col("links") * F.col("roots")).alias("most")).withColumn("few", F.col("most") <= LOCAL))
    # small components share walks, of about LOCAL pairs at most, for a walk has its price
    walks = -(-(few.filter("few").agg(F.sum("most")).first()[0] or 1) // max(LOCAL, 1))
    deal = F.pmod(F.xxhash64("part"), F.lit(walks)).alias("deal")
    kind = links.schema["parent"].dataType.simpleString()

    def walk(edges: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        under = defaultdict(list)
        for parent, child in zip(edges["parent"].tolist(), edges["child"].tolist(), strict=True):
            under[parent].append(child)
        tops, nodes = [], []
        for start in starts["root"].tolist():
            seen, queue = {start}, deque([start])
            while queue:
                for child in under.get(queue.popleft(), ()):
                    if child not in seen:
                        seen.add(child)
                        queue.append(child)
            tops.extend([start] * len(seen))
            nodes.extend(seen)
        return pd.DataFrame({"root": tops, "node": nodes})

    small = few.filter("few").select("part")
    near = mine.join(small, "part", "left_semi").select(deal, "parent", "child").groupBy("deal").cogroup(asked.join(small, "part", "left_semi").select(deal, "root").groupBy("deal")).applyInPandas(walk, f"root {kind}, node {kind}")
    large = few.filter("not few").select("part")
    wide = mine.join(large, "part", "left_semi").select("parent", "child")
    seen = front = asked.join(large, "part", "left_semi").select("root", F.col("root").alias("node"))
    while True:
        front = cut(front.join(wide, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    alone = roots.join(asked.select("root"), "root", "left_anti").select("root", F.col("root").alias("node"))
    return near.union(seen).union(alone)


def reached(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (node): the roots and all below any of them, each once.

    All roots start together, so a node is found once however many lead to it.
    """
    kind = links.schema["parent"].dataType.simpleString()
    links = cut(links.filter("parent <> child").select("parent", "child").distinct())
    named = components(links.toDF("a", "b")).withColumnRenamed("root", "part")
    wanted = roots.filter("root is not null").select(F.col("root").alias("node")).distinct()
    asked = cut(wanted.join(named, "node", "left").select("node", "part"))
    mine = cut(links.join(named, F.col("parent") == F.col("node")).join(asked.select("part").distinct(), "part", "left_semi").select("part", "parent", "child"))
    few = cut(mine.groupBy("part").agg((F.count("*") <= LOCAL).alias("few")))
    # the parts of few links: one walk from all roots at once
    both = mine.select("part", "parent", "child", F.lit(False).alias("top")).union(asked.filter("part is not null").select("part", "node", "node", F.lit(True))).join(few.filter("few"), "part", "left_semi")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        links, top = rows[~rows["top"]], rows["child"][rows["top"]]
        under = defaultdict(list)
        for parent, child in zip(links["parent"].tolist(), links["child"].tolist(), strict=True):
            under[parent].append(child)
        queue = deque(top.tolist())
        seen = set(queue)
        while queue:
            for child in under.get(queue.popleft(), ()):
                if child not in seen:
                    seen.add(child)
                    queue.append(child)
        return pd.DataFrame({"node": list(seen)})

    near = both.groupBy("part").applyInPandas(walk, f"node {kind}")
    large = few.filter("not few")
    wide = mine.join(large, "part", "left_semi").select("parent", "child")
    seen = front = asked.join(large, "part", "left_semi").select("node")
    while True:
        front = cut(front.join(wide, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return near.union(seen).union(asked.filter("part is null").select("node"))
