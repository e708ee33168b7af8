"""Graphs of facts: entities that share values, and personalised PageRank over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.recursion import cut


def shared_value_edges(facts: DataFrame, most: int = 500) -> DataFrame:
    """(src, dst, w) in both directions: w counts the (attribute, value) cells that two entities share.

    A value that more than `most` entities share says little and links none of them; that is the reference semantics of
    this graph. The limit also bounds the pairs of a value.
    """
    cells = facts.where("value is not null").select("entity", "attribute", "value").distinct()
    small = cells.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select("attribute", "value")
    kept = cells.join(small, ["attribute", "value"])
    a, b = kept.withColumnRenamed("entity", "src"), kept.withColumnRenamed("entity", "dst")
    return a.join(b, ["attribute", "value"]).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def related(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, top: int | None = 10, fixed: bool = False, digits: int | None = None) -> DataFrame:
    """(node, score): PageRank personalised to the seeds (column node), without the seeds; best first, ties by node.

    Seeds share the restart evenly; what a node without edges holds goes back to the seeds. Rounds are a join and an
    aggregate over edges; they end when the scores move less than the tolerance in total (or after `rounds`, if fixed).
    With `digits` scores are rounded before they are ranked, so that nodes whose sums differ by their order only are tied.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("all"))
    flow = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("share")))
    nodes = cut(flow.select(F.col("src").alias("node")).union(flow.select("dst")).distinct())
    start = seeds.select("node").distinct().join(nodes, "node", "left_semi")
    n = start.count()
    if not n:
        return nodes.limit(0).withColumn("score", F.lit(0.0))
    home = cut(start.withColumn("r", F.lit(1.0 / n)))
    score = home.withColumnRenamed("r", "score")
    for _ in range(rounds):
        moved = score.join(flow, score.node == flow.src).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        back = moved.agg((1 - damping * F.coalesce(F.sum("in"), F.lit(0.0))).alias("back"))  # what restarts, and what dangles
        spread = home.crossJoin(F.broadcast(back)).select("node", (F.col("r") * F.col("back")).alias("s"))
        new = cut(moved.select(F.col("dst").alias("node"), (damping * F.col("in")).alias("s")).unionByName(spread).groupBy("node").agg(F.sum("s").alias("score")))
        if not fixed:
            old = score.withColumnRenamed("score", "old")
            gap = new.join(old, "node", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        score = new
        if not fixed and gap < tolerance:
            break
    if digits is not None:
        score = score.withColumn("score", F.round("score", digits) + F.lit(0.0))
    ranked = score.join(start, "node", "left_anti").orderBy(F.desc("score"), "node")
    return ranked.limit(top) if top else ranked
