"""Connected components of a link table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import drop_tables, materialize


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Returns (node, component) for every node that has a link; component is the smallest node reachable.

    Each round replaces the links by links to smaller neighbours (large-star: every larger neighbour hangs on the
    smallest one; small-star: every smaller neighbour does), which needs about log2 of the longest path rounds.
    A node with very many links is never gathered: its smallest neighbour comes from a partial aggregate and its
    links stay rows, which AQE can split in the join. Links with a null end and loops say nothing and are left out;
    an empty table gives an empty result. Every round is a table in the shared folder.
    """
    edges = links.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("k", "m"))
        small = materialize(small.where("u <> v").distinct(), "small-star")
        drop_tables(large, edges)
        edges = small
        # A star forest keeps its links: the count and a hash of all links stay the same once it is reached.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
