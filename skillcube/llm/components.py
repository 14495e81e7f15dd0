"""Connected components of an undirected graph given as a table of edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillcube.llm.common import drop_path, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of every id that has an edge. edges: a, b (long).

    Labels spread to neighbours and then jump to their label's label, so the rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder, which cuts lineage. A hub is pre-aggregated by the grouping.
    """
    both, at_edges = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels, at = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        spread = labels.join(seen, "id").select("id", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        spread, at_spread = staged(spread, "labels")
        jump = spread.join(spread.select(F.col("id").alias("label"), F.col("label").alias("next")), "label")
        new, at_new = staged(jump.select("id", "was", F.least("label", "next").alias("label")), "labels")
        done = new.where("label <> was").limit(1).count() == 0
        drop_path(edges.sparkSession, at, at_spread)
        labels, at = new.select("id", "label"), at_new
        if done:
            drop_path(edges.sparkSession, at_edges)
            return labels
