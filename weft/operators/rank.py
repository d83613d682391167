"""Ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.plans.runtime import materialize, release


def page_rank(g: PropertyGraph, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """``node rank``, summing to one.

    A node w gives a linked node damping * r / outdegree and each other node (1 - damping) * r / N; without outgoing
    edges it gives every node damping * r / N.  Linked pairs get no other share; parallel edges count in the outdegree
    and give once.  In sparse form a round is one join and two sums.  With ``tolerance`` the rounds end when the squared
    change is no larger, and the ranks before that round are returned.
    """
    if not 0 <= damping <= 1:
        raise ValueError("damping must lie between 0 and 1")
    n = g.node_count()
    if n == 0:
        return g.nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("rank"))
    adj = g.adjacency()
    out = adj.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    links = materialize(adj.select("src", "dst").distinct(), "links")
    base = materialize(g.nodes.select(F.col("id").alias("node")).join(out, "node", "left"), "degrees")
    ranks = base.select("node", "deg", F.lit(1.0 / n).alias("rank"))
    held = None
    for _ in range(rounds):
        sums = ranks.agg(F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0)).alias("d"), F.coalesce(F.sum(F.when(F.col("deg").isNotNull(), F.col("rank"))), F.lit(0.0)).alias("s"))
        share = (damping * F.col("rank") / F.col("deg") - (1 - damping) * F.col("rank") / n).alias("v")
        given = ranks.where("deg IS NOT NULL").select(F.col("node").alias("src"), share).join(links, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("v").alias("v"))
        raw = base.join(given, "node", "left").join(F.broadcast(sums)).select("node", "deg", (damping * F.col("d") / n + (1 - damping) * F.col("s") / n + F.coalesce("v", F.lit(0.0))).alias("raw"))
        total = raw.agg(F.sum("raw").alias("t"))
        after = raw.join(F.broadcast(total)).select("node", "deg", (F.col("raw") / F.col("t")).alias("rank"))
        after = materialize(after, "ranks")
        if tolerance is not None:
            moved = after.join(ranks.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.pow(F.col("rank") - F.col("old"), 2))).first()[0]
            if moved is None or moved <= tolerance:
                return ranks.select("node", "rank")
        release(held)
        held = ranks = after
    return ranks.select("node", "rank")
