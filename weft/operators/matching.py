"""Greedy matching by handshakes, and reading matchings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators.traverse import Layers
from weft.plans.runtime import materialize, release


def greedy_matching(g: PropertyGraph, max_rounds: int = 1000) -> DataFrame:
    """``node mate`` with node < mate: a maximal matching.  Every free node offers its hand by the free edge of least
    hash (ties by ids); where both offer the same edge they match.  The edge of least hash always does, and random
    order makes the rounds logarithmic."""
    e = g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    free = materialize(e.withColumn("k", F.xxhash64("a", "b")), "free")
    found = None
    for _ in range(max_rounds):
        if free.isEmpty():
            break
        ends = free.select(F.col("a").alias("n"), "k", "a", "b").unionByName(free.select(F.col("b").alias("n"), "k", "a", "b"))
        picks = ends.groupBy("n").agg(F.min(F.struct("k", "a", "b")).alias("m"))
        matched = picks.groupBy("m.a", "m.b").count().where("count = 2").select("a", "b")
        if found is None:
            found = Layers(matched, "matched")
        else:
            found.add(matched)
        gone = found.last.select(F.explode(F.array("a", "b")).alias("n"))
        left = free.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti")
        after = materialize(left.select("a", "b", "k"), "free")
        release(free)
        free = after
    pairs = found.all() if found else free.select("a", "b")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("mate"))


def mates(matching: DataFrame) -> DataFrame:
    """``node mate`` from either side."""
    return matching.unionByName(matching.select(F.col("mate").alias("node"), F.col("node").alias("mate")))


def mate(matching: DataFrame, node: int) -> int | None:
    row = mates(matching).where(F.col("node") == node).first()
    return None if row is None else row.mate


def matched_nodes(matching: DataFrame) -> DataFrame:
    return mates(matching).select("node")


def contains_edge(matching: DataFrame, a: int, b: int) -> bool:
    return mate(matching, a) == b


def is_perfect(g: PropertyGraph, matching: DataFrame) -> bool:
    return 2 * matching.count() == g.node_count()
