"""Synthetic graphs: all small labelled graphs, random graphs, and the shapes that benchmarks use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import PropertyGraph


def _enumerated(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    if len(pairs) >= 63:
        raise ValueError("fewer than 63 possible edges can be enumerated")
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "bit int, src long, dst long")
    numbers = spark.range(1 << len(pairs)).withColumnRenamed("id", "graph_no")
    held = F.expr("shiftright(graph_no, bit) & 1") == 1
    return numbers.join(F.broadcast(table)).where(held).select("graph_no", "src", "dst")


def all_dags(spark: SparkSession, n: int) -> DataFrame:
    """``graph_no src dst`` of all graphs on n nodes whose edges go from lower to higher; number 0 has no edge and no row."""
    return _enumerated(spark, [(a, b) for a in range(n) for b in range(a + 1, n)])


def all_graphs(spark: SparkSession, n: int, directed: bool = True, loops: bool = False) -> DataFrame:
    """``graph_no src dst`` of all labelled graphs on n nodes."""
    return _enumerated(spark, [(a, b) for a in range(n) for b in range(n) if (a != b or loops) and (directed or a <= b)])


def random_graph(spark: SparkSession, n: int, p: float, directed: bool = True, loops: bool = True, seed: int = 0) -> PropertyGraph:
    """Every pair is an edge with probability p, by a hash of the pair and the seed: the same graph however it is split."""
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"))
    held = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 30)) < int(p * (1 << 30))
    keep = held & (F.lit(loops) | (F.col("src") != F.col("dst"))) & (F.lit(directed) | (F.col("src") <= F.col("dst")))
    edges = pairs.where(keep).select((F.col("src") * n + F.col("dst")).alias("edge_id"), "src", "dst")
    return PropertyGraph(spark.range(n), edges, directed)


def random_dag(spark: SparkSession, n: int, p: float, seed: int = 0) -> PropertyGraph:
    return random_graph(spark, n, p, True, False, seed).filter_edges(F.col("src") < F.col("dst"))


def tournament(spark: SparkSession, n: int, seed: int = 0) -> PropertyGraph:
    """One edge between every two nodes, its direction by a hash."""
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("a"), (F.col("id") % n).alias("b")).where("a < b")
    up = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(2)) == 0
    edges = pairs.select((F.col("a") * n + F.col("b")).alias("edge_id"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("dst"))
    return PropertyGraph(spark.range(n), edges, True)


def directed_fan(spark: SparkSession, n: int) -> PropertyGraph:
    """Node 0 linked to all others, and each of them to the next."""
    rest = spark.range(1, n)
    edges = rest.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(rest.where(F.col("id") < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    return PropertyGraph(spark.range(n), edges.select((F.col("src") * n + F.col("dst")).alias("edge_id"), "src", "dst"), True)


def grid(spark: SparkSession, rows: int, columns: int) -> PropertyGraph:
    """An undirected grid; node r * columns + c stands at row r and column c."""
    cells = spark.range(rows * columns)
    right = cells.where((F.col("id") % columns) < columns - 1).select((2 * F.col("id")).alias("edge_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.where(F.col("id") < (rows - 1) * columns).select((2 * F.col("id") + 1).alias("edge_id"), F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return PropertyGraph(cells, right.unionByName(down), False)
