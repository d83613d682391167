"""Traversal: breadth-first layers, reachability, topological levels, cycle and bipartite tests."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import OUT, PropertyGraph, numbered
from weft.plans.runtime import materialize, release

_FOLD_EVERY = 12


class GraphCycleError(ValueError):
    """The graph has a cycle through ``node``."""

    def __init__(self, node: int):
        super().__init__(f"a cycle goes through node {node}")
        self.node = node


class Layers:
    """Rows found so far, one table per round; folded into one now and then so that plans stay short."""

    def __init__(self, first: DataFrame, label: str):
        self.label, self.tables = label, [materialize(first, label)]

    @property
    def last(self) -> DataFrame:
        return self.tables[-1]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)

    def add(self, rows: DataFrame) -> bool:
        """Add a round; False if it has no rows."""
        new = materialize(rows, self.label)
        if new.isEmpty():
            release(new)
            return False
        if len(self.tables) > _FOLD_EVERY:
            old = self.tables
            self.tables = [materialize(reduce(DataFrame.unionByName, old), self.label)]
            release(*old)
        self.tables.append(new)
        return True


def bfs(g: PropertyGraph, starts: DataFrame | list[int], direction: str = OUT, goal: int | None = None) -> DataFrame:
    """``node depth parent`` of all nodes reachable from ``starts`` (ids, or a frame with ``id``): depth in edges from
    the nearest start, parent the smallest node of the layer before.  With ``goal`` it stops at the layer that has it.
    There are as many rounds as layers, however many these are."""
    adj = materialize(g.adjacency(direction).select("src", "dst").distinct(), "adjacency")
    if isinstance(starts, list):
        starts = g.spark.createDataFrame([(x,) for x in starts], "id long")
    first = g.nodes.join(starts, "id", "left_semi").select(F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    layers = Layers(first, "bfs")
    for depth in count(1):
        if goal is not None and not layers.last.where(F.col("node") == goal).isEmpty():
            break
        next_ = layers.last.select(F.col("node").alias("src")).join(adj, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = next_.join(layers.all().select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent")
        if not layers.add(new):
            break
    release(adj)
    return layers.all()


def has_path(g: PropertyGraph, a: int, b: int) -> bool:
    """Whether b can be reached from a; a node reaches itself."""
    return not bfs(g, [a], goal=b).where(F.col("node") == b).isEmpty()


def topological_levels(g: PropertyGraph, initials: list[int] | None = None) -> DataFrame:
    """``node level`` of the nodes that are neither on a cycle nor behind one; level is the longest way from a source.

    With ``initials`` only what is reached from those of them without incoming edges, and is not held up by others.
    """
    edges = materialize(g.edges.select("src", "dst"), "edges")
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    sources = g.nodes.select(F.col("id").alias("node")).join(degree, "node", "left_anti")
    if initials is not None:
        sources = sources.where(F.col("node").isin(*initials))
    layers = Layers(sources.withColumn("level", F.lit(0)), "kahn")
    waiting = materialize(degree, "waiting")
    for level in count(1):
        gone = layers.last.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("got"))
        left = materialize(waiting.join(gone, "node", "left").select("node", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")), "waiting")
        ready = left.where("need = 0").select("node", F.lit(level).alias("level"))
        more = layers.add(ready)
        release(waiting)
        waiting = materialize(left.where("need > 0"), "waiting")
        release(left)
        if not more:
            break
    release(edges, waiting)
    return layers.all()


def toposort(g: PropertyGraph) -> DataFrame:
    """``node level position``: a topological order by (level, node).  A cycle raises, with its component's least node."""
    levels = topological_levels(g)
    if levels.count() < g.node_count():
        from weft.operators.components import scc

        labels = scc(g)
        loops = g.edges.where("src = dst").select(F.col("src").alias("component"))
        big = labels.groupBy("component").count().where("count > 1").select("component")
        raise GraphCycleError(big.unionByName(loops).agg(F.min("component")).first()[0])
    return numbered(levels, "position", ["level", "node"])


def is_cyclic_directed(g: PropertyGraph) -> bool:
    """Whether the directed graph has a cycle; a loop is one."""
    return topological_levels(g).count() < g.node_count()


def is_cyclic_undirected(g: PropertyGraph) -> bool:
    """Whether the graph, its directions ignored, has a cycle; a loop and a pair of parallel edges are cycles."""
    from weft.operators.components import connected_components

    return g.edge_count() > g.node_count() - connected_components(g).select("component").distinct().count()


def is_bipartite(g: PropertyGraph, start: int) -> bool:
    """Whether what is reached from ``start`` can be 2-coloured; follows outgoing edges of a directed graph."""
    depth = bfs(g, [start]).select("node", "depth")
    ends = g.adjacency().select("src", "dst").join(depth.withColumnsRenamed({"node": "src", "depth": "a"}), "src").join(depth.withColumnsRenamed({"node": "dst", "depth": "b"}), "dst")
    return ends.where("(a - b) % 2 = 0").isEmpty()


def reachable_within(g: PropertyGraph, starts: list[int], keep: Column) -> DataFrame:
    """Breadth-first layers over the nodes that pass ``keep``."""
    return bfs(g.filter_nodes(keep), starts)
