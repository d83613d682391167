"""Graphs that grow batch by batch: disjoint sets and acyclic graphs, also as sinks of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import GraphError, NodeNotFound, PropertyGraph
from weft.operators.components import star_components
from weft.operators.traverse import GraphCycleError, bfs, toposort
from weft.plans.runtime import materialize, release


class DisjointSets:
    """Labels ``node component``; the representative of a set is its smallest node."""

    def __init__(self, spark: SparkSession, n: int = 0):
        self.labels = spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("component"))

    def __len__(self) -> int:
        return self.labels.count()

    def add(self, nodes: DataFrame) -> None:
        """Make each new ``node`` a set of its own."""
        new = nodes.select("node").distinct().join(self.labels, "node", "left_anti")
        self._put(self.labels.unionByName(new.select("node", F.col("node").alias("component"))))

    def find(self, node: int) -> int | None:
        row = self.labels.where(F.col("node") == node).first()
        return None if row is None else row.component

    def equiv(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        if x is None or y is None:
            raise NodeNotFound(f"node {a if x is None else b} is in no set")
        return x == y

    def union(self, pairs: DataFrame) -> int:
        """Join the sets of each pair ``(a, b)``; gives how many sets fewer there are.  Only labels meet: members follow."""
        named = pairs.select("a", "b")
        for end in ("a", "b"):
            named = named.join(self.labels.withColumnRenamed("node", end), end, "left").drop(end).withColumnRenamed("component", end)
        named = materialize(named, "unions")
        if not named.where("a IS NULL OR b IS NULL").isEmpty():
            raise NodeNotFound("a node is in no set")
        moved = materialize(star_components(named).select(F.col("node").alias("component"), F.col("component").alias("into")), "unions")
        gone = moved.where("into <> component").count()
        self._put(self.labels.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
        release(named, moved)
        return gone

    def _put(self, labels: DataFrame) -> None:
        old, self.labels = self.labels, materialize(labels, "labels")
        release(old)

    def sink(self, batch: DataFrame, _: int) -> None:
        """For ``foreachBatch``: a batch of edges ``src dst``.  A batch that comes twice changes nothing."""
        ends = batch.select(F.col("src").alias("node")).unionByName(batch.select(F.col("dst").alias("node")))
        self.add(ends)
        self.union(batch.select(F.col("src").alias("a"), F.col("dst").alias("b")))


class DagTable:
    """An acyclic graph and a topological position of each node, kept while edges are added."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.order = materialize(toposort(graph).select("node", "position"), "order")

    def add_edges(self, edges: DataFrame) -> None:
        """Add all of ``edges(src, dst, ...)`` or, if one is a loop, names no node or closes a cycle, none.

        Edges that run along the order change nothing else; only otherwise is the graph sorted again.
        """
        if not edges.where("src = dst").isEmpty():
            raise GraphCycleError(edges.where("src = dst").first().src)
        grown = self.graph.add_edges(edges)
        place = self.order.withColumnsRenamed({"node": "src", "position": "a"}), self.order.withColumnsRenamed({"node": "dst", "position": "b"})
        against = edges.select("src", "dst").join(place[0], "src").join(place[1], "dst").where("a >= b")
        if not against.isEmpty():
            new = materialize(toposort(grown).select("node", "position"), "order")
            release(self.order)
            self.order = new
        self.graph = grown

    def is_valid_edge(self, a: int, b: int) -> bool:
        """Whether a to b could be added: only nodes between b and a in the order are searched."""
        if a == b:
            return False
        at = {r.node: r.position for r in self.order.where(F.col("node").isin(a, b)).collect()}
        if len(at) < 2:
            return False
        if at[a] < at[b]:
            return True
        window = self.order.where(F.col("position").between(at[b], at[a])).select(F.col("node").alias("id"))
        part = PropertyGraph(self.graph.nodes.join(window, "id", "left_semi"), self.graph.edges.join(window.withColumnRenamed("id", "src"), "src", "left_semi").join(window.withColumnRenamed("id", "dst"), "dst", "left_semi"), True)
        return bfs(part, [b], goal=a).where(F.col("node") == a).isEmpty()

    def position(self, node: int) -> int | None:
        row = self.order.where(F.col("node") == node).first()
        return None if row is None else row.position

    def at_position(self, position: int) -> int | None:
        row = self.order.where(F.col("position") == position).first()
        return None if row is None else row.node

    def range(self, first: int, last: int) -> DataFrame:
        """Nodes at positions first to last, in order."""
        return self.order.where(F.col("position").between(first, last)).orderBy("position")

    def remove_edges(self, *edge_ids: int) -> None:
        self.graph = self.graph.remove_edges(*edge_ids)

    def remove_nodes(self, *ids: int) -> None:
        self.graph = self.graph.remove_nodes(*ids)
        old = self.order
        self.order = materialize(old.where(~F.col("node").isin(*ids)), "order")
        release(old)

    def sink(self, batch: DataFrame, _: int) -> None:
        """For ``foreachBatch``: edges with ``edge_id``; those present already are skipped, so a repeated batch is harmless."""
        if "edge_id" not in batch.columns:
            raise GraphError("a stream of edges needs edge_id")
        self.add_edges(batch.join(self.graph.edges.select("edge_id"), "edge_id", "left_anti"))
