"""Spanning and Steiner trees, transitive closure and reduction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators.components import connected_components, star_components
from weft.operators.paths import apsp
from weft.operators.traverse import Layers, toposort
from weft.plans.runtime import materialize, release


class DisconnectedTerminals(ValueError):
    """Terminals of a Steiner tree lie in different components."""


def min_spanning_tree(g: PropertyGraph, cost: Column | None = None, max_rounds: int = 64) -> DataFrame:
    """Edges of the minimum spanning forest, directions ignored; of equal costs the smaller edge id goes first.

    Each round every component takes its cheapest edge to another one; components joined by those merge.  The number
    of components at least halves, so rounds are logarithmic.
    """
    cost = F.lit(1) if cost is None else cost
    edges = materialize(g.edges.where("src <> dst").select("edge_id", "src", "dst", cost.alias("w")), "mst-edges")
    labels = materialize(g.nodes.select(F.col("id").alias("node"), F.col("id").alias("component")), "mst")
    taken: list[DataFrame] = []
    for _ in range(max_rounds):
        ends = edges.join(labels.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(labels.withColumnsRenamed({"node": "dst", "component": "b"}), "dst").where("a <> b")
        open_ = materialize(ends.select("edge_id", "src", "dst", "w", "a", "b"), "mst-edges")
        if open_.isEmpty():
            break
        both = open_.select("a", "b", "w", "edge_id").unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "edge_id"))
        picks = both.groupBy("a").agg(F.min(F.struct("w", "edge_id", "b")).alias("m"))
        chosen = materialize(picks.select(F.col("m.edge_id").alias("edge_id"), "a", F.col("m.b").alias("b")), "mst-picks")
        taken.append(chosen.select("edge_id").distinct())
        merged = star_components(chosen.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("into"))
        after = labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        release(edges)
        old, labels = labels, materialize(after, "mst")
        release(old)
        edges = open_.select("edge_id", "src", "dst", "w")
    if not taken:
        return g.edges.limit(0)
    return g.edges.join(reduce(DataFrame.unionByName, taken).distinct(), "edge_id", "left_semi").select(g.edges.columns)


def min_spanning_tree_prim(g: PropertyGraph, cost: Column | None = None) -> DataFrame:
    """The same tree for the component of the smallest node only."""
    labels = connected_components(g)
    first = g.nodes.agg(F.min("id").alias("m"))
    own = labels.join(first, labels.component == first.m).select(F.col("node").alias("id"))
    part = PropertyGraph(g.nodes.join(own, "id", "left_semi"), g.edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(g.edges.columns), g.directed)
    return min_spanning_tree(part, cost)


def metric_closure(g: PropertyGraph, terminals: list[int], cost: Column | None = None) -> DataFrame:
    """``src dst cost`` for terminals src < dst."""
    roots = g.nodes.where(F.col("id").isin(*terminals)).select("id")
    return apsp(g, cost, roots).where(F.col("dst").isin(*terminals) & (F.col("src") < F.col("dst"))).select("src", "dst", "cost")


def steiner_tree(g: PropertyGraph, terminals: list[int], cost: Column | None = None) -> DataFrame:
    """Edges of a tree that spans ``terminals`` at no more than twice the least cost (undirected graphs).

    A spanning tree over the terminals' distances is unfolded into shortest paths, a spanning tree of those edges is
    taken, and leaves that are no terminals are cut until none is left.
    """
    cost = F.lit(1).cast("long") if cost is None else cost
    g = g.into_edge_type(False)
    roots = g.nodes.where(F.col("id").isin(*terminals)).select("id")
    dist = materialize(apsp(g, cost, roots), "steiner")
    pairs = dist.where(F.col("dst").isin(*terminals) & (F.col("src") < F.col("dst")))
    if pairs.count() < len(set(terminals)) * (len(set(terminals)) - 1) // 2:
        raise DisconnectedTerminals("terminals are not connected")
    if len(set(terminals)) < 2:
        return g.edges.limit(0)
    closure = PropertyGraph.from_edges(pairs.select("src", "dst", F.col("cost").alias("weight")), False, fill=False)
    tree = min_spanning_tree(closure, F.col("weight"))
    walk = Layers(tree.select(F.col("src").alias("root"), F.col("dst").alias("at")), "steiner")
    while walk.add(walk.last.join(dist.select(F.col("src").alias("root"), F.col("dst").alias("at"), "prev"), ["root", "at"]).where("root <> at").select("root", F.col("prev").alias("at"))):
        pass
    steps = walk.all().join(dist.select(F.col("src").alias("root"), F.col("dst").alias("at"), "prev"), ["root", "at"]).where("root <> at")
    ends = steps.select(F.least("at", "prev").alias("a"), F.greatest("at", "prev").alias("b")).distinct()
    costed = g.edges.withColumn("_w", cost).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    best = costed.join(ends, ["a", "b"]).groupBy("a", "b").agg(F.min(F.struct("_w", "edge_id")).alias("m")).select(F.col("m.edge_id").alias("edge_id"))
    part = PropertyGraph(g.nodes, materialize(g.edges.join(best, "edge_id", "left_semi").select(g.edges.columns), "steiner"), False)
    edges = materialize(min_spanning_tree(part, cost), "steiner")
    while True:
        degree = edges.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").count()
        leaves = degree.where((F.col("count") == 1) & ~F.col("n").isin(*terminals)).select("n")
        cut = materialize(edges.join(leaves.withColumnRenamed("n", "src"), "src", "left_anti").join(leaves.withColumnRenamed("n", "dst"), "dst", "left_anti").select(g.edges.columns), "steiner")
        if cut.count() == edges.count():
            return cut
        edges = cut


def toposorted_adjacency(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Edges ``src dst`` between topological positions, and ``node position``."""
    rank = materialize(toposort(g).select("node", "position"), "ranks")
    e = g.edges.select("src", "dst")
    for end in ("src", "dst"):
        e = e.join(rank.withColumnsRenamed({"node": end, "position": "_p"}), end).drop(end).withColumnRenamed("_p", end)
    return e.select("src", "dst"), rank


def transitive_closure(g: PropertyGraph) -> DataFrame:
    """``src dst`` of all pairs joined by a path of at least one edge.

    Known are all pairs nearer than m, and those at distance m.  Pairs at distances up to 2m are one of these, or one of the
    first behind one of the second, so rounds are logarithmic in the longest distance.  Where that would try many more
    pairs than one further edge does (dense graphs, whose distances are short), the round takes that edge.
    """
    edges = materialize(g.adjacency_matrix(), "closure")
    near, far = [], edges

    def tried(first: DataFrame, then: DataFrame) -> int:
        """How many pairs meet in the middle."""
        a = first.groupBy(F.col("dst").alias("via")).agg(F.count(F.lit(1)).alias("a"))
        b = then.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("b"))
        return a.join(b, "via").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0

    def joined(first: DataFrame, then: DataFrame) -> DataFrame:
        return first.withColumnRenamed("dst", "via").join(then.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()

    while not far.isEmpty():
        known = reduce(DataFrame.unionByName, [*near, far])
        if near and tried(known, far) <= 4 * tried(far, edges) + 8 * known.count():
            more = materialize(joined(reduce(DataFrame.unionByName, near), far).join(known, ["src", "dst"], "left_anti"), "closure")
            known = known.unionByName(more)
            near = [*near, far, more]
            far = materialize(joined(far, far).join(known, ["src", "dst"], "left_anti"), "closure")
        else:
            near = [*near, far]
            far = materialize(joined(far, edges).join(known, ["src", "dst"], "left_anti"), "closure")
        if len(near) > 12:
            old, near = near, [materialize(reduce(DataFrame.unionByName, near), "closure")]
            release(*(t for t in old if t is not edges))
    release(far)
    return reduce(DataFrame.unionByName, near) if near else edges


def transitive_reduction_closure(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(reduction, closure) of an acyclic graph: the reduction has the edges that no longer path replaces."""
    closure = materialize(transitive_closure(g), "closure")
    if not closure.where("src = dst").isEmpty():
        raise ValueError("the graph has a cycle")
    edges = g.adjacency_matrix()
    bridged = edges.withColumnRenamed("dst", "via").join(closure.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
    return edges.join(bridged, ["src", "dst"], "left_anti"), closure
