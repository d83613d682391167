"""Weakly and strongly connected components, and condensation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph, numbered
from weft.plans.runtime import materialize, release

MAX_ROUNDS = 60


def star_components(pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of ``pairs(a, b)``: component is the smallest node reachable.

    Alternates two steps until nothing moves: every node hangs its larger neighbours under its smallest neighbour,
    then every node hangs itself and its smaller neighbours there.  The number of edges never grows and the rounds are
    logarithmic in the size of a component, whatever its diameter.  Loops only name their node.
    """
    nodes = None
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    loops = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    edges = materialize(edges.where("u <> v").distinct(), "wcc")
    seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(floor, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(hung.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "wcc")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        release(edges)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
    alone = loops.join(nodes, "node", "left_anti").select("node", F.col("node").alias("component"))
    return nodes.unionByName(alone)


def connected_components(g: PropertyGraph) -> DataFrame:
    """``node component``: component is the smallest node of the weakly connected component."""
    linked = star_components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    alone = g.nodes.select(F.col("id").alias("node")).join(linked, "node", "left_anti")
    return linked.unionByName(alone.select("node", F.col("node").alias("component")))


def component_count(g: PropertyGraph) -> int:
    return connected_components(g).select("component").distinct().count()


def scc(g: PropertyGraph, max_rounds: int = 1000) -> DataFrame:
    """``node component``: component is the smallest node of the strongly connected component.

    Rounds of colouring: nodes without incoming or outgoing edges are peeled off; every other node takes the smallest
    node that reaches it as colour; what reaches the colour's node inside the colour is a component and leaves.  An
    undirected graph gives its connected components.
    """
    if not g.directed:
        return connected_components(g)
    done: list[DataFrame] = []
    nodes = materialize(g.nodes.select(F.col("id").alias("node")), "scc-nodes")
    edges = materialize(g.edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges")

    def inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        e = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return materialize(e.select("src", "dst"), "scc-edges")

    for _ in range(max_rounds):
        while True:  # peel
            both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
            core = materialize(both, "scc-nodes")
            alone = materialize(nodes.join(core, "node", "left_anti"), "scc")
            if alone.isEmpty():
                break
            done.append(alone.select("node", F.col("node").alias("component")))
            nodes, edges = core, inside(core, edges)
        if nodes.isEmpty():
            break
        colour = materialize(nodes.select("node", F.col("node").alias("c")), "colour")
        while True:
            into = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("n"))
            next_ = colour.join(into, "node", "left").select("node", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved"))
            # pointer jumping: the colour of a colour is a colour, so long chains take logarithmic rounds
            next_ = materialize(next_, "colour")
            jump = next_.select(F.col("node").alias("c"), F.col("c").alias("cc"))
            jumped = next_.join(jump, "c", "left").select("node", F.least("c", "cc").alias("c"), (F.coalesce("moved", F.lit(False)) | (F.coalesce("cc", "c") < F.col("c"))).alias("moved"))
            after = materialize(jumped, "colour")
            moved = not after.where("moved").isEmpty()
            release(colour, next_)
            colour = after.select("node", "c")
            if not moved:
                break
        same = edges.join(colour.withColumnsRenamed({"node": "src", "c": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "c": "b"}), "dst")
        same = materialize(same.where("a = b").select("src", "dst"), "scc-same")
        found = [materialize(colour.where("node = c"), "scc")]
        while True:
            back = same.join(found[-1].withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "c").distinct()
            seen = reduce(DataFrame.unionByName, found).select("node")
            new = materialize(back.join(seen, "node", "left_anti"), "scc")
            if new.isEmpty():
                break
            found.append(new)
        part = materialize(reduce(DataFrame.unionByName, found), "scc")
        done.append(part.select("node", F.col("c").alias("component")))
        nodes = materialize(nodes.join(part, "node", "left_anti"), "scc-nodes")
        edges = inside(nodes, edges)
        release(same, *found)
        if nodes.isEmpty():
            break
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    return materialize(reduce(DataFrame.unionByName, done), "scc")


def scc_ordered(g: PropertyGraph) -> DataFrame:
    """``component members position``: components in reverse topological order (by level from the end, then component)."""
    from weft.operators.traverse import topological_levels

    labels = materialize(scc(g), "scc")
    small = condensation(g, labels=labels)
    levels = topological_levels(small.reverse())
    groups = labels.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return numbered(groups.join(levels, groups.component == levels.node).select("component", "members", "level"), "position", ["level", "component"])


def condensation(g: PropertyGraph, make_acyclic: bool = True, labels: DataFrame | None = None, weight: str | None = None) -> PropertyGraph:
    """One node per strongly connected component (its smallest node) with ``members`` (and ``weights``, if ``weight``
    names a node column).  With ``make_acyclic`` loops go and of parallel edges the last payload holds."""
    labels = scc(g) if labels is None else labels
    named = labels.join(g.nodes, labels.node == g.nodes.id)
    aggs = [F.array_sort(F.collect_list("node")).alias("members")] + ([F.transform(F.array_sort(F.collect_list(F.struct("node", weight))), lambda x: x[weight]).alias("weights")] if weight else [])
    nodes = named.groupBy(F.col("component").alias("id")).agg(*aggs)
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(labels.withColumnsRenamed({"node": end, "component": "_c"}), end).drop(end).withColumnRenamed("_c", end)
    made = PropertyGraph(nodes, e.select(g.edges.columns), True)
    return made.filter_edges(F.col("src") != F.col("dst")).last_wins() if make_acyclic else made
