"""Shortest paths: one source, all pairs, k best walks, simple paths.

Costs are Column expressions over the edges.  A result has reachable rows only.  All single-source operators share one
relaxation: the nodes improved in a round offer their edges, offers and old costs meet in one aggregate, and the loop
ends when nothing improves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.graph import OUT, PropertyGraph
from weft.operators.traverse import Layers
from weft.plans.runtime import materialize, release


class NegativeCycleError(ValueError):
    """A cycle of negative total cost can be reached."""


def _costed(g: PropertyGraph, cost: Column | None, direction: str = OUT) -> DataFrame:
    cost = F.lit(1).cast("long") if cost is None else cost
    return materialize(g.adjacency(direction).select("src", "dst", cost.alias("w")), "costs")


def _relax(state: DataFrame, edges: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """One round: ``keys node cost prev fresh``, fresh where the cost has just improved."""
    offers = state.where("fresh").drop("prev", "fresh").withColumnRenamed("node", "src").join(edges, "src")
    offers = offers.select(*keys, F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("prev"), F.lit(1).alias("r"))
    if keep is not None:
        offers = offers.where(keep)
    both = state.select(*keys, "node", "cost", "prev", F.lit(0).alias("r")).unionByName(offers)
    best = both.groupBy(*keys, "node").agg(F.min(F.struct("cost", "r", "prev")).alias("m"))
    return best.select(*keys, "node", "m.cost", "m.prev", (F.col("m.r") == 1).alias("fresh"))


def _settle(state: DataFrame, edges: DataFrame, keys: list[str], bound: int, stop: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    state = materialize(state, "sssp")
    negative = not edges.where("w < 0").isEmpty()
    for done in range(bound + 1):
        if state.where("fresh").isEmpty() or (stop is not None and stop(state)):
            return state
        if negative and _is_check(done) and _on_circle(state, keys, bound) is not None:
            raise NegativeCycleError("predecessors run in a circle")
        after = materialize(_relax(state, edges, keys), "sssp")
        release(state)
        state = after
    raise NegativeCycleError("costs still fall after as many rounds as there are nodes")


def _is_check(done: int) -> bool:
    """After 4, 8, 16, ... rounds it is worth looking for a circle of predecessors: there is one once a negative cycle was gone
    round, and there is none without."""
    return done >= 4 and done & (done - 1) == 0


def _on_circle(state: DataFrame, keys: list[str], bound: int) -> int | None:
    """A node on a circle of predecessors, or None: pointers are doubled until they span all nodes; what still points
    somewhere then points into a circle."""
    at = materialize(state.where("prev IS NOT NULL").select(*keys, "node", F.col("prev").alias("up")), "pointers")
    step = 1
    while step <= bound and not at.isEmpty():
        far = at.select(*keys, F.col("node").alias("up"), F.col("up").alias("top"))
        after = materialize(at.join(far, [*keys, "up"]).select(*keys, "node", F.col("top").alias("up")), "pointers")
        release(at)
        at, step = after, step * 2
    found = at.agg(F.min("up")).first()[0]
    release(at)
    return found


def _upwards(state: DataFrame, node: int, bound: int) -> dict[int, int]:
    """``{steps: node}`` along ``prev`` from ``node``, up to ``bound`` steps: paths double in every round."""
    jumps = materialize(state.where("prev IS NOT NULL").select("node", F.col("prev").alias("up")), "pointers")
    found = materialize(state.where(F.col("node") == node).select("node", F.lit(0).alias("steps")), "path")
    step = 1
    while step <= bound:
        more = materialize(found.join(jumps, "node").select(F.col("up").alias("node"), (F.col("steps") + step).alias("steps")), "path")
        if more.isEmpty():
            break
        found = materialize(found.unionByName(more), "path")
        far = jumps.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumps = materialize(jumps.join(far, "up").select("node", F.col("top").alias("up")), "pointers")
        step *= 2
    return {r.steps: r.node for r in found.where(F.col("steps") <= bound).collect()}  # the path itself


def _start(g: PropertyGraph, start: int, kind: str) -> DataFrame:
    row = g.nodes.where(F.col("id") == start)
    return row.select(F.col("id").alias("node"), F.lit(0).cast(kind).alias("cost"), F.lit(None).cast("long").alias("prev"), F.lit(True).alias("fresh"))


def sssp(g: PropertyGraph, start: int, cost: Column | None = None, direction: str = OUT) -> DataFrame:
    """``node cost prev`` from ``start``; negative costs are fine, a negative cycle in reach raises.  Among equally
    cheap predecessors that of the earliest round, then the smallest, is given."""
    edges = _costed(g, cost, direction)
    out = _settle(_start(g, start, edges.schema["w"].dataType.simpleString()), edges, [], g.node_count())
    release(edges)
    return out.drop("fresh")


bellman_ford = sssp
spfa = sssp


def dijkstra(g: PropertyGraph, start: int, goal: int | None = None, cost: Column | None = None) -> DataFrame:
    """``node cost prev`` for costs that are not negative.  With ``goal``: the nodes no further than it."""
    return with_dynamic_goal(g, start, None if goal is None else F.col("id") == goal, cost)[0]


def with_dynamic_goal(g: PropertyGraph, start: int, goal: Column | None, cost: Column | None = None) -> tuple[DataFrame, int | None]:
    """Costs, and the nearest node for which ``goal`` (over node columns) holds; the search ends there."""
    edges = _costed(g, cost)
    if goal is None:
        return _settle(_start(g, start, edges.schema["w"].dataType.simpleString()), edges, [], g.node_count()).drop("fresh"), None
    goals = materialize(g.nodes.where(goal).select(F.col("id").alias("node")), "goals")

    def nearest(state: DataFrame):
        return state.join(goals, "node", "left_semi").agg(F.min(F.struct("cost", "node")).alias("m")).first().m

    def stop(state: DataFrame) -> bool:
        best = nearest(state)
        return best is not None and state.where("fresh").agg(F.min("cost")).first()[0] >= best.cost

    state = _settle(_start(g, start, edges.schema["w"].dataType.simpleString()), edges, [], g.node_count(), stop)
    best = nearest(state)
    release(edges, goals)
    if best is None:
        return state.drop("fresh"), None
    return state.where(F.col("cost") <= best.cost).drop("fresh"), best.node


def bidirectional_dijkstra(g: PropertyGraph, start: int, goal: int, cost: Column | None = None):
    """Cost from start to goal, or None.  Two searches take turns; they end when no unsettled pair of ends can meet
    below the best meeting so far.  A node is at cost 0 from itself."""
    sides = [_costed(g, cost), _costed(g, cost, "in")]
    kind = sides[0].schema["w"].dataType.simpleString()
    states = [materialize(_start(g, x, kind), "sssp") for x in (start, goal)]
    best = None
    for turn in range(2 * g.node_count() + 2):
        met = states[0].select("node", F.col("cost").alias("a")).join(states[1].select("node", F.col("cost").alias("b")), "node")
        best = met.agg(F.min(F.col("a") + F.col("b"))).first()[0]
        low = [s.where("fresh").agg(F.min("cost")).first()[0] for s in states]
        if None in low and (best is not None or low == [None, None]):
            if low == [None, None]:
                break
        if None not in low and best is not None and low[0] + low[1] >= best:
            break
        k = turn % 2 if low[turn % 2] is not None else 1 - turn % 2
        if low[k] is None:
            break
        after = materialize(_relax(states[k], sides[k], []), "sssp")
        release(states[k])
        states[k] = after
    release(*sides, *states)
    return best


def astar(g: PropertyGraph, start: int, goal: Column, cost: Column | None = None, estimate: Column | None = None):
    """(cost, path) to the nearest goal, or None.  ``estimate`` over node columns never exceeds the cost to a goal; offers
    that cannot beat the best goal so far by it are dropped."""
    edges = _costed(g, cost)
    kind = edges.schema["w"].dataType.simpleString()
    guess = F.lit(0) if estimate is None else estimate
    info = materialize(g.nodes.select(F.col("id").alias("node"), guess.cast(kind).alias("h"), goal.alias("is_goal")), "estimates")
    state = materialize(_start(g, start, kind), "sssp")
    best = None
    for _ in range(g.node_count() + 1):
        best = state.join(info.where("is_goal"), "node", "left_semi").agg(F.min(F.struct("cost", "node")).alias("m")).first().m
        front = state.where("fresh").join(info, "node")
        if best is not None:
            front = front.where(F.col("cost") + F.col("h") < best.cost)
        if front.isEmpty():
            break
        narrowed = state.where("NOT fresh").unionByName(state.where("fresh").join(front.select("node"), "node", "left_anti").withColumn("fresh", F.lit(False))).unionByName(front.select(state.columns))
        after = materialize(_relax(narrowed, edges, []), "sssp")
        release(state)
        state = after
    if best is None:
        return None
    path = path_to(state, best.node)
    release(edges, info, state)
    return best.cost, path


def path_to(costs: DataFrame, goal: int) -> list[int]:
    """Nodes from the start to ``goal`` along ``prev``; empty if it was not reached."""
    found = _upwards(costs, goal, costs.count())
    path = [found[k] for k in sorted(found, reverse=True)]
    if len(set(path)) < len(path):
        raise NegativeCycleError("predecessors run in a circle")
    return path


def find_negative_cycle(g: PropertyGraph, start: int, cost: Column | None = None) -> list[int] | None:
    """Nodes of one negative cycle in reach of ``start``, smallest first, or None."""
    edges = _costed(g, cost)
    kind, bound = edges.schema["w"].dataType.simpleString(), g.node_count()
    state = materialize(_start(g, start, kind), "sssp")
    negative = not edges.where("w < 0").isEmpty()
    for done in range(bound + 1):
        if state.where("fresh").isEmpty():
            return None
        if negative and (_is_check(done) or done == bound) and (at := _on_circle(state, [], bound)) is not None:
            found = _upwards(state, at, bound)
            size = next(k for k in range(1, len(found)) if found[k] == at)
            cycle = [found[k] for k in range(size, 0, -1)]
            k = cycle.index(min(cycle))
            return cycle[k:] + cycle[:k]
        after = materialize(_relax(state, edges, []), "sssp")
        release(state)
        state = after
    return None


def apsp(g: PropertyGraph, cost: Column | None = None, sources: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """``src dst cost prev`` of all reachable pairs (sources: a frame with ``id``); every node is at cost 0 from itself.

    ``prev`` is the node before ``dst`` (``dst`` itself where src = dst).  A negative cycle raises, a negative loop
    too.  ``dense`` adds the other pairs with null cost.
    """
    edges = _costed(g, cost)
    kind = edges.schema["w"].dataType.simpleString()
    if not edges.where("src = dst AND w < 0").isEmpty():
        raise NegativeCycleError("a loop has a negative cost")
    roots = g.nodes.select("id") if sources is None else sources.select("id")
    first = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).cast(kind).alias("cost"), F.lit(None).cast("long").alias("prev"), F.lit(True).alias("fresh"))
    out = _settle(first, edges, ["root"], g.node_count())
    release(edges)
    if not out.where("root = node AND cost < 0").isEmpty():
        raise NegativeCycleError("a node has a negative cost from itself")
    out = out.select(F.col("root").alias("src"), F.col("node").alias("dst"), "cost", F.when(F.col("root") == F.col("node"), F.col("node")).otherwise(F.col("prev")).alias("prev"))
    if dense:
        pairs = roots.select(F.col("id").alias("src")).crossJoin(g.nodes.select(F.col("id").alias("dst")))  # the answer itself has all pairs
        out = pairs.join(out, ["src", "dst"], "left")
    return out


johnson = apsp
floyd_warshall = apsp


def k_shortest_walks(g: PropertyGraph, start: int, k: int, cost: Column | None = None, goal: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``node cost``: cost of the k-th cheapest walk from ``start`` (nodes may repeat); nodes with fewer walks are absent.

    Every round gives each node the k cheapest continuations of its neighbours' lists of that round, until no list moves.
    """
    edges = _costed(g, cost)
    kind = edges.schema["w"].dataType.simpleString()
    zero = g.nodes.where(F.col("id") == start).select(F.col("id").alias("node"), F.lit(0).cast(kind).alias("cost"))
    lists = materialize(zero.select("node", F.array("cost").alias("costs")), "walks")
    best = Window.partitionBy("node").orderBy("cost")
    for _ in range(max_rounds):
        walks = lists.select(F.col("node").alias("src"), F.explode("costs").alias("c")).join(edges, "src").select(F.col("dst").alias("node"), (F.col("c") + F.col("w")).alias("cost")).unionByName(zero)
        top = walks.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
        after = materialize(top.groupBy("node").agg(F.array_sort(F.collect_list("cost")).alias("costs")), "walks")
        still = after.join(lists.withColumnRenamed("costs", "old"), "node", "left").where("old IS NULL OR old <> costs").isEmpty()
        release(lists)
        lists = after
        if still:
            out = lists.where(F.size("costs") >= k).select("node", F.element_at("costs", k).alias("cost"))
            return out if goal is None else out.where(F.col("node") == goal)
    raise RuntimeError("walk costs did not settle")


def all_simple_paths(g: PropertyGraph, start: int, goals: list[int], least: int = 0, most: int | None = None, distinct: bool = False) -> DataFrame:
    """``path`` of every simple path from ``start`` to one of ``goals`` with ``least`` to ``most`` nodes between.

    Parallel edges give a path each (unless ``distinct``); from a node to itself there is none; a path goes on past a
    goal to other goals.
    """
    adj = materialize(g.adjacency().select("src", "dst") if not distinct else g.adjacency_matrix(), "adjacency")
    limit = (g.node_count() - 2 if most is None else most) + 1
    first = g.nodes.where(F.col("id") == start).select(F.array("id").alias("path"), F.col("id").alias("src"))
    layers = Layers(first, "simple")
    for _ in range(limit):
        more = layers.last.join(adj, "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"))
        if not layers.add(more):
            break
    release(adj)
    return layers.all().where(F.col("src").isin(*goals) & (F.size("path") >= least + 2)).select("path")
