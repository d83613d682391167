"""Patterns: subgraph isomorphism as joins, graph isomorphism, cliques, triangles, complement."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph, numbered
from weft.plans.runtime import materialize, release


class MultigraphError(ValueError):
    """Isomorphism is not defined for parallel edges here."""


def _simple(g: PropertyGraph) -> DataFrame:
    adj = g.adjacency()
    if not adj.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise MultigraphError("parallel edges")
    return adj


def subgraph_isomorphisms(
    pattern: list[tuple[int, int]],
    g: PropertyGraph,
    n_nodes: int | None = None,
    node_match: Callable[[int], Column | None] | None = None,
    edge_match: Callable[[tuple[int, int]], Column | None] | None = None,
    induced: bool = True,
) -> DataFrame:
    """Columns ``n0 n1 ...``: every way to place the pattern's nodes (0 to n-1, edges as pairs) on different nodes of ``g``.

    With ``induced`` placed nodes have no edges the pattern lacks.  ``node_match(i)`` and ``edge_match(edge)`` give
    conditions over the columns of ``g.nodes`` and ``g.edges``, pushed below the joins.  The plan is one join per
    pattern edge, always growing what is placed so far, and one anti-join per missing edge; a pattern in several parts
    pairs their placements, as its answer does.
    """
    n = max([n_nodes or 0, *(max(e) + 1 for e in pattern)])
    adj = materialize(_simple(g), "pattern")
    pairs = adj.select("src", "dst")
    undirected = not g.directed
    wanted = {(min(e), max(e)) for e in pattern} if undirected else set(pattern)

    def edge_table(a: int, b: int) -> DataFrame:
        rule = edge_match((a, b)) if edge_match else None
        return (adj if rule is None else adj.where(rule)).select(F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{b}"))

    def loop_table(a: int) -> DataFrame:
        rule = edge_match((a, a)) if edge_match else None
        loops = adj.where("src = dst") if rule is None else adj.where("src = dst").where(rule)
        return loops.select(F.col("src").alias(f"n{a}"))

    def node_table(i: int) -> DataFrame | None:
        rule = node_match(i) if node_match else None
        return None if rule is None else g.nodes.where(rule).select(F.col("id").alias(f"n{i}"))

    out: DataFrame | None = None
    placed: set[int] = set()
    left = sorted(wanted)

    def place(frame: DataFrame, new: list[int]) -> DataFrame:
        for i in new:
            if (rule := node_table(i)) is not None:
                frame = frame.join(rule, f"n{i}", "left_semi")
            for j in sorted(placed):
                frame = frame.where(F.col(f"n{i}") != F.col(f"n{j}"))
            placed.add(i)
        return frame

    while left or len(placed) < n:
        edge = next((e for e in left if e[0] in placed or e[1] in placed), left[0] if left else None)
        if edge is None:
            i = min(set(range(n)) - placed)
            alone = g.nodes.select(F.col("id").alias(f"n{i}"))
            out = place(alone if out is None else out.crossJoin(alone), [i])
            continue
        left.remove(edge)
        a, b = edge
        rows = edge_table(a, b) if a != b else loop_table(a)
        shared = [f"n{i}" for i in dict.fromkeys((a, b)) if i in placed]
        out = rows if out is None else out.join(rows, shared) if shared else out.crossJoin(rows)
        out = place(out, [i for i in dict.fromkeys((a, b)) if i not in placed])
    if out is None:
        return g.spark.createDataFrame([()], "struct<>")
    if induced:
        for a in range(n):
            for b in range(a if undirected else 0, n):
                if (a, b) not in wanted:
                    if a == b:
                        extra = pairs.where("src = dst").select(F.col("src").alias(f"n{a}"))
                        out = out.join(extra, f"n{a}", "left_anti")
                    else:
                        out = out.join(pairs.select(F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{b}")), [f"n{a}", f"n{b}"], "left_anti")
    return out.select(*[f"n{i}" for i in range(n)])


def colours(g: PropertyGraph, rounds: int = 3, label: Column | None = None) -> DataFrame:
    """``node colour``: a hash of each node's surroundings that isomorphic graphs share (refinement by neighbour colours)."""
    out, back = g.adjacency(), g.adjacency("in")
    state = g.nodes.select(F.col("id").alias("node"), F.xxhash64(F.lit(0) if label is None else label).alias("colour"))
    for _ in range(rounds):
        def around(adj: DataFrame, name: str) -> DataFrame:
            seen = adj.select(F.col("src").alias("at"), F.col("dst").alias("node")).join(state, "node")
            return seen.groupBy(F.col("at").alias("node")).agg(F.sum(F.xxhash64("colour").cast("decimal(38,0)")).alias(name))

        both = state.join(around(out, "o"), "node", "left").join(around(back, "i"), "node", "left")
        after = materialize(both.select("node", F.xxhash64("colour", F.col("o").cast("string"), F.col("i").cast("string")).alias("colour")), "colours")
        release(state if hasattr(state, "_weft_path") else None)
        state = after
    return state


def is_isomorphic(g0: PropertyGraph, g1: PropertyGraph, label: Column | None = None, edge_label: str | None = None, max_edges: int = 2_000_000) -> bool:
    """Whether the graphs differ in names only (with ``label`` over node columns and the edge column, those match too).

    Counts and refined colours decide most cases in parallel; what is left is settled by a search in one task, which
    refuses graphs beyond ``max_edges``.
    """
    sizes = [(g.node_count(), g.edge_count()) for g in (g0, g1)]
    if sizes[0] != sizes[1]:
        return False
    for g in (g0, g1):
        _simple(g)
    seen = [colours(g, label=label) for g in (g0, g1)]
    counts = [c.groupBy("colour").agg(F.count(F.lit(1)).alias("n")) for c in seen]
    if not counts[0].exceptAll(counts[1]).isEmpty() or not counts[1].exceptAll(counts[0]).isEmpty():
        return False
    if sizes[0][1] > max_edges:
        raise ValueError(f"{sizes[0][1]} edges exceed max_edges = {max_edges}")
    mark = F.lit("") if edge_label is None else F.col(edge_label).cast("string")
    rows = None
    for k, (g, c) in enumerate(zip((g0, g1), seen, strict=True)):
        part = c.select(F.lit(k).alias("k"), "node", F.lit(None).cast("long").alias("dst"), "colour", F.lit("").alias("mark")).unionByName(
            g.adjacency().select(F.lit(k).alias("k"), F.col("src").alias("node"), "dst", F.lit(None).cast("long").alias("colour"), mark.alias("mark"))
        )
        rows = part if rows is None else rows.unionByName(part)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        graphs = []
        for k in (0, 1):
            own = frame[frame.k == k]
            nodes = own[own.dst.isna()]
            nodes = nodes.sort_values("node")
            e = own[~own.dst.isna()]
            ids = nodes.node.to_numpy()
            graphs.append((nodes.colour.to_numpy().astype("int64"), np.searchsorted(ids, e.node.to_numpy()), np.searchsorted(ids, e.dst.to_numpy().astype("int64")), e.mark.tolist()))
        return pd.DataFrame({"same": [_search(*graphs)]})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "same boolean").first().same


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _refined(colour: np.ndarray, src: np.ndarray, dst: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Classes of nodes by what surrounds them, until they no longer split (after ``rounds`` only while many still do)."""
    classes = np.unique(colour, return_inverse=True)[1]
    k = classes.max(initial=-1) + 1
    for done in count():
        ahead, behind = np.zeros(len(colour), np.uint64), np.zeros(len(colour), np.uint64)
        np.add.at(ahead, src, _mixed(classes)[dst])
        np.add.at(behind, dst, _mixed(~classes)[src])
        classes = np.unique(_mixed(_mixed(ahead) + np.uint64(3) * _mixed(behind) + np.uint64(7) * _mixed(classes)), return_inverse=True)[1]
        before, k = k, classes.max(initial=-1) + 1
        if k <= before or (done >= rounds and k - before <= len(colour) // 1000):
            return classes


def _search(first, second) -> bool:
    """Whether the graphs ``(colours, sources, targets, marks)``, their nodes numbered from 0, are the same but for numbers.

    Nodes are placed along the edges, on nodes of their class beside the image of the node they were reached from, so a
    step looks at the edges of two nodes only.  A part placed whole stays: parts of one kind can stand for each other.
    """
    (c0, s0, d0, m0), (c1, s1, d1, m1) = first, second
    n = len(c0)
    classes = _refined(np.concatenate([c0, c1]), np.concatenate([s0, s1 + n]), np.concatenate([d0, d1 + n]))
    if not np.array_equal(np.sort(classes[:n]), np.sort(classes[n:])):
        return False
    own, other = classes[:n].tolist(), classes[n:].tolist()
    size = np.bincount(classes[:n]).tolist()
    edges, near = [], []
    for s, d, m in ((s0, d0, m0), (s1, d1, m1)):
        s, d = s.tolist(), d.tolist()
        edges.append({a * n + b: x for a, b, x in zip(s, d, m, strict=True)})
        around = [[] for _ in range(n)]
        for a, b in zip(s, d, strict=True):
            if a != b:
                around[a].append(b)
                if b * n + a not in edges[-1] or a < b:
                    around[b].append(a)
        near.append([list(dict.fromkeys(x)) for x in around])
    (e0, e1), (near0, near1) = edges, near
    of_class: dict = {}
    for m, c in enumerate(other):
        of_class.setdefault(c, []).append(m)
    to, used, seen = [-1] * n, bytearray(n), bytearray(n)
    beside: dict = {}  # (image of the node before, class): its neighbours of the class
    free: dict = {}  # how many of them are known to be used

    def fits(v: int, m: int) -> bool:
        if e0.get(v * n + v) != e1.get(m * n + m):
            return False
        placed = 0
        for p in near0[v]:
            q = to[p]
            if q >= 0:
                placed += 1
                if e0.get(v * n + p) != e1.get(m * n + q) or e0.get(p * n + v) != e1.get(q * n + m):
                    return False
        return placed == sum(used[q] for q in near1[m])

    def places(v: int, came: int):
        c = own[v]
        if came < 0:
            key, some = c, of_class[c]
        else:
            key = (to[came], c)
            if to[came] not in beside:
                groups: dict = {}
                for m in near1[to[came]]:
                    groups.setdefault(other[m], []).append(m)
                beside[to[came]] = groups
            some = beside[to[came]].get(c, ())
        k = free.get(key, 0)
        while k < len(some) and used[some[k]]:
            k += 1
        free[key] = k
        for i in range(k, len(some)):
            if not used[some[i]] and fits(v, some[i]):
                yield some[i]

    for start in sorted(range(n), key=lambda v: size[own[v]]):
        if seen[start]:
            continue
        order, queue = [], deque([(start, -1)])
        seen[start] = 1
        while queue:
            v, came = queue.popleft()
            order.append((v, came))
            for m in sorted((m for m in near0[v] if not seen[m]), key=lambda m: size[own[m]]):
                seen[m] = 1
                queue.append((m, v))
        choices = [places(*order[0])]
        while True:
            v = order[len(choices) - 1][0]
            if to[v] >= 0:  # it was placed and what came after did not fit
                used[to[v]] = 0
                to[v] = -1
                free.clear()
            m = next(choices[-1], None)
            if m is None:
                choices.pop()
                if not choices:
                    return False
                continue
            to[v] = m
            used[m] = 1
            if len(choices) == len(order):
                break
            choices.append(places(*order[len(choices)]))
    return True


def triangles(g: PropertyGraph) -> DataFrame:
    """``a b c`` with a < b < c, directions, loops and parallels ignored.

    Nodes are ranked by degree and every edge belongs to its lower end, so no node has more than a root of the edges, hubs
    included.  To each edge s, t go the neighbours of s after t, as one row of ranks; those that t has too close a triangle.
    The pairs of neighbours themselves are never shuffled.
    """
    e = g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = materialize(e, "triangles")
    deg = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    ranks = materialize(numbered(deg, "r", ["d", "n"]).select("n", "r"), "triangles")
    kind = "int" if ranks.count() < 1 << 31 else "long"
    ranks = ranks.select("n", F.col("r").cast(kind).alias("r"))
    w = e.join(ranks.withColumnsRenamed({"n": "a", "r": "ra"}), "a").join(ranks.withColumnsRenamed({"n": "b", "r": "rb"}), "b")
    lists = materialize(w.groupBy(F.least("ra", "rb").alias("s")).agg(F.sort_array(F.collect_list(F.greatest("ra", "rb"))).alias("after")), "triangles")
    rest = lists.select("s", "after", F.posexplode("after").alias("i", "t")).where(F.col("i") + 1 < F.size("after"))
    rest = rest.select("s", "t", F.expr("slice(after, i + 2, size(after))").alias("rest"))
    own = lists.withColumnsRenamed({"s": "t", "after": "own"}).hint("shuffle_hash")
    out = rest.join(own, "t").select("s", "t", F.explode(F.array_intersect("rest", "own")).alias("u"))
    for c in ("s", "t", "u"):
        out = out.join(ranks.withColumnsRenamed({"n": f"n{c}", "r": c}), c)
    corners = F.array_sort(F.array("ns", "nt", "nu"))
    return out.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def maximal_cliques(g: PropertyGraph, max_neighbours: int = 100_000) -> DataFrame:
    """``clique``: sorted members of every maximal clique, directions and loops ignored; an isolated node is one.

    Each node searches among its neighbours later in the order (degree, id), with earlier ones only excluded, so a
    clique is found once, by its first member, in a task that holds that node's surroundings.
    """
    e = g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cliques")
    deg = both.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("d"))
    ball = both.join(deg.withColumnsRenamed({"n": "b", "d": "d"}), "b").select(F.col("a").alias("seed"), F.col("b").alias("n"), "d")
    inner = ball.select("seed", F.col("n").alias("a")).join(both, "a").join(ball.select("seed", F.col("n").alias("b")), ["seed", "b"], "left_semi").where("a < b")
    own = deg.select(F.col("n").alias("seed"), "n", "d")
    rows = own.unionByName(ball).select("seed", "n", F.col("d"), F.lit(None).cast("long").alias("m")).unionByName(inner.select("seed", F.col("a").alias("n"), F.lit(None).cast("long").alias("d"), F.col("b").alias("m")))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seed = int(key[0])
        members = frame[frame.m.isna()]
        if len(members) > max_neighbours:
            raise ValueError(f"node {seed} has more than {max_neighbours} neighbours")
        rank = {int(n): (d, int(n)) for n, d in zip(members.n, members.d, strict=True)}
        near = {n: set() for n in rank}
        for a, b in frame[~frame.m.isna()][["n", "m"]].astype("int64").itertuples(index=False):
            near[a].add(b)
            near[b].add(a)
        others = set(rank) - {seed}
        todo = [([seed], {n for n in others if rank[n] > rank[seed]}, {n for n in others if rank[n] < rank[seed]})]
        out = []
        while todo:
            r, p, x = todo.pop()
            if not p:
                if not x:
                    out.append(sorted(r))
                continue
            pivot = max(p | x, key=lambda n: (len(p & near[n]), n))
            for n in sorted(p - near[pivot]):
                todo.append(([*r, n], p & near[n], x & near[n]))
                p = p - {n}
                x = x | {n}
        return pd.DataFrame({"clique": pd.Series(out, dtype=object)})

    alone = g.nodes.join(both.select(F.col("a").alias("id")), "id", "left_anti").select(F.array("id").alias("clique"))
    return rows.groupBy("seed").applyInPandas(run, "clique array<long>").unionByName(alone)


def complement(g: PropertyGraph) -> PropertyGraph:
    """Edges between all different nodes that have none: one per ordered pair, or per pair if undirected.

    The answer holds nearly all pairs of nodes, so the pairs are enumerated; this is for small graphs.
    """
    a, b = g.nodes.select(F.col("id").alias("src")), g.nodes.select(F.col("id").alias("dst"))
    pairs = a.crossJoin(b).where("src <> dst" if g.directed else "src < dst")
    missing = pairs.join(g.adjacency_matrix(), ["src", "dst"], "left_anti")
    return PropertyGraph(g.nodes, numbered(missing, "edge_id", ["src", "dst"]), g.directed)
