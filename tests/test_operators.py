"""Small graphs with known answers, and invariants on seeded random graphs."""

import pytest
from pyspark.sql import functions as F

from weft.graph import PropertyGraph
from weft.operators import components, kernels, matching, paths, pattern, rank, spanning, traverse
from weft.sources import generators

# a ring of three and a ring of five, a link between them
RINGS = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 6), (6, 7), (7, 3), (2, 5)]
WEIGHTED = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (2, 3, 8), (3, 4, 3), (2, 5, 10), (4, 5, 1)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_shortest_paths(spark):
    g = PropertyGraph.from_rows(spark, WEIGHTED, False)
    w = F.col("weight")
    best = paths.sssp(g, 0, w)
    assert rows(best, "node", "cost") == [(0, 0), (1, 3), (2, 1), (3, 8), (4, 11), (5, 11)]
    assert paths.path_to(best, 4) == [0, 2, 1, 3, 4] and paths.path_to(best, 0) == [0] and paths.path_to(best, 9) == []
    assert paths.bidirectional_dijkstra(g, 0, 4, w) == 11
    assert paths.bidirectional_dijkstra(g, 2, 2, w) == 0
    assert paths.astar(g, 0, F.col("id") == 4, w) == (11, [0, 2, 1, 3, 4])
    assert rows(paths.dijkstra(g, 0, 1, w), "node") == [(0,), (1,), (2,)]


def test_negative_cycles(spark):
    g = PropertyGraph.from_rows(spark, [(0, 1, 1), (1, 2, -3), (2, 1, 1), (2, 3, 1)])
    with pytest.raises(paths.NegativeCycleError):
        paths.sssp(g, 0, F.col("weight"))
    assert paths.find_negative_cycle(g, 0, F.col("weight")) == [1, 2]
    ring = PropertyGraph.from_rows(spark, [(i, (i + 1) % 9, 1) for i in range(9)] + [(4, 9, 0), (9, 5, -6), (9, 10, 1)])
    assert paths.find_negative_cycle(ring, 0, F.col("weight")) is None
    less = ring.set_edges(weight=F.col("weight") - F.when(F.col("src") == 9, 3).otherwise(0))
    assert paths.find_negative_cycle(less, 2, F.col("weight")) == [0, 1, 2, 3, 4, 9, 5, 6, 7, 8]
    with pytest.raises(paths.NegativeCycleError):
        paths.sssp(less, 0, F.col("weight"))
    fine = g.set_edges(weight=F.abs("weight"))
    assert paths.find_negative_cycle(fine, 0, F.col("weight")) is None


def test_components_and_order(spark):
    g = PropertyGraph.from_rows(spark, RINGS)
    assert rows(components.scc(g), "node", "component") == [(i, 0 if i < 3 else 3) for i in range(8)]
    assert rows(components.scc_ordered(g), "position", "component") == [(0, 3), (1, 0)]
    assert components.component_count(g) == 1
    with pytest.raises(traverse.GraphCycleError) as e:
        traverse.toposort(g)
    assert e.value.node == 0
    assert not traverse.is_cyclic_directed(PropertyGraph.from_rows(spark, [(0, 1), (0, 2), (1, 2)]))
    assert traverse.is_cyclic_undirected(PropertyGraph.from_rows(spark, [(0, 1), (1, 0)]))
    assert traverse.is_bipartite(PropertyGraph.from_rows(spark, [(0, 1), (1, 2), (2, 3), (3, 0)], False), 0)


def test_deep_graphs(spark):
    n = 10
    g = PropertyGraph.from_rows(spark, [(i, i + 1) for i in range(n)])
    assert traverse.has_path(g, 0, n) and not traverse.has_path(g, n, 0)
    assert not traverse.is_cyclic_directed(g) and traverse.is_bipartite(g, 0)
    assert rows(traverse.toposort(g), "node", "position") == [(i, i) for i in range(n + 1)]
    assert paths.path_to(traverse.bfs(g, [0]).withColumnRenamed("parent", "prev"), n) == list(range(n + 1))


def test_long_chain_components(spark):
    n = 300
    g = PropertyGraph.from_rows(spark, [(i, i + 1) for i in range(n)])
    assert rows(components.connected_components(g).agg(F.max("component"), F.count("node")), "max(component)", "count(node)") == [(0, n + 1)]


def test_cuts(spark):
    g = PropertyGraph.from_rows(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (3, 4)], False)
    assert rows(kernels.bridges(g), "src", "dst") == [(2, 3)]
    assert rows(kernels.articulation_points(g), "node") == [(2,), (3,)]


def test_dominators(spark):
    g = PropertyGraph.from_rows(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 4)])
    assert rows(kernels.dominators(g, [0]).where("idom IS NOT NULL"), "node", "idom") == [(1, 0), (2, 0), (3, 0), (4, 3)]


def test_flow_and_matching(spark):
    g = PropertyGraph.from_rows(spark, [(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)])
    f = kernels.max_flow(g, 0, 3, F.col("weight"))
    assert kernels.flow_value(g, f, 0) == 5
    ring = PropertyGraph.from_rows(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (4, 5), (2, 6)], False)
    assert kernels.maximum_matching(ring).count() == 3
    assert 2 <= matching.greedy_matching(ring).count() <= 3


def test_page_rank_with_parallel_edges_and_a_dead_end(spark):
    edges = [(0, 1), (0, 1), (0, 2), (1, 2), (2, 0), (2, 2), (1, 3)]
    d, n = 0.85, 4
    r = [1 / n] * n
    deg = [sum(s == w for s, _ in edges) for w in range(n)]
    for _ in range(8):
        pi = [sum(d * r[w] / deg[w] if (w, v) in edges else d * r[w] / n if not deg[w] else (1 - d) * r[w] / n for w in range(n)) for v in range(n)]
        r = [x / sum(pi) for x in pi]
    got = rows(rank.page_rank(PropertyGraph.from_rows(spark, edges), d, 8), "node", "rank")
    assert [x for _, x in got] == pytest.approx(r, abs=1e-12)


def test_trees(spark):
    g = PropertyGraph.from_rows(spark, WEIGHTED, False)
    tree = spanning.min_spanning_tree(g, F.col("weight"))
    assert rows(tree, "src", "dst") == [(0, 2), (1, 3), (2, 1), (3, 4), (4, 5)]
    steiner = spanning.steiner_tree(g, [0, 4], F.col("weight"))
    assert rows(steiner, "src", "dst") == [(0, 2), (1, 3), (2, 1), (3, 4)]
    with pytest.raises(spanning.DisconnectedTerminals):
        spanning.steiner_tree(PropertyGraph.from_rows(spark, [(0, 1), (2, 3)], False), [0, 3])
    dag = PropertyGraph.from_rows(spark, [(0, 1), (1, 2), (0, 2)])
    reduction, closure = spanning.transitive_reduction_closure(dag)
    assert rows(reduction, "src", "dst") == [(0, 1), (1, 2)] and closure.count() == 3


def test_patterns(spark):
    k4 = PropertyGraph.from_rows(spark, [(a, b) for a in range(4) for b in range(a)] + [(4, 0)], False)
    assert rows(pattern.maximal_cliques(k4), "clique") == [([0, 1, 2, 3],), ([0, 4],)]
    assert pattern.triangles(k4).count() == 4
    assert pattern.subgraph_isomorphisms([(0, 1), (1, 2)], k4).count() == 6
    assert pattern.is_isomorphic(k4, PropertyGraph.from_rows(spark, [(4 - a, 4 - b) for a in range(4) for b in range(a)] + [(0, 4)], False))
    back = pattern.complement(pattern.complement(k4))
    assert rows(back.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), "a", "b") == rows(k4.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), "a", "b")
    with pytest.raises(pattern.MultigraphError):
        pattern.subgraph_isomorphisms([(0, 1)], PropertyGraph.from_rows(spark, [(0, 1), (0, 1)]))


def test_search_events(spark):
    g = PropertyGraph.from_rows(spark, [(0, 1), (0, 2), (1, 2), (2, 0)])
    got = [(r.event, r.u, r.v) for r in kernels.dfs_events(g, [0]).orderBy("seq").collect()]
    assert got == [("discover", 0, None), ("tree", 0, 2), ("discover", 2, None), ("back", 2, 0), ("finish", 2, None), ("tree", 0, 1), ("discover", 1, None), ("cross_forward", 1, 2), ("finish", 1, None), ("finish", 0, None)]


def test_search_control(spark):
    def events(edges, starts, **control):
        return [(r.event, r.u, r.v) for r in kernels.dfs_events(PropertyGraph.from_rows(spark, edges), starts, **control).orderBy("seq").collect()]

    edges = [(0, 1), (0, 2), (2, 3), (3, 0)]
    pruned = events(edges, [0], prune=F.col("id") == 2)
    assert pruned == [("discover", 0, None), ("tree", 0, 2), ("discover", 2, None), ("finish", 2, None), ("tree", 0, 1), ("discover", 1, None), ("finish", 1, None), ("finish", 0, None)]
    assert events(edges, [0], stop=F.col("id") == 3) == [("discover", 0, None), ("tree", 0, 2), ("discover", 2, None), ("tree", 2, 3), ("discover", 3, None)]


def _postorder(edges, start):
    after, out, seen = {}, [], {start}
    for a, b in reversed(edges):
        after.setdefault(a, []).append(b)

    def visit(n):
        for m in after.get(n, []):
            if m not in seen:
                seen.add(m)
                visit(m)
        out.append(n)

    visit(start)
    return out


def _largest_matching(edges):
    """By trying every edge in and out."""
    if not edges:
        return 0
    (a, b), rest = edges[0], edges[1:]
    return max(_largest_matching(rest), a != b and 1 + _largest_matching([e for e in rest if not {a, b} & set(e)]))


def _cheapest_tree(edges, wanted):
    """By trying every set of edges that joins the wanted nodes."""
    best = None
    for k in range(1 << len(edges)):
        some = [e for i, e in enumerate(edges) if k >> i & 1]
        weight, seen, grown = sum(w for *_, w in some), {wanted[0]}, True
        if best is not None and weight >= best:
            continue
        while grown:
            more = {n for a, b, _ in some for n in (a, b) if {a, b} & seen} - seen
            seen, grown = seen | more, bool(more)
        if set(wanted) <= seen:
            best = weight
    return best


def test_kernels_against_brute_force(spark):
    import random

    draw = random.Random(11)
    for _ in range(2):
        edges = sorted({(draw.randrange(8), draw.randrange(8)) for _ in range(13)})
        draw.shuffle(edges)
        g = PropertyGraph.from_rows(spark, edges)
        start = edges[0][0]
        post = _postorder(edges, start)
        assert [n for _, n in rows(kernels.dfs_postorder(g, start), "position", "node")] == post
        assert {n for n, in rows(kernels.dfs_preorder(g, start), "node")} == set(post)
        assert kernels.maximum_matching(g.into_edge_type(False)).count() == _largest_matching(edges)
    net = [(0, 1, 3), (1, 2, 4), (2, 3, 2), (3, 0, 6), (0, 4, 2), (1, 4, 2), (2, 4, 2), (3, 4, 3), (4, 5, 1)]
    tree = spanning.steiner_tree(PropertyGraph.from_rows(spark, net, False), [0, 2, 3, 5], F.col("weight"))
    assert tree.agg(F.sum("weight")).first()[0] <= 2 * _cheapest_tree(net, [0, 2, 3, 5]) * (1 - 1 / 4)


def test_walks_and_paths(spark):
    g = PropertyGraph.from_rows(spark, [(0, 1), (1, 2), (2, 1), (0, 2)])
    assert rows(paths.k_shortest_walks(g, 0, 2), "node", "cost") == [(1, 2), (2, 2)]
    assert rows(paths.all_simple_paths(g, 0, [2]), "path") == [([0, 1, 2],), ([0, 2],)]
    assert rows(paths.all_simple_paths(g, 0, [2], most=0), "path") == [([0, 2],)]
    assert paths.all_simple_paths(g, 0, [0]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    g = generators.random_graph(spark, 14, 0.2, seed=seed)
    one = rows(paths.sssp(g, 0), "node", "cost")
    assert one == rows(traverse.bfs(g, [0]), "node", "depth")
    assert [(d, c) for s, d, c in rows(paths.apsp(g), "src", "dst", "cost") if s == 0] == one
    tour = generators.tournament(spark, 9, seed)
    gone = kernels.greedy_feedback_arc_set(tour)
    assert gone.count() <= 36 / 2 - 9 / 6
    assert not traverse.is_cyclic_directed(PropertyGraph(tour.nodes, tour.edges.join(gone.select("edge_id"), "edge_id", "left_anti")))
    colours = dict(rows(kernels.dsatur_coloring(g.filter_edges(F.col("src") != F.col("dst"))), "node", "color"))
    assert all(colours[a] != colours[b] for a, b in rows(g.edges, "src", "dst") if a != b)


def test_whole_tables_against_brute_force(spark):
    from weft.plans import queries, views

    sf = "/root/testdata/sf0.001"
    run = lambda name: queries.QUERIES[f"{name}_whole"](spark, sf).collect()
    pairs = {(r.src, r.dst) for r in views.handoff(spark, sf).edges.collect()}
    assert {(r.dst, r.src) for r in run("reversed")} == pairs
    nodes = {n for e in pairs for n in e}

    def reach(edges, start, without=None):
        seen, todo = {start}, [start]
        while todo:
            n = todo.pop()
            new = {b for a, b in edges if a == n and b != without} - seen
            seen |= new
            todo += new
        return seen

    ahead = {n: reach(pairs, n) for n in nodes}
    assert {(r.node, r.component) for r in run("scc")} == {(n, min(m for m in ahead[n] if n in ahead[m])) for n in nodes}
    top = [(r.edge_id, r.src, r.dst) for r in views.top_next(spark, sf).edges.collect()]
    both = lambda skip=None: [p for k, a, b in top if k != skip for p in ((a, b), (b, a))]
    assert {r.edge_id for r in run("bridges")} == {k for k, a, b in top if b not in reach(both(k), a)}
