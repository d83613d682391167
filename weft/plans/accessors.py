"""Further queries: single accessors, formats with their settings, and operators on graphs whose answer SQL can give."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.order import opposite_end
from weft.graph import KeyedGraph, PropertyGraph
from weft.operators import kernels, matching, paths, pattern, spanning
from weft.plans import views as v
from weft.plans.queries import _DOM, _SSSP, ORACLES, ROUNDS, _dominator_tree, _relaxed, first_node, last_node, one, query
from weft.plans.runtime import materialize, new_path
from weft.sources import dot, files, generators, graph6
from weft.streaming.incremental import DagTable

# -- graph accessors ------------------------------------------------------------------------------------------------

_FIRST = "a AS (SELECT min(id) AS a FROM hnodes), b AS (SELECT min(dst) AS b FROM handoff, a WHERE src = a)"


@query(
    f"WITH {v.HANDOFF}, {_FIRST} SELECT a * 2147483648 + b AS edge, (SELECT arg_max(src = a, src * 2147483648 + dst) FROM handoff WHERE (src = a AND dst = b) OR (src = b AND dst = a)) AS leaves, "
    "true AS has_edge, false AS has_other, true AS has_node, (SELECT max(src * 2147483648 + dst) FROM handoff WHERE src = a) AS first_edge, (SELECT w FROM handoff WHERE src = a AND dst = b) AS w, b AS target FROM a, b"
)
def q_edge_lookup(spark, sf):
    g = v.handoff(spark, sf)
    a = first_node(g)
    b = g.neighbors(a).agg(F.min("id")).first()[0]
    edge = g.find_edge(a, b)
    return one(
        spark, edge=edge, leaves=g.find_edge_undirected(a, b)[1] == "out", has_edge=g.contains_edge(a, b), has_other=g.contains_edge(a, -1), has_node=g.contains_node(a),
        first_edge=g.first_edge(a), w=g.edge_payload(edge).first().w, target=g.edge_endpoints(edge)[1],
    )


@query(f"WITH {v.PARTS} SELECT src, dst, w FROM supplier_part WHERE src = (SELECT min(src) FROM supplier_part) AND dst = (SELECT min(dst) FROM supplier_part WHERE src = (SELECT min(src) FROM supplier_part))")
def q_edges_connecting(spark, sf):
    g = v.supplier_part(spark, sf)
    a = g.edges.agg(F.min("src")).first()[0]
    b = g.edges.where(F.col("src") == a).agg(F.min("dst")).first()[0]
    assert g.contains_edge(b, a)
    return g.edges_connecting(a, b).select("src", "dst", "w")


@query(f"WITH {v.HANDOFF} SELECT src, dst, w * 2 AS twice FROM handoff")
def q_map(spark, sf):
    return v.handoff(spark, sf).map(edges=[(F.col("w") * 2).alias("twice")]).edges.select("src", "dst", "twice")


@query(f"WITH {v.HANDOFF} SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS nodes_cleared FROM hnodes")
def q_clear(spark, sf):
    g = v.handoff(spark, sf)
    return one(spark, nodes=g.clear_edges().node_count(), edges=g.clear_edges().edge_count(), nodes_cleared=g.clear().node_count())


@query(f"WITH {v.PARTS} SELECT src, dst FROM supplier_part UNION SELECT dst, src FROM supplier_part")
def q_adjacency_matrix(spark, sf):
    g = v.supplier_part(spark, sf)
    return PropertyGraph(g.nodes, materialize(g.edges.select("src", "dst")), g.directed).adjacency_matrix()


@query(f"WITH {v.HANDOFF} SELECT src, dst, CASE WHEN src = (SELECT min(id) FROM hnodes) THEN dst ELSE src END AS other FROM handoff WHERE (SELECT min(id) FROM hnodes) IN (src, dst)")
def q_opposite_end(spark, sf):
    g = v.handoff(spark, sf)
    return g.edges.select("src", "dst", opposite_end(F.lit(first_node(g))).alias("other")).where("other IS NOT NULL")


@query(f"WITH {v.EVENTS} SELECT src, dst, w AS weight FROM event_next WHERE w >= 2")
def q_elements(spark, sf):
    g = v.event_next(spark, sf)
    g = PropertyGraph(g.nodes.select("id", F.lit(0).cast("long").alias("weight")), g.edges.withColumnRenamed("w", "weight"))
    kept = g.elements().where("kind = 'node' OR weight >= 2")
    return PropertyGraph.from_elements(kept).edges.select("src", "dst", "weight")


@query(f"WITH {v.HANDOFF} SELECT src, dst, w FROM handoff WHERE src % 5 <> 0 AND dst % 5 <> 0")
def q_folder_round_trip(spark, sf):
    """Ids keep their gaps."""
    path = new_path(spark, "graph")
    files.write_graph(v.handoff(spark, sf).filter_nodes(F.col("id") % 5 != 0), path)
    return files.read_graph(spark, path, directed=True).validate().edges.select("src", "dst", "w")


@query("SELECT DISTINCT o_orderstatus AS src, o_orderpriority AS dst FROM orders")
def q_keyed_folder_round_trip(spark, sf):
    pairs = v.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("src"), F.col("o_orderpriority").alias("dst"))
    path = new_path(spark, "keyed")
    files.write_graph(KeyedGraph.from_edges(pairs).into_graph(), path)
    return KeyedGraph.from_graph(files.read_graph(spark, path)).edges.select("src", "dst")


# -- searches -------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {v.CHAIN}, r(node, cost) AS (SELECT min(o_orderkey), CAST(0 AS BIGINT) FROM orders UNION ALL SELECT e.dst, r.cost - e.src % 7 FROM r JOIN order_chain e ON e.src = r.node) SELECT node, cost FROM r")
def q_bellman_ford(spark, sf):
    """Costs below zero along the orders of a customer."""
    g = v.order_chain(spark, sf)
    return paths.bellman_ford(g, first_node(g), -(F.col("src") % 7)).select("node", "cost")


@query(ORACLES["bellman_ford"])
def q_spfa(spark, sf):
    g = v.order_chain(spark, sf)
    return paths.spfa(g, first_node(g), -(F.col("src") % 7)).select("node", "cost")


@query("SELECT CAST(10 AS BIGINT) AS cost, CAST(11 AS BIGINT) AS nodes, true AS is_path")
def q_astar_estimate(spark, sf):
    """From corner to corner of a grid, with the distance along its axes as estimate."""
    g = generators.grid(spark, 8, 4)
    guess = (7 - F.floor(F.col("id") / 4)) + (3 - F.col("id") % 4)
    cost, path = paths.astar(g, 0, F.col("id") == 31, estimate=guess)
    steps = all(abs(a - b) in (1, 4) for a, b in zip(path, path[1:], strict=False))
    return one(spark, cost=cost, nodes=len(path), is_path=steps and (path[0], path[-1]) == (0, 31))


@query(ORACLES["johnson"])
def q_parallel_johnson(spark, sf):
    return paths.johnson(v.event_next(spark, sf), F.col("w"), v.event_next(spark, sf).nodes.select("id")).select("src", "dst", "cost")


@query(f"WITH RECURSIVE {_DOM} SELECT node, d AS dominator FROM dom UNION ALL SELECT node, node FROM reach")
def q_dominators_of(spark, sf):
    tree = materialize(_dominator_tree(v.strong(spark, sf)))
    return kernels.strict_dominators(tree).select("node", "dominator").unionByName(tree.select("node", F.col("node").alias("dominator")))


@query(f"WITH RECURSIVE {_DOM}, idom AS (SELECT reach.node, arg_max(dom.d, deep.k) AS idom FROM reach JOIN dom ON dom.node = reach.node JOIN deep ON deep.node = dom.d GROUP BY reach.node) SELECT root.id AS root, node FROM idom, root WHERE idom = root.id")
def q_immediately_dominated_by(spark, sf):
    g = v.strong(spark, sf)
    root = g.edges.agg(F.min("src")).first()[0]
    return kernels.dominated_by(kernels.dominators(g, [root]), root).select("root", "node")


_UNDIRECTED = f"{v.HANDOFF}, hu AS (SELECT src, dst, w FROM handoff UNION ALL SELECT dst, src, w FROM handoff), {_relaxed('hu', 'SELECT min(id) AS node, CAST(0 AS BIGINT) AS cost FROM hnodes')}"


@query(f"WITH {_UNDIRECTED} SELECT CAST(cost AS BIGINT) AS weight FROM r{ROUNDS} WHERE node = (SELECT max(id) FROM hnodes)")
def q_steiner_tree_of_two(spark, sf):
    """Of two terminals the tree is a shortest path."""
    g = v.handoff(spark, sf).into_edge_type(False)
    return spanning.steiner_tree(g, [first_node(g), last_node(g)], F.col("w")).agg(F.sum("w").alias("weight"))


@query(f"WITH {_SSSP} SELECT node, CAST(cost AS BIGINT) AS cost FROM r{ROUNDS} WHERE cost <= (SELECT min(cost) FROM r{ROUNDS} WHERE node % 10 = 3)")
def q_dijkstra_dynamic_goal(spark, sf):
    """To the nearest of many goals."""
    g = v.handoff(spark, sf)
    return paths.with_dynamic_goal(g, first_node(g), F.col("id") % 10 == 3, F.col("w"))[0].select("node", "cost")


# -- matchings ------------------------------------------------------------------------------------------------------


@query(f"WITH {v.TOP}, n AS (SELECT count(DISTINCT dst) AS n FROM top_next) SELECT n AS size, 2 * n AS nodes, false AS is_empty, false AS is_perfect, true AS mates_agree, true AS has_edge, true AS has_node FROM n")
def q_matching_accessors(spark, sf):
    """Users on one side, their top successors on the other: each successor can be matched once."""
    g = v.top_next(spark, sf)
    edges = g.edges.select("edge_id", (2 * F.col("src")).alias("src"), (2 * F.col("dst") + 1).alias("dst"), "w")
    g = PropertyGraph.from_edges(edges, False, fill=False)
    m = materialize(kernels.maximum_matching(g))
    row = m.first()
    back = matching.mate(m, matching.mate(m, row.node))
    return one(
        spark, size=m.count(), nodes=matching.matched_nodes(m).distinct().count(), is_empty=m.isEmpty(), is_perfect=matching.is_perfect(g, m), mates_agree=back == row.node,
        has_edge=matching.contains_edge(m, row.mate, row.node), has_node=matching.mate(m, row.node) is not None,
    )


# -- isomorphism ----------------------------------------------------------------------------------------------------


@query("SELECT true AS same_weights, false AS other_weights, true AS part, false AS no_part")
def q_isomorphic_matching(spark, sf):
    g = v.event_next(spark, sf)
    moved = PropertyGraph(g.nodes.select((4 - F.col("id")).alias("id"), "label"), g.edges.select("edge_id", (4 - F.col("src")).alias("src"), (4 - F.col("dst")).alias("dst"), "w"))
    heavier = moved.set_edges(w=F.when(F.col("edge_id") == moved.edges.agg(F.min("edge_id")).first()[0], F.col("w") + 1).otherwise(F.col("w")))
    return one(
        spark, same_weights=pattern.is_isomorphic(g, moved, F.col("label"), "w"), other_weights=pattern.is_isomorphic(g, heavier, F.col("label"), "w"),
        part=not pattern.subgraph_isomorphisms([(0, 1)], g, induced=False).isEmpty(), no_part=not pattern.subgraph_isomorphisms([(k, k + 1) for k in range(6)], g, induced=False).isEmpty(),
    )


# -- formats --------------------------------------------------------------------------------------------------------


@query("SELECT '    ' || n_nationkey || ' [ label = \"' || replace(n_name, 'A', '\\\\') || '\\\"\\l' || '\" ]' AS line FROM nation UNION ALL SELECT '    ' || n_nationkey || ' -- ' || n_regionkey || ' [ ]' FROM nation")
def q_dot_escaping(spark, sf):
    n = v.table(spark, sf, "nation")
    label = F.concat(F.replace("n_name", F.lit("A"), F.lit("\\")), F.lit('"\n'))
    g = PropertyGraph(n.select(F.col("n_nationkey").cast("long").alias("id"), label.alias("label")), n.select(F.col("n_nationkey").cast("long").alias("edge_id"), F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst")), False)
    return dot.dot_lines(g, F.col("label"), content_only=True).select("line")


@query(
    f"WITH {v.EVENTS} SELECT 'digraph {{' AS line UNION ALL SELECT '    rankdir=\"LR\"' UNION ALL SELECT '    ' || id || ' [ label = \"' || id || '\" shape = box ]' FROM kinds "
    "UNION ALL SELECT '    ' || src || ' -> ' || dst || ' [ label = \"' || (src * 2147483648 + dst) || '\" color = c' || w || ' ]' FROM event_next UNION ALL SELECT '}'"
)
def q_dot_settings(spark, sf):
    g = v.event_next(spark, sf)
    return dot.dot_lines(g, node_attributes=F.lit("shape = box"), edge_attributes=F.concat(F.lit("color = c"), F.col("w").cast("string")), index_labels=True, rank_dir="LR").select("line")


@query(
    f"WITH {v.EVENTS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM event_next WHERE src <> dst), n AS (SELECT count(*) AS n FROM kinds), "
    "k AS (SELECT CAST(b * (b - 1) // 2 + a AS BIGINT) AS k FROM u), c AS (SELECT i AS c, 63 + coalesce((SELECT CAST(sum(1 << (5 - k % 6)) AS BIGINT) FROM k WHERE k // 6 = i), 0) AS s FROM n, range((n * (n - 1) // 2 + 5) // 6) t(i)) "
    "SELECT chr(CAST(63 + n AS INTEGER)) || (SELECT string_agg(chr(CAST(s AS INTEGER)), '' ORDER BY c) FROM c) AS g6 FROM n"
)
def q_graph6_string(spark, sf):
    return one(spark, g6=graph6.to_graph6(v.event_next(spark, sf).into_edge_type(False)))


@query("SELECT * FROM (VALUES (0, 1), (1, 0), (1, 2), (2, 2)) t(src, dst)")
def q_adjacency_text(spark, sf):
    lines = spark.createDataFrame([(0, " 0 1 0"), (1, "1\t0  1 "), (2, "0 0 1")], "row int, value string")
    return files.edges_of_matrix(lines).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query("SELECT CAST(k AS BIGINT) AS edges, count(*) AS graphs FROM (SELECT g.n, sum((g.n >> b.b) & 1) AS k FROM range(512) g(n), range(9) b(b) GROUP BY g.n) WHERE k > 0 GROUP BY k")
def q_all_graphs(spark, sf):
    return generators.all_graphs(spark, 3, loops=True).groupBy("graph_no").count().groupBy(F.col("count").alias("edges")).agg(F.count(F.lit(1)).alias("graphs"))


@query("SELECT i // 20 AS src, i % 20 AS dst FROM range(400) t(i) WHERE i // 20 <> i % 20")
def q_random_graph_of_all_pairs(spark, sf):
    """With probability one every pair is an edge."""
    return generators.random_graph(spark, 20, 1.0, loops=False).edges.select("src", "dst")


# -- growth ---------------------------------------------------------------------------------------------------------


@query(f"WITH {v.STRONG} SELECT src, dst, true AS forward FROM strong WHERE src < dst")
def q_growing_dag_order(spark, sf):
    """Edges along the order that is kept while they are added, and sorted again only for batches that run against it."""
    g = v.strong_dag(spark, sf)
    dag = DagTable(g.clear_edges())
    for k in (2, 0, 1):
        dag.sink(g.edges.where(F.col("src") % 3 == k), k)
    at = dag.order
    ends = dag.graph.edges.join(at.withColumnsRenamed({"node": "src", "position": "a"}), "src").join(at.withColumnsRenamed({"node": "dst", "position": "b"}), "dst")
    return ends.select("src", "dst", (F.col("a") < F.col("b")).alias("forward"))


@query(f"WITH {v.STRONG}, e AS (SELECT src, dst FROM strong WHERE src < dst ORDER BY src, dst LIMIT 1) SELECT true AS there, true AS between, false AS back, false AS loop, (SELECT count(*) FROM snodes) AS nodes FROM e")
def q_dag_positions(spark, sf):
    g = v.strong_dag(spark, sf)
    dag = DagTable(g)
    e = g.edges.orderBy("src", "dst").first()
    if e is None:  # no edge, no row, as in SQL
        return one(spark, there=True, between=True, back=False, loop=False, nodes=0).limit(0)
    a, b = dag.position(e.src), dag.position(e.dst)
    inside = {r.node for r in dag.range(a, b).collect()}
    return one(spark, there=dag.at_position(a) == e.src, between={e.src, e.dst} <= inside and len(inside) == b - a + 1, back=dag.is_valid_edge(e.dst, e.src), loop=dag.is_valid_edge(e.src, e.src), nodes=dag.order.count())
