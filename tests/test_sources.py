import random

import pytest

from weft.graph import GraphError, NodeNotFound, PropertyGraph
from weft.operators.traverse import GraphCycleError
from weft.sources import dot, files, generators, graph6
from weft.streaming.incremental import DagTable, DisjointSets


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 7, 70])
def test_graph6_round_trip(spark, n):
    draw = random.Random(n)
    edges = [(a, b) for b in range(n) for a in range(b) if draw.random() < 0.3]
    bits = "".join("1" if (a, b) in set(edges) else "0" for b in range(n) for a in range(b))
    bits += "0" * (-len(bits) % 6)
    head = chr(n + 63) if n < 63 else "~" + "".join(chr((n >> s & 63) + 63) for s in (12, 6, 0))
    want = head + "".join(chr(int(bits[i : i + 6], 2) + 63) for i in range(0, len(bits), 6))
    g = PropertyGraph(spark.range(n), spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "edge_id long, src long, dst long"), False)
    assert graph6.to_graph6(g) == want
    assert rows(graph6.from_graph6(spark, want).edges, "src", "dst") == sorted(edges)


def test_dot():
    text = 'digraph g { node [color=red]; a -> b -> "c d" [label="x\\"y"]; // note\n subgraph s { e [shape=box] } }'
    directed, nodes, edges = dot.parse_dot(text)
    assert directed and [n for n, _ in nodes] == ["a", "b", "c d", "e"]
    assert edges == [("a", "b", {"label": 'x"y'}), ("b", "c d", {"label": 'x"y'})]
    assert dict(nodes)["e"] == {"color": "red", "shape": "box"}
    directed, nodes, edges = dot.parse_dot("digraph { a -> {b c} -> d [x=1]; subgraph s { node [k=2] e }; f:p -> subgraph t {g:q} }")
    assert edges == [("a", "b", {"x": "1"}), ("a", "c", {"x": "1"}), ("b", "d", {"x": "1"}), ("c", "d", {"x": "1"}), ("f", "g", {})]
    assert dict(nodes)["e"] == {"k": "2"} and dict(nodes)["g"] == {}
    for bad in ("graph { a -> b }", "digraph { a ->", "nothing", "digraph { -> a }", "digraph " + "{" * 500):
        with pytest.raises(dot.DotError):
            dot.parse_dot(bad)


def test_json(spark):
    text = '{"nodes": ["x", "y"], "node_holes": [1], "edge_property": "directed", "edges": [[0, 2, 5], null]}'
    g = files.from_json(spark, text)
    assert rows(g.nodes, "id", "weight") == [(0, "x"), (2, "y")] and rows(g.edges, "src", "dst", "weight") == [(0, 2, 5)]
    assert files.from_json(spark, files.to_json(g)).edge_count() == 1
    with pytest.raises(NodeNotFound):
        files.from_json(spark, text.replace("[0, 2, 5]", "[0, 1, 5]"))
    with pytest.raises(GraphError):
        files.from_json(spark, text, directed=False)


def test_folder_and_matrix(spark, tmp_path):
    g = generators.directed_fan(spark, 5)
    files.write_graph(g, str(tmp_path / "g"))
    assert rows(files.read_graph(spark, str(tmp_path / "g")).edges, "src", "dst") == rows(g.edges, "src", "dst")
    with pytest.raises(GraphError):
        files.read_graph(spark, str(tmp_path / "g"), directed=False)
    lines = spark.createDataFrame([(0, "0 1 1"), (1, "0 0 0"), (2, "1 0 0")], "row int, value string")
    assert rows(files.edges_of_matrix(lines), "src", "dst") == [(0, 1), (0, 2), (2, 0)]


def test_generators(spark):
    assert generators.all_dags(spark, 3).select("graph_no").distinct().count() == 7
    assert generators.all_graphs(spark, 2).select("graph_no").distinct().count() == 3
    assert generators.grid(spark, 3, 4).edge_count() == 17
    assert generators.tournament(spark, 6).edge_count() == 15


def test_disjoint_sets(spark):
    s = DisjointSets(spark, 6)
    assert s.union(spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "a long, b long")) == 2
    assert s.equiv(0, 2) and not s.equiv(0, 3) and s.find(9) is None
    with pytest.raises(NodeNotFound):
        s.union(spark.createDataFrame([(0, 9)], "a long, b long"))


def test_growing_dag(spark):
    d = DagTable(PropertyGraph.with_nodes(spark, 4))
    d.add_edges(spark.createDataFrame([(3, 1), (1, 0)], "src long, dst long"))
    assert d.position(3) < d.position(1) < d.position(0)
    assert not d.is_valid_edge(0, 3) and d.is_valid_edge(3, 2)
    with pytest.raises(GraphCycleError):
        d.add_edges(spark.createDataFrame([(0, 3)], "src long, dst long"))
    assert d.graph.edge_count() == 2


def test_stream_of_edges(spark, tmp_path):
    path = str(tmp_path / "edges")
    spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 5, 6)], "edge_id long, src long, dst long").write.parquet(path)
    sets = DisjointSets(spark)
    stream = spark.readStream.schema("edge_id long, src long, dst long").parquet(path)
    q = stream.writeStream.foreachBatch(sets.sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(sets.labels, "node", "component") == [(0, 0), (1, 0), (2, 0), (5, 5), (6, 5)]
