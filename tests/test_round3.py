"""Queries on tables whose graphs are empty or odd, compared with their SQL; kernels compared with plain ones."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weft.graph import PropertyGraph
from weft.operators import kernels, pattern, rank, spanning
from weft.plans import runtime
from weft.sources import files


def same_as_sql(spark, sf, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(sf)).select(want.columns)
    return Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def events_of(spark, users, path):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(users)], "event_id long, user_id long")
    rows.withColumn("ts", F.timestamp_seconds(F.col("event_id"))).coalesce(1).write.parquet(f"{path}/parts")
    duckdb.sql(f"COPY (SELECT * FROM '{path}/parts/*.parquet') TO '{path}/events.parquet' (FORMAT parquet)")
    return path


@pytest.fixture(scope="module")
def no_pair_thrice(spark, tmp_path_factory):
    return events_of(spark, range(12), tmp_path_factory.mktemp("few"))


def test_dag_positions_without_edges(spark, no_pair_thrice):
    assert same_as_sql(spark, no_pair_thrice, "dag_positions")


def test_page_rank_of_nothing(spark, no_pair_thrice):
    assert rank.page_rank(PropertyGraph.empty(spark), tolerance=0.0).isEmpty()
    assert same_as_sql(spark, no_pair_thrice, "page_rank_tolerance")


def test_dfs_events_without_edges_from_the_least_node(spark, no_pair_thrice, tmp_path):
    assert same_as_sql(spark, no_pair_thrice, "dfs_events")
    assert same_as_sql(spark, events_of(spark, [7, 3, 9, 7, 3, 1, 7, 3, 2, 0], tmp_path), "dfs_events")


def test_dominators_without_a_root(spark, no_pair_thrice):
    assert same_as_sql(spark, no_pair_thrice, "dominators")


def test_dominators_of_without_a_root(spark, no_pair_thrice):
    assert same_as_sql(spark, no_pair_thrice, "dominators_of")


def test_rings_that_look_alike_are_told_apart_quickly(spark):
    def rings(*sizes):
        out = []
        for k in sizes:
            n = len(out)
            out += [(n + i, n + (i + 1) % k) for i in range(k)]
        return PropertyGraph.from_rows(spark, out, False)

    assert not pattern.is_isomorphic(rings(*[6] * 10, 3, 3), rings(*[6] * 11))
    assert pattern.is_isomorphic(rings(3, 6, 4), rings(6, 4, 3))


@pytest.mark.parametrize("weights", [[5, None, -7], [1.5, 2.0, float("inf")], ["a\"b", "3", None], [True, None, False]])
def test_json_in_lines_as_json_in_one_text(spark, tmp_path, weights):
    kind = {int: "long", float: "double", str: "string", bool: "boolean"}[type(weights[0])]
    nodes = spark.createDataFrame(list(zip([1, 3, 6], weights)), f"id long, weight {kind}")
    edges = spark.createDataFrame([(8, 6, 1, weights[0]), (2, 3, 3, weights[1]), (5, 1, 3, weights[2])], f"edge_id long, src long, dst long, weight {kind}")
    g = PropertyGraph(nodes, edges)
    files.write_json(g, f"{tmp_path}/g")
    got, want = files.read_json(spark, f"{tmp_path}/g"), files.from_json(spark, files.to_json(g))
    for a, b in ((got.nodes, want.nodes), (got.edges, want.edges)):
        assert a.dtypes == b.dtypes and sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_json_round_trip_of_a_whole_table_is_not_one_text(spark, monkeypatch):
    monkeypatch.setattr(files, "to_json", lambda *_: pytest.fail("the graph meets in the driver"))
    assert same_as_sql(spark, "/root/testdata/sf0.001", "json_round_trip_whole")


# -- kernels: a group's edges must not become Python objects all at once ------------------------------------------------

DRAW = random.Random(5)
EDGES = [(DRAW.randrange(30), DRAW.randrange(30), DRAW.randrange(1, 6)) for _ in range(90)]


def in_arrays(df):
    return "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_postorder_in_arrays(spark):
    after, want, seen = {}, [], set()
    for a, b, _ in reversed(EDGES):
        after.setdefault(a, []).append(b)

    def visit(n):
        seen.add(n)
        for m in after.get(n, []):
            if m not in seen:
                visit(m)
        want.append(n)

    visit(EDGES[0][0])
    got = kernels.dfs_postorder(PropertyGraph.from_rows(spark, EDGES), EDGES[0][0])
    assert in_arrays(got) and [r.node for r in got.orderBy("position").collect()] == want


def test_colouring_in_arrays(spark):
    near = {n: {b for e in EDGES for a, b in (e[:2], e[1::-1]) if a == n != b} for n in range(30)}
    want = {}
    while len(want) < 30:
        n = min(set(near) - set(want), key=lambda n: (-len({want[m] for m in near[n] if m in want}), -len(near[n]), n))
        want[n] = next(c for c in range(30) if c not in {want.get(m) for m in near[n]})
    g = PropertyGraph.from_rows(spark, EDGES + [(29, 28, 1), (28, 29, 1)], False).filter_edges(F.col("src") != F.col("dst"))
    near[28].add(29), near[29].add(28)
    got = kernels.dsatur_coloring(g)
    colours = {r.node: r.color for r in got.collect()}
    assert in_arrays(got) and set(colours) == set(near) and all(colours[a] != colours[b] for a in near for b in near[a])
    assert max(colours.values()) <= max(want.values()) + 1


def test_events_in_arrays(spark):
    got = kernels.dfs_events(PropertyGraph.from_rows(spark, EDGES, False), [EDGES[0][0]])
    rows = got.orderBy("seq").collect()
    assert in_arrays(got) and [r.seq for r in rows] == list(range(len(rows)))
    done, found = set(), set()
    for r in rows:
        if r.event == "discover":
            found.add(r.u)
        elif r.event == "finish":
            done.add(r.u)
        else:
            assert r.event == ("tree" if r.v not in found else "cross_forward" if r.v in done else "back")
    assert sum(r.v is not None for r in rows) == sum((1 + (a != b)) for a, b, _ in EDGES if a in found)


def test_flow_in_arrays(spark):
    g = PropertyGraph.from_rows(spark, EDGES)
    got = kernels.max_flow(g, 0, 29, F.col("weight"))
    flow = {r.edge_id: r.flow for r in got.collect()}
    assert in_arrays(got) and len(flow) == len(EDGES) and all(0 <= flow[i] <= w for i, (_, _, w) in enumerate(EDGES))
    net = {n: sum(flow[i] * ((a == n) - (b == n)) for i, (a, b, _) in enumerate(EDGES)) for n in range(30)}
    side, grown = {0}, True
    while grown:
        more = {y for i, (a, b, w) in enumerate(EDGES) for x, y, room in ((a, b, w - flow[i]), (b, a, flow[i])) if x in side and room > 0} - side
        side, grown = side | more, bool(more)
    assert 29 not in side and net[0] == sum(w for a, b, w in EDGES if a in side and b not in side) and not any(net[n] for n in range(1, 29))


def _reached(start, without=None):
    seen, todo = {start}, [start]
    while todo:
        n = todo.pop()
        new = {b for a, b, _ in EDGES if a == n and b != without} - seen
        seen |= new
        todo += new
    return seen


def test_dominators_in_arrays(spark):
    tree = kernels.dominators(PropertyGraph.from_rows(spark, EDGES), [0, 7])
    assert in_arrays(tree)
    for root in (0, 7):
        idom = {r.node: r.idom for r in tree.where(F.col("root") == root).collect()}
        everything = _reached(root)
        above = {n: {c for c in everything - {n, root} if n not in _reached(root, c)} | {root} for n in everything - {root}}
        assert set(idom) == everything and all(idom[n] == max(above[n], key=lambda c: len(above.get(c, ()))) for n in above)


def test_strict_dominators_in_arrays(spark):
    tree = kernels.dominators(PropertyGraph.from_rows(spark, EDGES), [0])
    got = {(r.node, r.dominator) for r in kernels.strict_dominators(tree).collect()}
    everything = _reached(0)
    assert in_arrays(tree) and got == {(n, c) for n in everything for c in everything - {n} if c == 0 or n not in _reached(0, c)}


def test_closure_of_a_long_way_takes_few_rounds(spark, monkeypatch):
    made = []
    plain = spanning.materialize
    monkeypatch.setattr(spanning, "materialize", lambda df, label="step": made.append(label) or plain(df, label))
    n = 40
    got = spanning.transitive_closure(PropertyGraph.from_rows(spark, [(i, i + 1) for i in range(n)] + [(n, 3)]))
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in range(n + 1) for b in range(n + 1)} - {(a, b) for a in range(3, n + 1) for b in range(3)} - {(a, b) for a in range(3) for b in range(a + 1)}
    assert len(made) <= 20
    dense = PropertyGraph.from_rows(spark, [(a, b) for a in range(9) for b in range(9) if (a * b + a) % 3 != 1])
    reach = {(r.src, r.dst) for r in dense.edges.collect()}
    for k in range(9):
        reach |= {(a, b) for a, x in reach if x == k for y, b in reach if y == k}
    assert sorted(map(tuple, spanning.transitive_closure(dense).collect())) == sorted(reach)


def test_adjacency_matrix_takes_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_A_TASK", 10)
    g = PropertyGraph.from_rows(spark, EDGES + [(3, 3, 1), (3, 3, 2), (1, 2, 1), (2, 1, 1)], False)
    got = g.adjacency_matrix()
    assert got.rdd.getNumPartitions() == 10  # of 94 rows, beyond the session's four
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for r in g.edges.collect() for p in ((r.src, r.dst), (r.dst, r.src))}


def test_triangles_send_lists_not_pairs(spark):
    got = pattern.triangles(PropertyGraph.from_rows(spark, EDGES + [(n, 31, 1) for n in range(30)] + [(4, 4, 1)]))
    near = {frozenset(e[:2]) for e in EDGES} | {frozenset((n, 31)) for n in range(30)}
    want = {(a, b, c) for a in range(32) for b in range(a + 1, 32) if {a, b} in near for c in range(b + 1, 32) if {a, c} in near and {b, c} in near}
    assert sorted(map(tuple, got.collect())) == sorted(want) and "array_intersect" in got._jdf.queryExecution().toString()
