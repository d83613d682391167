"""Graphs as JSON or Parquet folders and as adjacency matrices in text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import GraphError, NodeNotFound, PropertyGraph, numbered
from weft.plans.runtime import materialize


def write_graph(g: PropertyGraph, path: str) -> None:
    """Write a folder with ``nodes``, ``edges`` (Parquet) and ``meta`` (JSON); ids, and so gaps in them, are kept."""
    g.nodes.write.parquet(f"{path}/nodes")
    g.edges.write.parquet(f"{path}/edges")
    meta = g.spark.createDataFrame([("directed" if g.directed else "undirected",)], "edge_property string")
    meta.coalesce(1).write.json(f"{path}/meta")


def read_graph(spark: SparkSession, path: str, directed: bool | None = None) -> PropertyGraph:
    """Read such a folder; another kind of edges than asked for, or an edge without its nodes, raises."""
    kind = spark.read.schema("edge_property string").json(f"{path}/meta").first().edge_property
    if kind not in ("directed", "undirected"):
        raise GraphError(f"unknown edge property {kind!r}")
    if directed is not None and directed != (kind == "directed"):
        raise GraphError(f"the graph is {kind}")
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), kind == "directed").validate()


def to_json(g: PropertyGraph, weight: str | None = "weight") -> str:
    """One small graph in the exchange format: nodes' weights by id, ids without a node, edges as [src, dst, weight]."""
    def value(row, has: bool):
        return row[weight] if has else None

    has_n, has_e = weight in g.nodes.columns, weight in g.edges.columns
    nodes = {r.id: value(r, has_n) for r in g.nodes.collect()}
    bound = max(nodes, default=-1) + 1
    edges = [[r.src, r.dst, value(r, has_e)] for r in g.edges.orderBy("edge_id").collect()]
    return json.dumps({"nodes": [nodes[i] for i in sorted(nodes)], "node_holes": [i for i in range(bound) if i not in nodes], "edge_property": "directed" if g.directed else "undirected", "edges": edges})


def from_json(spark: SparkSession, text: str, directed: bool | None = None) -> PropertyGraph:
    """Inverse of :func:`to_json`; weights are kept as JSON text where they are no numbers or strings."""
    data = json.loads(text)
    kind = data["edge_property"]
    if kind not in ("directed", "undirected") or (directed is not None and directed != (kind == "directed")):
        raise GraphError(f"edge property is {kind!r}")
    holes = set(data["node_holes"])
    size = len(data["nodes"]) + len(holes)
    if any(not 0 <= h < size for h in holes):
        raise GraphError("a hole lies outside the graph")
    ids = [i for i in range(size) if i not in holes]
    own = set(ids)
    edges = [e for e in data["edges"] if e is not None]
    if any(s not in own or d not in own for s, d, _ in edges):
        raise NodeNotFound("an edge names a node that does not exist")

    def column(values: list) -> tuple[str, list]:
        real = [v for v in values if v is not None]
        if all(isinstance(v, int) and not isinstance(v, bool) for v in real):
            return "long", values
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in real):
            return "double", [None if v is None else float(v) for v in values]
        return "string", [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]

    n_kind, n_values = column(data["nodes"])
    e_kind, e_values = column([w for _, _, w in edges])
    nodes = spark.createDataFrame(list(zip(ids, n_values, strict=True)), f"id long, weight {n_kind}")
    rows = [(i, s, d, w) for i, ((s, d, _), w) in enumerate(zip(edges, e_values, strict=True))]
    return PropertyGraph(nodes, spark.createDataFrame(rows, f"edge_id long, src long, dst long, weight {e_kind}"), kind == "directed")


def write_json(g: PropertyGraph, path: str, weight: str | None = "weight") -> None:
    """A graph of any size in the exchange format, its lists as folders of text with one element a line: ``nodes`` (weights
    by id), ``node_holes``, ``edges`` (by edge id) and ``meta``.  The order is that of file names and of lines in them."""

    def element(df: DataFrame, name: str | None) -> Column:
        if name not in df.columns:
            return F.lit("null")
        text = F.to_json(F.array(name))
        text = F.substring(text, 2, F.length(text) - 2)
        return F.when(F.isnan(name) | (F.abs(name) == float("inf")), F.col(name).cast("string")).otherwise(text) if dict(df.dtypes)[name] in ("double", "float") else text

    def write(df: DataFrame, order: str, line: Column, name: str) -> None:
        df.repartitionByRange(order).sortWithinPartitions(order).select(line.alias("value")).write.text(f"{path}/{name}")

    write(g.nodes, "id", element(g.nodes, weight), "nodes")
    write(g.spark.range(g.node_bound()).join(g.nodes, "id", "left_anti"), "id", F.col("id").cast("string"), "node_holes")
    write(g.edges, "edge_id", F.concat(F.lit("["), F.col("src").cast("string"), F.lit(", "), F.col("dst").cast("string"), F.lit(", "), element(g.edges, weight), F.lit("]")), "edges")
    g.spark.createDataFrame([(json.dumps({"edge_property": "directed" if g.directed else "undirected"}),)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_json(spark: SparkSession, path: str, directed: bool | None = None) -> PropertyGraph:
    """Inverse of :func:`write_json`, with the ids and types that :func:`from_json` gives."""
    kind = json.loads(spark.read.text(f"{path}/meta").first().value)["edge_property"]
    if kind not in ("directed", "undirected") or (directed is not None and directed != (kind == "directed")):
        raise GraphError(f"edge property is {kind!r}")

    def lines(name: str, number: str) -> DataFrame:
        text = spark.read.schema("value string").text(f"{path}/{name}").where("value <> 'null'" if name == "edges" else "true")
        placed = text.select(F.trim("value").alias("value"), F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_l"))
        return numbered(placed, number, ["_f", "_b", "_l"]).select(number, "value")

    def typed(df: DataFrame) -> DataFrame:
        """Column ``weight`` from JSON text: whole numbers, numbers, or strings."""
        raw, whole, number = F.col("weight"), r"^-?\d+$", r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|NaN|-?Infinity)$"
        real = df.where(raw != "null")
        odd = real.agg(F.coalesce(F.bool_or(~raw.rlike(whole)), F.lit(False)).alias("w"), F.coalesce(F.bool_or(~raw.rlike(number)), F.lit(False)).alias("n")).first()
        text = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit("["), raw, F.lit("]")), "$[0]")).otherwise(raw) if odd.n else raw
        return df.withColumn("weight", F.when(raw != "null", text).cast("string" if odd.n else "double" if odd.w else "long"))

    nodes, holes = lines("nodes", "_at"), spark.read.schema("value string").text(f"{path}/node_holes").select(F.col("value").cast("long").alias("id")).distinct()
    size = nodes.count() + holes.count()
    if not holes.where((F.col("id") < 0) | (F.col("id") >= size)).isEmpty():
        raise GraphError("a hole lies outside the graph")
    ids = numbered(spark.range(size).join(holes, "id", "left_anti"), "_at", ["id"])
    nodes = typed(nodes.join(ids, "_at").select("id", F.col("value").alias("weight")))
    part = lambda k: F.regexp_extract("value", r"(?s)^\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(.*?)\s*\]$", k)
    edges = materialize(lines("edges", "edge_id").select("edge_id", part(1).cast("long").alias("src"), part(2).cast("long").alias("dst"), part(3).alias("weight")), "json")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    if not ends.join(ids, "id", "left_anti").isEmpty():
        raise NodeNotFound("an edge names a node that does not exist")
    return PropertyGraph(nodes, typed(edges), kind == "directed")


def edges_of_matrix(lines: DataFrame) -> DataFrame:
    """``src dst`` of the ones in an adjacency matrix given as ``row value``, entries split by white space."""
    cells = lines.select(F.col("row").alias("src"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("dst", "cell"))
    return cells.where("cell = '1'").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
