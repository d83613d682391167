"""DOT text: writing graphs and reading them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.order import escape_label
from weft.graph import PropertyGraph


class DotError(ValueError):
    """The text is no graph."""


def dot_lines(
    g: PropertyGraph,
    node_label: Column | None = None,
    edge_label: Column | None = None,
    node_attributes: Column | None = None,
    edge_attributes: Column | None = None,
    index_labels: bool = False,
    content_only: bool = False,
    rank_dir: str | None = None,
) -> DataFrame:
    """``section key line`` of the DOT text, ordered by section and key; labels are string columns of nodes and edges.

    Without a label an element has none (or, with ``index_labels``, its id); attributes are added as given.
    """
    if rank_dir not in (None, "TB", "BT", "LR", "RL"):
        raise ValueError("rank_dir is TB, BT, LR or RL")
    spark, arrow = g.spark, " -> " if g.directed else " -- "

    def tail(label: Column | None, own: Column, more: Column | None) -> Column:
        text = F.concat(F.lit('label = "'), escape_label(label.cast("string")), F.lit('" ')) if label is not None else F.concat(F.lit('label = "'), own.cast("string"), F.lit('" ')) if index_labels else F.lit("")
        return F.concat(F.lit(" [ "), text, F.lit("") if more is None else F.concat(more, F.lit(" ")), F.lit("]"))

    nodes = g.nodes.select(F.lit(1).alias("section"), F.col("id").alias("key"), F.concat(F.lit("    "), F.col("id").cast("string"), tail(node_label, F.col("id"), node_attributes)).alias("line"))
    ends = F.concat(F.lit("    "), F.col("src").cast("string"), F.lit(arrow), F.col("dst").cast("string"))
    edges = g.edges.select(F.lit(2).alias("section"), F.col("edge_id").alias("key"), F.concat(ends, tail(edge_label, F.col("edge_id"), edge_attributes)).alias("line"))
    out = nodes.unionByName(edges)
    if not content_only:
        head = [(0, 0, ("digraph" if g.directed else "graph") + " {")] + ([(0, 1, f'    rankdir="{rank_dir}"')] if rank_dir else [])
        out = out.unionByName(spark.createDataFrame([*head, (3, 0, "}")], "section int, key long, line string"))
    return out


def write_dot(lines: DataFrame, path: str) -> None:
    """Write the lines in order; parts of the folder follow one another."""
    lines.orderBy("section", "key").select("line").write.text(path)


_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|#[^\n]*|("(?:\\.|[^"\\])*"|-?(?:\.\d+|\d+(?:\.\d*)?)|[A-Za-z_\x80-\uffff][\w\x80-\uffff]*|->|--|[{}\[\]=;,:])', re.DOTALL)


DEEPEST = 200


def parse_dot(text: str) -> tuple[bool, list[tuple[str, dict[str, str]]], list[tuple[str, str, dict[str, str]]]]:
    """(directed, nodes, edges) with their attributes; nodes in order of appearance.  A subgraph opens a scope;
    as an end of an edge it stands for each of its nodes."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DotError(f"unexpected {text[at]!r}")
        if m[1]:
            tokens.append(m[1])
        at = m.end()
    at = 0

    def peek(k: int = 0) -> str:
        return tokens[at + k] if at + k < len(tokens) else ""

    def take(expected: str | None = None) -> str:
        nonlocal at
        if not peek() or (expected and peek() != expected):
            raise DotError(f"expected {expected or 'more'}, found {peek()!r}")
        at += 1
        return tokens[at - 1]

    def name(raw: str) -> str:
        return re.sub(r'\\(["\\])', r"\1", raw[1:-1]) if raw[:1] == '"' else raw

    def attributes() -> dict[str, str]:
        out: dict[str, str] = {}
        while peek() == "[":
            take()
            while peek() != "]":
                key = name(take())
                out[key] = name(take()) if peek() == "=" and take() else "true"
                if peek() in (",", ";"):
                    take()
            take("]")
        return out

    if peek().lower() == "strict":
        take()
    kind = take().lower()
    if kind not in ("graph", "digraph"):
        raise DotError("a graph starts with graph or digraph")
    directed, nodes, edges = kind == "digraph", {}, []
    if peek() != "{":
        take()
    take("{")

    def operand(scope: tuple[dict, dict], depth: int) -> tuple[list[str], bool]:
        """Names of one end of an edge, and whether it is a single node: a node, or a subgraph and so all nodes in it."""
        if peek().lower() == "subgraph":
            take()
            if peek() != "{":
                take()
        if peek() == "{":
            take()
            return block((dict(scope[0]), dict(scope[1])), depth + 1), False
        if peek() in ("->", "--", "}", "[", "]", "=", ":", ";", ","):
            raise DotError(f"expected a node, found {peek()!r}")
        one = name(take())
        while peek() == ":":
            take()
            take()
        nodes.setdefault(one, dict(scope[0]))
        return [one], True

    def block(scope: tuple[dict, dict], depth: int) -> list[str]:
        """Statements up to the closing brace; the names in them, each once."""
        if depth > DEEPEST:
            raise DotError(f"subgraphs are nested deeper than {DEEPEST}")
        held: dict[str, None] = {}
        while peek() != "}":
            token = peek()
            if token in (";", ","):
                take()
            elif token.lower() in ("node", "edge", "graph") and peek(1) == "[":
                take()
                own = attributes()
                if token.lower() != "graph":
                    scope[token.lower() == "edge"].update(own)
            elif peek(1) == "=":
                take()
                take()
                take()
            else:
                chain = [operand(scope, depth)]
                while peek() in ("->", "--"):
                    if (take() == "->") != directed:
                        raise DotError("an arrow of the other kind")
                    chain.append(operand(scope, depth))
                own = attributes()
                held.update(dict.fromkeys(n for group, _ in chain for n in group))
                if len(chain) == 1 and chain[0][1]:
                    nodes[chain[0][0][0]].update(own)
                edges.extend((x, y, {**scope[1], **own}) for (left, _), (right, _) in zip(chain, chain[1:], strict=False) for x in left for y in right)
        take("}")
        return list(held)

    block(({}, {}), 0)
    if at != len(tokens):
        raise DotError("text after the graph")
    return directed, list(nodes.items()), edges


def graph_from_dot(spark: SparkSession, text: str) -> PropertyGraph:
    """Graph of one DOT text: nodes with ``name`` and ``attrs``, edges with ``attrs``."""
    directed, nodes, edges = parse_dot(text)
    ids = {n: i for i, (n, _) in enumerate(nodes)}
    return PropertyGraph(
        spark.createDataFrame([(ids[n], n, a) for n, a in nodes], "id long, name string, attrs map<string,string>"),
        spark.createDataFrame([(i, ids[a], ids[b], x) for i, (a, b, x) in enumerate(edges)], "edge_id long, src long, dst long, attrs map<string,string>"),
        directed,
    )


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """``path directed nodes edges`` of every DOT file below ``path``, parsed in parallel; a bad file raises."""
    schema = "path string, directed boolean, nodes array<struct<name:string,attrs:map<string,string>>>, edges array<struct<src:string,dst:string,attrs:map<string,string>>>"
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [(p, *parse_dot(v)) for p, v in zip(frame.path, frame.value, strict=True)]
            yield pd.DataFrame(
                [(p, d, [{"name": n, "attrs": list(a.items())} for n, a in ns], [{"src": s, "dst": t, "attrs": list(a.items())} for s, t, a in es]) for p, d, ns, es in rows],
                columns=["path", "directed", "nodes", "edges"],
            )

    return files.mapInPandas(run, schema)
