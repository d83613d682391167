"""graph6 strings of undirected simple graphs: upper triangle column by column, six bits a character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import PropertyGraph

MAX_ORDER = 258_047


def encode_graph6(graphs: DataFrame) -> DataFrame:
    """``graph_id g6`` of ``graphs(graph_id, order, src, dst)``, one row per edge (null ends where there is none).

    Loops and repeated edges are ignored.  A graph's bits come from a sequence over its triangle, so the text is built
    without code outside the JVM.
    """
    ends = F.when(F.col("src") != F.col("dst"), F.greatest("src", "dst") * (F.greatest("src", "dst") - 1) / 2 + F.least("src", "dst")).cast("long")
    each = graphs.groupBy("graph_id", "order").agg(F.collect_set(ends).alias("bits"))
    n = F.col("order").cast("long")
    size = (n * (n - 1) / 2).cast("long")
    sixes = F.when(size > 0, F.sequence(F.lit(0).cast("long"), F.ceil(size / 6) - 1)).otherwise(F.array().cast("array<bigint>"))
    bit = [F.lit(1 << (5 - k)) for k in range(6)]
    value = lambda w: sum((F.when(F.array_contains("bits", w * 6 + k), bit[k]).otherwise(0) for k in range(6)), F.lit(0))
    body = F.array_join(F.transform(sixes, lambda w: F.chr(value(w) + 63)), "")
    return each.select("graph_id", F.concat(_order_text(n), body).alias("g6"))


def _order_text(n: Column) -> Column:
    def six(shift: int) -> Column:
        return F.chr(F.shiftright(n, shift).bitwiseAND(63) + 63)

    long_form = F.concat(F.lit("~"), six(12), six(6), six(0))
    return F.when(n < 63, F.chr(n + 63)).when(n <= MAX_ORDER, long_form).otherwise(F.raise_error(F.lit("graph6 order is too large")))


def decode_graph6(texts: DataFrame, column: str = "g6") -> DataFrame:
    """``texts`` with ``order`` and ``edges`` (array of struct src < dst), by column of the triangle."""
    codes = F.transform(F.filter(F.split(column, ""), lambda c: c != ""), lambda c: F.ascii(c) - 63)
    df = texts.withColumn("_codes", codes)
    short = F.get("_codes", 0) < 63
    c = [F.get("_codes", i).cast("long") for i in range(4)]
    df = df.withColumn("order", F.when(short, c[0]).otherwise(c[1] * 4096 + c[2] * 64 + c[3]))
    body = F.slice("_codes", F.when(short, 2).otherwise(5), F.greatest(F.size("_codes"), F.lit(1)))
    bits = F.flatten(F.transform(body, lambda v: F.array(*[F.shiftright(v, 5 - k).bitwiseAND(1) for k in range(6)])))
    at = F.filter(F.transform(bits, lambda b, i: F.when(b == 1, i.cast("long"))), lambda k: k.isNotNull())
    # position k lies in the last column c with c (c - 1) / 2 <= k
    flat = df.withColumn("_at", at).withColumn("edges", F.transform("_at", lambda k: F.struct((k - _column(k) * (_column(k) - 1) / 2).cast("long").alias("src"), _column(k).alias("dst"))))
    return flat.withColumn("edges", F.filter("edges", lambda e: e.dst < F.col("order"))).drop("_codes", "_at")


def _column(k: Column) -> Column:
    return F.floor((F.sqrt(8.0 * k + 1) + 1) / 2).cast("long")


def to_graph6(g: PropertyGraph) -> str:
    """graph6 text of one compact graph."""
    rows = g.edges.select(F.lit(0).alias("graph_id"), F.lit(g.node_count()).alias("order"), "src", "dst")
    if rows.isEmpty():
        rows = g.spark.createDataFrame([(0, g.node_count(), None, None)], "graph_id int, order int, src long, dst long")
    return encode_graph6(rows).first().g6


def from_graph6(spark, text: str) -> PropertyGraph:
    row = decode_graph6(spark.createDataFrame([(text,)], "g6 string")).first()
    edges = spark.createDataFrame([(i, e.src, e.dst) for i, e in enumerate(row.edges)], "edge_id long, src long, dst long")
    return PropertyGraph(spark.range(row.order), edges, False)
