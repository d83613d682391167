"""Graph views over the tables of an order and event database, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.graph import PropertyGraph
from weft.plans.runtime import materialize, spread

EDGE_SPACE = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def next_in_order(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``column`` of the row that follows in the order of all rows.

    Rows are ranged over tasks and looked up inside each; only the first row of each range meets the others, to serve
    the last row of the range before.
    """
    parted = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("_part").orderBy(*order)
    inside = parted.withColumn(name, F.lead(column).over(own)).withColumn("_last", F.lead(F.lit(1)).over(own).isNull())
    heads = parted.groupBy("_part").agg(F.min(F.struct(*order, column)).alias("h"))
    follow = heads.select((F.col("_part")).alias("_p"), F.col("h")).withColumn("_before", F.lag("_p").over(Window.orderBy("_p")))
    follow = follow.where("_before IS NOT NULL").select(F.col("_before").alias("_part"), F.col(f"h.{column}").alias("_next"))
    joined = inside.join(F.broadcast(follow), "_part", "left")
    return joined.withColumn(name, F.when(F.col("_last"), F.col("_next")).otherwise(F.col(name))).drop("_part", "_last", "_next")


def _with_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select((F.col("src") * EDGE_SPACE + F.col("dst")).alias("edge_id"), "src", "dst", "w")


def handoff(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users linked to the user of the next event, ``w`` times."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    steps = next_in_order(events, ["ts", "event_id"], "user_id", "dst").where("dst IS NOT NULL")
    pairs = steps.groupBy(F.col("user_id").alias("src"), "dst").agg(F.count(F.lit(1)).alias("w"))
    edges = materialize(_with_ids(pairs), "handoff")
    return PropertyGraph(events.select(F.col("user_id").alias("id")).distinct(), edges)


def strong(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Hand-offs that happened at least three times, on the users they link."""
    edges = handoff(spark, sf_dir).edges.where("w >= 3")
    return PropertyGraph.from_edges(edges, True, fill=False)


def linked(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """All hand-offs, on the users they link."""
    return PropertyGraph.from_edges(handoff(spark, sf_dir).edges, True, fill=False)


def strong_dag(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return strong(spark, sf_dir).filter_edges(F.col("src") < F.col("dst"))


def top_next(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each user's most frequent other successor."""
    g = handoff(spark, sf_dir)
    best = g.edges.where("src <> dst").groupBy("src").agg(F.min(F.struct(-F.col("w"), "dst")).alias("m"))
    edges = best.select("src", F.col("m.dst").alias("dst"), (-F.col("m.col1")).alias("w"))
    return PropertyGraph(g.nodes, _with_ids(edges))


def order_chain(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each customer's orders one after another."""
    orders = table(spark, sf_dir, "orders")
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(own).alias("dst"), F.lit(1).cast("long").alias("w")).where("dst IS NOT NULL")
    return PropertyGraph(orders.select(F.col("o_orderkey").alias("id")), _with_ids(edges))


def supplier_part(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Suppliers and the parts they delivered, undirected; parts are numbered from 10^9."""
    lines = table(spark, sf_dir, "lineitem")
    ends = lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"))
    pairs = spread(ends, lines.count(), "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    return PropertyGraph.from_edges(_with_ids(pairs), False, fill=False)


def event_next(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Event types, numbered in alphabetical order, linked to the type of the same user's next event."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    ids = kinds.select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long").alias("id"))
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.select(F.col("event_type").alias("a"), F.lead("event_type").over(own).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    named = steps.join(F.broadcast(ids.withColumnsRenamed({"event_type": "a", "id": "src"})), "a").join(F.broadcast(ids.withColumnsRenamed({"event_type": "b", "id": "dst"})), "b")
    return PropertyGraph(ids.select("id", F.col("event_type").alias("label")), materialize(_with_ids(named), "event-next"))


# The same views for a SQL engine, as common table expressions.
HANDOFF = """h0 AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
handoff AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS w FROM h0 WHERE dst IS NOT NULL GROUP BY src, dst),
hnodes AS (SELECT DISTINCT user_id AS id FROM events)"""
STRONG = HANDOFF + """,
strong AS (SELECT src * 2147483648 + dst AS edge_id, src, dst, w FROM handoff WHERE w >= 3),
snodes AS (SELECT src AS id FROM strong UNION SELECT dst FROM strong),
sboth AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong)"""
LINKED = STRONG.replace(" WHERE w >= 3", "")
TOP = HANDOFF + """,
top_next AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM handoff WHERE src <> dst) WHERE r = 1),
tboth AS (SELECT src, dst FROM top_next UNION SELECT dst, src FROM top_next)"""
CHAIN = """c0 AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
order_chain AS (SELECT src, dst FROM c0 WHERE dst IS NOT NULL)"""
PARTS = """supplier_part AS (SELECT l_suppkey AS src, l_partkey + 1000000000 AS dst, CAST(count(*) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2)"""
EVENTS = """kinds AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)),
e0 AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
event_next AS (SELECT x.id AS src, y.id AS dst, CAST(count(*) AS BIGINT) AS w FROM e0 JOIN kinds x ON a = x.event_type JOIN kinds y ON b = y.event_type GROUP BY 1, 2)"""
