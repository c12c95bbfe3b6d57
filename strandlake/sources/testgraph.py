"""Graphs derived from the relational tables that the tests and benchmarks use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.handles import canonical, pack
from strandlake.operators.order import parts_for
from strandlake.schema import Graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_edges(nodes: DataFrame, paths: DataFrame, visits: DataFrame, order: list[Column], rows: int) -> Graph:
    """The graph of ``rows`` visits (path_id, handle and the order's columns), and the edges that they walk.

    Numbers and next handles come from one sort, and parts from the number of rows, so a task's memory doesn't grow.
    Most edges are walked once, so they are dealt out before repeats go.
    """
    n = parts_for(rows, visits.sparkSession)
    w = Window.partitionBy("path_id").orderBy(*order)
    s = visits.repartition(n, "path_id").withColumns({"ord": F.row_number().over(w).cast("bigint"), "next": F.lead("handle").over(w)})
    edges = s.where("next is not null").select(canonical("handle", "next").alias("e")).select("e.l", "e.r").repartition(n, "l", "r").distinct()
    return Graph(nodes, edges, paths, s.select("path_id", "ord", F.col("ord").alias("step_id"), "handle"))


def dense(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts are nodes, orders are paths, line items are steps; every part has many neighbours."""
    seq = F.expr("substr(translate(md5(cast(p_partkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 1 + p_size % 32)")
    nodes = _table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("node_id"), seq.alias("seq"))
    o = _table(spark, sf_dir, "orders")
    paths = o.select(F.col("o_orderkey").alias("path_id"), F.concat(F.lit("order#"), "o_orderkey").alias("name"), (F.col("o_orderstatus") == "P").alias("circular"))
    li = _table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")]
    visits = li.select(F.col("l_orderkey").alias("path_id"), *order, pack(F.col("l_partkey") + 1, F.col("l_linestatus") == "F").alias("handle"))
    return _with_edges(nodes, paths, visits, order, li.count())


def chains(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders are nodes between nation and segment hubs, customers are paths; interior runs merge."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    seq = F.expr("substr(translate(md5(cast(o_orderkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 4)")
    segment = F.array_position(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("c_mktsegment")).cast("bigint")
    nodes = o.select((F.col("o_orderkey") + 101).alias("node_id"), seq.alias("seq"))
    nodes = nodes.unionByName(n.select((F.col("n_nationkey").cast("bigint") + 1).alias("node_id"), F.lit("A").alias("seq")))
    nodes = nodes.unionByName(c.select((segment + 50).alias("node_id"), F.lit("C").alias("seq")).distinct())
    paths = c.select(F.col("c_custkey").alias("path_id"), F.concat(F.lit("customer#"), "c_custkey").alias("name"), F.lit(False).alias("circular"))
    first = c.select(F.col("c_custkey").alias("path_id"), F.lit(0).alias("side"), F.lit(None).cast("timestamp").alias("t"), F.lit(0).cast("bigint").alias("k"), pack(F.col("c_nationkey").cast("bigint") + 1).alias("handle"))
    last = c.select(F.col("c_custkey").alias("path_id"), F.lit(2).alias("side"), F.lit(None).cast("timestamp").alias("t"), F.lit(0).cast("bigint").alias("k"), pack(segment + 50).alias("handle"))
    inner = o.select(F.col("o_custkey").alias("path_id"), F.lit(1).alias("side"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("k"), pack(F.col("o_orderkey") + 101).alias("handle"))
    visits = first.unionByName(inner).unionByName(last)
    return _with_edges(nodes, paths, visits, [F.col("side"), F.col("t"), F.col("k")], o.count() + 2 * c.count())


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

#: The same graphs in SQL.
DENSE_SQL = """
nodes AS (SELECT CAST(p_partkey + 1 AS BIGINT) AS node_id,
  substr(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 1 + p_size % 32) AS seq FROM part),
paths AS (SELECT o_orderkey AS path_id, 'order#' || o_orderkey AS name, o_orderstatus = 'P' AS circular FROM orders),
steps AS (SELECT l_orderkey AS path_id, ord, ord AS step_id, 2 * (l_partkey + 1) + CAST(l_linestatus = 'F' AS BIGINT) AS handle FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS ord FROM lineitem)),
"""
CHAINS_SQL = """
seg AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 ELSE 0 END AS s FROM customer),
nodes AS (SELECT o_orderkey + 101 AS node_id, substr(translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 4) AS seq FROM orders
  UNION ALL SELECT CAST(n_nationkey + 1 AS BIGINT), 'A' FROM nation UNION ALL SELECT DISTINCT CAST(s + 50 AS BIGINT), 'C' FROM seg),
paths AS (SELECT c_custkey AS path_id, 'customer#' || c_custkey AS name, false AS circular FROM customer),
raw AS (SELECT c_custkey AS path_id, 0 AS side, NULL::TIMESTAMP AS t, 0 AS k, CAST(2 * (c_nationkey + 1) AS BIGINT) AS handle FROM seg
  UNION ALL SELECT c_custkey, 2, NULL, 0, CAST(2 * (s + 50) AS BIGINT) FROM seg
  UNION ALL SELECT o_custkey, 1, o_orderdate, o_orderkey, 2 * (o_orderkey + 101) FROM orders),
steps AS (SELECT path_id, ord, ord AS step_id, handle FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY side, t, k) AS ord FROM raw)),
"""
EDGES_SQL = """
links AS (SELECT path_id, ord, handle AS a, lead(handle) OVER (PARTITION BY path_id ORDER BY ord) AS b FROM steps),
edges AS (SELECT DISTINCT CASE WHEN a > xor(b, 1::BIGINT) THEN xor(b, 1::BIGINT) ELSE a END AS l,
  CASE WHEN a > xor(b, 1::BIGINT) THEN xor(a, 1::BIGINT) ELSE b END AS r FROM links WHERE b IS NOT NULL),
adj AS (SELECT l, r FROM edges UNION SELECT xor(r, 1::BIGINT), xor(l, 1::BIGINT) FROM edges)
"""


def dense_sql(query: str, more: str = "") -> str:
    return f"WITH {DENSE_SQL}{EDGES_SQL}{', ' + more if more else ''} {query}"


def chains_sql(query: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{CHAINS_SQL}{EDGES_SQL}{', ' + more if more else ''} {query}"
