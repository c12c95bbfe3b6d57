"""Scans, look-ups and aggregates over nodes and edges; all take and return tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.dna import oriented
from strandlake.functions.handles import canonical, flip, forward, is_reverse, node_of, pack
from strandlake.operators.order import number_globally, prefix_sum
from strandlake.schema import Graph


def handles(g: Graph) -> DataFrame:
    """Every node as its forward handle."""
    return g.nodes.select(pack("node_id").alias("handle"))


def adjacency(g: Graph) -> DataFrame:
    """Both readings of every edge: ``l`` is followed by ``r``.  An edge that reads alike both ways is one row."""
    e = F.explode(F.when(F.col("l") == flip("r"), F.array(F.struct("l", "r"))).otherwise(F.array(F.struct("l", "r"), F.struct(flip("r").alias("l"), flip("l").alias("r")))))
    return g.edges.select(e.alias("e")).select("e.l", "e.r")


def summary(g: Graph) -> DataFrame:
    """One row of counts: nodes, bases, edges, paths, steps, least and largest live node id (null if none)."""
    nodes = g.nodes.agg(F.count("*").alias("node_count"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("bigint").alias("total_length"), F.min("node_id").alias("min_node_id"), F.max("node_id").alias("max_node_id"))
    counts = (("edge_count", g.edges), ("path_count", g.paths), ("step_count", g.steps))
    return nodes.select("*", *[t.agg(F.count("*")).scalar().alias(name) for name, t in counts])


def has_node(g: Graph, ids: DataFrame, col: str = "node_id") -> DataFrame:
    """``ids`` with ``present``."""
    known = g.nodes.select(F.col("node_id").alias("_n"), F.lit(True).alias("_p"))
    return ids.join(known, ids[col] == known["_n"], "left").select(*ids.columns, F.coalesce("_p", F.lit(False)).alias("present"))


def nodes_of(g: Graph, ids: DataFrame, col: str = "node_id", *, strict: bool = False) -> DataFrame:
    """The node rows of ``ids``; ``strict`` makes a missing one a run-time error."""
    j = ids.join(g.nodes.select(F.col("node_id").alias("_n"), "seq"), F.col(col) == F.col("_n"), "left" if strict else "inner")
    seq = F.when(F.assert_true(F.col("_n").isNotNull(), F.lit("no such node")).isNull(), F.col("seq")) if strict else F.col("seq")
    return j.select(*ids.columns, seq.alias("seq"))


def neighbours(g: Graph, wanted: DataFrame, direction: str = "right", col: str = "handle") -> DataFrame:
    """``(handle, neighbour)``: what follows each handle (right), or what it follows (left)."""
    a, b = ("l", "r") if direction == "right" else ("r", "l")
    adj = adjacency(g).select(F.col(a).alias(col), F.col(b).alias("neighbour"))
    return wanted.select(col).distinct().join(adj, col)


def degrees(g: Graph) -> DataFrame:
    """``(node_id, right_degree, left_degree)`` of the forward handle of every node, 0 where it has none.

    The right degree of a handle counts rows of the adjacency that start with it; its left
    degree is the right degree of the flipped handle, so one grouped count serves both.
    """
    n = adjacency(g).groupBy(node_of("l").alias("node_id")).agg(
        F.count(F.when(~is_reverse("l"), 1)).alias("right_degree"), F.count(F.when(is_reverse("l"), 1)).alias("left_degree")
    )
    zero = F.lit(0)
    return g.nodes.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("right_degree", zero).cast("bigint").alias("right_degree"), F.coalesce("left_degree", zero).cast("bigint").alias("left_degree"))


def degree(g: Graph, wanted: DataFrame, direction: str = "right", col: str = "handle") -> DataFrame:
    """``wanted`` with ``degree``, for handles of either orientation."""
    d = degrees(g).select(F.col("node_id").alias("_n"), "right_degree", "left_degree")
    j = wanted.join(d, node_of(F.col(col)) == F.col("_n"), "left")
    straight = is_reverse(col) == F.lit(direction == "left")
    return j.select(*wanted.columns, F.coalesce(F.when(straight, F.col("right_degree")).otherwise(F.col("left_degree")), F.lit(0)).alias("degree"))


def has_edge(g: Graph, pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """``pairs`` with ``present``."""
    e = g.edges.select(F.col("l").alias("_l"), F.col("r").alias("_r"), F.lit(True).alias("_p"))
    d = pairs.withColumn("_e", canonical(left, right))
    j = d.join(e, (F.col("_e.l") == F.col("_l")) & (F.col("_e.r") == F.col("_r")), "left")
    return j.select(*pairs.columns, F.coalesce("_p", F.lit(False)).alias("present"))


def sequences(g: Graph, wanted: DataFrame, col: str = "handle") -> DataFrame:
    """``wanted`` with ``seq`` as the handle reads it; handles without a node are left out."""
    n = g.nodes.select(F.col("node_id").alias("_n"), F.col("seq").alias("_s"))
    return wanted.join(n, node_of(F.col(col)) == F.col("_n")).select(*wanted.columns, oriented("_s", is_reverse(col)).alias("seq"))


def subsequences(g: Graph, wanted: DataFrame, start: str, length: str, col: str = "handle") -> DataFrame:
    """``wanted`` with ``sub``: ``length`` bases from 0-based ``start``, less at the end."""
    s = sequences(g, wanted, col)
    return s.withColumn("sub", F.substring(F.col("seq"), F.col(start) + 1, F.col(length))).drop("seq")


def bases(g: Graph, wanted: DataFrame, index: str, col: str = "handle") -> DataFrame:
    """``wanted`` with ``base`` at the 0-based index, null outside."""
    s = sequences(g, wanted, col)
    i = F.col(index)
    return s.withColumn("base", F.when((i >= 0) & (i < F.length("seq")), F.substring(F.col("seq"), i + 1, F.lit(1)))).drop("seq")


def layout(g: Graph) -> DataFrame:
    """``(node_id, start, len)``: where each sequence lies if all are put together in id order.

    Two phases: numbers by range partitions, then a blocked prefix sum, so no task sees all rows.
    """
    n = number_globally(g.nodes.select("node_id", F.length("seq").cast("bigint").alias("len")), [F.col("node_id")], "rank")
    d = prefix_sum(n.withColumn("_g", F.lit(0)), ["_g"], "rank", F.col("len"), "start")
    return d.select("node_id", "start", "len")


def layout_ends(g: Graph, wanted: DataFrame, col: str = "handle") -> DataFrame:
    """``wanted`` with the layout coordinates where the oriented handle starts and ends."""
    n = layout(g).select(F.col("node_id").alias("_n"), F.col("start").alias("_a"), (F.col("start") + F.col("len")).alias("_z"))
    rev = is_reverse(col)
    return wanted.join(n, node_of(F.col(col)) == F.col("_n")).select(*wanted.columns, F.when(rev, F.col("_z")).otherwise(F.col("_a")).alias("start_in_layout"), F.when(rev, F.col("_a")).otherwise(F.col("_z")).alias("end_in_layout"))


def dangling_edges(g: Graph) -> DataFrame:
    """Edges with an end that is no node, and that end."""
    ends = g.edges.select("l", "r", F.explode(F.array("l", "r")).alias("handle"))
    known = g.nodes.select(F.col("node_id").alias("_n"))
    return ends.join(known, node_of(F.col("handle")) == F.col("_n"), "left_anti").select("l", "r", forward("handle").alias("missing")).distinct()
