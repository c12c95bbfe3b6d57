"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds: every round is a grouped minimum and
an equi-join, in parts by the number of rows, so no neighbour list is ever collected.  Edges of a hub
never meet in one task: nodes of over ``HUB`` edges are joined by broadcast.  The number of
rounds grows with the logarithm of the node count.  Each half round is written to the shared
scratch folder, so a lost executor costs one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandlake.operators.order import parts_for
from strandlake.plans.scratch import Table, hold

#: A node of more edges is a hub; a table has one in so many edges at most.
HUB = 1 << 17


def _parts(e: DataFrame) -> int:
    """Parts by the rows of a written table, so that a task's memory doesn't grow with it."""
    return parts_for(e.count(), e.sparkSession)


def _least(e: DataFrame) -> DataFrame:
    """``(a, m)``: the least neighbour of every node that has a smaller one; of an edge, ``b`` is the smaller end."""
    return e.repartition(_parts(e), "a").groupBy("a").agg(F.min("b").alias("m"))


def _with_least(e: DataFrame, end: str) -> DataFrame:
    """``e`` with ``m``, the least neighbour of the node at this ``end``, null if none is smaller."""
    low = _least(e).withColumnRenamed("a", "_n")
    join = lambda d, t: d.join(t, F.col(end) == F.col("_n"), "left").drop("_n")
    many = []
    if e.count() > HUB:
        many = e.groupBy(F.col(end).alias("_n")).agg(F.count("*").alias("_c")).where(F.col("_c") > HUB).select("_n").collect()
    if not many:
        return join(e.repartition(_parts(e), end), low)
    hubs = e.sparkSession.createDataFrame(many, StructType([StructField("_n", e.schema[end].dataType)]))
    known = low.join(F.broadcast(hubs), "_n", "left_semi")
    marked = join(e, F.broadcast(hubs.join(known, "_n", "left").withColumn("_hub", F.lit(True))))
    rest = join(marked.where("_hub is null").select("a", "b").repartition(_parts(e), end), low)
    return marked.where("_hub").select("a", "b", "m").unionByName(rest)


def _large_star(e: DataFrame) -> DataFrame:
    # what lies above a node goes to its least neighbour, and stays where there is none below it
    return _with_least(e, "b").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    moved = _with_least(e, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(_least(e).select("a", F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", *, max_rounds: int = 60) -> DataFrame:
    """``(node, comp)`` for every node that has an edge to another; comp is the smallest node.

    Nodes without an edge (and self loops) are left out: their component is themselves.
    Rows with a null end are ignored.
    """
    u, v = F.col(left), F.col(right)
    start = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    start = start.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct()
    table = Table(start, "cc")
    seen = _mark(table.df)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        large = Table(_large_star(table.df), "cc")
        table.drop()
        new = Table(_small_star(large.df), "cc")
        large.drop()
        table, last = new, seen
        seen = _mark(table.df)
        if seen == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    hold(table.spark, table.path)
    stars = table.df
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
