"""Graph text files (GFA 1.0): tab-separated S, L and P records.

Header lines, tags, overlaps, and all other records are ignored; lines may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.handles import canonical_edges, is_reverse, node_of, pack
from strandlake.operators.order import number_globally, rank_rows
from strandlake.schema import Graph


def parse_lines(lines: DataFrame, col: str = "value") -> Graph:
    """The graph of a table of lines.  Paths are numbered from 0 by name; one name twice is an error."""
    f = lines.select(F.split(F.regexp_replace(F.col(col), "\r$", ""), "\t").alias("f"))
    s = f.where(F.get("f", F.lit(0)) == "S").select(F.get("f", F.lit(1)).try_cast("bigint").alias("node_id"), F.get("f", F.lit(2)).alias("seq"))
    nodes = s.where(F.assert_true(F.col("node_id") > 0, F.lit("segment names must be positive integers")).isNull())
    e = f.where(F.get("f", F.lit(0)) == "L").select(pack(F.get("f", F.lit(1)).try_cast("bigint"), F.get("f", F.lit(2)) == "-").alias("l"), pack(F.get("f", F.lit(3)).try_cast("bigint"), F.get("f", F.lit(4)) == "-").alias("r"))
    p = f.where(F.get("f", F.lit(0)) == "P").select(F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("walk"))
    once = p.groupBy("name").agg(F.count("*").alias("n"))
    once = once.where(F.assert_true(F.col("n") == 1, F.lit("path name used twice")).isNull()).select("name")
    ids = number_globally(once, [F.col("name")], "path_id", 0)
    paths = ids.select("path_id", "name", F.lit(False).alias("circular"))
    steps = p.join(ids, "name").select("path_id", F.posexplode(F.split(F.regexp_replace("walk", ",$", ""), ",")).alias("k", "s")).where("s != ''")
    steps = steps.select("path_id", (F.col("k") + 1).cast("bigint").alias("ord"), (F.col("k") + 1).cast("bigint").alias("step_id"), pack(F.expr("try_cast(substring(s, 1, length(s) - 1) AS bigint)"), F.col("s").endswith("-")).alias("handle"))
    return Graph(nodes, canonical_edges(e), paths, steps)


def read_gfa(spark: SparkSession, path: str) -> Graph:
    return parse_lines(spark.read.text(path))


def _signed(handle: str):
    return F.concat(node_of(handle).cast("string"), F.when(is_reverse(handle), "-").otherwise("+"))


def gfa_lines(g: Graph) -> DataFrame:
    """``(kind, k1, k2, line)``: all lines with their sort keys, in the order header, segments, links, paths."""
    sign = lambda c: F.when(is_reverse(c), "-").otherwise("+")
    zero = F.lit(0).cast("bigint")
    head = g.nodes.sparkSession.range(1).select(F.lit(0).alias("kind"), zero.alias("k1"), zero.alias("k2"), F.lit("H\tVN:Z:1.0").alias("line"))
    s = g.nodes.select(F.lit(1), F.col("node_id"), zero, F.concat_ws("\t", F.lit("S"), "node_id", "seq"))
    e = g.edges.select(F.lit(2), "l", "r", F.concat_ws("\t", F.lit("L"), node_of("l").cast("string"), sign("l"), node_of("r").cast("string"), sign("r"), F.lit("0M")))
    walk = g.steps.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", _signed("handle").alias("s")))), lambda x: x["s"]), ",").alias("walk"))
    p = g.paths.join(walk, "path_id", "left").select(F.lit(3), "path_id", zero, F.concat_ws("\t", F.lit("P"), "name", F.coalesce("walk", F.lit("")), F.lit("*")))
    return head.union(s).union(e).union(p)


def write_gfa(g: Graph, path: str) -> None:
    """One text file per range partition; put together in name order they are one file."""
    gfa_lines(g).orderBy("kind", "k1", "k2").select("line").write.text(path)


def read_tables(spark: SparkSession, folder: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{folder}/{t}") for t in ("nodes", "edges", "paths", "steps")))


def write_tables(g: Graph, folder: str) -> None:
    for t in ("nodes", "edges", "paths", "steps"):
        getattr(g, t).write.parquet(f"{folder}/{t}")


def golden_rows(g: Graph) -> DataFrame:
    """Rows as text: nodes with sorted neighbour handles, paths with their handles, occurrences."""
    from strandlake.operators.scan import adjacency

    adj = adjacency(g)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    right = adj.where(~is_reverse("l")).groupBy(node_of("l").alias("node_id")).agg(joined("r").alias("right"))
    left = adj.where(~is_reverse("r")).groupBy(node_of("r").alias("node_id")).agg(joined("l").alias("left"))
    none = F.lit("")
    n = g.nodes.join(left, "node_id", "left").join(right, "node_id", "left").select(F.lit("node").alias("kind"), F.concat_ws("\t", "node_id", "seq", F.coalesce("left", none), F.coalesce("right", none)).alias("row"))
    walk = g.steps.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "handle"))), lambda x: x["handle"].cast("string")), ",").alias("walk"))
    p = g.paths.join(walk, "path_id", "left").select(F.lit("path"), F.concat_ws("\t", "name", F.coalesce("walk", none)))
    o = rank_rows(g.steps, ["path_id"], [F.col("ord")], "k").join(g.paths, "path_id").select(F.lit("occurrence"), F.concat_ws("\t", node_of("handle").cast("string"), "name", F.col("k").cast("string")))
    return n.union(p).union(o)
