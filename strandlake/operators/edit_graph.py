"""Edits of nodes and edges in sets: each takes a graph and tables and returns a new graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.dna import reverse_complement
from strandlake.functions.handles import ID_LIMIT, canonical_edges, is_reverse, node_of, pack
from strandlake.operators.order import number_globally, rank_rows
from strandlake.schema import Graph, empty


def _max_id(table: DataFrame, col: str) -> int:
    return table.agg(F.max(col)).first()[0] or 0


def append_nodes(g: Graph, seqs: DataFrame, *order: str) -> Graph:
    """Add a node per row of ``seqs`` (seq), numbered on from the largest id in the given order."""
    new = number_globally(seqs, [F.col(c) for c in order or seqs.columns], "node_id", _max_id(g.nodes, "node_id") + 1)
    return create_nodes(g, new.select("node_id", "seq"), check=False)


def create_nodes(g: Graph, new: DataFrame, *, check: bool = True) -> Graph:
    """Add nodes with the given ids; a bad or known id or an empty sequence is a run-time error."""
    ok = F.assert_true((F.col("node_id") > 0) & (F.col("node_id") < ID_LIMIT) & (F.length("seq") > 0), F.lit("bad node"))
    new = new.where(ok.isNull())
    if check:
        counted = g.nodes.select("node_id", "seq").unionByName(new).groupBy("node_id").agg(F.min("seq").alias("seq"), F.count("*").alias("_n"))
        return g.having(nodes=counted.where(F.assert_true(F.col("_n") == 1, F.lit("node id in use")).isNull()).select("node_id", "seq"))
    return g.having(nodes=g.nodes.unionByName(new))


def create_edges(g: Graph, pairs: DataFrame, left: str = "l", right: str = "r") -> Graph:
    """Add edges; known ones, and the other reading of a known one, change nothing."""
    return g.having(edges=g.edges.unionByName(canonical_edges(pairs, left, right)).distinct())


def clear(g: Graph) -> Graph:
    return empty(g.nodes.sparkSession)


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Remove nodes, their edges, and every path that visits one of them."""
    gone = ids.select(F.col("node_id").alias("_n")).distinct()
    hit = g.steps.join(gone, node_of(F.col("handle")) == F.col("_n"), "left_semi").select("path_id").distinct()
    edges = g.edges.join(gone, node_of(F.col("l")) == F.col("_n"), "left_anti").join(gone, node_of(F.col("r")) == F.col("_n"), "left_anti")
    return Graph(g.nodes.join(gone, F.col("node_id") == F.col("_n"), "left_anti"), edges, g.paths.join(hit, "path_id", "left_anti"), g.steps.join(hit, "path_id", "left_anti"))


def remove_edges(g: Graph, pairs: DataFrame, left: str = "l", right: str = "r") -> Graph:
    """Remove edges given in either reading; unknown ones change nothing."""
    return g.having(edges=g.edges.join(canonical_edges(pairs, left, right), ["l", "r"], "left_anti"))


def divide_nodes(g: Graph, cuts: DataFrame) -> Graph:
    """Cut nodes at the offsets of ``cuts`` (node_id, offset), strictly inside their sequences.

    The first piece keeps the id; the others get new ids, in order of node and offset.  Pieces
    are chained by edges, edges at the node's end move to its last piece, and every step becomes
    the chain of pieces, in the step's orientation.  A path's steps are numbered anew.
    """
    c = cuts.select("node_id", F.col("offset").cast("int").alias("offset")).distinct().join(g.nodes, "node_id")
    c = c.where((F.col("offset") > 0) & (F.col("offset") < F.length("seq")))
    lists = c.groupBy("node_id").agg(F.array_sort(F.collect_set("offset")).alias("at"), F.min("seq").alias("seq"))
    pieces = lists.select("node_id", "seq", F.posexplode(F.concat(F.array(F.lit(0)), "at")).alias("k", "begin"), F.concat("at", F.array(F.length("seq"))).alias("ends"))
    pieces = pieces.select("node_id", "k", F.expr("substring(seq, begin + 1, ends[k] - begin)").alias("seq"))
    later = number_globally(pieces.where("k > 0"), [F.col("node_id"), F.col("k")], "piece_id", _max_id(g.nodes, "node_id") + 1)
    pieces = later.unionByName(pieces.where("k = 0").withColumn("piece_id", F.col("node_id")))
    chain = pieces.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece_id"))), lambda x: x["piece_id"]).alias("chain"))
    chain = chain.select(F.col("node_id").alias("_n"), "chain", F.element_at("chain", -1).alias("last"))

    nodes = g.nodes.join(chain, F.col("node_id") == F.col("_n"), "left_anti").unionByName(pieces.select(F.col("piece_id").alias("node_id"), "seq"))
    edges = g.edges
    for col, reverse_is_end in (("l", False), ("r", True)):  # the node's end: left of an edge if forward, right of one if reverse
        at_end = is_reverse(col) if reverse_is_end else ~is_reverse(col)
        j = edges.join(chain.select("_n", "last"), node_of(F.col(col)) == F.col("_n"), "left")
        moved = F.when(F.col("last").isNotNull() & at_end, pack("last", is_reverse(col))).otherwise(F.col(col))
        edges = j.withColumn(col, moved).select("l", "r")
    links = chain.select(F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("a"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("b"))).alias("x"))
    links = links.select(pack("x.a").alias("l"), pack("x.b").alias("r"))

    s = g.steps.join(chain, node_of(F.col("handle")) == F.col("_n"), "left")
    order = F.when(is_reverse("handle"), F.reverse("chain")).otherwise(F.col("chain"))
    s = s.select("path_id", "ord", "step_id", "handle", F.posexplode(F.coalesce(order, F.array(node_of("handle")))).alias("k", "piece"))
    s = rank_rows(s, ["path_id"], [F.col("ord"), F.col("k")], "new_ord")
    steps = s.select("path_id", F.col("new_ord").alias("ord"), F.col("new_ord").alias("step_id"), pack("piece", is_reverse("handle")).alias("handle"))
    return Graph(nodes, canonical_edges(edges.unionByName(links)), g.paths, steps)


def reorient(g: Graph, ids: DataFrame) -> Graph:
    """Turn nodes over: their sequence is reverse-complemented and every handle of theirs flips."""
    turn = ids.select(F.col("node_id").alias("_n")).distinct().withColumn("_t", F.lit(1).cast("bigint"))

    def flipped(df: DataFrame, col: str) -> DataFrame:
        j = df.join(turn, node_of(F.col(col)) == F.col("_n"), "left")
        return j.withColumn(col, F.col(col).bitwiseXOR(F.coalesce("_t", F.lit(0).cast("bigint")))).select(*df.columns)

    n = g.nodes.join(turn, F.col("node_id") == F.col("_n"), "left")
    nodes = n.select("node_id", F.when(F.col("_t").isNotNull(), reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"))
    return Graph(nodes, canonical_edges(flipped(flipped(g.edges, "l"), "r")), g.paths, flipped(g.steps, "handle"))


def relabel(g: Graph, mapping: DataFrame) -> Graph:
    """Give nodes other ids: ``mapping`` (old_id, new_id); nodes that it lacks keep theirs."""
    m = mapping.select(F.col("old_id").alias("_o"), F.col("new_id").cast("bigint").alias("_w"))

    def moved(df: DataFrame, col: str) -> DataFrame:
        j = df.join(m, node_of(F.col(col)) == F.col("_o"), "left")
        return j.withColumn(col, F.coalesce(pack("_w", is_reverse(col)), F.col(col))).select(*df.columns)

    n = g.nodes.join(m, F.col("node_id") == F.col("_o"), "left")
    nodes = n.select(F.coalesce("_w", "node_id").alias("node_id"), "seq")
    return Graph(nodes, canonical_edges(moved(moved(g.edges, "l"), "r")), g.paths, moved(g.steps, "handle"))


def apply_ordering(g: Graph, order: DataFrame) -> Graph:
    """Permute ids: the node whose id is the i-th in ascending order gets the i-th id of ``order`` (rank from 1, node_id)."""
    ranked = number_globally(g.nodes.select(F.col("node_id").alias("old_id")), [F.col("old_id")], "rank")
    return relabel(g, ranked.join(order.select("rank", F.col("node_id").alias("new_id")), "rank"))


def compact_ids(g: Graph) -> Graph:
    """Ids 1 to n: nodes with edges first, by the place of their first edge in (l, r) order, then the others by id."""
    e = number_globally(g.edges, [F.col("l"), F.col("r")], "place")
    ends = e.select(F.posexplode(F.array(node_of("l"), node_of("r"))).alias("side", "node_id"), "place")
    first = ends.groupBy("node_id").agg(F.min(2 * F.col("place") + F.col("side")).alias("first"))
    d = g.nodes.select("node_id").join(first, "node_id", "left")
    d = number_globally(d, [F.col("first").asc_nulls_last(), F.col("node_id")], "new_id")
    return relabel(g, d.select(F.col("node_id").alias("old_id"), "new_id"))


def defragment(g: Graph) -> Graph:
    """Path ids 1 to n in their order, and every path's step ids 1 to m in the order of the old step ids."""
    p = number_globally(g.paths.select("path_id"), [F.col("path_id")], "new_path")
    paths = g.paths.join(p, "path_id").select(F.col("new_path").alias("path_id"), "name", "circular")
    s = rank_rows(g.steps, ["path_id"], [F.col("step_id")], "new_step").join(p, "path_id")
    return g.having(paths=paths, steps=s.select(F.col("new_path").alias("path_id"), "ord", F.col("new_step").alias("step_id"), "handle"))
