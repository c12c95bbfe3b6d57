"""Perfect neighbours, simple components, concatenation of runs, and unchopping.

A run is a chain of nodes joined by edges that nothing else shares and that every path follows
through.  So a path that visits a node of a run walks all of it, and windows over paths find the
runs.  Those that no path visits are found on oriented nodes by pointer doubling: every link is
one row, each round joins the links with themselves, and the number of rounds is the logarithm
of the longest run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.dna import oriented
from strandlake.functions.handles import canonical, canonical_edges, flip, is_reverse, node_of, pack
from strandlake.operators.components import connected_components
from strandlake.operators.edit_graph import apply_ordering
from strandlake.operators.order import neighbours, number_globally, rank_rows
from strandlake.operators.paths import with_next_handle
from strandlake.operators.scan import adjacency
from strandlake.plans.scratch import Table, hold, materialize
from strandlake.schema import Graph


def components(g: Graph) -> DataFrame:
    """``(node_id, component)``: the smallest node id that edges lead to, for every node."""
    e = g.edges.select(node_of("l").alias("u"), node_of("r").alias("v"))
    c = connected_components(e).withColumnRenamed("node", "node_id")
    return g.nodes.select("node_id").join(c, "node_id", "left").select("node_id", F.coalesce("comp", "node_id").alias("component"))


def _fixed(g: Graph) -> Graph:
    """``g`` with steps and edges that are made once, for those who read them again and again."""
    return g.having(edges=materialize(g.edges, "edges"), steps=materialize(g.steps, "steps"))


def perfect_pairs(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """Canonical pairs (l, r) with ``perfect``: every path that visits either node goes from one to the other.

    Of all edges, or of ``pairs``.  Pairs of a node with itself are never perfect; pairs that no
    path visits are.
    """
    return _judged(g, (g.edges if pairs is None else canonical_edges(pairs)).select("l", "r")).drop("visited")


def _judged(g: Graph, e: DataFrame) -> DataFrame:
    """The canonical pairs ``e`` with ``perfect`` and ``visited``, whether a path goes from one to the other."""
    visits = g.steps.groupBy(node_of("handle").alias("n")).agg(F.count("*").alias("c"))
    seen = with_next_handle(g.steps).select(canonical("handle", "next_handle").alias("e")).groupBy("e.l", "e.r").agg(F.count("*").alias("both"))
    a = visits.select(F.col("n").alias("_a"), F.col("c").alias("ca"))
    b = visits.select(F.col("n").alias("_b"), F.col("c").alias("cb"))
    j = e.join(seen, ["l", "r"], "left").join(a, node_of(F.col("l")) == F.col("_a"), "left").join(b, node_of(F.col("r")) == F.col("_b"), "left")
    zero = F.lit(0)
    both, ca, cb = (F.coalesce(c, zero) for c in ("both", "ca", "cb"))
    return j.select("l", "r", ((node_of("l") != node_of("r")) & (ca == both) & (cb == both)).alias("perfect"), (both > 0).alias("visited"))


def run_links(g: Graph) -> DataFrame:
    """Canonical edges (l, r) along which runs go on: the only edge on either side, and perfect; with ``visited``."""
    adj = adjacency(g)
    out = adj.groupBy("l").agg(F.count("*").alias("out_degree"))
    into = adj.groupBy("r").agg(F.count("*").alias("in_degree"))
    e = _judged(g, g.edges.select("l", "r")).where("perfect")
    return e.join(out, "l").where("out_degree = 1").join(into, "r").where("in_degree = 1").select("l", "r", "visited")


def simple_components(g: Graph, min_size: int = 2) -> DataFrame:
    """``(run_id, rank, handle)``: runs of at least ``min_size`` nodes, ranked from 1.

    A run is read so that its smallest node is forward; a cycle is cut before that node; run_id
    is the smallest node id.  With ``min_size`` 1 single nodes are runs, too.
    """
    return _runs(_fixed(g), min_size)


def _runs(g: Graph, min_size: int) -> DataFrame:
    links = materialize(run_links(g), "links")
    out = _walked(g.steps, links.where("visited")).where(F.col("size") >= min_size).drop("size")
    apart = links.where("not visited").select("l", "r")
    if not apart.isEmpty():
        out = out.unionByName(_doubled(apart).where(F.col("size") >= min_size).drop("size"))
    if min_size <= 1:
        out = materialize(out, "runs")
        alone = g.nodes.select("node_id").join(out.select(node_of("handle").alias("node_id")), "node_id", "left_anti")
        out = out.unionByName(alone.select(F.col("node_id").alias("run_id"), F.lit(1).cast("bigint").alias("rank"), pack("node_id").alias("handle")))
    return out


def _walked(steps: DataFrame, links: DataFrame) -> DataFrame:
    """``(run_id, rank, handle, size)`` of the runs whose links are visited: stretches of paths, read alike at every visit."""
    s = neighbours(steps.select("path_id", "ord", "handle"), ["path_id"], "ord", "handle", nxt="_next")
    s = s.select("path_id", "ord", "handle", canonical("handle", "_next").alias("e"))
    on = links.select(F.col("l").alias("_l"), F.col("r").alias("_r"), F.lit(True).alias("on"))
    s = s.join(on, (F.col("e.l") == F.col("_l")) & (F.col("e.r") == F.col("_r")), "left")
    before = Window.partitionBy("path_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("path_id", "ord", "handle", F.max(F.when(F.col("on").isNull(), F.col("ord"))).over(before).alias("cut"))
    stretch = Window.partitionBy("path_id", "cut")
    s = s.select("handle", "ord", F.min("ord").over(stretch).alias("a"), F.max("ord").over(stretch).alias("z"), F.min("handle").over(stretch).alias("least"))
    s = s.where("a < z")
    ahead = ~is_reverse("least")
    read = F.when(ahead, F.col("handle")).otherwise(flip("handle")).alias("handle")
    rank = F.when(ahead, F.col("ord") - F.col("a")).otherwise(F.col("z") - F.col("ord")) + 1
    return s.select(node_of("least").alias("run_id"), rank.alias("rank"), read, (F.col("z") - F.col("a") + 1).alias("size")).distinct()


def _doubled(links: DataFrame) -> DataFrame:
    """``(run_id, rank, handle, size)`` of the runs of any links (l, r)."""
    both = links.unionByName(links.select(flip("r").alias("l"), flip("l").alias("r")))
    comps = materialize(connected_components(links.select(node_of("l").alias("u"), node_of("r").alias("v"))), "runs")
    # the link into a cycle's smallest forward handle is cut: the run then starts there
    into = both.select(F.col("r").alias("handle")).distinct()
    members = comps.select("node", "comp", F.explode(F.array(pack("node"), pack("node", True))).alias("handle"))
    heads = members.join(into, "handle", "left_anti").groupBy("comp").agg(F.count("*").alias("n"))
    cycles = comps.select("comp").distinct().join(heads, "comp", "left_anti").select(F.col("comp").alias("_c"))
    j = both.join(cycles, node_of(F.col("r")) == F.col("_c"), "left").where(~(F.col("_c").isNotNull() & ~is_reverse("r")))
    j = j.drop("_c").join(cycles, node_of(F.col("l")) == F.col("_c"), "left").where(~(F.col("_c").isNotNull() & is_reverse("l"))).select("l", "r")
    # distance from the head by doubling: (handle, back, hops), back being hops links before
    table = Table(members.select("handle").join(j.select(F.col("r").alias("handle"), F.col("l").alias("back")), "handle", "left").withColumn("hops", F.when(F.col("back").isNull(), 0).otherwise(1).cast("bigint")), "rank")
    while True:
        far = table.df.select(F.col("handle").alias("back"), F.col("back").alias("b2"), F.col("hops").alias("h2"))
        open_ = table.df.where("back is not null").join(far, "back")
        if open_.where("b2 is not null or h2 > 0").isEmpty():
            break
        done = table.df.where("back is null")
        # a handle whose predecessor is a head has its final distance
        step = open_.select("handle", F.col("b2").alias("back"), (F.col("hops") + F.col("h2")).alias("hops"))
        new = Table(done.unionByName(step), "rank")
        table.drop()
        table = new
    ranks = table.df.select("handle", "hops")
    r = members.join(ranks, "handle")
    size = comps.groupBy("comp").agg(F.count("*").alias("size"))
    r = r.join(size, "comp")
    hold(table.spark, table.path)
    return r.join(_reading(j, members), ["comp", "handle"], "left_semi").select(F.col("comp").alias("run_id"), (F.col("hops") + 1).alias("rank"), "handle", "size")


def _reading(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(comp, handle)``: the handles of each run in the reading with its smallest node forward.

    The oriented links make two components of every run, mirror images; the one of the smallest
    node's forward handle is kept.
    """
    sides = connected_components(links, "l", "r")
    own = members.join(sides.withColumnRenamed("node", "handle").withColumnRenamed("comp", "side"), "handle")
    wanted = own.where((F.col("node") == F.col("comp")) & ~is_reverse("handle")).select("comp", "side")
    return own.join(wanted, ["comp", "side"], "left_semi").select("comp", "handle")


def concat_runs(g: Graph, runs: DataFrame) -> tuple[Graph, DataFrame]:
    """Put every run (run_id, rank, handle) into one new node; also ``(run_id, new_id)``.

    New ids go on from the largest, in run order.  Outer edges move to the new node, inner ones
    go; each visit of a run becomes one step, reverse where the path reads it backwards.
    """
    top = g.nodes.agg(F.max("node_id")).first()[0] or 0
    ids = materialize(number_globally(runs.select("run_id").distinct(), [F.col("run_id")], "new_id", top + 1), "ids")
    size = runs.groupBy("run_id").agg(F.max("rank").alias("size"))
    r = materialize(runs.join(ids, "run_id").join(size, "run_id").select("handle", node_of("handle").alias("_n"), "rank", "size", "new_id"), "runs")
    seqs = r.join(g.nodes.select(F.col("node_id").alias("_n"), "seq"), "_n")
    seqs = seqs.groupBy("new_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", oriented("seq", is_reverse("handle")).alias("s")))), lambda x: x["s"]), "").alias("seq"))
    nodes = g.nodes.join(r.select(F.col("_n").alias("node_id")), "node_id", "left_anti").unionByName(seqs.select(F.col("new_id").alias("node_id"), "seq"))

    inner = r.select("new_id", (F.col("rank") + 1).alias("rank"), F.col("handle").alias("a")).join(r.select("new_id", "rank", F.col("handle").alias("b")), ["new_id", "rank"])
    edges = g.edges.join(canonical_edges(inner, "a", "b"), ["l", "r"], "left_anti")
    for col in ("l", "r"):
        j = edges.join(r.select("_n", F.col("handle").alias("_h"), "new_id"), node_of(F.col(col)) == F.col("_n"), "left")
        edges = j.withColumn(col, F.when(F.col("new_id").isNull(), F.col(col)).otherwise(pack("new_id", F.col("_h") != F.col(col)))).select("l", "r")

    j = g.steps.join(r.withColumnRenamed("handle", "_h"), node_of(F.col("handle")) == F.col("_n"), "left")
    backwards = F.col("_h") != F.col("handle")
    first = F.when(backwards, F.col("rank") == F.col("size")).otherwise(F.col("rank") == 1)
    kept = j.where(F.col("new_id").isNull() | first).withColumn("handle", F.when(F.col("new_id").isNull(), F.col("handle")).otherwise(pack("new_id", backwards)))
    steps = rank_rows(kept.select("path_id", F.col("ord").alias("_o"), "handle"), ["path_id"], [F.col("_o")])
    steps = steps.select("path_id", "ord", F.col("ord").alias("step_id"), "handle")
    return Graph(nodes, canonical_edges(edges), g.paths, steps), ids


def unchop(g: Graph) -> Graph:
    """Merge all runs of two nodes or more, then order ids by the mean old rank, largest first.

    The i-th id in ascending order is replaced by the i-th id of that order; equal means go by id.
    """
    g = _fixed(g)
    runs = materialize(_runs(g, 2), "unchop")
    old = number_globally(g.nodes.select("node_id"), [F.col("node_id")], "rank")
    merged, ids = concat_runs(g, runs)
    merged = Graph(*(materialize(t, "merged") for t in (merged.nodes, merged.edges, merged.paths, merged.steps)))
    mean = runs.select("run_id", node_of("handle").alias("node_id")).join(old, "node_id").groupBy("run_id").agg(F.avg("rank").alias("mean")).join(ids, "run_id")
    kept = old.join(merged.nodes.select("node_id"), "node_id", "left_semi").select("node_id", F.col("rank").cast("double").alias("mean"))
    order = kept.unionByName(mean.select(F.col("new_id").alias("node_id"), "mean"))
    return apply_ordering(merged, number_globally(order, [F.col("mean").desc(), F.col("node_id")], "rank").select("rank", "node_id"))
