"""Consensus graphs: some paths, and the most telling links between them, as a graph of their own.

The order-dependent parts ("has this node been seen in an earlier link?") are windows over
(link order, step): the first row of a node is where it is new.  Only the short list of new
runs inside one link is folded, as an array function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.dna import oriented
from strandlake.functions.handles import canonical_edges, flip, is_reverse, node_of
from strandlake.operators.edit_graph import compact_ids, defragment, remove_edges
from strandlake.operators.order import number_globally, rank_rows
from strandlake.operators.paths import positions, with_next_handle
from strandlake.operators.scan import adjacency, layout_ends
from strandlake.plans.chains import unchop
from strandlake.plans.scratch import materialize
from strandlake.schema import Graph

ORDER = ("length", "hash", "path_id", "begin_ord")


def consensus_of_nodes(g: Graph, chosen: DataFrame) -> DataFrame:
    """``(node_id, cons)``: the first consensus path (by pos) that visits each node.  ``chosen``: (pos, path_id)."""
    s = g.steps.join(chosen, "path_id").select(node_of("handle").alias("node_id"), F.struct("pos", "path_id").alias("x"))
    return s.groupBy("node_id").agg(F.min("x")["path_id"].alias("cons"))


def link_candidates(g: Graph, chosen: DataFrame, jump_max: int) -> DataFrame:
    """Links of the other paths between one consensus node and the next.

    ``(from_path, to_path, path_id, begin_ord, end_ord, length, hash, jump_len)``: from and to
    are the consensus paths with the smaller and larger id, length counts the bases strictly
    between, the hash tells apart what is walked, and the jump is the distance in the layout.  A
    short jump inside one consensus path is none.
    """
    cons = consensus_of_nodes(g, chosen)
    p = positions(g).join(chosen.select("path_id"), "path_id", "left_anti").withColumn("node_id", node_of("handle")).join(cons, "node_id", "left")
    by_path = Window.partitionBy("path_id").orderBy("ord")
    p = p.withColumn("begin_ord", F.max(F.when(F.col("cons").isNotNull(), F.col("ord"))).over(by_path.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    on = layout_ends(g, p.where("cons is not null").select("path_id", "ord", "handle", "cons", "begin0", "len", "node_id"))
    back = lambda c: F.lag(c).over(by_path)
    on = on.select(
        "path_id", back("ord").alias("begin_ord"), F.col("ord").alias("end_ord"), back("cons").alias("c0"), F.col("cons").alias("c1"), back("node_id").alias("n0"), F.col("node_id").alias("n1"),
        (F.col("begin0") - back("begin0") - back("len")).alias("length"), F.abs(F.col("start_in_layout") - back("end_in_layout")).alias("jump_len"),
    ).where("begin_ord is not null")
    on = on.where((F.col("c0") != F.col("c1")) | (F.col("jump_len") >= jump_max))
    inner = p.where("cons is null and begin_ord is not null").join(g.nodes, "node_id").select("path_id", "begin_ord", F.struct("ord", oriented("seq", is_reverse("handle")).alias("s")).alias("x"))
    spelled = inner.groupBy("path_id", "begin_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("between"))
    j = on.join(spelled, ["path_id", "begin_ord"], "left")
    digest = F.md5(F.concat_ws(":", F.col("n0").cast("string"), F.col("n1").cast("string"), F.coalesce("between", F.lit(""))))
    return j.select(F.least("c0", "c1").alias("from_path"), F.greatest("c0", "c1").alias("to_path"), "path_id", "begin_ord", "end_ord", "length", digest.alias("hash"), "jump_len")


def _walk(g: Graph, links: DataFrame, *, closed: bool) -> DataFrame:
    """The steps of each link (link_id, path_id, begin_ord, end_ord), without its last unless ``closed``."""
    end = F.col("ord") <= F.col("end_ord") if closed else F.col("ord") < F.col("end_ord")
    # ordinals are spelled out, so this is an equi-join
    spread = links.withColumn("ord", F.explode(F.sequence("begin_ord", "end_ord"))).where(end)
    return spread.join(g.steps.select("path_id", "ord", "handle"), ["path_id", "ord"])


def novel_gaps(walk: DataFrame, order: list[str], link: str, group: list[str]) -> DataFrame:
    """``(link, gap, n_steps)``: the most bases of consecutive new steps that a seen step follows.

    ``walk`` has the steps of all links with ``ord``, ``node_id``, ``len`` and ``known`` (seen before
    any link); a node is new at its first step in the group, in ``order``.
    """
    first = F.row_number().over(Window.partitionBy(*group, "node_id").orderBy(*order, "ord")) == 1
    w = walk.withColumn("_new", first & ~F.col("known"))
    inside = Window.partitionBy(link).orderBy("ord")
    w = w.withColumn("_island", F.sum(F.when(F.col("_new"), 0).otherwise(1)).over(inside))
    last = F.max(F.struct("ord", "_new"))
    runs = w.where("_new").groupBy(link, "_island").agg(F.sum("len").alias("_bp"), F.max("ord").alias("_last"))
    ends = w.groupBy(link).agg(last.alias("_x"), F.count("*").alias("n_steps")).select(link, F.col("_x.ord").alias("_end"), "n_steps")
    j = ends.join(runs, link, "left").groupBy(link).agg(F.coalesce(F.max(F.when(F.col("_last") != F.col("_end"), F.col("_bp"))), F.lit(0)).alias("gap"), F.first("n_steps").alias("n_steps"))
    return j


def best_links(g: Graph, links: DataFrame, jump_max: int, jump_limit: int) -> tuple[DataFrame, DataFrame]:
    """The links that are kept, with ``rank`` in their (from, to) pair, and the perfect edges (l, r)."""
    pair = ["from_path", "to_path"]
    links = links.withColumn("n", F.count("*").over(Window.partitionBy(*pair, "hash")))
    once = links.withColumn("_k", F.row_number().over(Window.partitionBy(*pair, "hash").orderBy(*ORDER))).where("_k = 1").drop("_k")
    once = materialize(number_globally(once, [F.col(c) for c in (*pair, *ORDER)], "link_id"), "unique")
    best = once.withColumn("_b", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("n"), "length", "hash"))).where("_b = 1").select(*pair, F.col("link_id").alias("best"))

    ends = g.steps.groupBy("path_id").agg(F.min_by("handle", "ord").alias("first"), F.max_by("handle", "ord").alias("last"))
    side = lambda x: ends.select(F.col("path_id").alias(f"{x}_path"), F.col("first").alias(f"{x}_first"), F.col("last").alias(f"{x}_last"))
    p = best.join(side("from"), "from_path").join(side("to"), "to_path")
    adj = adjacency(g)
    e1 = p.join(adj, (F.col("from_last") == F.col("l")) & (F.col("to_first") == F.col("r"))).select(*pair, "l", "r", F.lit(1).alias("k"))
    e2 = p.join(adj, (F.col("to_last") == F.col("l")) & (F.col("from_first") == F.col("r"))).select(*pair, "l", "r", F.lit(2).alias("k"))
    edges = materialize(e1.unionByName(e2).groupBy(*pair).agg(F.min(F.struct("k", "l", "r")).alias("x")).select(*pair, "x.l", "x.r"), "perfect")

    walk = materialize(_walk(g, once, closed=True).withColumn("node_id", node_of("handle")), "walks")
    nxt = walk.select("link_id", (F.col("ord") - 1).alias("ord"), F.col("handle").alias("e"))
    two = walk.select("link_id", *pair, "ord", F.col("handle").alias("b")).join(nxt, ["link_id", "ord"]).join(p.select(*pair, "from_last", "to_first"), pair)
    a, z = F.col("from_last"), F.col("to_first")
    hit = ((F.col("b") == a) & (F.col("e") == z)) | ((F.col("b") == flip(a)) & (F.col("e") == flip(z))) | ((F.col("b") == z) & (F.col("e") == a)) | ((F.col("b") == flip(z)) & (F.col("e") == flip(a)))
    perfect = two.where(hit).join(edges, pair, "left_anti").groupBy(*pair).agg(F.min("link_id").alias("perfect"))
    c = best.join(perfect, pair, "left").join(edges.select(*pair, F.lit(True).alias("_edge")), pair, "left")
    chosen = c.select(*pair, "best", F.when(F.col("_edge"), None).when(F.col("perfect").isNotNull(), F.col("perfect")).when(F.col("from_path") != F.col("to_path"), F.col("best")).alias("chosen"))
    chosen = materialize(chosen, "chosen")

    length = g.nodes.select("node_id", F.length("seq").cast("bigint").alias("len"))
    open_walk = walk.where("ord < end_ord").join(length, "node_id")
    known = open_walk.join(chosen.select(F.col("chosen").alias("link_id")), "link_id", "left_semi").select(*pair, "node_id", F.lit(True).alias("_k")).distinct()
    rest = open_walk.join(chosen.select(F.col("best").alias("link_id")), "link_id", "left_anti").join(known, [*pair, "node_id"], "left").withColumn("known", F.coalesce("_k", F.lit(False)))
    gaps = novel_gaps(rest, ["link_id"], "link_id", pair)
    j = once.join(gaps, "link_id")
    far = (F.col("jump_len") >= jump_max) & (F.col("jump_len") < jump_limit) & ((F.col("length") == 0) | (F.col("gap") / F.col("n_steps") > 1.0))
    more = j.where(far | (F.col("gap") >= jump_max)).join(chosen.select(*pair, F.when(F.col("chosen").isNotNull(), 1).otherwise(0).alias("_base")), pair)
    more = rank_rows(more, pair, [F.col("link_id")], "_r").withColumn("rank", (F.col("_base") + F.col("_r") - 1).cast("bigint"))
    zero = once.join(chosen.select(F.col("chosen").alias("link_id")), "link_id", "left_semi").withColumn("rank", F.lit(0).cast("bigint"))
    cols = ["link_id", *pair, "rank", "path_id", "begin_ord", "end_ord", "length", "hash", "jump_len"]
    return zero.select(*cols).unionByName(more.select(*cols)), edges.select("l", "r")


def assemble(g: Graph, chosen: DataFrame, kept: DataFrame, perfect: DataFrame) -> Graph:
    """The graph of the consensus paths, a path for every kept link with bases, and their edges."""
    name = g.paths.select("path_id", "name")
    own = chosen.join(name, "path_id").select("path_id", "pos", "name")
    long_links = kept.where("length > 0").join(name.select(F.col("path_id").alias("from_path"), F.col("name").alias("_f")), "from_path").join(name.select(F.col("path_id").alias("to_path"), F.col("name").alias("_t")), "to_path")
    long_links = long_links.withColumn("name", F.concat_ws("_", F.lit("Link"), "_f", "_t", F.col("rank").cast("string")))
    long_links = long_links.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("link_id"))).where("_k = 1")
    all_names = own.select(F.lit(0).alias("kind"), F.col("pos").cast("bigint").alias("k"), "name", F.col("path_id").alias("old"), F.lit(None).cast("bigint").alias("link_id"))
    all_names = all_names.unionByName(long_links.select(F.lit(1).alias("kind"), F.col("link_id").alias("k"), "name", F.col("path_id").alias("old"), "link_id"))
    ids = materialize(number_globally(all_names, [F.col("kind"), F.col("k"), F.col("name")], "new_path", 0), "names")
    s = g.steps.join(ids.where("kind = 0").select(F.col("old").alias("path_id"), "new_path"), "path_id").select(F.col("new_path").alias("path_id"), "ord", "handle")
    w = _walk(g, long_links.select("link_id", "path_id", "begin_ord", "end_ord"), closed=False).join(ids.where("kind = 1").select("link_id", "new_path"), "link_id")
    s = s.unionByName(w.select(F.col("new_path").alias("path_id"), "ord", "handle"))
    steps = materialize(rank_rows(s.withColumnRenamed("ord", "_o"), ["path_id"], [F.col("_o")]).select("path_id", "ord", F.col("ord").alias("step_id"), "handle"), "steps")
    paths = ids.select(F.col("new_path").alias("path_id"), "name", F.lit(False).alias("circular"))
    nodes = g.nodes.join(steps.select(node_of("handle").alias("node_id")).distinct(), "node_id", "left_semi")
    walked = with_next_handle(steps).select(F.col("handle").alias("l"), F.col("next_handle").alias("r"))
    at = lambda c, x: g.steps.select("path_id", F.col("ord").alias(c), F.col("handle").alias(x))
    border = kept.select("path_id", F.explode(F.array(F.struct(F.col("begin_ord").alias("a"), (F.col("begin_ord") + 1).alias("b")), F.struct((F.col("end_ord") - 1).alias("a"), F.col("end_ord").alias("b")))).alias("x"))
    border = border.select("path_id", "x.a", "x.b").join(at("a", "l"), ["path_id", "a"]).join(at("b", "r"), ["path_id", "b"]).select("l", "r")
    for c in ("l", "r"):
        border = border.join(nodes.select(F.col("node_id").alias("_n")), node_of(F.col(c)) == F.col("_n"), "left_semi")
    return Graph(nodes, canonical_edges(walked.unionByName(perfect.select("l", "r")).unionByName(border)), paths, steps)


def novel_fragments(g: Graph, is_link: Column, jump_max: int) -> Graph:
    """Replace link paths by their new parts, ``<link>_<k>``.

    Links are taken by (smallest end node, largest end node descending).  A part is a run of nodes
    that no earlier link has, with the seen step after it; it is kept if it has ``jump_max`` new
    bases or a neighbour that is first reached here and lies on another path.
    """
    links = g.paths.where(is_link).select("path_id", "name")
    ends = g.steps.join(links, "path_id").groupBy("path_id", "name").agg(node_of(F.min_by("handle", "ord")).alias("a"), node_of(F.max_by("handle", "ord")).alias("z"))
    order = number_globally(ends.select("path_id", "name", F.least("a", "z").alias("lo"), F.greatest("a", "z").alias("hi")), [F.col("lo"), F.col("hi").desc(), F.col("name")], "turn")
    order = materialize(order.select("path_id", "name", "turn"), "turns")
    s = g.steps.join(order, "path_id").withColumn("node_id", node_of("handle")).join(g.nodes.select("node_id", F.length("seq").cast("bigint").alias("len")), "node_id")
    s = s.withColumn("new", F.row_number().over(Window.partitionBy("node_id").orderBy("turn", "ord")) == 1)
    s = materialize(s, "links")
    adj = adjacency(g)
    right = s.where("new").select("turn", "ord", "handle").join(adj.withColumnRenamed("l", "handle"), "handle").select("turn", "ord", node_of("r").alias("other"))
    left = s.where("new").select("turn", "ord", "handle").join(adj.withColumnRenamed("r", "handle"), "handle").select("turn", "ord", node_of("l").alias("other"))
    first = right.unionByName(left).groupBy("other").agg(F.min(F.struct("turn", "ord")).alias("x"))
    on_cons = g.steps.join(links, "path_id", "left_anti").select(node_of("handle").alias("other")).distinct()
    external = first.join(on_cons, "other", "left_semi").select("x.turn", "x.ord").distinct().withColumn("ext", F.lit(True))
    s = s.join(external, ["turn", "ord"], "left").withColumn("ext", F.coalesce("ext", F.lit(False)))
    s = s.withColumn("island", F.sum(F.when(F.col("new"), 0).otherwise(1)).over(Window.partitionBy("turn").orderBy("ord")))
    n = s.groupBy("turn").agg(F.max("ord").alias("n"))
    runs = s.where("new").groupBy("turn", "island").agg(F.min("ord").alias("a"), F.max("ord").alias("z"), F.sum("len").alias("bp"), F.max("ext").alias("ext")).join(n, "turn")
    runs = runs.groupBy("turn").agg(F.array_sort(F.collect_list(F.struct("a", F.least(F.col("z") + 1, F.col("n")).alias("z"), "bp", "ext"))).alias("runs"))
    # bases and reach of runs that aren't kept count for the next one
    start = F.struct(F.lit(0).cast("bigint").alias("bp"), F.lit(False).alias("ext"), F.array().cast("array<struct<a:bigint,z:bigint>>").alias("out"))

    def step(acc, x):
        bp, ext = acc["bp"] + x["bp"], acc["ext"] | x["ext"]
        keep = ext | (bp >= jump_max)
        out = F.when(keep, F.concat(acc["out"], F.array(F.struct(x["a"].alias("a"), x["z"].alias("z"))))).otherwise(acc["out"])
        return F.struct(F.when(keep, F.lit(0).cast("bigint")).otherwise(bp).alias("bp"), (ext & ~keep).alias("ext"), out.alias("out"))

    kept = runs.select("turn", F.posexplode(F.aggregate("runs", start, step, lambda acc: acc["out"])).alias("k", "x")).join(order, "turn")
    top = (g.paths.agg(F.max("path_id")).first()[0] or 0) + 1
    kept = kept.select(F.concat_ws("_", "name", F.col("k").cast("string")).alias("name"), F.col("path_id").alias("old"), F.col("x.a").alias("a"), F.col("x.z").alias("z"), "turn", "k")
    kept = materialize(number_globally(kept, [F.col("turn"), F.col("k")], "path_id", top), "fragments")
    body = kept.withColumn("o", F.explode(F.sequence("a", "z"))).join(g.steps.select(F.col("path_id").alias("old"), F.col("ord").alias("o"), "handle"), ["old", "o"])
    body = body.select("path_id", (F.col("o") - F.col("a") + 1).alias("ord"), (F.col("o") - F.col("a") + 1).alias("step_id"), "handle")
    paths = g.paths.join(links.select("path_id"), "path_id", "left_anti").unionByName(kept.select("path_id", "name", F.lit(False).alias("circular")))
    return _fixed(g.having(paths=paths, steps=g.steps.join(links.select("path_id"), "path_id", "left_anti").unionByName(body)))


def drop_unvisited(g: Graph) -> Graph:
    """Nodes that no step visits go, with their edges."""
    on = g.steps.select(node_of("handle").alias("_n")).distinct()
    edges = g.edges
    for c in ("l", "r"):
        edges = edges.join(on, node_of(F.col(c)) == F.col("_n"), "left_semi")
    return g.having(nodes=g.nodes.join(on, F.col("node_id") == F.col("_n"), "left_semi"), edges=edges)


def prune_edges(g: Graph, jump_max: int) -> Graph:
    """Remove edges from steps with several next handles that only shortcut the own path by under ``jump_max`` bases.

    An edge stays if, for any step with it, the next node has several steps, lies on another
    path, or on this one exactly after the step or ``jump_max`` beyond that.
    """
    adj = adjacency(g)
    many = adj.groupBy("l").agg(F.count("*").alias("n")).where("n > 1").select("l")
    p = positions(g)
    here = p.select("path_id", F.col("handle").alias("l"), (F.col("begin0") + F.col("len")).alias("end")).join(many, "l", "left_semi").join(adj, "l").withColumn("node_id", node_of("r"))
    there = p.select(node_of("handle").alias("node_id"), F.col("path_id").alias("other"), F.col("begin0").alias("at"))
    single = there.groupBy("node_id").agg(F.count("*").alias("n"), F.min("other").alias("other"), F.min("at").alias("at"))
    j = here.join(single, "node_id", "left")
    fits = (F.col("other") != F.col("path_id")) | (F.col("at") == F.col("end")) | (F.col("at") - F.col("end") >= jump_max)
    ok = F.coalesce((F.col("n") > 1) | fits, F.lit(False))
    c = canonical_edges(j.where(ok).select("l", "r"))
    gone = canonical_edges(j.where(~ok).select("l", "r")).join(c, ["l", "r"], "left_anti")
    return remove_edges(g, gone)


def _fixed(g: Graph) -> Graph:
    return Graph(*(materialize(t, "graph") for t in (g.nodes, g.edges, g.paths, g.steps)))


def consensus_graph(g: Graph, names: DataFrame, jump_max: int, jump_limit: int) -> Graph:
    """The consensus graph of the paths in ``names`` (pos, name); unknown names are ignored.

    Every consensus path spells what it did.
    """
    chosen = materialize(names.join(g.paths.select("name", "path_id"), "name").select("pos", "path_id"), "chosen")
    links = materialize(link_candidates(g, chosen, jump_max), "candidates")
    kept, perfect = best_links(g, links, jump_max, jump_limit)
    out = unchop(_fixed(assemble(g, chosen, materialize(kept, "kept"), perfect)))
    own = chosen.join(g.paths, "path_id").select("name")
    marked = out.paths.join(own.withColumn("_own", F.lit(True)), "name", "left")
    links_of = [r["path_id"] for r in marked.where("_own is null").select("path_id").limit(1).collect()]
    if links_of:
        out = out.having(paths=marked.select("path_id", "name", F.col("_own").isNotNull().alias("circular")))
        out = novel_fragments(out, ~F.col("circular"), jump_max)
        out = out.having(paths=out.paths.withColumn("circular", F.lit(False)))
    out = unchop(_fixed(drop_unvisited(out)))
    out = unchop(_fixed(prune_edges(out, jump_max)))
    out = unchop(_fixed(defragment(drop_unvisited(out))))
    return _fixed(defragment(compact_ids(out)))
