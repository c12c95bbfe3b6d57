"""Registered queries of the graph operators, each with the SQL that it must agree with.

Every query runs over the whole derived graph; what an edit acts on (short nodes, shipped steps)
is a condition on the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna, handles
from strandlake.functions.handles import flip, is_reverse, node_of, pack
from strandlake.operators import edit_graph, edit_paths, paths, scan, validate
from strandlake.plans import chains as runs
from strandlake.plans import consensus
from strandlake.plans.scratch import materialize
from strandlake.schema import Graph
from strandlake.sources import gfa
from strandlake.sources.testgraph import chains, chains_sql, dense, dense_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph=dense):
    """Register a function of a graph under ``name``."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(graph(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Register a function of (spark, sf_dir)."""
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def long(c, name: str):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name)


def step_handles(g: Graph) -> DataFrame:
    return g.steps.select("handle").distinct()


COMP_FROM, COMP_TO = dna.FROM, dna.TO
RC = f"translate(reverse(seq), '{COMP_FROM}', '{COMP_TO}')"


# Column functions -----------------------------------------------------------------------------


@query("handle_pack", dense_sql("SELECT path_id, ord, handle, handle >> 1 AS node_id, (handle & 1) = 1 AS reverse, handle AS packed FROM steps"))
def _(g):
    return g.steps.select("path_id", "ord", "handle", node_of("handle").alias("node_id"), is_reverse("handle").alias("reverse"), handles.checked_pack(node_of("handle"), is_reverse("handle")).alias("packed"))


@query("handle_flip_forward", dense_sql("SELECT DISTINCT handle, xor(handle, 1::BIGINT) AS flipped, (handle >> 1) * 2 AS forward FROM steps"))
def _(g):
    return step_handles(g).select("handle", flip("handle").alias("flipped"), handles.forward("handle").alias("forward"))


@query("edge_canonical", dense_sql("SELECT a, b, CASE WHEN a > xor(b, 1::BIGINT) THEN xor(b, 1::BIGINT) ELSE a END AS l, CASE WHEN a > xor(b, 1::BIGINT) THEN xor(a, 1::BIGINT) ELSE b END AS r FROM links WHERE b IS NOT NULL"))
def _(g):
    s = paths.with_next_handle(g.steps).select(F.col("handle").alias("a"), F.col("next_handle").alias("b"))
    return s.select("a", "b", handles.canonical("a", "b").alias("e")).select("a", "b", "e.l", "e.r")


@query("complement_bases", dense_sql(f"SELECT node_id, translate(seq, '{COMP_FROM}', '{COMP_TO}') AS complement FROM nodes"))
def _(g):
    return g.nodes.select("node_id", dna.complement("seq").alias("complement"))


@query("rev_comp", dense_sql(f"SELECT node_id, {RC} AS rev_comp FROM nodes"))
def _(g):
    return g.nodes.select("node_id", dna.reverse_complement("seq").alias("rev_comp"))


register(
    "normalise_packed",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), dna.plain_bases("p_name").alias("bases")),
    "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g') AS bases FROM part",
)


@query("encode_decode_bases", dense_sql("SELECT node_id, translate(seq, 'ACGTN', '01234') || CASE WHEN length(seq) % 2 = 1 THEN 'F' ELSE '' END AS packed_hex, seq AS decoded FROM nodes"))
def _(g):
    packed = dna.encode_bases("seq")
    return g.nodes.select("node_id", F.hex(packed).alias("packed_hex"), dna.decode_bases(packed).alias("decoded"))


# Aggregates and scans ---------------------------------------------------------------------------


@query("graph_summary", dense_sql("""SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM nodes) AS total_length,
  (SELECT min(node_id) FROM nodes) AS min_node_id, (SELECT max(node_id) FROM nodes) AS max_node_id, (SELECT count(*) FROM edges) AS edge_count,
  (SELECT count(*) FROM paths) AS path_count, (SELECT count(*) FROM steps) AS step_count"""))
def _(g):
    return scan.summary(g)


@query("node_count_total_length", dense_sql("SELECT count(*) AS node_count, CAST(sum(length(seq)) AS BIGINT) AS total_length FROM nodes"))
def _(g):
    return g.nodes.agg(F.count("*").alias("node_count"), long(F.sum(F.length("seq")), "total_length"))


@query("min_max_node_id", dense_sql("SELECT min(node_id) AS min_node_id, max(node_id) AS max_node_id FROM nodes"))
def _(g):
    return g.nodes.agg(F.min("node_id").alias("min_node_id"), F.max("node_id").alias("max_node_id"))


@query("handle_list", dense_sql("SELECT 2 * node_id AS handle FROM nodes"))
def _(g):
    return scan.handles(g)


@query("edge_list", dense_sql("SELECT l, r FROM edges"))
def _(g):
    return g.edges


@query("edge_count", dense_sql("SELECT count(*) AS edge_count FROM edges"))
def _(g):
    return g.edges.agg(F.count("*").alias("edge_count"))


@query("path_list", dense_sql("SELECT path_id, name, circular FROM paths"))
def _(g):
    return g.paths


def _has_node(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(((F.col("l_suppkey") + 1) * 37).alias("node_id")).distinct()
    return scan.has_node(dense(spark, sf_dir), ids)


register("has_node_probe", _has_node, dense_sql("SELECT DISTINCT CAST(l_suppkey + 1 AS BIGINT) * 37 AS node_id, CAST(l_suppkey + 1 AS BIGINT) * 37 IN (SELECT node_id FROM nodes) AS present FROM lineitem"))


@query("nodes_of_steps", dense_sql("SELECT handle >> 1 AS node_id, seq FROM (SELECT DISTINCT (handle >> 1) * 2 AS handle FROM steps) JOIN nodes ON node_id = handle >> 1"))
def _(g):
    return scan.nodes_of(g, g.steps.select(node_of("handle").alias("node_id")).distinct(), strict=True)


@query("neighbors_right", dense_sql("SELECT handle, r AS neighbour FROM (SELECT DISTINCT handle FROM steps) JOIN adj ON l = handle"))
def _(g):
    return scan.neighbours(g, step_handles(g), "right")


@query("neighbors_left", dense_sql("SELECT handle, l AS neighbour FROM (SELECT DISTINCT handle FROM steps) JOIN adj ON r = handle"))
def _(g):
    return scan.neighbours(g, step_handles(g), "left")


@query("degree_both", dense_sql("""SELECT node_id, coalesce(a, 0) AS right_degree, coalesce(b, 0) AS left_degree FROM nodes
  LEFT JOIN (SELECT l, count(*) AS a FROM adj GROUP BY l) ON l = 2 * node_id LEFT JOIN (SELECT r, count(*) AS b FROM adj GROUP BY r) ON r = 2 * node_id"""))
def _(g):
    return scan.degrees(g)


@query("degree_oriented", dense_sql("SELECT handle, count(l) AS degree FROM (SELECT DISTINCT handle FROM steps) LEFT JOIN adj ON r = handle GROUP BY handle"))
def _(g):
    return scan.degree(g, step_handles(g), "left")


@query("has_edge_probe", dense_sql("""SELECT a AS l, b AS r, EXISTS (SELECT 1 FROM adj WHERE adj.l = a AND adj.r = b) AS present FROM
  (SELECT DISTINCT xor(handle, 1::BIGINT) AS a, lead(handle, 2) OVER (PARTITION BY path_id ORDER BY ord) AS b FROM steps) WHERE b IS NOT NULL"""))
def _(g):
    two = g.steps.select("path_id", (F.col("ord") - 2).alias("ord"), F.col("handle").alias("r"))
    pairs = g.steps.select("path_id", "ord", flip("handle").alias("l")).join(two, ["path_id", "ord"]).select("l", "r").distinct()
    return scan.has_edge(g, pairs)


@query("handle_sequence", dense_sql(f"SELECT handle, CASE WHEN handle & 1 = 1 THEN {RC} ELSE seq END AS seq FROM (SELECT DISTINCT handle FROM steps) JOIN nodes ON node_id = handle >> 1"))
def _(g):
    return scan.sequences(g, step_handles(g))


@query("subsequence", dense_sql(f"SELECT handle, substr(CASE WHEN handle & 1 = 1 THEN {RC} ELSE seq END, 3, 5) AS sub FROM (SELECT DISTINCT handle FROM steps) JOIN nodes ON node_id = handle >> 1"))
def _(g):
    return scan.subsequences(g, step_handles(g).withColumns({"s": F.lit(2), "n": F.lit(5)}), "s", "n").select("handle", "sub")


@query("base_at", dense_sql(f"SELECT handle, CASE WHEN length(seq) > 4 THEN substr(CASE WHEN handle & 1 = 1 THEN {RC} ELSE seq END, 5, 1) END AS base FROM (SELECT DISTINCT handle FROM steps) JOIN nodes ON node_id = handle >> 1"))
def _(g):
    return scan.bases(g, step_handles(g).withColumn("i", F.lit(4)), "i").select("handle", "base")


@query("node_lengths", dense_sql("SELECT node_id, length(seq) AS len FROM nodes"))
def _(g):
    return g.nodes.select("node_id", long(F.length("seq"), "len"))


LAYOUT = "lay AS (SELECT node_id, CAST(sum(length(seq)) OVER (ORDER BY node_id) - length(seq) AS BIGINT) AS start, length(seq) AS len FROM nodes)"


@query("layout_offsets", dense_sql("SELECT node_id, start, len FROM lay", LAYOUT))
def _(g):
    return scan.layout(g)


@query("layout_ends", dense_sql("""SELECT handle, CASE WHEN handle & 1 = 1 THEN start + len ELSE start END AS start_in_layout, CASE WHEN handle & 1 = 1 THEN start ELSE start + len END AS end_in_layout
  FROM (SELECT DISTINCT handle FROM steps) JOIN lay ON node_id = handle >> 1""", LAYOUT))
def _(g):
    return scan.layout_ends(g, step_handles(g))


# Paths --------------------------------------------------------------------------------------------


@query("find_paths", dense_sql("SELECT 'order#' || (3 * k) AS name, p.path_id FROM (SELECT path_id AS k FROM paths) LEFT JOIN (SELECT path_id, name AS n FROM paths) p ON p.n = 'order#' || (3 * k)"))
def _(g):
    return paths.find_paths(g, g.paths.select(F.concat(F.lit("order#"), F.col("path_id") * 3).alias("name")))


@query("path_len", dense_sql("SELECT path_id, name, circular, count(ord) AS n_steps FROM paths LEFT JOIN steps USING (path_id) GROUP BY ALL"))
def _(g):
    return paths.path_lengths(g)


@query("path_ends", dense_sql("SELECT path_id, min_by(step_id, ord) AS first_step, max_by(step_id, ord) AS last_step FROM paths LEFT JOIN steps USING (path_id) GROUP BY path_id"))
def _(g):
    return paths.path_ends(g)


@query("handle_at_step", dense_sql("SELECT p.path_id, k.step_id, s.handle FROM paths p, (VALUES (2::BIGINT)) k(step_id) LEFT JOIN steps s ON s.path_id = p.path_id AND s.step_id = k.step_id"))
def _(g):
    return paths.handles_at(g, g.paths.select("path_id", F.lit(2).cast("bigint").alias("step_id"))).select("path_id", "step_id", "handle")


@query("next_prev_step", dense_sql("SELECT path_id, ord, step_id, lead(step_id) OVER w AS next_step, lag(step_id) OVER w AS prev_step FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY ord)"))
def _(g):
    return paths.next_and_previous(g).drop("handle")


@query("steps_reverse", dense_sql("SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord DESC) AS rev_ord, xor(handle, 1::BIGINT) AS handle FROM steps"))
def _(g):
    return paths.reversed_steps(g)


@query("steps_range", dense_sql("SELECT path_id, 2::BIGINT AS from_step, 4::BIGINT AS to_step, ord, step_id, handle FROM (SELECT *, max(ord) OVER (PARTITION BY path_id) AS n FROM steps) WHERE (n < 2 OR ord >= 2) AND (n < 4 OR ord <= 4)"))
def _(g):
    two, four = (F.lit(x).cast("bigint") for x in (2, 4))
    return paths.steps_between(g, g.paths.select("path_id", two.alias("from_step"), four.alias("to_step")))


@query("path_contains", dense_sql("SELECT DISTINCT path_id, xor(handle, 1::BIGINT) AS handle, EXISTS (SELECT 1 FROM steps t WHERE t.path_id = s.path_id AND t.handle = xor(s.handle, 1::BIGINT)) AS present FROM steps s"))
def _(g):
    return paths.contains(g, g.steps.select("path_id", flip("handle").alias("handle")).distinct())


@query("occurrences", dense_sql("SELECT handle >> 1 AS node_id, path_id, step_id, handle & 1 = 1 AS reverse FROM steps"))
def _(g):
    return paths.occurrences(g)


@query("occurrence_counts", dense_sql("SELECT node_id, count(path_id) AS n_steps, count(DISTINCT path_id) AS n_paths FROM nodes LEFT JOIN steps ON handle >> 1 = node_id GROUP BY node_id"))
def _(g):
    return paths.occurrence_counts(g)


POS = "pos AS (SELECT path_id, ord, step_id, handle, length(seq) AS len, CAST(sum(length(seq)) OVER (PARTITION BY path_id ORDER BY ord) - length(seq) AS BIGINT) AS begin0 FROM steps JOIN nodes ON node_id = handle >> 1), bp AS (SELECT path_id, CAST(coalesce(sum(len), 0) AS BIGINT) AS n FROM paths LEFT JOIN pos USING (path_id) GROUP BY path_id)"


@query("path_bases_len", dense_sql("SELECT path_id, n AS n_bases, n + 1 AS end1 FROM bp", POS))
def _(g):
    return paths.path_bases(g)


@query("step_base_offset", dense_sql("SELECT path_id, step_id, begin0 FROM pos", POS))
def _(g):
    return paths.positions(g).select("path_id", "step_id", "begin0")


@query("position_index_1based", dense_sql("SELECT path_id, ord, step_id, handle, len, begin0, begin0 + 1 AS begin1 FROM pos", POS))
def _(g):
    return paths.positions(g)


PROBES = "SELECT path_id, ord * 23 AS pos FROM (SELECT path_id, ord FROM steps UNION ALL SELECT path_id, 0 FROM paths)"


def _probes(g: Graph) -> DataFrame:
    return g.steps.select("path_id", (F.col("ord") * 23).alias("pos")).unionByName(g.paths.select("path_id", F.lit(0).cast("bigint").alias("pos")))


@query("step_at_base", dense_sql(f"SELECT w.path_id, w.pos, p.step_id FROM ({PROBES}) w LEFT JOIN pos p ON p.path_id = w.path_id AND w.pos >= p.begin0 AND w.pos < p.begin0 + p.len", POS))
def _(g):
    return paths.step_at_base(g, _probes(g))


@query("asof_step", dense_sql(f"SELECT w.path_id, w.pos, CASE WHEN w.pos <= n + 1 THEN p.step_id END AS step_id FROM ({PROBES}) w JOIN bp USING (path_id) ASOF LEFT JOIN pos p ON p.path_id = w.path_id AND w.pos >= p.begin0 + 1", POS))
def _(g):
    return paths.step_as_of_base(g, _probes(g))


@query("handle_positions", dense_sql("SELECT 2 * node_id AS handle, path_id, step_id, begin0 + 1 AS begin1 FROM nodes JOIN pos ON handle >> 1 = node_id WHERE length(seq) = 1", POS))
def _(g):
    return paths.handle_positions(g, scan.handles(g.having(nodes=g.nodes.where("length(seq) = 1"))))


@query("path_sequence", dense_sql(f"SELECT path_id, coalesce(string_agg(CASE WHEN handle & 1 = 1 THEN {RC} ELSE seq END, '' ORDER BY ord), '') AS seq FROM paths LEFT JOIN steps USING (path_id) LEFT JOIN nodes ON node_id = handle >> 1 GROUP BY path_id"))
def _(g):
    return paths.path_sequences(g)


# Edits: each returns the rows of the tables that change -----------------------------------------


def rows(g: Graph, *tables: str) -> DataFrame:
    """Some of a graph's tables as rows of one shape: kind, two numbers, a text."""
    null = F.lit(None).cast("string")
    shape = {
        "nodes": lambda: g.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("seq").alias("t")),
        "edges": lambda: g.edges.select(F.lit("edge").alias("kind"), F.col("l").alias("a"), F.col("r").alias("b"), null.alias("t")),
        "paths": lambda: g.paths.select(F.lit("path").alias("kind"), F.col("path_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("name").alias("t")),
        "steps": lambda: g.steps.select(F.lit("step").alias("kind"), F.col("path_id").alias("a"), F.col("ord").alias("b"), F.col("handle").cast("string").alias("t")),
    }
    out = [shape[t]() for t in tables]
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


SHORT = "short AS (SELECT node_id AS s FROM nodes WHERE length(seq) <= 2)"


def short_nodes(g: Graph) -> DataFrame:
    return g.nodes.where("length(seq) <= 2").select("node_id")


@query("append_nodes", dense_sql("SELECT 'node' AS kind, node_id AS a, 0::BIGINT AS b, seq AS t FROM nodes UNION ALL SELECT 'node', (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY seq, k), 0, seq || 'A' FROM (SELECT seq, node_id AS k FROM nodes WHERE length(seq) <= 2)"))
def _(g):
    new = g.nodes.where("length(seq) <= 2").select(F.concat("seq", F.lit("A")).alias("seq"), F.col("node_id").alias("k"), F.col("seq").alias("s"))
    return rows(edit_graph.append_nodes(g, new, "s", "k"), "nodes")


@query("create_nodes", dense_sql("SELECT node_id, seq FROM nodes UNION ALL SELECT node_id + 1000000000, seq FROM nodes"))
def _(g):
    return edit_graph.create_nodes(g, g.nodes.select((F.col("node_id") + 1000000000).alias("node_id"), "seq")).nodes


@query("create_edges", dense_sql("SELECT l, r FROM edges UNION SELECT least(a, b), CASE WHEN a <= b THEN b ELSE a END FROM (SELECT 2 * node_id AS a, 2 * node_id + 1 AS b FROM nodes)"))
def _(g):
    return edit_graph.create_edges(g, g.nodes.select(pack("node_id").alias("l"), pack("node_id", True).alias("r"))).edges


@query("remove_handle", dense_sql("""SELECT 'node' AS kind, node_id AS a, 0::BIGINT AS b, seq AS t FROM nodes WHERE node_id NOT IN (SELECT s FROM short)
  UNION ALL SELECT 'edge', l, r, NULL FROM edges WHERE l >> 1 NOT IN (SELECT s FROM short) AND r >> 1 NOT IN (SELECT s FROM short)
  UNION ALL SELECT 'path', path_id, 0, name FROM paths WHERE path_id NOT IN (SELECT path_id FROM hit)
  UNION ALL SELECT 'step', path_id, ord, CAST(handle AS VARCHAR) FROM steps WHERE path_id NOT IN (SELECT path_id FROM hit)""", SHORT + ", hit AS (SELECT path_id FROM steps WHERE handle >> 1 IN (SELECT s FROM short))"))
def _(g):
    return rows(edit_graph.remove_nodes(g, short_nodes(g)), "nodes", "edges", "paths", "steps")


@query("remove_edge", dense_sql("SELECT l, r FROM edges WHERE (l >> 1) <= (r >> 1)"))
def _(g):
    gone = g.edges.where(node_of("l") > node_of("r")).select(flip("r").alias("l"), flip("l").alias("r"))
    return edit_graph.remove_edges(g, gone).edges


@query("clear_graph", "SELECT CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS VARCHAR) AS seq WHERE false")
def _(g):
    return edit_graph.clear(g).nodes


DIVIDE = """cutn AS (SELECT node_id AS n, seq AS s FROM nodes WHERE length(seq) > 30),
piece AS (SELECT n, k, CASE WHEN k = 0 THEN n ELSE (SELECT max(node_id) FROM nodes) + row_number() OVER (PARTITION BY k > 0 ORDER BY n, k) END AS id, substr(s, k * 10 + 1, CASE WHEN k = 2 THEN length(s) ELSE 10 END) AS ps FROM cutn, range(3) AS t(k)),
lastp AS (SELECT n, id AS last_id FROM piece WHERE k = 2)"""


@query("divide_handle", dense_sql("""SELECT 'node' AS kind, node_id AS a, 0::BIGINT AS b, seq AS t FROM nodes WHERE length(seq) <= 30 UNION ALL SELECT 'node', id, 0, ps FROM piece
  UNION ALL SELECT 'edge', CASE WHEN nl > xor(nr, 1::BIGINT) THEN xor(nr, 1::BIGINT) ELSE nl END, CASE WHEN nl > xor(nr, 1::BIGINT) THEN xor(nl, 1::BIGINT) ELSE nr END, NULL FROM (
    SELECT CASE WHEN p.last_id IS NOT NULL AND l & 1 = 0 THEN 2 * p.last_id ELSE l END AS nl, CASE WHEN q.last_id IS NOT NULL AND r & 1 = 1 THEN 2 * q.last_id + 1 ELSE r END AS nr
    FROM edges LEFT JOIN lastp p ON p.n = l >> 1 LEFT JOIN lastp q ON q.n = r >> 1 UNION ALL SELECT 2 * x.id, 2 * y.id FROM piece x JOIN piece y ON x.n = y.n AND y.k = x.k + 1)
  UNION ALL SELECT 'step', path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord, kk), CAST(coalesce(2 * id + (handle & 1), handle) AS VARCHAR) FROM (
    SELECT s.*, id, CASE WHEN handle & 1 = 1 THEN -k ELSE k END AS kk FROM steps s LEFT JOIN piece ON n = handle >> 1)""", DIVIDE))
def _(g):
    cuts = g.nodes.where("length(seq) > 30").select("node_id", F.explode(F.array(F.lit(10), F.lit(20))).alias("offset"))
    return rows(edit_graph.divide_nodes(g, cuts), "nodes", "edges", "steps")


TURN = f"""turned AS (SELECT l, r, CASE WHEN l >> 1 IN (SELECT s FROM short) THEN xor(l, 1::BIGINT) ELSE l END AS a, CASE WHEN r >> 1 IN (SELECT s FROM short) THEN xor(r, 1::BIGINT) ELSE r END AS b FROM edges)"""


@query("apply_orientation", dense_sql(f"""SELECT 'node' AS kind, node_id AS a, 0::BIGINT AS b, CASE WHEN length(seq) <= 2 THEN {RC} ELSE seq END AS t FROM nodes
  UNION ALL SELECT DISTINCT 'edge', CASE WHEN a > xor(b, 1::BIGINT) THEN xor(b, 1::BIGINT) ELSE a END, CASE WHEN a > xor(b, 1::BIGINT) THEN xor(a, 1::BIGINT) ELSE b END, NULL FROM turned
  UNION ALL SELECT 'step', path_id, ord, CAST(CASE WHEN handle >> 1 IN (SELECT s FROM short) THEN xor(handle, 1::BIGINT) ELSE handle END AS VARCHAR) FROM steps""", f"{SHORT}, {TURN}"))
def _(g):
    return rows(edit_graph.reorient(g, short_nodes(g)), "nodes", "edges", "steps")


@query("transform_ids", dense_sql("""SELECT 'node' AS kind, 1000000 - node_id AS a, 0::BIGINT AS b, seq AS t FROM nodes
  UNION ALL SELECT 'edge', CASE WHEN a > xor(b, 1::BIGINT) THEN xor(b, 1::BIGINT) ELSE a END, CASE WHEN a > xor(b, 1::BIGINT) THEN xor(a, 1::BIGINT) ELSE b END, NULL FROM
    (SELECT 2 * (1000000 - (l >> 1)) + (l & 1) AS a, 2 * (1000000 - (r >> 1)) + (r & 1) AS b FROM edges)
  UNION ALL SELECT 'step', path_id, ord, CAST(2 * (1000000 - (handle >> 1)) + (handle & 1) AS VARCHAR) FROM steps"""))
def _(g):
    return rows(edit_graph.relabel(g, g.nodes.select(F.col("node_id").alias("old_id"), (1000000 - F.col("node_id")).alias("new_id"))), "nodes", "edges", "steps")


@query("apply_ordering", dense_sql("""SELECT 'node' AS kind, new_id AS a, 0::BIGINT AS b, seq AS t FROM nodes JOIN m ON old_id = node_id
  UNION ALL SELECT 'step', path_id, ord, CAST(2 * new_id + (handle & 1) AS VARCHAR) FROM steps JOIN m ON old_id = handle >> 1""",
  "o AS (SELECT node_id AS new_id, row_number() OVER (ORDER BY seq, node_id) AS k FROM nodes), m AS (SELECT node_id AS old_id, new_id FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) AS k FROM nodes) JOIN o USING (k))"))
def _(g):
    from strandlake.operators.order import number_globally

    order = number_globally(g.nodes.select("seq", "node_id"), [F.col("seq"), F.col("node_id")], "rank").select("rank", "node_id")
    return rows(edit_graph.apply_ordering(g, order), "nodes", "steps")


@query("compact_ids", dense_sql("""SELECT 'node' AS kind, new_id AS a, 0::BIGINT AS b, seq AS t FROM m
  UNION ALL SELECT 'step', path_id, ord, CAST(2 * new_id + (handle & 1) AS VARCHAR) FROM steps JOIN m ON node_id = handle >> 1""",
  """pl AS (SELECT l, r, row_number() OVER (ORDER BY l, r) AS k FROM edges),
  f AS (SELECT n, min(k) AS k FROM (SELECT l >> 1 AS n, 2 * k AS k FROM pl UNION ALL SELECT r >> 1, 2 * k + 1 FROM pl) GROUP BY n),
  m AS (SELECT node_id, seq, row_number() OVER (ORDER BY k NULLS LAST, node_id) AS new_id FROM nodes LEFT JOIN f ON n = node_id)"""))
def _(g):
    return rows(edit_graph.compact_ids(g), "nodes", "steps")


@query("defragment_steps", dense_sql("""SELECT p.k AS path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord) AS ord, row_number() OVER (PARTITION BY path_id ORDER BY step_id) AS step_id, handle
  FROM (SELECT * FROM steps WHERE handle & 1 = 0) s JOIN (SELECT path_id, row_number() OVER (ORDER BY path_id) AS k FROM paths WHERE NOT circular) p USING (path_id)"""))
def _(g):
    g = edit_paths.destroy_paths(g, g.paths.where("circular").select("path_id"))
    g = edit_paths.remove_steps(g, g.steps.where(is_reverse("handle")).select("path_id", "step_id"))
    return edit_graph.defragment(g).steps


@query("create_path", dense_sql("SELECT path_id, name, circular FROM paths UNION ALL SELECT (SELECT max(path_id) FROM paths) + row_number() OVER (ORDER BY name), name, false FROM (SELECT 'copy of ' || name AS name FROM paths WHERE circular)"))
def _(g):
    names = g.paths.where("circular").select(F.concat(F.lit("copy of "), "name").alias("name")).unionByName(g.paths.select("name"))
    return edit_paths.create_paths(g, names).paths


@query("destroy_path", dense_sql("SELECT path_id, ord, step_id, handle FROM steps JOIN paths USING (path_id) WHERE NOT circular"))
def _(g):
    return edit_paths.destroy_paths(g, g.paths.where("circular").select("path_id")).steps


@query("set_circularity", dense_sql("SELECT path_id, name, NOT circular AS circular FROM paths"))
def _(g):
    return edit_paths.set_circular(g, g.paths.select("path_id", (~F.col("circular")).alias("circular"))).paths


def inserted(side: str) -> str:
    place = {"append": "1e18::BIGINT, 1", "prepend": "0::BIGINT, -1"}[side]
    return f"""SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY o, k) AS ord, handle FROM (
      SELECT path_id, ord AS o, 0 AS k, handle FROM steps UNION ALL SELECT path_id, {place.split(",")[0]}, j, 2 * j FROM paths, (VALUES (1::BIGINT), (2)) v(j))"""


def two_steps(g: Graph) -> DataFrame:
    return g.paths.select("path_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("k")).select("path_id", "k", (2 * F.col("k")).alias("handle"))


@query("append_step", dense_sql(inserted("append")))
def _(g):
    return edit_paths.insert_steps(g, two_steps(g), "append").steps.drop("step_id")


@query("prepend_step", dense_sql(inserted("prepend")))
def _(g):
    return edit_paths.insert_steps(g, two_steps(g), "prepend").steps.drop("step_id")


AFTER = "SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY o, k) AS ord, handle FROM (SELECT path_id, ord AS o, 0 AS k, handle FROM steps UNION ALL SELECT path_id, ord, {side} * j, 2 * j FROM steps, (VALUES (1::BIGINT), (2)) v(j) WHERE step_id = 2)"


@query("insert_step_after", dense_sql(AFTER.format(side="1")))
def _(g):
    return edit_paths.insert_steps(g, two_steps(g).withColumn("step_id", F.lit(2).cast("bigint")), "after").steps.drop("step_id")


@query("insert_step_before", dense_sql(AFTER.format(side="1").replace("ord, 1 * j", "ord, j - 3")))
def _(g):
    return edit_paths.insert_steps(g, two_steps(g).withColumn("step_id", F.lit(2).cast("bigint")), "before").steps.drop("step_id")


@query("remove_step", dense_sql("SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord) AS ord, step_id, handle FROM steps WHERE handle & 1 = 0"))
def _(g):
    return edit_paths.remove_steps(g, g.steps.where(is_reverse("handle")).select("path_id", "step_id")).steps


@query("flip_step", dense_sql("SELECT path_id, ord, step_id, CASE WHEN handle & 1 = 1 THEN handle - 1 ELSE handle END AS handle FROM steps"))
def _(g):
    return edit_paths.flip_steps(g, g.steps.where(is_reverse("handle")).select("path_id", "step_id")).steps


@query("rewrite_segment", dense_sql("""SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY o, k) AS ord, handle FROM (
  SELECT path_id, ord AS o, 9 AS k, handle FROM (SELECT *, max(ord) OVER (PARTITION BY path_id) AS n FROM steps) WHERE n < 2 OR ord < 2 OR (n >= 4 AND ord >= 4)
  UNION ALL SELECT path_id, 2, j, 2 * j FROM steps, (VALUES (1), (2), (3)) v(j) WHERE step_id = 2)"""))
def _(g):
    n = paths.path_lengths(g)
    seg = n.select("path_id", F.lit(2).cast("bigint").alias("from_step"), F.when(F.col("n_steps") >= 4, 4).cast("bigint").alias("to_step"), F.array(*[F.lit(2 * k).cast("bigint") for k in (1, 2, 3)]).alias("handles"))
    return edit_paths.rewrite_segments(g, seg).steps.drop("step_id")


@query("map_paths", dense_sql("SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord DESC) AS ord, handle FROM steps"))
def _(g):
    return edit_paths.map_paths(g, lambda pdf: pdf.iloc[::-1]).steps.drop("step_id")


@query("change_log", dense_sql("SELECT path_id, v.op, step_id, CASE WHEN v.op = 'remove' THEN handle ELSE handle - 1 END AS handle FROM steps, (VALUES ('remove'), ('insert')) v(op) WHERE handle & 1 = 1"))
def _(g):
    return edit_paths.changes(g, edit_paths.flip_steps(g, g.steps.where(is_reverse("handle")).select("path_id", "step_id")))


@query("replay_log", dense_sql("SELECT path_id, step_id, CASE WHEN handle & 1 = 1 THEN handle - 1 ELSE handle END AS handle FROM steps"))
def _(g):
    log = edit_paths.changes(g, edit_paths.flip_steps(g, g.steps.where(is_reverse("handle")).select("path_id", "step_id")))
    log = log.withColumn("seq_no", F.when(F.col("op") == "remove", 1).otherwise(2).cast("bigint"))
    return edit_paths.replay(g.steps.select("path_id", "step_id", "handle"), log)


# Algorithms -----------------------------------------------------------------------------------------

PERFECT = """vis AS (SELECT handle >> 1 AS n, count(*) AS c FROM steps GROUP BY 1),
both_ AS (SELECT CASE WHEN a > xor(b, 1::BIGINT) THEN xor(b, 1::BIGINT) ELSE a END AS l, CASE WHEN a > xor(b, 1::BIGINT) THEN xor(a, 1::BIGINT) ELSE b END AS r, count(*) AS c FROM links WHERE b IS NOT NULL GROUP BY 1, 2),
perf AS (SELECT e.l, e.r, e.l >> 1 <> e.r >> 1 AND coalesce(x.c, 0) = coalesce(m.c, 0) AND coalesce(y.c, 0) = coalesce(m.c, 0) AS perfect
  FROM edges e LEFT JOIN both_ m ON m.l = e.l AND m.r = e.r LEFT JOIN vis x ON x.n = e.l >> 1 LEFT JOIN vis y ON y.n = e.r >> 1)"""


@query("perfect_pairs", chains_sql("SELECT l, r, perfect FROM perf", PERFECT), chains)
def _(g):
    return runs.perfect_pairs(g)


@query("perfect_pairs_dense", dense_sql("SELECT l, r, perfect FROM perf", PERFECT))
def _(g):
    return runs.perfect_pairs(g)


RUNS = f"""{PERFECT},
outd AS (SELECT l, count(*) AS c FROM adj GROUP BY l), ind AS (SELECT r, count(*) AS c FROM adj GROUP BY r),
good AS (SELECT CASE WHEN p.l & 1 = 1 THEN p.r >> 1 ELSE p.l >> 1 END AS u, CASE WHEN p.l & 1 = 1 THEN p.l >> 1 ELSE p.r >> 1 END AS v FROM perf p JOIN outd o ON o.l = p.l JOIN ind i ON i.r = p.r WHERE perfect AND o.c = 1 AND i.c = 1),
walk(head, node, rank) AS (SELECT u, u, 1 FROM good WHERE u NOT IN (SELECT v FROM good) UNION ALL SELECT head, v, rank + 1 FROM walk JOIN good ON u = node),
runs AS (SELECT min(node) OVER (PARTITION BY head) AS run_id, node, rank, head FROM walk)"""


@query("simple_components", chains_sql("SELECT run_id, CAST(rank AS BIGINT) AS rank, 2 * node AS handle FROM runs", RUNS, recursive=True), chains)
def _(g):
    return runs.simple_components(g, 2)


@query("components", chains_sql("SELECT n AS node_id, CAST(min(m) AS BIGINT) AS component FROM reach GROUP BY n", """
pairs AS (SELECT DISTINCT l >> 1 AS u, r >> 1 AS v FROM edges UNION SELECT DISTINCT r >> 1, l >> 1 FROM edges),
reach(n, m) AS (SELECT node_id, node_id FROM nodes WHERE node_id IN (SELECT min(node_id) FROM nodes) OR node_id NOT IN (SELECT u FROM pairs)
  UNION SELECT v, m FROM reach JOIN pairs ON u = n)""", recursive=True), chains)
def _(g):
    return runs.components(g)


UNCHOP = RUNS + """,
rank_of AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS k FROM nodes),
newid AS (SELECT run_id, (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY run_id) AS id FROM (SELECT DISTINCT run_id FROM runs)),
merged AS (SELECT id AS node_id, string_agg(seq, '' ORDER BY rank) AS seq, avg(k) AS mean FROM runs JOIN newid USING (run_id) JOIN nodes n ON n.node_id = node JOIN rank_of q ON q.node_id = node GROUP BY id),
kept AS (SELECT n.node_id, seq, CAST(k AS DOUBLE) AS mean FROM nodes n JOIN rank_of USING (node_id) WHERE n.node_id NOT IN (SELECT node FROM runs)),
allof AS (SELECT * FROM merged UNION ALL SELECT * FROM kept),
perm AS (SELECT a.node_id AS old_id, b.node_id AS new_id FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) AS k FROM allof) a JOIN (SELECT node_id, row_number() OVER (ORDER BY mean DESC, node_id) AS k FROM allof) b USING (k))"""


@query("unchop_nodes", chains_sql("SELECT new_id AS node_id, seq FROM allof JOIN perm ON old_id = node_id", UNCHOP, recursive=True), chains)
def _(g):
    return runs.unchop(g).nodes


@query("unchop_paths", chains_sql("""SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord) AS ord, 2 * new_id + (handle & 1) AS handle FROM
  (SELECT path_id, ord, handle, coalesce(id, handle >> 1) AS n FROM steps LEFT JOIN runs ON node = handle >> 1 LEFT JOIN newid USING (run_id) WHERE rank IS NULL OR rank = 1) JOIN perm ON old_id = n""", UNCHOP, recursive=True), chains)
def _(g):
    return runs.unchop(g).steps.drop("step_id")


# Consensus: the paths of customers with a negative balance are the consensus, in the order of their ids.

LINKS = f"""chosen AS (SELECT c_custkey AS path_id, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer WHERE c_acctbal < 0),
cons AS (SELECT handle >> 1 AS node_id, min(path_id) AS cons FROM steps JOIN chosen USING (path_id) GROUP BY 1),
{POS.split(", bp AS")[0]},
lay AS (SELECT node_id, CAST(sum(length(seq)) OVER (ORDER BY node_id) - length(seq) AS BIGINT) AS start, length(seq) AS len FROM nodes),
onc AS (SELECT p.path_id, p.ord, cons, begin0, p.len, p.handle >> 1 AS node_id, CASE WHEN handle & 1 = 1 THEN start + lay.len ELSE start END AS a, CASE WHEN handle & 1 = 1 THEN start ELSE start + lay.len END AS z
  FROM pos p JOIN cons c ON c.node_id = p.handle >> 1 JOIN lay ON lay.node_id = p.handle >> 1 WHERE p.path_id NOT IN (SELECT path_id FROM chosen)),
lagged AS (SELECT path_id, lag(ord) OVER w AS begin_ord, ord AS end_ord, lag(cons) OVER w AS c0, cons AS c1, lag(node_id) OVER w AS n0, node_id AS n1,
  begin0 - lag(begin0) OVER w - lag(len) OVER w AS length, abs(a - lag(z) OVER w) AS jump_len FROM onc WINDOW w AS (PARTITION BY path_id ORDER BY ord)),
cand AS (SELECT * FROM lagged WHERE begin_ord IS NOT NULL AND (c0 <> c1 OR jump_len >= 50)),
spelled AS (SELECT c.path_id, c.begin_ord, string_agg(CASE WHEN s.handle & 1 = 1 THEN {RC} ELSE seq END, '' ORDER BY s.ord) AS t
  FROM cand c JOIN steps s ON s.path_id = c.path_id AND s.ord > c.begin_ord AND s.ord < c.end_ord JOIN nodes n ON n.node_id = s.handle >> 1 GROUP BY 1, 2)"""


def consensus_paths(g: Graph, spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0")
    return own.select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("path_id"))


def _links(spark, sf_dir):
    g = chains(spark, sf_dir)
    return consensus.link_candidates(g, consensus_paths(g, spark, sf_dir), 50)


def _best(spark, sf_dir):
    g = runs._fixed(chains(spark, sf_dir))
    links = materialize(consensus.link_candidates(g, consensus_paths(g, spark, sf_dir), 50), "candidates")
    return consensus.best_links(g, links, 50, 10_000)[0].drop("link_id")


register("consensus_links", _links, chains_sql("""SELECT least(c0, c1) AS from_path, greatest(c0, c1) AS to_path, c.path_id, c.begin_ord, end_ord, length,
  md5(concat_ws(':', n0, n1, coalesce(t, ''))) AS hash, jump_len FROM cand c LEFT JOIN spelled s ON s.path_id = c.path_id AND s.begin_ord = c.begin_ord""", LINKS))
register("consensus_best_links", _best)


# Files and checks ---------------------------------------------------------------------------------

SIGN = "CASE WHEN {0} & 1 = 1 THEN '-' ELSE '+' END"


@query("gfa_lines", dense_sql(f"""SELECT 'H' || chr(9) || 'VN:Z:1.0' AS line UNION ALL SELECT concat_ws(chr(9), 'S', node_id, seq) FROM nodes
  UNION ALL SELECT concat_ws(chr(9), 'L', l >> 1, {SIGN.format('l')}, r >> 1, {SIGN.format('r')}, '0M') FROM edges
  UNION ALL SELECT concat_ws(chr(9), 'P', name, coalesce(string_agg((handle >> 1) || {SIGN.format('handle')}, ',' ORDER BY ord), ''), '*') FROM paths LEFT JOIN steps USING (path_id) GROUP BY path_id, name"""))
def _(g):
    return gfa.gfa_lines(g).select("line")


@query("gfa_round_trip", dense_sql("""SELECT 'node' AS kind, node_id AS a, 0::BIGINT AS b, seq AS t FROM nodes UNION ALL SELECT 'edge', l, r, NULL FROM edges
  UNION ALL SELECT 'step', k, ord, CAST(handle AS VARCHAR) FROM steps JOIN (SELECT path_id, row_number() OVER (ORDER BY name) - 1 AS k FROM paths) USING (path_id)"""))
def _(g):
    lines = materialize(gfa.gfa_lines(g).select(F.col("line").alias("value")), "lines")  # as a file is; every kind of record reads it
    return rows(gfa.parse_lines(lines), "nodes", "edges", "steps")


@query("validate", dense_sql("""SELECT 'empty sequence' AS problem, CAST(node_id AS VARCHAR) AS subject FROM nodes WHERE seq = ''
  UNION ALL SELECT 'step without node', concat_ws(',', path_id, ord, handle) FROM steps WHERE handle >> 1 IN (SELECT s FROM short)
  UNION ALL SELECT 'edge without node', concat_ws(',', l, r, m) FROM (SELECT l, r, (l >> 1) * 2 AS m FROM edges UNION SELECT l, r, (r >> 1) * 2 FROM edges) WHERE m >> 1 IN (SELECT s FROM short)""", SHORT))
def _(g):
    return validate.violations(g.having(nodes=g.nodes.where("length(seq) > 2")))


@query("golden_rows", dense_sql("""SELECT 'node' AS kind, concat_ws(chr(9), node_id, seq, coalesce(lt, ''), coalesce(rt, '')) AS row FROM nodes
  LEFT JOIN (SELECT r, string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) AS lt FROM adj GROUP BY r) ON r = 2 * node_id LEFT JOIN (SELECT l, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS rt FROM adj GROUP BY l) ON l = 2 * node_id
  UNION ALL SELECT 'path', concat_ws(chr(9), name, coalesce(string_agg(CAST(handle AS VARCHAR), ',' ORDER BY ord), '')) FROM paths LEFT JOIN steps USING (path_id) GROUP BY path_id, name
  UNION ALL SELECT 'occurrence', concat_ws(chr(9), handle >> 1, name, ord) FROM steps JOIN paths USING (path_id)"""))
def _(g):
    return gfa.golden_rows(g)
