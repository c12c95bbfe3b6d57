"""Path look-ups, navigation, occurrences and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.dna import oriented
from strandlake.functions.handles import flip, is_reverse, node_of
from strandlake.operators.order import neighbours, prefix_sum
from strandlake.schema import Graph


def find_paths(g: Graph, names: DataFrame, col: str = "name") -> DataFrame:
    """``names`` with ``path_id``, null for a name that no path has."""
    p = g.paths.select(F.col("name").alias("_n"), "path_id")
    return names.join(p, F.col(col) == F.col("_n"), "left").select(*names.columns, "path_id")


def path_lengths(g: Graph) -> DataFrame:
    """``(path_id, name, circular, n_steps)`` of all paths, with 0 for empty ones."""
    n = g.steps.groupBy("path_id").agg(F.count("*").alias("n_steps"))
    return g.paths.join(n, "path_id", "left").select("path_id", "name", "circular", F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def path_ends(g: Graph) -> DataFrame:
    """``(path_id, first_step, last_step)``, null for an empty path."""
    n = g.steps.groupBy("path_id").agg(F.min_by("step_id", "ord").alias("first_step"), F.max_by("step_id", "ord").alias("last_step"))
    return g.paths.select("path_id").join(n, "path_id", "left")


def handles_at(g: Graph, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path_id, step_id) with ``handle``, null where there is no such step."""
    s = g.steps.select("path_id", "step_id", "handle")
    return wanted.join(s, ["path_id", "step_id"], "left")


def next_and_previous(g: Graph) -> DataFrame:
    """Every step with ``next_step`` and ``prev_step``, null at the ends."""
    return neighbours(g.steps, ["path_id"], "ord", "step_id", "next_step", "prev_step")


def with_next_handle(steps: DataFrame) -> DataFrame:
    """Every step but the last of a path, with ``next_handle``."""
    return neighbours(steps, ["path_id"], "ord", "handle", nxt="next_handle").where("next_handle is not null")


def reversed_steps(g: Graph) -> DataFrame:
    """Every path read from its other end: ``(path_id, rev_ord, handle)`` with flipped handles."""
    n = g.steps.groupBy("path_id").agg(F.max("ord").alias("_n"))
    return g.steps.join(n, "path_id").select("path_id", (F.col("_n") - F.col("ord") + 1).alias("rev_ord"), flip("handle").alias("handle"))


def steps_between(g: Graph, ranges: DataFrame) -> DataFrame:
    """Steps of ``ranges`` (path_id, from_step, to_step), both ends in; an unknown end is the path's."""
    s = g.steps
    lo = s.select("path_id", F.col("step_id").alias("from_step"), F.col("ord").alias("_lo"))
    hi = s.select("path_id", F.col("step_id").alias("to_step"), F.col("ord").alias("_hi"))
    r = ranges.select("path_id", "from_step", "to_step").join(lo, ["path_id", "from_step"], "left").join(hi, ["path_id", "to_step"], "left")
    j = s.join(r, "path_id").where((F.col("_lo").isNull() | (F.col("ord") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("ord") <= F.col("_hi"))))
    return j.select("path_id", "from_step", "to_step", "ord", "step_id", "handle")


def contains(g: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs`` (path_id, handle) with ``present``: some step has that oriented handle."""
    s = g.steps.select("path_id", "handle").distinct().withColumn("_p", F.lit(True))
    return pairs.join(s, ["path_id", "handle"], "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def occurrences(g: Graph, nodes: DataFrame | None = None) -> DataFrame:
    """``(node_id, path_id, step_id, reverse)`` of all steps, or of those on ``nodes``, in either orientation."""
    s = g.steps.select(node_of("handle").alias("node_id"), "path_id", "step_id", is_reverse("handle").alias("reverse"))
    return s if nodes is None else s.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def occurrence_counts(g: Graph) -> DataFrame:
    """``(node_id, n_steps, n_paths)`` of every node."""
    n = occurrences(g).groupBy("node_id").agg(F.count("*").alias("n_steps"), F.countDistinct("path_id").alias("n_paths"))
    zero = F.lit(0)
    return g.nodes.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("n_steps", zero).alias("n_steps"), F.coalesce("n_paths", zero).alias("n_paths"))


# Coordinates ---------------------------------------------------------------------------------


def _with_lengths(g: Graph) -> DataFrame:
    n = g.nodes.select(F.col("node_id").alias("_n"), F.length("seq").cast("bigint").alias("len"))
    return g.steps.join(n, node_of(F.col("handle")) == F.col("_n")).drop("_n")


def positions(g: Graph) -> DataFrame:
    """Every step with ``begin0`` and ``begin1``, the 0-based and 1-based place of its first base, and ``len``."""
    d = prefix_sum(_with_lengths(g), ["path_id"], "ord", F.col("len"), "begin0")
    return d.withColumn("begin1", F.col("begin0") + 1)


def path_bases(g: Graph) -> DataFrame:
    """``(path_id, n_bases, end1)``; end1 is the 1-based place after the last base."""
    n = _with_lengths(g).groupBy("path_id").agg(F.sum("len").alias("_b"))
    b = F.coalesce("_b", F.lit(0))
    return g.paths.select("path_id").join(n, "path_id", "left").select("path_id", b.alias("n_bases"), (b + 1).alias("end1"))


def step_at_base(g: Graph, wanted: DataFrame, pos: str = "pos", *, bucket: int = 1024) -> DataFrame:
    """``wanted`` (path_id, pos) with the step that covers the 0-based place, null outside the path.

    Steps are cut at bucket borders, so the join is on (path, bucket) and a hot path is many keys.
    """
    p = positions(g).where("len > 0").select("path_id", "step_id", "begin0", (F.col("begin0") + F.col("len")).alias("_end"))
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin0") / bucket), F.floor((F.col("_end") - 1) / bucket))))
    w = wanted.withColumn("_b", F.floor(F.col(pos) / bucket))
    hit = w.alias("w").join(p.alias("p"), (F.col("w.path_id") == F.col("p.path_id")) & (F.col("w._b") == F.col("p._b")) & (F.col(f"w.{pos}") >= F.col("p.begin0")) & (F.col(f"w.{pos}") < F.col("p._end")), "left")
    return hit.select(*[F.col(f"w.{c}").alias(c) for c in wanted.columns], F.col("p.step_id").alias("step_id"))


def step_as_of_base(g: Graph, wanted: DataFrame, pos: str = "pos") -> DataFrame:
    """``wanted`` (path_id, pos) with the last step that begins at or before the 1-based place.

    Null before the first base and beyond the end of the path.  Of several steps that begin
    alike (empty sequences) the last one is taken.
    """
    before_end = path_bases(g).select("path_id", "end1")
    w = wanted.join(before_end, "path_id", "left").withColumn("_pos0", F.least(F.col(pos), F.col("end1") - 1) - 1)
    found = step_at_base(g, w, "_pos0")
    ok = (F.col(pos) >= 1) & (F.col(pos) <= F.col("end1"))
    return found.select(*wanted.columns, F.when(ok, F.col("step_id")).alias("step_id"))


def handle_positions(g: Graph, handles: DataFrame) -> DataFrame:
    """``(handle, path_id, step_id, begin1)`` of all steps on the nodes of ``handles``; others give no row."""
    p = positions(g).select(node_of("handle").alias("_n"), "path_id", "step_id", "begin1")
    return handles.select("handle").distinct().join(p, node_of(F.col("handle")) == F.col("_n")).drop("_n")


def path_sequences(g: Graph) -> DataFrame:
    """``(path_id, seq)``: the bases a path spells, empty for an empty path."""
    n = g.nodes.select(F.col("node_id").alias("_n"), "seq")
    s = g.steps.join(n, node_of(F.col("handle")) == F.col("_n")).select("path_id", F.struct("ord", oriented("seq", is_reverse("handle")).alias("s")).alias("x"))
    spelled = s.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("_s"))
    return g.paths.select("path_id").join(spelled, "path_id", "left").select("path_id", F.coalesce("_s", F.lit("")).alias("seq"))
