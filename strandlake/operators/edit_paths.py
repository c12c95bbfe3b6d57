"""Edits of paths in sets.  Step ids of kept steps never change; ``ord`` is numbered anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.handles import flip
from strandlake.operators.order import number_globally, rank_rows
from strandlake.schema import Graph


def create_paths(g: Graph, names: DataFrame) -> Graph:
    """Add empty paths (name, optional circular); a name in use is skipped.  Ids go on from the largest ever used."""
    new = names.select("name", (F.col("circular") if "circular" in names.columns else F.lit(False)).alias("circular"))
    new = new.groupBy("name").agg(F.max("circular").alias("circular")).join(g.paths.select("name"), "name", "left_anti")
    top = g.paths.agg(F.max("path_id")).first()[0]
    new = number_globally(new, [F.col("name")], "path_id", 0 if top is None else top + 1)
    return g.having(paths=g.paths.unionByName(new))


def destroy_paths(g: Graph, ids: DataFrame) -> Graph:
    ids = ids.select("path_id").distinct()
    return g.having(paths=g.paths.join(ids, "path_id", "left_anti"), steps=g.steps.join(ids, "path_id", "left_anti"))


def set_circular(g: Graph, flags: DataFrame) -> Graph:
    """``flags`` (path_id, circular) replace the paths' own."""
    f = flags.select("path_id", F.col("circular").alias("_c"))
    return g.having(paths=g.paths.join(f, "path_id", "left").select("path_id", "name", F.coalesce("_c", "circular").alias("circular")))


def flip_steps(g: Graph, chosen: DataFrame) -> Graph:
    """Flip the handles of steps (path_id, step_id)."""
    c = chosen.select("path_id", "step_id").distinct().withColumn("_f", F.lit(True))
    s = g.steps.join(c, ["path_id", "step_id"], "left")
    return g.having(steps=s.select("path_id", "ord", "step_id", F.when(F.col("_f"), flip("handle")).otherwise(F.col("handle")).alias("handle")))


def _renumbered(g: Graph, rows: DataFrame, order: list[Column]) -> Graph:
    """Steps from rows (path_id, step_id or null for new ones, handle and the order's columns).

    New steps are numbered on from the path's largest step id, in path order.
    """
    top = g.steps.groupBy("path_id").agg(F.max("step_id").alias("_top"))
    rows = rank_rows(rows, ["path_id"], order, "_ord")
    new = rank_rows(rows.where("step_id is null"), ["path_id"], [F.col("_ord")], "_k").join(top, "path_id", "left")
    new = new.withColumn("step_id", F.coalesce("_top", F.lit(0)) + F.col("_k"))
    cols = [F.col("path_id"), F.col("_ord").alias("ord"), F.col("step_id"), F.col("handle")]
    return g.having(steps=rows.where("step_id is not null").select(*cols).unionByName(new.select(*cols)))


def remove_steps(g: Graph, chosen: DataFrame) -> Graph:
    left = g.steps.join(chosen.select("path_id", "step_id").distinct(), ["path_id", "step_id"], "left_anti")
    return _renumbered(g, left, [F.col("ord")])


def insert_steps(g: Graph, new: DataFrame, where: str = "append") -> Graph:
    """Insert rows of ``new`` (path_id, handle, k; and step_id for ``after`` and ``before``) in the order of k.

    ``where``: ``append`` at the end, ``prepend`` at the beginning (k runs towards the old first
    step), or ``after`` or ``before`` the given step.  Rows for unknown paths or steps are dropped.
    """
    known = new.join(g.paths.select("path_id"), "path_id", "left_semi")
    if where in ("after", "before"):
        at = g.steps.select("path_id", "step_id", F.col("ord").alias("_at"))
        known = known.join(at, ["path_id", "step_id"]).drop("step_id")
    else:
        known = known.withColumn("_at", F.lit(None if where == "append" else 0).cast("bigint"))
    side = {"append": 1, "after": 1, "before": -1, "prepend": -1}[where]
    rows = known.select("path_id", F.lit(None).cast("bigint").alias("step_id"), "handle", F.col("_at").alias("ord"), F.lit(side).alias("_side"), F.col("k").cast("bigint").alias("k"))
    old = g.steps.select("path_id", "step_id", "handle", "ord", F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("k"))
    return _renumbered(g, old.unionByName(rows), [F.col("ord").asc_nulls_last(), F.col("_side"), F.col("k")])


def rewrite_segments(g: Graph, segments: DataFrame, *, end_inclusive: bool = False) -> Graph:
    """Replace runs of steps: ``segments`` (path_id, from_step, to_step, handles), one per path.

    The run goes from ``from_step`` up to ``to_step``, without it unless ``end_inclusive``; a null
    ``to_step`` is the end of the path.  Equal ends give an insertion before the step (without
    ``end_inclusive``).  A segment whose end comes before its start, or with an unknown step, is
    left out.
    """
    s = g.steps
    seg = segments.join(s.select("path_id", F.col("step_id").alias("from_step"), F.col("ord").alias("_lo")), ["path_id", "from_step"])
    seg = seg.join(s.select("path_id", F.col("step_id").alias("to_step"), F.col("ord").alias("_to")), ["path_id", "to_step"], "left")
    stop = F.col("_to") + F.lit(1 if end_inclusive else 0)
    seg = seg.withColumn("_hi", F.when(F.col("to_step").isNull(), F.lit((1 << 62))).otherwise(stop)).where("_hi >= _lo")
    bounds = seg.select("path_id", "_lo", "_hi")
    old = s.join(bounds, "path_id", "left").where("_lo is null or ord < _lo or ord >= _hi")
    # what is new comes before the first old step that is kept after it
    old = old.select("path_id", "step_id", "handle", "ord", F.lit(1).alias("_side"), F.lit(0).alias("k"))
    new = seg.select("path_id", F.lit(None).cast("bigint").alias("step_id"), F.posexplode("handles").alias("k", "handle"), F.col("_lo").alias("ord"), F.lit(0).alias("_side"))
    return _renumbered(g, old.unionByName(new.select(*old.columns)), [F.col("ord"), F.col("_side"), F.col("k")])


# Bulk edits by user code, and change logs ------------------------------------------------------


def _each_path(fn) -> Callable[[Iterator], Iterator]:
    """``fn`` for every path of frames whose rows come path by path, in path order.

    What a path costs besides ``fn`` is kept small: its frame is a view, and results leave in large batches.
    """

    def run(frames):
        import numpy as np
        import pandas as pd

        names = pd.Index(["path_id", "ord", "step_id", "handle"])

        def changed(rows):
            ids = rows[:, 0]
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            out = [fn(pd.DataFrame(rows[a:b], columns=names)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)])]
            n = np.array([len(x) for x in out])
            place = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + 1
            return pd.DataFrame({"path_id": np.concatenate([x["path_id"].to_numpy() for x in out]), "ord": place, "step_id": place, "handle": np.concatenate([x["handle"].to_numpy() for x in out])})

        open_ = []  # rows of a path that may go on
        for frame in frames:
            rows = frame.to_numpy()
            if not len(rows):
                continue
            ends = np.flatnonzero(rows[:, 0] != rows[-1, 0])
            if len(ends):
                yield changed(np.concatenate([*open_, rows[: ends[-1] + 1]]))
                open_ = []
            elif open_ and open_[-1][-1, 0] != rows[-1, 0]:
                yield changed(np.concatenate(open_))
                open_ = []
            open_.append(rows[ends[-1] + 1 :] if len(ends) else rows)
        if open_:
            yield changed(np.concatenate(open_))

    return run


def map_paths(g: Graph, fn, only: DataFrame | None = None) -> Graph:
    """Run ``fn`` on the steps of each path (a pandas frame in path order) and take its ``handle`` column.

    The escape hatch for edits that tables can't express: a path must fit a task's memory.
    """
    own = g.steps if only is None else g.steps.join(only.select("path_id").distinct(), "path_id", "left_semi")

    rows = own.select("path_id", "ord", "step_id", "handle").repartition("path_id").sortWithinPartitions("path_id", "ord")
    changed = rows.mapInPandas(_each_path(fn), "path_id bigint, ord bigint, step_id bigint, handle bigint")
    rest = g.steps.limit(0) if only is None else g.steps.join(only.select("path_id").distinct(), "path_id", "left_anti")
    return g.having(steps=rest.unionByName(changed))


def map_paths_with(g: Graph, values: DataFrame, fn) -> Graph:
    """:func:`map_paths` with a value for each path: ``values`` has one row (rank, ...) per path in id order."""
    ranked = number_globally(g.paths.select("path_id"), [F.col("path_id")], "rank").join(values, "rank")

    def run(key, steps, own):
        if steps.empty or own.empty:
            return steps[["path_id", "ord", "step_id", "handle"]]
        out = fn(steps.sort_values("ord").reset_index(drop=True), own.iloc[0])[["path_id", "handle"]].reset_index(drop=True)
        out["ord"] = out.index + 1
        out["step_id"] = out["ord"]
        return out[["path_id", "ord", "step_id", "handle"]]

    both = g.steps.groupBy("path_id").cogroup(ranked.groupBy("path_id"))
    return g.having(steps=both.applyInPandas(run, "path_id bigint, ord bigint, step_id bigint, handle bigint"))


def changes(before: Graph, after: Graph) -> DataFrame:
    """The change log between two states: ``(path_id, op, step_id, handle)``, removals first."""
    old = before.steps.select("path_id", "step_id", "handle")
    new = after.steps.select("path_id", "step_id", "handle")
    gone = old.join(new, ["path_id", "step_id", "handle"], "left_anti").withColumn("op", F.lit("remove"))
    come = new.join(old, ["path_id", "step_id", "handle"], "left_anti").withColumn("op", F.lit("insert"))
    return gone.unionByName(come).select("path_id", "op", "step_id", "handle")


def replay(occurrences: DataFrame, log: DataFrame) -> DataFrame:
    """Occurrences (path_id, step_id, handle) after a log (seq_no, path_id, op, step_id, handle): the last entry of a step wins."""
    last = log.groupBy("path_id", "step_id").agg(F.max_by(F.struct("op", "handle"), "seq_no").alias("x"))
    kept = occurrences.join(last.select("path_id", "step_id"), ["path_id", "step_id"], "left_anti")
    new = last.where("x.op = 'insert'").select("path_id", "step_id", F.col("x.handle").alias("handle"))
    return kept.select("path_id", "step_id", "handle").unionByName(new)
