"""Integrity checks: an empty result is a valid graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.handles import canonical, node_of
from strandlake.operators.scan import dangling_edges
from strandlake.schema import Graph


def violations(g: Graph) -> DataFrame:
    """``(problem, subject)`` for every broken rule."""

    def found(df: DataFrame, problem: str, *subject) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.concat_ws(",", *subject).alias("subject"))

    known = g.nodes.select(F.col("node_id").alias("_n"))
    twice = lambda df, *key: df.groupBy(*key).count().where("count > 1")
    c = canonical("l", "r")
    gaps = g.steps.groupBy("path_id").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo != 1 or hi != n")
    parts = [
        found(twice(g.nodes, "node_id"), "node id twice", "node_id"),
        found(g.nodes.where("node_id is null or node_id <= 0"), "bad node id", F.coalesce(F.col("node_id").cast("string"), F.lit("null"))),
        found(g.nodes.where("seq is null or seq = ''"), "empty sequence", "node_id"),
        found(twice(g.edges, "l", "r"), "edge twice", "l", "r"),
        found(g.edges.where((c["l"] != F.col("l")) | (c["r"] != F.col("r"))), "edge not canonical", "l", "r"),
        found(dangling_edges(g), "edge without node", "l", "r", "missing"),
        found(twice(g.paths, "name"), "path name twice", "name"),
        found(twice(g.paths, "path_id"), "path id twice", "path_id"),
        found(g.steps.join(known, node_of(F.col("handle")) == F.col("_n"), "left_anti"), "step without node", "path_id", "ord", "handle"),
        found(g.steps.join(g.paths.select("path_id"), "path_id", "left_anti"), "step without path", "path_id", "ord"),
        found(twice(g.steps, "path_id", "ord"), "ordinal twice", "path_id", "ord"),
        found(twice(g.steps, "path_id", "step_id"), "step id twice", "path_id", "step_id"),
        found(gaps, "ordinals with gaps", "path_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
