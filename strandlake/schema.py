"""The four tables of a sequence graph.

``nodes(node_id, seq)``, ``edges(l, r)`` in canonical form without repeats, ``paths(path_id, name,
circular)`` and ``steps(path_id, ord, step_id, handle)``.  A handle is an oriented node,
``2 * node_id + reverse``; ``ord`` counts a path's steps from 1 without gaps, ``step_id`` names a
step for good, whatever is inserted around it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

NODES = "node_id bigint, seq string"
EDGES = "l bigint, r bigint"
PATHS = "path_id bigint, name string, circular boolean"
STEPS = "path_id bigint, ord bigint, step_id bigint, handle bigint"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    steps: DataFrame

    def having(self, **tables: DataFrame) -> Graph:
        """This graph with some tables replaced."""
        return replace(self, **tables)

    def persist(self) -> Graph:
        return Graph(*(t.persist() for t in (self.nodes, self.edges, self.paths, self.steps)))


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (NODES, EDGES, PATHS, STEPS)))


def from_rows(spark: SparkSession, nodes, edges=(), paths=()) -> Graph:
    """A small graph from Python rows: (id, seq); handle pairs; (path_id, name, circular, [handles])."""
    from strandlake.functions.handles import canonical_edges

    steps = [(p[0], i, i, h) for p in paths for i, h in enumerate(p[3], 1)]
    return Graph(
        spark.createDataFrame(list(nodes), NODES),
        canonical_edges(spark.createDataFrame(list(edges), EDGES)),
        spark.createDataFrame([tuple(p[:3]) for p in paths], PATHS),
        spark.createDataFrame(steps, STEPS),
    )
