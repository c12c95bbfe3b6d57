"""Streaming ingestion of graph text and of step change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.handles import canonical, pack
from strandlake.operators.edit_paths import replay


def stream_gfa(spark: SparkSession, folder: str, out: str, *, checkpoint: str):
    """Append the records of text files that arrive in ``folder`` to Parquet tables under ``out``.

    One pass per micro-batch.  A batch that runs again overwrites its own part.  Edges
    may repeat over batches and paths have their name as key: :func:`settle` makes a graph of it.
    """

    def batch(lines: DataFrame, number: int) -> None:
        f = lines.select(F.split("value", "\t").alias("f")).persist()
        tables = {
            "nodes": f.where(F.get("f", F.lit(0)) == "S").select(F.get("f", F.lit(1)).try_cast("bigint").alias("node_id"), F.get("f", F.lit(2)).alias("seq")),
            "edges": f.where(F.get("f", F.lit(0)) == "L").select(canonical(pack(F.get("f", F.lit(1)).try_cast("bigint"), F.get("f", F.lit(2)) == "-"), pack(F.get("f", F.lit(3)).try_cast("bigint"), F.get("f", F.lit(4)) == "-")).alias("e")).select("e.l", "e.r"),
            "walks": f.where(F.get("f", F.lit(0)) == "P").select(F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("walk")),
        }
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        f.unpersist()

    return spark.readStream.text(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle(spark: SparkSession, out: str):
    """The graph of what :func:`stream_gfa` has stored."""
    from strandlake.sources.gfa import parse_lines

    tab = F.lit("\t")
    n = spark.read.parquet(f"{out}/nodes").select(F.concat(F.lit("S"), tab, "node_id", tab, "seq").alias("value"))
    p = spark.read.parquet(f"{out}/walks").select(F.concat(F.lit("P"), tab, "name", tab, "walk", tab, F.lit("*")).alias("value"))
    g = parse_lines(n.unionByName(p))
    return g.having(edges=spark.read.parquet(f"{out}/edges").select("l", "r").distinct())


def stream_changes(spark: SparkSession, log_folder: str, state: str, *, checkpoint: str):
    """Apply a log of step changes (Parquet files) to the occurrence table under ``state``, one version per batch."""

    schema = "seq_no bigint, path_id bigint, op string, step_id bigint, handle bigint"

    def batch(log: DataFrame, number: int) -> None:
        before = spark.read.schema("path_id bigint, step_id bigint, handle bigint").parquet(f"{state}/v{number}")
        replay(before, log).write.mode("overwrite").parquet(f"{state}/v{number + 1}")

    return spark.readStream.schema(schema).parquet(log_folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
