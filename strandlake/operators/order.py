"""Ordered operations inside groups, where a group may hold a large part of all rows.

A group's rows are cut into blocks of consecutive ordinals.  Windows run inside blocks; a
table with one row per block carries totals and ends over to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 18
#: Rows that one task sorts or groups, about, where a table is dealt out by its size.
TASK_ROWS = 1 << 19


def _block(ordinal: Column) -> Column:
    return F.floor(ordinal / F.lit(BLOCK))


def parts_for(rows: int, spark: SparkSession) -> int:
    """Parts of a table of so many rows, so that what a task holds doesn't grow with the table; not fewer than shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def prefix_sum(df: DataFrame, group: list[str], ordinal: str, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group (0 for the first)."""
    d = df.withColumns({"_b": _block(F.col(ordinal)), "_v": value})
    totals = d.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).where("_base != 0").drop("_t")
    inside = Window.partitionBy(*group, "_b").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(totals, [*group, "_b"], "left")
    return d.select(*df.columns, (F.col("_in") + F.coalesce("_base", F.lit(0))).cast("bigint").alias(out))


def neighbours(df: DataFrame, group: list[str], ordinal: str, value: str, nxt: str | None = None, prev: str | None = None) -> DataFrame:
    """Add the value of the next and of the previous row of the group; ordinals have no gaps.

    A row at the border of a block is also put into the block on the other side, so one sort serves for both.
    """
    own = _block(F.col(ordinal))
    blocks = F.array(own)
    for name, step in ((nxt, -1), (prev, 1)):
        if name:
            other = _block(F.col(ordinal) + step)
            blocks = F.when(other != own, F.concat(blocks, F.array(other))).otherwise(blocks)
    d = df.withColumn("_b", F.explode(blocks))
    w = Window.partitionBy(*group, "_b").orderBy(ordinal)
    found = {name: f(value).over(w) for name, f in ((nxt, F.lead), (prev, F.lag)) if name}
    return d.withColumns(found).where(F.col("_b") == own).select(*df.columns, *found)


def rank_rows(df: DataFrame, group: list[str], order: list[Column], out: str = "ord") -> DataFrame:
    """Number the rows of every group from 1 in ``order``."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def number_globally(df: DataFrame, order: list[Column], out: str, first: int = 1) -> DataFrame:
    """Number all rows in ``order``: a range partitioning, numbers inside each part, and the parts' bases.

    The order must have no ties, so that a repeated task numbers alike.
    """
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    from strandlake.plans.scratch import materialize

    parts = materialize(parts, "ranges")
    sizes = parts.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    bases = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_p").orderBy(*order)
    numbered = parts.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(bases), "_p")
    return numbered.select(*df.columns, (F.col("_base") + F.col("_r") + F.lit(first - 1)).cast("bigint").alias(out))
