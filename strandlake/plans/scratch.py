"""Tables that cut lineage, kept in the folder that the cluster's executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only a plain local session
(tests) may leave it unset; then a temporary folder serves, since driver and executors
are one process there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder as a URI, created and set on first use in a local session."""
    found = spark.conf.get(_KEY, None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="strandlake-")
    spark.conf.set(_KEY, own)
    return own


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Table:
    """A written table: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, tag)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


#: Paths that lazy results still read; they are deleted when the session's process ends.
_HELD: list[tuple[SparkSession, str]] = []


def hold(spark: SparkSession, path: str) -> None:
    """Keep ``path`` for results that are read later, until the process ends."""
    if not _HELD:
        atexit.register(_release)
    _HELD.append((spark, path))


def _release() -> None:
    while _HELD:
        spark, path = _HELD.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone, and its folder may have, too
            return


class Scope:
    """Scratch tables that go together: at the end of a ``with`` block all but those kept are deleted.

    A kept table is what a lazy result reads; it stays until the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def table(self, df: DataFrame, tag: str = "step") -> DataFrame:
        """``df``, written; the shuffle files that made it go as soon as nothing else refers to them."""
        made = Table(df, tag)
        self.tables.append(made)
        del df
        self.spark.sparkContext._jvm.System.gc()  # Spark deletes shuffle files when the driver's references to them are collected
        return made.df

    def instead(self, old: DataFrame, df: DataFrame, tag: str = "step") -> DataFrame:
        """``df``, written, in place of this scope's table ``old``, which is deleted: what is not read again takes no disk."""
        made = self.table(df, tag)
        for t in self.tables:
            if t.df is old:
                self.tables.remove(t)
                t.drop()
                return made
        raise ValueError("not a table of this scope")

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` itself, which must be one of this scope's tables, to be read after the end."""
        for t in self.tables:
            if t.df is df:
                self.tables.remove(t)
                hold(self.spark, t.path)
                return df
        raise ValueError("not a table of this scope")

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        for t in self.tables:
            t.drop()
        self.tables = []


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` once and read it back, so that later plans start from the files; the table stays until the process ends."""
    made = Table(df, tag)
    hold(made.spark, made.path)
    return made.df
