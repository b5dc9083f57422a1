"""Reliable intermediate tables.

Iterative operators cut their lineage by writing a table to the shared folder
named in ``spark.checkpoint.dir`` and reading it back. The rows are computed
once, survive the loss of any executor, and come back with file sizes the
planner can use to choose join strategies.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        root = tempfile.mkdtemp(prefix="taxoloom-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/taxoloom-{app}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a DataFrame that scans the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Settled:
    """A settled table that is removed once what was made from it is written."""

    def __init__(self, df: DataFrame, name: str):
        self._spark, self._path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.parquet(self._path)
        self.df = self._spark.read.schema(df.schema).parquet(self._path)

    def drop(self) -> None:
        context = self._spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Parts:
    """A table that grows by one written part per round of a loop.

    Each part can be scanned alone, and the whole table is one scan however
    many rounds there were.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._path, self._n = spark, scratch_path(spark, name), 0
        self._schema: T.StructType | None = None

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next part and return it."""
        path = f"{self._path}/part={self._n}"
        self._n += 1
        self._schema = self._schema or df.schema
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(f"{self._path}/part=*")
