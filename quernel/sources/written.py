"""Intermediate tables, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset, the context's own checkpoint
    folder, or the warehouse. Only where all of Spark is one process (a local master) may it be a new temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and sc.master.partition("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quernel-"))
        named = sc.getCheckpointDir()
    named = named or spark.conf.get("spark.sql.warehouse.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return str(named).rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table through the Hadoop file system it lies on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut the lineage and survive a lost executor.

    keep(df) writes df and returns the table read again; free(table) deletes it when nothing lazy needs it any more.
    What is never freed goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quernel-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):
            delete(self.spark, self.root)

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path, partitionBy=list(partition_by) or None)
        return self.at(path, self.spark.read.schema(df.schema).parquet(path))

    def at(self, path: str, table: DataFrame) -> DataFrame:
        """The table, freed with the path it is read from."""
        table._quernel_path = path
        return table

    def free(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := table.__dict__.pop("_quernel_path", None):
                delete(self.spark, path)
