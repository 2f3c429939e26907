"""A table of Parquet versions: readers see the last finished version, a writer adds the next one."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path(self.path)):
            return []
        names = [s.getPath() for s in self.fs.listStatus(self._path(self.path))]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and self.fs.exists(self._path(f"{p}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{done[-1]}") if done else None

    def write(self, df: DataFrame, keep: int = 2) -> None:
        """Add a version; older ones than the last `keep` go, so that running readers keep theirs."""
        done = self.versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{(done[-1] if done else 0) + 1}")
        for old in done[: len(done) + 1 - keep]:
            self.fs.delete(self._path(f"{self.path}/v{old}"), True)

    def verify(self, columns: set[str] | dict[str, str], dimension: int | None = None, vector: str = "embedding") -> bool:
        """Whether the table exists, has all the columns (with their types, where given as Spark writes them) and, where a
        dimension is given, all its vectors have it."""
        df = self.read()
        if df is None:
            return False
        kinds = dict(df.dtypes)
        wanted = columns if isinstance(columns, dict) else {c: kinds.get(c) for c in columns}
        if not all(c in kinds and kinds[c] == kind for c, kind in wanted.items()):
            return False
        return dimension is None or bool(df.agg(F.coalesce(F.every(F.size(vector) == dimension), F.lit(True))).first()[0])


def ready(tables: dict[str, VersionedTable], columns: set[str] | dict[str, str], dimension: int | None = None) -> dict[str, bool]:
    """Whether each table can be read as expected, and under "ready" whether all can."""
    found = {name: table.verify(columns, dimension) for name, table in tables.items()}
    return found | {"ready": all(found.values())}


def checked_name(name: str) -> str:
    """The name of a table or column, if it is letters, digits and underscores and starts with no digit; ValueError otherwise."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no name of a table or column")
    return name


def verification(tables: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """table_name, total, dimensions, models, versions and norms of each table with embedding_model and embedding_version."""
    n = norm(F.col(vector))
    figures = [F.count("*").alias("total"), F.min(F.size(vector)).alias("min_dims"), F.max(F.size(vector)).alias("max_dims"), F.min("embedding_model").alias("model"), F.min("embedding_version").alias("version"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm")]
    return reduce(DataFrame.unionByName, (df.agg(*figures).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()))
