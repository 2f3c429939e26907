"""Incremental sync: first record of an id, changed content, upsert, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each id in the given order; rows without an id go. The least row of an id is aggregated partly before
    rows move, so an id with very many rows is one row for each task."""
    kept = df.where(F.col(key).isNotNull())
    least = F.min_by(F.struct(*df.columns), F.struct(*order))
    return kept.groupBy(F.col(key).alias("_key")).agg(least.alias("_row")).select("_row.*")


def hash_diff(source: DataFrame, stored: DataFrame, key: str = "external_id", column: str = "content_hash") -> DataFrame:
    """Source rows with a column changed: no stored hash or another one. Expensive columns belong after this filter."""
    old = stored.select(key, F.col(column).alias("_old"))
    return source.join(old, key, "left").withColumn("changed", ~F.col(column).eqNullSafe(F.col("_old"))).drop("_old")


def upsert(target: DataFrame, staged: DataFrame, key: str = "external_id") -> DataFrame:
    """The target with staged rows in the place of those of the same id; nothing is deleted."""
    return target.join(staged.select(key), key, "left_anti").unionByName(staged)


def counters(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count("*").alias("processed"), F.count_if(~F.col("changed")).alias("skipped"), F.count_if(F.col("changed")).alias("upserted"))
