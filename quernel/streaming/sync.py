"""Incremental sync of a stream of records into a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jobs import Counters
from ..operators import sync
from ..sources.table import VersionedTable


def apply_batch(batch: DataFrame, table: VersionedTable, embed: Callable[[DataFrame], DataFrame] | None = None) -> Counters:
    """Counters of one batch of (external_id, content_hash, ...): the first record of an id by page and position (by hash where
    there are none), only changed ones embedded and put in the table, which never loses rows. They are counted before the table is
    written. The same batch again changes nothing, so a replayed batch is safe."""
    order = [c for c in ("page", "pos") if c in batch.columns]
    rows = sync.dedupe_first(batch, "external_id", *order, "content_hash").drop(*order)
    old = table.read()
    diff = sync.hash_diff(rows, old) if old is not None else rows.withColumn("changed", F.lit(True))
    counted = Counters(*sync.counters(diff).first())
    if counted.upserted:
        staged = diff.where("changed").drop("changed")
        staged = (embed(staged) if embed else staged).withColumn("updated_at", F.current_timestamp())
        table.write(sync.upsert(old, staged) if old is not None else staged)
    return counted


def start(stream: DataFrame, table: VersionedTable, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None, told: Callable[[int, Counters], None] = lambda number, counters: None) -> StreamingQuery:
    """Run over what is there now, and end. Each batch's number and counters are told."""
    return stream.writeStream.foreachBatch(lambda df, n: told(n, apply_batch(df, table, embed))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
