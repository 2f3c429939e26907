"""Sync jobs: records of a paged source, mapped, compared with the table by hash, embedded where changed, and upserted.

    python -m quernel.jobs places --source https://api.example/places --table hdfs:///tables/places --dry-run
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.documents import load_catalogue, versioned_hash
from .operators import embed, sync
from .sources.pages import PagedJson
from .sources.records import place_records, post_records
from .sources.table import VersionedTable

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Counters:
    processed: int = 0
    skipped: int = 0
    upserted: int = 0
    errors: int = 0


def stage(rows: DataFrame, table: VersionedTable, embedder: embed.Embedder, dry_run: bool = False, key: str = "external_id", as_of: datetime | None = None) -> Counters:
    """One batch of records (external_id, document, metadata, content_hash, is_active), one for each id: those whose versioned
    hash isn't the stored one are embedded and take the place of stored rows; nothing is deleted. A dry run embeds and
    counts, and writes nothing. The counters are taken before the table is written, in one pass over hashes."""
    hashed = rows.withColumn("content_hash", versioned_hash(F.col("content_hash"), embedder.model, embedder.version, embedder.dimension))
    old = table.read()
    diff = sync.hash_diff(hashed, old) if old is not None else hashed.withColumn("changed", F.lit(True))
    counted = Counters(*sync.counters(diff).first())
    if not counted.upserted:
        return counted
    staged = embedder.embed(diff.where("changed").drop("changed"), "document").withColumns({"embedding_model": F.lit(embedder.model), "embedding_version": F.lit(embedder.version), "updated_at": F.lit(as_of) if as_of else F.current_timestamp()})
    if dry_run:
        staged.write.format("noop").mode("overwrite").save()
        log.info("dry run: prepared %s upserts", counted.upserted)
    else:
        table.write(sync.upsert(old, staged, key) if old is not None else staged)
    return counted


def run(kind: str, rows: DataFrame, table: VersionedTable, embedder: embed.Embedder, catalogue: DataFrame | None = None, dry_run: bool = False) -> Counters:
    """A whole sync of source rows (id, record, page, pos): the first record of an id by page and position counts. A failure
    counts all its records as errors, is logged, and leaves the table as it was."""
    first = sync.dedupe_first(rows, "id", "page", "pos")
    records = place_records(first, catalogue) if kind == "places" else post_records(first)
    try:
        return stage(records, table, embedder, dry_run)
    except Exception:
        log.exception("the sync of %s failed", kind)
        processed = rows.where("id is not null").select("id").distinct().count()
        return Counters(processed=processed, errors=processed)


def sync_source(spark: SparkSession, kind: str, source: str, table: VersionedTable, embedder: embed.Embedder, catalogue: DataFrame | None = None, dry_run: bool = False, **options: str) -> Counters:
    """The sync of a paged source; RuntimeError where records failed."""
    spark.dataSource.register(PagedJson)
    rows = spark.read.format("paged_json").options(url=source, kind=kind, **options).load()
    counters = run(kind, rows, table, embedder, catalogue, dry_run)
    log.info("finished %s processed=%s skipped=%s upserted=%s errors=%s", kind, counters.processed, counters.skipped, counters.upserted, counters.errors)
    if counters.errors:
        raise RuntimeError(f"the sync of {kind} finished with {counters.errors} failed records")
    return counters


def main(arguments: list[str] | None = None, session: Callable[[], SparkSession] = lambda: SparkSession.builder.getOrCreate()) -> Counters:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("kind", choices=("places", "posts"))
    parser.add_argument("--source", required=True)
    parser.add_argument("--table", required=True)
    parser.add_argument("--catalogue")
    parser.add_argument("--embedder", default="hash", choices=sorted(embed.EMBEDDERS))
    parser.add_argument("--words", help="table of word vectors, for the embedder `words`")
    parser.add_argument("--dimension", type=int, default=300)
    parser.add_argument("--page-limit", type=int, default=100)
    parser.add_argument("--max-pages", type=int)
    parser.add_argument("--mode", default="cursor", choices=("cursor", "offset", "page"))
    parser.add_argument("--token")
    parser.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(arguments)
    spark = session()
    embedder = embed.create(a.embedder, a.dimension, spark.read.parquet(a.words) if a.words else None)
    options = {"limit": str(a.page_limit), "mode": a.mode} | ({"max_pages": str(a.max_pages)} if a.max_pages else {}) | ({"internal_token": a.token} if a.token else {})
    return sync_source(spark, a.kind, a.source, VersionedTable(spark, a.table), embedder, load_catalogue(spark, a.catalogue) if a.catalogue else None, a.dry_run, **options)


if __name__ == "__main__":
    main()
