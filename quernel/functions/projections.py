"""Projections from stored rows to candidates, contexts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_list

#: Metadata that a language model's context holds beside a place's own fields, and digits of answers.
CONTEXT, DIGITS = ("tags", "occasion", "short_description"), 4


def meta(name: str, column: str = "metadata") -> Column:
    """A field of the metadata (JSON) as text; null where it is missing."""
    return F.get_json_object(column, f"$.{name}")


def has_key(name: str, column: str = "metadata") -> Column:
    """Whether the metadata (JSON) has the key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(column), name), F.lit(False))


def has_text(name: str, column: str = "metadata") -> Column:
    """Whether the metadata's field is there and not empty."""
    return F.coalesce(meta(name, column), F.lit("")) != ""


def filled_or(*cs: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cs))


def decoded(rows: DataFrame) -> DataFrame:
    """id, score, metadata, document of rows that may name their id external_id or id and may lack the other columns: a missing
    score is 0, missing metadata an empty object."""
    there = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    return rows.select(
        F.coalesce(there("external_id", "string"), there("id", "string")).alias("id"), F.coalesce(there("score", "double"), F.lit(0.0)).alias("score"), F.coalesce(there("metadata", "string"), F.lit("{}")).alias("metadata"), there("document", "string").alias("document")
    )


def place_candidates(rows: DataFrame) -> DataFrame:
    """id, name, score, category, city, state, price_range, metadata and document; a place without a name has its id for one."""
    fields = [meta(n).alias(n) for n in ("category", "city", "state", "price_range")]
    return decoded(rows).select("id", filled_or(meta("name"), F.col("id")).alias("name"), "score", *fields, "metadata", "document")


def post_candidates(rows: DataFrame) -> DataFrame:
    """id, title, score, city, tags and metadata; tags may be a list or a text separated by commas."""
    raw = meta("tags")
    tags = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(text_list(raw))
    return decoded(rows).select("id", filled_or(meta("title"), meta("name"), F.col("id")).alias("title"), "score", meta("city").alias("city"), tags.alias("tags"), "metadata")


def llm_context() -> Column:
    """JSON of a candidate for a language model: its own fields, null ones too, the score rounded, and of the metadata only what
    CONTEXT names, where it is there."""
    own = F.to_json(F.struct("id", "name", "category", "city", "state", "price_range", F.round("score", DIGITS).alias("score")), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct(*(meta(n).alias(n) for n in CONTEXT)))
    return F.when(more == "{}", own).otherwise(F.concat(F.left(own, F.length(own) - 1), F.lit(","), F.substring(more, 2, 1 << 30)))


def answered(rows: DataFrame, *figures: str) -> DataFrame:
    """The rows with the given figures rounded as answers show them; only the last projection rounds."""
    return rows.withColumns({c: F.round(c, DIGITS) for c in figures})


def as_text(c: Column, is_list: bool = False) -> Column:
    """A value as text: nothing for null, a list's values joined by one space."""
    return F.coalesce(F.array_join(c, " ", "None") if is_list else c.cast("string"), F.lit(""))


def sorted_ids(ids: Column) -> Column:
    """Collected ids in order, so that equal sets give equal keys."""
    return F.array_sort(F.array_distinct(ids))
