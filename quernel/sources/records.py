"""Source records of places and posts from JSON rows, as one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import PLACE_WEIGHTS, content_hash, expand_category, sparse, weighted_document, with_tags
from ..functions.text import clean, text_list

#: The state of a record that names none, the version of a place's document, letters of a short description.
STATE, DOCUMENT_VERSION, SHORT = "Chiapas", "weighted-tags-v2", 300
#: JSON of values that count as false.
FALSE = ("false", "0", "0.0", '""', "[]", "{}")


def field(*names: str) -> Column:
    """The first of the fields that is there and not null, as a variant; an empty text counts as there."""
    each = (F.variant_get("_record", f"$.{n}", "variant") for n in names)
    return F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in each))


def text_of(value: Column, default: str | None = None) -> Column:
    """A value as text; lists and objects as JSON."""
    found = value.cast("string")
    return found if default is None else F.coalesce(found, F.lit(default))


def scalar(value: Column) -> Column:
    """Numbers, truth values and texts as they are, lists and objects as a text."""
    quoted = F.variant_get(F.parse_json(F.to_json(F.array(value.cast("string")))), "$[0]", "variant")
    return F.when(F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)"), quoted).otherwise(value)


def truth(value: Column) -> Column:
    """Whether a value counts as true, as an empty text, list or object and zero do not; a missing one does."""
    return F.coalesce(~F.to_json(value).isin(*FALSE), F.lit(True))


def list_of(value: Column) -> Column:
    """A JSON list or a text separated by commas, as trimmed texts that aren't empty; another value is one text."""
    raw = F.to_json(value)
    listed = F.filter(F.transform(F.from_json(raw, "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.startswith(raw, F.lit("[")), listed).otherwise(text_list(value.cast("string"))), F.array().cast("array<string>"))


def parsed(rows: DataFrame) -> DataFrame:
    return rows.where("id is not null").select(F.col("id").alias("external_id"), F.try_parse_json("record").alias("_record"))


def place_records(rows: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """external_id, document, metadata (JSON), content_hash, is_active and metadata's tag columns from (id, record).

    Tags are resolved by the catalogue (id, name, category); without one, ids stay unknown. Rows without an id go; a record
    that is no JSON has empty fields. The hash covers document, metadata, is_active and the version of the document.
    """
    catalogue = rows.sparkSession.createDataFrame([], "id int, name string, category string") if catalogue is None else catalogue
    flat = with_tags(parsed(rows).withColumn("_raw", list_of(field("tags", "keywords"))), catalogue, "_raw", "t")
    name, description = F.trim(text_of(field("name", "title"), "")), text_of(field("description", "summary", "about"), "")
    category, state, active = field("category", "type"), F.coalesce(field("state"), F.parse_json(F.lit(f'"{STATE}"'))), truth(field("is_active", "isActive"))
    weights = dict(PLACE_WEIGHTS)
    parts = {"name": name, "category": expand_category(text_of(category, "")), "description": description, "tags": F.array_join("t.tag_names", " ")}
    version = F.lit(DOCUMENT_VERSION)
    meta = sparse(
        name=name, category=scalar(category), city=scalar(field("city", "municipality")), state=scalar(state), source=scalar(field("source")), price_range=scalar(field("price_range", "priceRange")), is_active=active,
        occasion=F.array_join(list_of(field("occasion", "occasions")), ","), tags=F.array_join("t.tag_names", ","), tag_ids=F.col("t.tag_ids"), tag_categories=F.col("t.tag_categories"), unknown_tag_ids=F.col("t.unknown_tag_ids"),
        semantic_document_version=version, short_description=F.substring(description, 1, SHORT),
    )
    out = flat.select("external_id", weighted_document([(c, weights[n]) for n, c in parts.items()]).alias("document"), meta.alias("_meta"), active.alias("is_active"))
    hashed = content_hash(True, document=F.col("document"), metadata=F.col("_meta"), is_active=F.col("is_active"), semantic_document_version=version)
    return out.withColumn("content_hash", hashed).withColumn("metadata", F.to_json("_meta")).select("external_id", "document", "metadata", "content_hash", "is_active")


def post_records(rows: DataFrame) -> DataFrame:
    """external_id, document, metadata (JSON), content_hash and is_active from (id, record). Rows without an id go."""
    title, state = F.trim(text_of(field("title", "name"), "")), F.coalesce(field("state"), F.parse_json(F.lit(f'"{STATE}"')))
    tags, active = list_of(field("tags", "keywords")), truth(field("is_active", "isActive"))
    said = [title, *(F.when(truth(v), text_of(v)) for v in (field("city", "municipality"), state, field("source"))), F.array_join(tags, " "), text_of(field("text", "content", "description", "body"))]
    document = clean(F.concat_ws(" ", *(F.when(c != "", c) for c in said)))
    meta = sparse(title=title, city=field("city", "municipality"), state=state, source=field("source"), tags=F.array_join(tags, ","), is_active=active)
    out = parsed(rows).select("external_id", document.alias("document"), meta.alias("_meta"), active.alias("is_active"))
    hashed = content_hash(True, document=F.col("document"), metadata=F.col("_meta"), is_active=F.col("is_active"))
    return out.withColumn("content_hash", hashed).withColumn("metadata", F.to_json("_meta")).select("external_id", "document", "metadata", "content_hash", "is_active")
