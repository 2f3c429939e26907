"""Building documents and records: coalescing, weighted fields, sparse metadata, tags, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import clean, fold

#: Words that a category stands for.
CATEGORY_PROFILES = {
    "restaurant": "restaurante comida gastronomia comer cena almuerzo desayuno",
    "cafe": "cafe cafeteria bebidas desayuno postres conversar",
    "bar": "bar bebidas cocteles cerveza amigos musica noche",
    "nightlife": "vida nocturna noche baile musica bar fiesta",
    "shopping": "compras tiendas ropa calzado productos mercado centro comercial",
    "lodging": "alojamiento hotel hospedaje hostal dormir turismo viaje",
    "park": "parque naturaleza caminar paseo aire libre mascotas ejercicio",
    "culture": "cultura museo arte historia biblioteca exposicion lectura",
    "tourism": "turismo atraccion visitar explorar paseo historia",
    "sports": "deporte ejercicio entrenamiento gimnasio actividad fisica",
    "community": "comunidad convivencia reuniones centro comunitario actividades",
    "family": "familia ninos juegos convivencia actividades familiares",
    "entertainment": "entretenimiento diversion juegos cine actividades",
}
#: Weights of a place document's fields, in the order of the fields.
PLACE_WEIGHTS = (("name", 1), ("category", 4), ("description", 3), ("tags", 6))


def first_present(*cs: Column, default: str | None = None) -> Column:
    """The first value that is not null; an empty text counts as present."""
    return F.coalesce(*cs, *([] if default is None else [F.lit(default)]))


def weighted_document(fields: list[tuple[Column, int]]) -> Column:
    """Every cleaned, non-empty field as many times as it weighs, joined by one space."""
    if any(w < 1 for _, w in fields):
        raise ValueError("a field must weigh at least 1")
    parts = [F.when(clean(c) != "", F.array_join(F.array_repeat(clean(c), w), " ")) for c, w in fields]
    return F.concat_ws(" ", *parts)


def expand_category(c: Column, profiles: dict[str, str] = CATEGORY_PROFILES) -> Column:
    """The words a category stands for; another category stands for itself, cleaned."""
    table = F.create_map(*(F.lit(x) for kv in profiles.items() for x in kv))
    label = clean(F.replace(fold(clean(c)), F.lit("_"), F.lit(" ")))
    return F.coalesce(table[F.replace(label, F.lit(" "), F.lit("_"))], label)


def filled(c: Column) -> Column:
    """The value, or null where it is an empty text or list; false and zero stay."""
    return F.when(~F.to_json(F.struct(c.alias("v"))).isin('{"v":""}', '{"v":[]}'), c)


def sparse(**fields: Column) -> Column:
    """A struct of the fields in the order of their names, as filled."""
    return F.struct(*(filled(fields[n]).alias(n) for n in sorted(fields)))


def sparse_json(**fields: Column) -> Column:
    """JSON of the fields that are neither null nor empty, in the order given."""
    return F.to_json(F.struct(*(filled(c).alias(n) for n, c in fields.items())))


def content_hash(ignore_nulls: bool = False, **fields: Column) -> Column:
    """SHA-256 of compact JSON with its keys in order; null fields are written as null, or left out."""
    if ignore_nulls:
        return F.sha2(F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields)))), 256)
    return F.sha2(F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def versioned_hash(source_hash: Column, model: str, version: str, dimension: int) -> Column:
    return content_hash(embedding_dimension=F.lit(dimension), embedding_model=F.lit(model), embedding_version=F.lit(version), source_content_hash=source_hash)


#: A catalogue of at most this many rows becomes a map that goes with every row; a larger one is joined.
MAPPED_CATALOGUE = 2_000
_CATALOGUE = "id int, name string, category string"


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """id, name, category from JSON files {"data": [{"id", "name", "category"}]}; of rows that share an id the last counts."""
    rows = spark.read.schema(f"data array<struct<{_CATALOGUE.replace(' int', ':int').replace(' string', ':string')}>>").json(path, multiLine=True)
    each = rows.select(F.posexplode("data").alias("pos", "x")).select("pos", "x.*").where("id is not null")
    return each.groupBy("id").agg(F.max_by(F.struct("name", "category"), "pos").alias("x")).select("id", "x.name", "x.category")


def tag_number(tag: Column) -> Column:
    """The id that a tag of digits stands for; null for others."""
    return F.when(F.trim(tag).rlike("^[0-9]+$"), F.trim(tag).cast("int"))


def distinct_tags(items: Column) -> Column:
    """A struct of tag_names, tag_ids, tag_categories and unknown_tag_ids of an array of (tag_id, name, category, known): each in
    order and without repeats.

    An id counts among the ids even where the catalogue doesn't know it, and then among the unknown ones too. Names lose
    underscores and count as equal whatever their case; the first spelling stays.
    """
    label = lambda x: clean(F.replace(x["name"], F.lit("_"), F.lit(" ")))
    named = F.transform(F.filter(items, lambda x: x["tag_id"].isNull() | x["known"]), lambda x: F.struct(label(x).alias("label"), fold(label(x)).alias("fold")))
    first = F.aggregate(
        F.filter(named, lambda x: x["label"] != ""), F.array().cast("array<struct<label:string,fold:string>>"), lambda done, x: F.when(F.exists(done, lambda y: y["fold"] == x["fold"]), done).otherwise(F.concat(done, F.array(x)))
    )
    return F.struct(
        F.transform(first, lambda x: x["label"]).alias("tag_names"),
        F.array_distinct(F.transform(F.filter(items, lambda x: x["tag_id"].isNotNull()), lambda x: x["tag_id"])).alias("tag_ids"),
        F.array_distinct(F.transform(F.filter(items, lambda x: x["known"]), lambda x: x["category"])).alias("tag_categories"),
        F.array_distinct(F.transform(F.filter(items, lambda x: x["tag_id"].isNotNull() & ~x["known"]), lambda x: x["tag_id"])).alias("unknown_tag_ids"),
    )


def with_tags(rows: DataFrame, catalogue: DataFrame, tags: str, name: str) -> DataFrame:
    """The rows with a struct of their resolved tags (see distinct_tags) as a further column; repeated rows stay apart.

    A tag of digits is an id of the catalogue (id, name, category); others are names. A small catalogue is counted and goes
    along as a map, so no row is moved; a larger one meets the exploded tags in a join.
    """
    if catalogue.count() <= MAPPED_CATALOGUE:
        known = catalogue.select(F.map_from_entries(F.collect_list(F.struct("id", F.struct("name", "category")))).alias("_known"))  # one row
        entry = lambda t: F.get(F.array(F.element_at("_known", tag_number(t))), F.lit(0))
        item = lambda t: F.struct(tag_number(t).alias("tag_id"), F.when(tag_number(t).isNull(), t).otherwise(entry(t)["name"]).alias("name"), entry(t)["category"].alias("category"), (tag_number(t).isNotNull() & entry(t).isNotNull()).alias("known"))
        met = rows.crossJoin(F.broadcast(known))
        return met.withColumn(name, distinct_tags(F.transform(F.coalesce(tags, F.array().cast("array<string>")), item))).drop("_known")
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    each = keyed.select("_row", F.posexplode(tags).alias("pos", "tag")).withColumn("tag_id", tag_number(F.col("tag")))
    met = each.join(catalogue.select(F.col("id").alias("tag_id"), F.col("name").alias("known_name"), "category"), "tag_id", "left")
    item = F.struct("pos", "tag_id", F.when(F.col("tag_id").isNull(), F.col("tag")).otherwise(F.col("known_name")).alias("name"), "category", F.col("known_name").isNotNull().alias("known"))
    items = met.groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("_items"))  # one row's tags
    none = F.array().cast("array<struct<pos:int,tag_id:int,name:string,category:string,known:boolean>>")
    return keyed.join(items, "_row", "left").withColumn(name, distinct_tags(F.coalesce("_items", none))).drop("_row", "_items")


def resolve_tags(rows: DataFrame, catalogue: DataFrame, key: str, tags: str) -> DataFrame:
    """key, tag_names, tag_ids, tag_categories, unknown_tag_ids of every row."""
    return with_tags(rows.select(key, tags), catalogue, tags, "_tags").select(key, "_tags.*")
