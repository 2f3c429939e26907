"""Small made tables for tests and first steps: places, posts, clusters, and an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTERS = "id string, label string, post_ids array<string>, size int, metadata struct<generated_by:string>"


def places(spark: SparkSession, n: int = 12) -> DataFrame:
    """id, name, category, city, state, price_range, is_active, occasion, tags, short_description, ordinal, document: places made
    from a rule; the document is all texts but the price."""
    i = F.col("id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    rows = spark.range(1, n + 1).select(
        F.concat(F.lit("place_"), i).alias("id"), F.concat(pick("Casa", "Jardín", "Patio", "Mirador"), F.lit(" "), pick("Azul", "Verde", "Rojo"), F.lit(" "), i).alias("name"), pick("cafe", "restaurant", "park", "culture", "bar").alias("category"),
        pick("Tuxtla Gutierrez", "San Cristobal de las Casas").alias("city"), F.lit("Chiapas").alias("state"), pick("$", "$$", "$$$").alias("price_range"), F.lit(True).alias("is_active"), pick("cita,amigos", "familia", "trabajo,estudio").alias("occasion"),
        pick("tranquilo café", "mariscos terraza", "naturaleza caminar", "arte historia").alias("tags"), pick("Un lugar tranquilo para conversar.", "Comida local con terraza.", "Paseo al aire libre.").alias("short_description"), i.cast("int").alias("ordinal"),
    )
    return rows.withColumn("document", F.concat_ws(" ", "name", "category", "city", "state", "tags", "occasion", "short_description"))


def posts(spark: SparkSession) -> DataFrame:
    """id, title, city, tags, text, document; the document is title, city and text."""
    rows = [("post_1", "Cafés para leer", "Tuxtla Gutierrez", ["cafe", "lectura"], "Tres mesas junto a la ventana."), ("post_2", "Miradores", "San Cristobal de las Casas", ["fotos"], "Para ver la puesta del sol."), ("post_3", "Domingo de antojitos", "Tuxtla Gutierrez", ["comida"], "Puestos del mercado.")]
    return spark.createDataFrame(rows, "id string, title string, city string, tags array<string>, text string").withColumn("document", F.concat_ws(" ", "title", "city", "text"))


def clusters(spark: SparkSession) -> DataFrame:
    """id, label, post_ids, size, metadata: what an offline job left; nothing is computed for a request."""
    rows = [("cluster_food", "Comida de domingo", ["post_1", "post_3"], 2, ("offline",)), ("cluster_views", "Paseos y fotos", ["post_2"], 1, ("offline",))]
    return spark.createDataFrame(rows, CLUSTERS)


def cluster_posts(clusters_: DataFrame) -> DataFrame:
    """cluster_id, label, position, post_id: a row for each post of a cluster, in order."""
    return clusters_.select(F.col("id").alias("cluster_id"), "label", F.posexplode("post_ids").alias("position", "post_id"))


def evaluation(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """queries (qid, text) and qrels (qid, doc_id, grade 1 to 3) over the places."""
    queries = [(1, "cafe tranquilo"), (2, "parque para caminar"), (3, "mariscos con terraza")]
    qrels = [(1, "place_5", 3), (1, "place_4", 1), (2, "place_2", 3), (2, "place_12", 2), (3, "place_1", 3), (3, "place_9", 1)]
    return spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(qrels, "qid long, doc_id string, grade int")
