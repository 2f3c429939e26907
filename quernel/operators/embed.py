"""Embeddings from a table of word vectors."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedding_tokens
from ..functions.vectors import hash_embedding, l2_normalize


class Embedder(Protocol):
    """What turns texts into vectors: its name and version are part of a row's hash, so a change embeds everything again."""

    model: str
    version: str
    dimension: int

    def embed(self, rows: DataFrame, text: str, name: str = "embedding") -> DataFrame:
        """The rows with a further column of vectors."""
        ...


@dataclass(frozen=True)
class HashEmbedder:
    """Sums of the tokens' hash vectors: no model, the same everywhere."""

    dimension: int = 300
    model: str = "hash"
    version: str = "v1"

    def embed(self, rows: DataFrame, text: str, name: str = "embedding") -> DataFrame:
        return rows.withColumn(name, hash_embedding(embedding_tokens(F.col(text)), self.dimension))


@dataclass(frozen=True)
class WordEmbedder:
    """Means of the tokens' vectors from a table (word, vector)."""

    words: DataFrame
    dimension: int = 300
    unknown: list[float] | None = None
    model: str = "words"
    version: str = "v1"

    def embed(self, rows: DataFrame, text: str, name: str = "embedding") -> DataFrame:
        numbered = rows.withColumn("_row", F.monotonically_increasing_id())
        vectors = mean_of_words(numbered.select("_row", text), self.words, self.dimension, "_row", text, self.unknown).withColumnRenamed("embedding", name)
        return numbered.join(vectors, "_row").drop("_row")


EMBEDDERS = {"hash": lambda dimension, words: HashEmbedder(dimension), "words": lambda dimension, words: WordEmbedder(words, dimension)}


def create(provider: str, dimension: int = 300, words: DataFrame | None = None) -> Embedder:
    """An embedder by its name, in any case: hash, or words with a table of word vectors of that dimension."""
    if provider.lower() not in EMBEDDERS:
        raise ValueError(f"there is no embedder {provider}")
    if provider.lower() == "words" and words is None:
        raise ValueError("the embedder of words needs a table of word vectors")
    return EMBEDDERS[provider.lower()](dimension, words)


def mean_of_words(rows: DataFrame, words: DataFrame, dimension: int, key: str = "external_id", text: str = "text", unknown: list[float] | None = None) -> DataFrame:
    """key, embedding: the mean of the tokens' vectors, repeats counted, at unit length.

    words: (word, vector). A token that isn't there counts with the unknown vector, or not at all; rows without tokens get
    zeros. Tokens are counted by row before they meet their vectors, and sums are partly aggregated before the shuffle, so
    only row x dimension partial sums move.
    """
    if dimension < 1 or (unknown is not None and len(unknown) != dimension):
        raise ValueError("the unknown vector must have the dimension, which is positive")
    counts = rows.select(key, F.explode_outer(embedding_tokens(F.col(text))).alias("word")).where("word is not null").groupBy(key, "word").agg(F.count("*").alias("n"))
    met = counts.join(words.select("word", "vector"), "word", "left")
    if unknown is not None:
        met = met.withColumn("vector", F.coalesce(F.col("vector").cast("array<double>"), F.array(*map(F.lit, map(float, unknown)))))
    sums = met.where("vector is not null").select(key, "n", F.posexplode("vector").alias("pos", "v")).groupBy(key, "pos").agg((F.sum(F.col("n") * F.col("v").cast("double")) / F.sum("n")).alias("v"))
    vectors = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("mean"))  # as long as the dimension
    return rows.select(key).join(vectors, key, "left").select(key, F.coalesce(l2_normalize(F.col("mean")), F.array_repeat(F.lit(0.0), dimension)).alias("embedding"))
