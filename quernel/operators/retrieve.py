"""Filtered retrieval by cosine similarity, for one or many queries at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, IntegralType, StringType, StructField, StructType

from ..functions.text import fold, normalize
from ..functions.vectors import cosine, norm
from .blocks import nearest

#: A query table of at most so many rows, and pairs with rows, is broadcast; beyond it, blocks of queries meet blocks of rows.
BROADCAST_QUERIES, MOST_PAIRS = 2_000, 1_000_000
#: Rows and queries of a block. A worker holds a block of each twice.
BLOCK, QUERY_BLOCK = 131_072, 65_536
#: Types of keys and ties that Arrow sorts as Spark does; by others, all pairs are scored by the expression.
SORTED = (IntegralType, StringType, BooleanType, DateType, DecimalType)


@dataclass(frozen=True)
class Filters:
    """Optional predicates, all of which must hold. ids: a table of allowed ids (an empty one allows nothing)."""

    city: str | None = None
    state: str | None = None
    category: str | None = None
    price_range: str | None = None
    occasion: str | None = None
    is_active: bool | None = True
    ids: DataFrame | None = None


def apply(df: DataFrame, f: Filters, mode: str = "sql", key: str = "external_id") -> DataFrame:
    """sql: equality in lower case, exact price, occasion as a pattern where % and _ are wild, active rows only (asking for
    inactive ones gives nothing). normalized: equality of normalised texts, occasion as a part, is_active as asked."""
    tests: list[Column] = []
    if mode == "sql":
        if f.is_active is False:
            return df.limit(0)
        tests.append(F.col("is_active"))
        tests += [F.lower(c) == v.lower() for c, v in (("city", f.city), ("state", f.state), ("category", f.category)) if v is not None]
        if f.price_range is not None:
            tests.append(F.col("price_range") == f.price_range)
        if f.occasion is not None:
            tests.append(F.col("occasion").ilike(f"%{f.occasion}%"))
    else:
        tests += [normalize(F.col(c)) == normalize(F.lit(v)) for c, v in (("city", f.city), ("state", f.state), ("category", f.category), ("price_range", f.price_range)) if v is not None]
        if f.occasion is not None:
            tests.append(F.contains(normalize(F.col("occasion")), normalize(F.lit(f.occasion))))
        if f.is_active is not None:
            tests.append(F.col("is_active") == f.is_active)
    out = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return out if f.ids is None else out.join(f.ids.select(F.col(f.ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def top_k(items: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score: the k best rows for one query vector, ties to the smaller key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return items.select(key, cosine(F.col(vector), q).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def batch_top_k(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "qid", query_vector: str = "qv", tie: str | None = None) -> DataFrame:
    """query_key, rank, key, score for every query; equal scores by the column tie (the order rows came in, for instance), or else
    by key. Each norm is computed once. Few queries over few rows are broadcast against all rows; else both are cut into blocks,
    each block of queries meets each block of rows, and a pair of blocks keeps its k best by matrix products and exact scores."""
    ties = ["_tie"] if tie else []
    a = items.select(key, vector, *([F.col(tie).alias("_tie")] if tie else [])).withColumn("_n", norm(F.col(vector)))
    b = queries.select(query_key, query_vector).withColumn("_m", norm(F.col(query_vector)))

    def scored(rows: DataFrame, asked: DataFrame) -> DataFrame:
        met = rows.crossJoin(F.broadcast(asked))
        return met.select(query_key, key, *ties, cosine(F.col(vector), F.col(query_vector), F.col("_n"), F.col("_m")).alias("score")).where("score is not null")

    (n, odd_n), (m, odd_m) = (t.agg(F.count("*"), F.count_if(~plain(c) & (F.col(c) != 0))).first() for t, c in ((a, "_n"), (b, "_m")))
    if (m <= BROADCAST_QUERIES and n * m <= MOST_PAIRS) or not all(isinstance(a.schema[c].dataType, SORTED) for c in [key, *ties]):
        best = scored(a, b)
    else:
        best = in_blocks(a.where(plain("_n")), b.where(plain("_m")), k, n, m, key, vector, query_key, query_vector, ties)
        # Norms that overflow or aren't numbers go by the expression; a norm of 0 gives a score with those only.
        odd = lambda c: ~plain(c) & (F.col(c) != 0)
        if odd_m:
            best = best.unionByName(scored(a, b.where(odd("_m"))))
        if odd_n:
            best = best.unionByName(scored(a.where(odd("_n")), b.where(~odd("_m"))))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), *ties, key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, key, "score", "rank")


def plain(c: str) -> Column:
    """A norm that is neither 0 nor far from what doubles can square."""
    return F.col(c).between(1e-100, 1e100)


def in_blocks(a: DataFrame, b: DataFrame, k: int, n: int, m: int, key: str, vector: str, query_key: str, query_vector: str, ties: list[str]) -> DataFrame:
    """query_key, key, ties and score of the k best of each block of rows for each query, among vectors of the query's length."""
    # A row is copied once for each block of queries, a query once for each block of rows; small tables give every core a block.
    parts = max(1, -(-n // BLOCK), min(a.sparkSession.sparkContext.defaultParallelism, -(-n // 4_096)))
    width = max(1, -(-m // QUERY_BLOCK))
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = lambda t, c: "float" if t.schema[c].dataType.simpleString() == "array<float>" else "double"
    # Numbers of blocks are ints on both sides: a cogroup hashes them as they are.
    left = a.select(key, *ties, F.col(vector).cast(f"array<{kind(a, vector)}>").alias("_v"), F.size(vector).alias("_d"), part(parts, key, vector).alias("_s"), upto(width).alias("_b"))
    right = b.select(query_key, F.col(query_vector).cast(f"array<{kind(b, query_vector)}>").alias("_q"), F.size(query_vector).alias("_d"), part(width, query_key, query_vector).alias("_b"), upto(parts).alias("_s"))
    schema = StructType([StructField(query_key, b.schema[query_key].dataType), *(StructField(c, a.schema[c].dataType) for c in [key, *ties]), StructField("score", DoubleType())])

    def vectors(t: pa.Table, c: str) -> np.ndarray:
        return pa.chunked_array([x.flatten() for x in t.column(c).chunks], t.schema.field(c).type.value_type).to_numpy().reshape(t.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            i = j = np.empty(0, np.int64)
            score = np.empty(0)
        else:
            left = left.take(pc.sort_indices(left, [(c, "ascending") for c in [*ties, key]], null_placement="at_start"))
            i, j, score = nearest(vectors(left, "_v"), vectors(right, "_q"), k)
        return pa.table({query_key: right.column(query_key).take(pa.array(i)), **{c: left.column(c).take(pa.array(j)) for c in [key, *ties]}, "score": pa.array(score)})

    return left.groupBy("_d", "_s", "_b").cogroup(right.groupBy("_d", "_s", "_b")).applyInArrow(run, schema)


def tie_boost(df: DataFrame, city: str | None, category: str | None) -> list[Column]:
    """Order by score, then by a match of city, then of category; a match never changes the score."""
    hit = lambda c, v: F.when(fold(F.col(c)) == v.casefold(), 1).otherwise(0) if v else F.lit(0)
    return [F.desc("score"), F.desc(hit("city", city)), F.desc(hit("category", category))]
