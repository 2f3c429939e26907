"""Retrieval metrics per query and their averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, precision, recall, mrr, ap, ndcg at k for every query. ranking: (qid, doc_id, rank from 1); qrels: (qid, doc_id, grade)."""
    judged = ranking.where(F.col("rank") <= k).join(qrels, ["qid", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit = (F.col("grade") > 0).cast("int")
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    found = judged.withColumn("hits", F.sum(hit).over(so_far)).groupBy("qid").agg(
        F.sum(hit).alias("n_hits"),
        F.countDistinct(F.when(F.col("grade") > 0, F.col("doc_id"))).alias("d_hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("grade") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id"))
    ideal = qrels.withColumn("r", ideal_rank).groupBy("qid").agg(
        F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("idcg")
    )
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return queries.select("qid").join(found, "qid", "left").join(ideal, "qid", "left").select(
        "qid", F.coalesce(F.col("n_hits") / k, F.lit(0.0)).alias("precision"), share("d_hits", "relevant").alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), share("ap_sum", "relevant").alias("ap"), share("dcg", "idcg").alias("ndcg"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    """One row with the mean of each metric, zeros without queries."""
    return per_query.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "mrr", "ap", "ndcg")))


def score_stats(queries: DataFrame, candidates: DataFrame, returned: DataFrame, query_key: str = "qid") -> DataFrame:
    """Per query the number of candidates, and of the returned rows the number, that of positive scores, and least, largest and
    mean score; zeros without any. Only the first figure is over the candidates."""
    pool = candidates.groupBy(query_key).agg(F.count("*").alias("candidate_count"))
    s = returned.groupBy(query_key).agg(F.count("*").alias("returned_count"), F.count_if(F.col("score") > 0).alias("nonzero_count"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    met = queries.select(query_key).join(pool, query_key, "left").join(s, query_key, "left")
    return met.select(query_key, *(zero(c, 0) for c in ("candidate_count", "returned_count", "nonzero_count")), *(zero(c, 0.0) for c in ("min_score", "max_score", "mean_score")))


def coverage(queries: DataFrame, candidates: DataFrame, docs_terms: DataFrame, key: str = "external_id", query_key: str = "qid") -> DataFrame:
    """Per query with terms (query_key, term, ...): their number, the number of those that a candidate holds, and its share."""
    held = candidates.select(query_key, key).join(docs_terms.select(key, "term"), key).join(queries.select(query_key, "term"), [query_key, "term"], "left_semi").select(query_key, "term").distinct()
    met = queries.select(query_key, "term").join(held.withColumn("hit", F.lit(1)), [query_key, "term"], "left").groupBy(query_key).agg(F.count("*").alias("query_terms"), F.count("hit").alias("matched_terms"))
    return met.withColumn("coverage", F.col("matched_terms") / F.col("query_terms"))


#: Names of the metrics at k and the one that is recommended.
LABELS = {"precision": "Precision@{k}", "recall": "Recall@{k}", "mrr": "MRR", "ap": "MAP", "ndcg": "nDCG@{k}"}
RECOMMENDED = "ndcg"


def labels(k: int) -> dict[str, str]:
    """The name of each metric at k."""
    return {name: label.format(k=k) for name, label in LABELS.items()}


def match_quality(top: F.Column, no_match: float = 0.30, relevant: float = 0.50) -> F.Column:
    return F.when(top <= no_match, "no_match").when(top < relevant, "low_confidence").otherwise("confident")
