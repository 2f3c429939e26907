"""Term statistics, BM25 and TF-IDF ranking over long-format terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ranking_tokens
from ..sources.written import Scratch

#: Terms of an array of tokens with their counts, without moving rows: the tokens are sorted, and each begin of a run of equal ones
#: gives a term. A list bound by transform(array(...), x -> ...) is made once.
_COUNTED = """
transform(array(sort_array(tokens)), s -> if(size(s) = 0, cast(array() as array<struct<term:string,tf:bigint>>),
  transform(array(filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> get(s, i - 1))), b ->
    transform(sequence(0, size(b) - 1), k -> named_struct('term', s[b[k]], 'tf', cast(coalesce(get(b, k + 1), size(s)) - b[k] as bigint))))[0]))[0]
"""


def counted_tokens(rows: DataFrame, key: str) -> DataFrame:
    """key, len, first, term, tf of the rows (key, tokens): a row for each distinct term of each document, and one with a null
    term where there is none; first marks one row of each document. Rows are documents of their own; none is moved."""
    each = rows.select(key, F.size("tokens").alias("len"), F.posexplode_outer(F.expr(_COUNTED)).alias("at", "x"))
    return each.select(key, "len", (F.coalesce("at", F.lit(0)) == 0).alias("first"), "x.term", "x.tf")


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same of a text column's ranking tokens."""
    return counted_tokens(docs.select(key, ranking_tokens(F.col(text)).alias("tokens")), key)


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, len: a row for each distinct term of each document."""
    return counted(docs, key, text).where("term is not null").select(key, "term", "tf", "len")


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(ranking_tokens(F.col(text))).alias("len"))


@dataclass(frozen=True)
class Corpus:
    """The terms of all documents, cut and counted once and written: (key, term, tf, len), and one row (n, avg_len)."""

    terms: DataFrame
    facts: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: str) -> Corpus:
        table = Scratch(docs.sparkSession).keep(counted(docs, key, text))
        return cls(table.where("term is not null").select(key, "term", "tf", "len"), table.where("first").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")))


def document_frequency(terms_: DataFrame) -> DataFrame:
    return terms_.groupBy("term").agg(F.count("*").alias("df"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, avg_len: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """What a term's frequency weighs in BM25; k1 must be positive and b within 0..1."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive, b within 0..1")
    return F.when(avg_len > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))).otherwise(0.0)


def bm25(queries: DataFrame, docs_terms: DataFrame, n_docs: DataFrame, k1: float = 1.5, b: float = 0.75, key: str = "doc_id", query_key: str = "qid") -> DataFrame:
    """query_key, key, score. queries: (query_key, term, qtf); every occurrence of a query term counts. n_docs: one row (n, avg_len).

    Document terms first lose what no query holds, then get their idf; the score adds up over shared terms.
    """
    wanted = docs_terms.join(queries.select("term").distinct(), "term", "left_semi")
    idf = document_frequency(wanted).crossJoin(F.broadcast(n_docs)).select("term", bm25_idf(F.col("n"), F.col("df")).alias("idf"), "avg_len")  # n_docs is one row
    asked = queries.join(idf, "term")
    return wanted.join(asked, "term").groupBy(query_key, key).agg(F.sum(F.col("idf") * F.col("qtf") * bm25_weight(F.col("tf"), F.col("len"), F.col("avg_len"), k1, b)).alias("score"))


def tfidf(queries: DataFrame, docs_terms: DataFrame, n_docs: DataFrame, key: str = "doc_id", query_key: str = "qid") -> DataFrame:
    """query_key, key, score: cosine of TF-IDF vectors, tf as a share of the length, idf ln(n / df). Query terms meet their idf
    first and cut the documents' terms down for the products; only the norms take all terms, by one aggregate."""
    idf = document_frequency(docs_terms).crossJoin(F.broadcast(n_docs)).select("term", F.log(F.col("n") / F.col("df")).alias("idf"))  # n_docs is one row
    total = queries.groupBy(query_key).agg(F.sum("qtf").alias("qlen"))
    q = queries.join(total, query_key).join(idf, "term").select(query_key, "term", "idf", (F.col("qtf") / F.col("qlen") * F.col("idf")).alias("qw"))
    qn = q.groupBy(query_key).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    share = F.col("tf") / F.col("len") * F.col("idf")
    dn = docs_terms.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(share * share)).alias("dn"))
    dots = docs_terms.join(q, "term").groupBy(query_key, key).agg(F.sum(F.col("qw") * share).alias("dot"))
    return dots.join(dn, key).join(qn, query_key).where("dn > 0 and qn > 0").select(query_key, key, (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def best(scored: DataFrame, k: int, key: str = "doc_id", query_key: str = "qid", digits: int = 9) -> DataFrame:
    """The k best of each query with their rank. Scores are rounded before they are compared, so sums in another order
    rank alike; ties go to the smaller key."""
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# ---- reranking of each query's own candidates ------------------------------------------------------------------------
def rerank_bm25(queries: DataFrame, candidates: DataFrame, docs_terms: DataFrame, doc_lengths: DataFrame, k1: float = 1.5, b: float = 0.75, key: str = "external_id", query_key: str = "qid") -> DataFrame:
    """The candidates (query_key, key, ...) with a further column rank_score: BM25 whose idf and mean length are those of each
    query's own candidates; 0 where no term is shared. queries: (query_key, term, qtf); doc_lengths: (key, len) of every candidate."""
    pool = candidates.select(query_key, key)
    facts = pool.join(doc_lengths, key).groupBy(query_key).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    # Of the documents' terms only those that the query holds are counted; df is that of the query's candidates.
    met = pool.join(docs_terms, key).join(queries, [query_key, "term"])
    df = met.groupBy(query_key, "term").agg(F.count("*").alias("df"))
    w = F.col("qtf") * bm25_idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("len"), F.col("avg_len"), k1, b)
    scored = met.join(df, [query_key, "term"]).join(facts, query_key).groupBy(query_key, key).agg(F.sum(w).alias("rank_score"))
    return candidates.join(scored, [query_key, key], "left").withColumn("rank_score", F.coalesce("rank_score", F.lit(0.0)))


def rerank_tfidf(queries: DataFrame, candidates: DataFrame, docs_terms: DataFrame, doc_lengths: DataFrame, key: str = "external_id", query_key: str = "qid") -> DataFrame:
    """The candidates with a further column rank_score: cosine of TF-IDF vectors, idf over each query's own candidates; 0
    where no term is shared or a norm is 0."""
    pool = candidates.select(query_key, key)
    n = pool.groupBy(query_key).agg(F.count("*").alias("n"))
    own = pool.join(docs_terms, key)
    idf = own.groupBy(query_key, "term").agg(F.count("*").alias("df")).join(n, query_key).select(query_key, "term", F.log(F.col("n") / F.col("df")).alias("idf"))
    total = queries.groupBy(query_key).agg(F.sum("qtf").alias("qlen"))
    q = queries.join(total, query_key).join(idf, [query_key, "term"]).select(query_key, "term", (F.col("qtf") / F.col("qlen") * F.col("idf")).alias("qw"))
    d = own.join(idf, [query_key, "term"]).select(query_key, key, "term", (F.col("tf") / F.col("len") * F.col("idf")).alias("w"))
    qn = q.groupBy(query_key).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dn = d.groupBy(query_key, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    dots = d.join(q, [query_key, "term"]).groupBy(query_key, key).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    scored = dots.join(dn, [query_key, key]).join(qn, query_key).select(query_key, key, F.when((F.col("dn") > 0) & (F.col("qn") > 0), F.col("dot") / (F.col("dn") * F.col("qn"))).otherwise(0.0).alias("rank_score"))
    return candidates.join(scored, [query_key, key], "left").withColumn("rank_score", F.coalesce("rank_score", F.lit(0.0)))


def ranked(candidates: DataFrame, limit: int, *ties: Column, query_key: str = "qid", digits: int = 9) -> DataFrame:
    """The `limit` best candidates of each query by rank_score (rounded before it is compared), then by the vector score, then
    by ties, then as retrieved: query_key, rank, ..., score (the rank_score)."""
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("rank_score", digits)), *(ties or (F.desc("score"),)), "rank")
    placed = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return placed.withColumns({"rank": F.col("place"), "vector_score": F.col("score"), "score": F.col("rank_score")}).drop("place", "rank_score")
