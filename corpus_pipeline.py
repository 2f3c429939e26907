"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, jaccard, mixing, quality_rules, toxicity
from quernel.llm.common import WORD, Scratch, free_name, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs; each row is judged by its own text.

    Null, empty and short texts fail the base rules and go; whole texts are measured, however long; a null language is a stratum
    of its own; repeated rows stay or go together; other columns are kept, whatever their names; without labels only the base
    rules reject; an empty table gives an empty one.
    """
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"), Scratch(spark), joint=True, whole=True)
    return judged.where("kept").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't find toxic; each row is judged by its own text.

    Null and empty texts match nothing and stay; whole texts, however long; repeated rows stay or go together; other columns are
    kept, whatever their names; without labels every row stays; an empty table gives an empty one.
    """
    toxic = free_name(docs, "toxic")
    return toxicity.flagged(docs, table(spark, sf_dir, "labels"), toxic).where(F.col(toxic) == 0).drop(toxic)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of several with that id the one with the
    smallest class and hash of its text.

    Texts without words (null and empty ones too) and rows without an id are linked with nothing and stay. Rows that repeat id
    and text leave one row, the smallest of them; rows that share an id and differ in text are documents of their own.
    Other columns are kept, whatever their names. An empty table gives an empty one.
    """
    scratch = Scratch(spark)
    linked = jaccard.link(docs, scratch)
    first = linked.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "class_id", "text_hash")).alias("x"))
    first = scratch.keep(first.select("x.doc_id", "x.text_hash"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD).alias("words"), row.alias("row"))
    alone = rows.where("doc_id is null or not words").select("row")
    chosen = rows.where("doc_id is not null and words").join(first, ["doc_id", "text_hash"], "left_semi")
    several = linked.where("component is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash")
    # Repeated rows of one id and text, partly aggregated before they move; all others stay as they are.
    several = scratch.keep(several.join(first, ["doc_id", "text_hash"], "left_semi"))
    single = chosen.join(several, ["doc_id", "text_hash"], "left_anti").select("row")
    least = chosen.join(several, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.struct(*(F.col("row").getField(c).cast("string") for c in docs.columns if c != "text"))).alias("row")).select("row")
    return single.unionByName(least).unionByName(alone).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it, none more than three times.

    Null and empty texts have no words and go; a null source is a source of its own; whole texts are counted, however long;
    rows that repeat an id, source and size share their copies; other columns are kept, whatever their names; an empty table
    gives an empty one.
    """
    return mixing.mixed(docs, Scratch(spark))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix holds, a row for each row.

    Null and empty texts have no tokens; whole texts are encoded, however long; repeated rows give repeated results; other columns
    are ignored; an empty table gives an empty result.
    """
    return bpe.encode(docs)


STAGES = [("quality_rules", quality), ("toxicity", clean), ("near_duplicates", distinct), ("mixing", mixed), ("bpe", encoded)]

#: The stages on labels, rounding and tokens can't be put in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
