"""The queries of the subpackage on the small tables: against their SQL where they have one, and on columns and rows elsewhere."""

import glob
import os
import random

import duckdb
import pytest

from quernel.llm import queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
COLUMNS = {
    "op3_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_licenses": {"path": "string", "license": "string", "score": "double", "origin": "string", "inherited_from": "string", "doc_id": "bigint"},
    "op9_quality_model": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


def against_sql(df, sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    columns = sorted(df.columns)
    expected = con.sql(sql)
    assert sorted(expected.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM expected").fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    against_sql(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_topk_counts_every_length(spark, tmp_path):
    """Vectors of any length take part, by the places that both have: against the SQL, and, where empty ones have no sum there, 0."""
    rng = random.Random(6)
    vectors = [[rng.uniform(-1, 1) for _ in range(rng.choice([1, 3, 8, 9, 40]))] for _ in range(160)]
    vectors[7], vectors[100], vectors[101] = [3e6] * 30, [5e5, -2.0], [2e5, 1.0, 1.0]  # beyond the index
    write = lambda rows, name: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    write(list(enumerate(vectors)), "any")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/any/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op1_topk']})").fetchall()
    assert sorted(tuple(r) for r in queries.op1_topk(spark, f"{tmp_path}/any").collect()) == sorted(want) and len(want) == 20
    write([(0, []), (1, [1.0]), (2, [-1.0]), (50, [0.5]), (51, [])], "empty")
    got = sorted(tuple(r) for r in queries.op1_topk(spark, f"{tmp_path}/empty").collect())
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 50, 0), (0, 4, 51, 0), (50, 1, 1, 32768), (50, 2, 0, 0), (50, 3, 51, 0), (50, 4, 2, -32768)]


def test_topk_blocks_meet_in_every_partition(spark):
    """Small partitions that aren't joined into one: each block of queries still meets each block of rows."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        against_sql(queries.op1_topk(spark, SF), queries.ORACLES["op1_topk"], SF)
    finally:
        spark.conf.unset(name)


def test_quality_rules_against_sql_with_cutoffs(spark):
    """On the larger tables there are cutoffs, so the SQL is held to them and not to the base rules alone."""
    df = queries.op4_quality_rules(spark, LARGER).cache()
    assert df.where("not base_failed and not kept").limit(1).count()
    against_sql(df, queries.ORACLES["op4_quality_rules"], LARGER)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_without_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert dict(df.dtypes) == COLUMNS[name]
    table, key = ("pages", "page_id") if name == "op10_html" else ("documents", "doc_id")
    want = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in want.collect())


def test_every_query_has_a_test():
    assert set(COLUMNS) | set(queries.ORACLES) == set(queries.QUERIES)


@pytest.mark.parametrize(("name", "column", "modulus", "remainder", "least"), [("op6_toxicity", "toxic", 5, 0, (0.93, 0.99)), ("op9_quality_model", "quality", 4, 2, (0.95, 0.95))])
def test_held_out_accuracy(spark, name, column, modulus, remainder, least):
    """On held-out documents of the larger tables: the share of label 1 and of label 0 that is predicted."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", column)
    rows = queries.QUERIES[name](spark, LARGER).where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    for y, bound in zip((1, 0), least, strict=True):
        of = [r["predicted"] == y for r in rows if r[column] == y]
        assert of and sum(of) / len(of) >= bound, (y, sum(of), len(of))
