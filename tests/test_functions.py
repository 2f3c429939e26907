import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quernel.functions import documents as fd
from quernel.functions import text as ft
from quernel.functions import vectors as fv


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean_and_normalize(spark):
    assert one(spark, " a  b\r\n\tc ", ft.clean) == "a b c"
    assert one(spark, None, ft.clean) == ""
    assert one(spark, "  CAFÉ  Straße ÑANDÚ é", ft.normalize) == "cafe strasse nandu e"


def test_tokens_and_stems(spark):
    assert one(spark, "Lugares tranquilos para cenar", ft.ranking_tokens) == ["tranquil", "cen"]
    assert one(spark, "cenar tranquilo", ft.ranking_tokens) == ["cen", "tranquil"]
    assert one(spark, "de la y a", ft.ranking_tokens) == []
    assert one(spark, "de la y a", ft.embedding_tokens) == ["de", "la", "y", "a"]
    assert one(spark, "x 7 bailando comidas", ft.ranking_tokens) == ["7", "bail", "comid"]


def test_cut(spark):
    assert one(spark, "ab " * 400, ft.squeeze_and_cut) == ("ab " * 233).strip() + "..."
    assert one(spark, "short", ft.squeeze_and_cut) == "short"


def test_vectors(spark):
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0, 1.0])], "a array<float>, z array<float>, b array<float>")
    row = pair.select(
        fv.cosine(F.col("a"), F.col("b")).alias("c"), fv.cosine(F.col("a"), F.col("z")).alias("n"), fv.cosine_clamped(F.col("a"), F.col("z")).alias("k"), fv.l2_normalize(F.col("b")).alias("u"), fv.l2_normalize(F.col("z")).alias("s")).first()
    assert row["c"] == pytest.approx(math.sqrt(0.5)) and row["n"] is None and row["k"] == 0.0
    assert row["u"] == pytest.approx([math.sqrt(0.5)] * 2) and row["s"] == [0.0, 0.0]


def test_token_vector_matches_its_rule(spark):
    digest = hashlib.sha256("café".encode()).digest()
    assert one(spark, "café", lambda c: fv.token_vector(c, 40)) == [digest[i % 32] / 255 * 2 - 1 for i in range(40)]
    assert one(spark, [], lambda c: fv.hash_embedding(c, 4), "array<string>") == [0.0] * 4


def test_documents(spark):
    row = spark.createDataFrame([("Bar", "Uno", None)], "a string, b string, c string")
    assert row.select(fd.weighted_document([(F.col("a"), 1), (F.col("b"), 2), (F.col("c"), 3)]).alias("d")).first()["d"] == "Bar Uno Uno"
    with pytest.raises(ValueError):
        fd.weighted_document([(F.lit("x"), 0)])
    assert one(spark, "Cafe", fd.expand_category).startswith("cafe cafeteria")
    assert one(spark, "night_club", fd.expand_category) == "night club"
    text = json.dumps({"a": "é", "b": None}, separators=(",", ":"), ensure_ascii=False)
    got = row.select(fd.content_hash(b=F.col("c"), a=F.lit("é")).alias("h")).first()["h"]
    assert got == hashlib.sha256(text.encode()).hexdigest()


def test_resolve_tags(spark):
    catalogue = spark.createDataFrame([(29, "Compras", "compras"), (187, "Ropa_barata", "compras")], "id int, name string, category string")
    rows = spark.createDataFrame([("p", ["29", "187", "9999", "ropa barata", "Vegano"])], "id string, tags array<string>")
    r = fd.resolve_tags(rows, catalogue, "id", "tags").first()
    assert r["tag_names"] == ["Compras", "Ropa barata", "Vegano"] and r["tag_ids"] == [29, 187, 9999]
    assert r["tag_categories"] == ["compras"] and r["unknown_tag_ids"] == [9999]
