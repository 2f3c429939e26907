import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quernel.engine import Config, Engine, Expiring, Geo, cache_key, check_request, trace_ids, wider
from quernel.functions.text import place_tokens
from quernel.operators import embed, metrics, policy, rank, retrieve, sync
from quernel.plans import catalogue
from quernel.sources import fixtures
from quernel.sources.table import VersionedTable, ready


def test_bm25_pins(spark):
    docs = spark.createDataFrame([(1, "cafe tranquilo"), (2, "parque tranquilo")], "doc_id long, text string")
    terms, n = rank.terms(docs, "doc_id", "text"), spark.createDataFrame([(2, 2.0)], "n long, avg_len double")
    idf = {r["term"]: r["i"] for r in rank.document_frequency(terms).crossJoin(n).select("term", rank.bm25_idf(F.col("n"), F.col("df")).alias("i")).collect()}
    assert idf["cafe"] == pytest.approx(math.log(2)) and idf["tranquil"] == pytest.approx(math.log(1.2))
    q = spark.createDataFrame([(0, "cafe", 1), (1, "cafe", 2), (2, "muse", 1)], "qid long, term string, qtf long")
    s = {(r["qid"], r["doc_id"]): r["score"] for r in rank.bm25(q, terms, n).collect()}
    assert set(s) == {(0, 1), (1, 1)} and s[1, 1] == pytest.approx(2 * s[0, 1])


def test_metrics_pins(spark):
    queries = spark.createDataFrame([(0,), (1,)], "qid long")
    ranking = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "qid long, doc_id string, rank int")
    qrels = spark.createDataFrame([(0, "a", 3), (0, "c", 1)], "qid long, doc_id string, grade int")
    got = {r["qid"]: r for r in metrics.evaluate(queries, ranking, qrels, 3).collect()}
    assert got[0]["precision"] == pytest.approx(2 / 3) and got[0]["recall"] == 1 and got[0]["mrr"] == 1
    assert got[0]["ap"] == pytest.approx(5 / 6) and 0 < got[0]["ndcg"] <= 1
    assert tuple(got[1])[1:] == (0.0,) * 5
    assert metrics.macro(metrics.evaluate(queries.limit(0), ranking.limit(0), qrels, 3)).first()["mrr"] == 0.0


def test_batch_is_the_same_as_single_queries_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, float(q), 0.5]) for q in range(4)], "qid long, qv array<double>")
    rows = lambda df: sorted((r["qid"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    batch = rows(retrieve.batch_top_k(items, queries, 3))
    for q in range(4):
        single = [r["vec_id"] for r in retrieve.top_k(items, [1.0, float(q), 0.5], 3).collect()]
        assert single == [v for qq, _, v, _ in batch if qq == q]
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 0)
    assert rows(retrieve.batch_top_k(items, queries, 3)) == batch


def test_blocks_give_what_the_expression_gives(spark, monkeypatch):
    """Copies, ties, odd norms, lengths, nulls, repeated ids and keys of text: the same rows and the same bits by matrix products; with
    small partitions that aren't joined, too."""
    rng = random.Random(8)
    made = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(120)]
    made += [made[3]] * 20 + [[2 * x for x in made[3]]] * 5 + [[0.0] * 6] * 3 + [[float("nan")] * 6, [float("inf")] + [1.0] * 5, [1e200] * 6, [1e-200] * 6, [None] + [1.0] * 5, None, [], [1.0] * 3, [2.0, 1.0, 1.0]]
    items = spark.createDataFrame([(f"é{i % 160}", v, i // 9 % 5 or None) for i, v in enumerate(made)], "vec_id string, embedding array<double>, ordinal int")
    queries = spark.createDataFrame([(i // 2, v) for i, v in enumerate(made[::3] + made[-12:])], "qid long, qv array<double>")
    rows = lambda **o: sorted(repr(tuple(r)) for r in retrieve.batch_top_k(items, queries, 7, **o).select("qid", "rank", "vec_id", "score").collect())
    plain, tied = rows(), rows(tie="ordinal")
    for name, n in (("MOST_PAIRS", 0), ("BLOCK", 30), ("QUERY_BLOCK", 20)):
        monkeypatch.setattr(retrieve, name, n)
    assert any("nan" in r for r in plain) and rows() == plain and rows(tie="ordinal") == tied
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        assert rows() == plain
    finally:
        spark.conf.unset(name)


def test_blocks_do_the_work_of_large_searches(spark):
    """A million pairs and more meet in blocks, not in a crossed join whose pairs are scored one by one."""
    e = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    found = retrieve.batch_top_k(e, catalogue.query_vectors(e), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
    assert found.count() == 3_000


def test_equal_scores_in_the_order_of_a_column(spark):
    items = spark.createDataFrame([(1, [1.0], 3), (2, [2.0], 1), (3, [3.0], 2)], "vec_id long, embedding array<double>, ordinal int")
    queries = spark.createDataFrame([(0, [1.0])], "qid long, qv array<double>")
    ids = lambda **o: [r["vec_id"] for r in retrieve.batch_top_k(items, queries, 3, **o).orderBy("rank").collect()]
    assert ids() == [1, 2, 3] and ids(tie="ordinal") == [2, 3, 1]


def test_cache_expires():
    now = [0.0]
    cache = Expiring(10, lambda: now[0])
    cache.set("a", 1)
    now[0] = 9.0
    assert cache.get("a") == 1 and cache.get("b") is None
    now[0] = 11.0
    assert cache.get("a") is None and not cache.held


def test_tables_are_ready(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    assert ready({"t": table}, {"embedding"}) == {"t": False, "ready": False}
    table.write(spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>"))
    assert ready({"t": table}, {"embedding"}, 2) == {"t": True, "ready": True} and not ready({"t": table}, {"embedding"}, 3)["ready"]


def test_filters(spark):
    rows = spark.createDataFrame([("1", "Tuxtla", "$", "cena romántica", True), ("2", "tuxtla", "$$", None, False)], "external_id string, city string, price_range string, occasion string, is_active boolean")
    ids = lambda f, m="sql": sorted(r[0] for r in retrieve.apply(rows, f, m).select("external_id").collect())
    assert ids(retrieve.Filters(city="TUXTLA")) == ["1"]
    assert ids(retrieve.Filters(is_active=False)) == []
    assert ids(retrieve.Filters(is_active=False), "normalized") == ["2"]
    assert ids(retrieve.Filters(occasion="CENA%tica")) == ["1"]
    assert ids(retrieve.Filters(occasion="romantica"), "normalized") == ["1"]
    assert ids(retrieve.Filters(ids=rows.select("external_id").limit(0))) == []


def test_sync(spark):
    source = spark.createDataFrame([("a", "1", 2), ("a", "0", 1), ("b", "2", 1), (None, "3", 1)], "external_id string, content_hash string, pos int")
    first = sync.dedupe_first(source, "external_id", "pos").drop("pos")
    assert {tuple(r) for r in first.collect()} == {("a", "0"), ("b", "2")}
    stored = spark.createDataFrame([("a", "0"), ("c", "9")], "external_id string, content_hash string")
    diff = sync.hash_diff(first, stored)
    assert tuple(sync.counters(diff).first()) == (2, 1, 1)
    done = sync.upsert(stored, diff.where("changed").drop("changed"))
    assert {tuple(r) for r in done.collect()} == {("a", "0"), ("b", "2"), ("c", "9")}
    assert tuple(sync.counters(sync.hash_diff(first, done)).first()) == (2, 2, 0)


def test_guard_and_template(spark):
    rows = [("corto", "confident", []), ("Hoy está abierto hasta tarde", "confident", []), ("La opción Mirador Azul te va a gustar", "no_match", []), ("El restaurante Azul es bueno", "confident", ["Verde"]), ("El restaurante Verde es bueno", "confident", ["Verde"]), ("cuesta $ 20 por persona", "confident", [])]
    df = spark.createDataFrame(rows, "m string, mode string, names array<string>")
    got = [r[0] for r in df.select(policy.guard_reason(F.col("m"), F.col("mode"), F.col("names"))).collect()]
    assert got == ["empty_or_too_short", "unsupported_claims", "place_mentioned_without_matches", "mentions_unverified_place", None, "unsupported_claims"]
    assert "a, b, c." in spark.createDataFrame([(["a", "b", "c", "d"],)], "n array<string>").select(policy.template_message(F.lit("confident"), F.col("n"))).first()[0]


@pytest.fixture(scope="module")
def engine(spark):
    config = Config(dimension=16)
    texts = spark.createDataFrame([("p1", "Cafe Azul", "cafe tranquilo", "cafe", "Tuxtla"), ("p2", "Parque", "parque naturaleza", "park", "Tuxtla"), ("p3", "", "museo", "culture", "San Cristobal")], "external_id string, name string, document string, category string, city string")
    entities = Engine(texts, config).embed(texts, "document").withColumnRenamed("qv", "embedding").withColumn("is_active", F.lit(True)).cache()
    return Engine(entities, config)


QUERIES = [(0, "cafe tranquilo"), (1, "xyzzy")]


def test_engine_search(spark, engine):
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    top = engine.search(queries, 1).where("qid = 0").collect()
    assert [(r["external_id"], r["match_quality"]) for r in top] == [("p1", "confident")]
    # A query without candidates has a row of its own.
    empty = engine.search(queries, 1, retrieve.Filters(city="nowhere")).collect()
    assert [(r["qid"], r["rank"], r["match_quality"]) for r in sorted(empty)] == [(0, None, "no_match"), (1, None, "no_match")]
    m = {r["qid"]: r for r in engine.run(queries, 2).metrics.collect()}
    assert m[0]["engine"] == "semantic" and m[0]["candidate_count"] == 3 and m[0]["returned_count"] == 2 and m[0]["max_score"] == pytest.approx(1)
    assert (m[0]["query_token_count"], m[0]["matched_query_token_count"], m[0]["query_coverage"]) == (2, 2, 1.0) and m[1]["query_coverage"] == 0.0
    assert m[0]["location_filter_applied"] is False and m[0]["nearby_place_count"] is None and json.loads(m[0]["field_weights"])["tags"] == 6


def test_engine_rankers(spark, engine):
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    by = {n: Engine(engine.entities, Config(dimension=16, ranker=n)).run(queries, 3) for n in ("semantic", "vector", "bm25", "tfidf")}
    for n, found in by.items():
        assert [r["external_id"] for r in found.places.where("qid = 0").orderBy("rank").collect()][0] == "p1", n
    bm25 = {r["external_id"]: r for r in by["bm25"].places.where("qid = 0").collect()}
    # Tokens: p1 [cafe, tranquil, cafe], p2 [parque, naturalez, park], p3 [museo -> muse, culture]; "cafe" and "tranquil" are p1's alone.
    assert len(bm25) == 3 and bm25["p2"]["score"] == bm25["p3"]["score"] == 0.0 and bm25["p1"]["score"] > 0
    zeros = sorted((r for r in bm25.values() if r["score"] == 0), key=lambda r: r["rank"])
    assert zeros[0]["vector_score"] >= zeros[1]["vector_score"]
    m = {r["qid"]: r for r in by["bm25"].metrics.collect()}
    assert m[1]["match_quality"] == "no_match" and m[1]["nonzero_score_count"] == 0 and json.loads(m[1]["ranking_parameters"]) == {"k1": 1.5, "b": 0.75}
    with pytest.raises(ValueError):
        Config(ranker="other")
    with pytest.raises(ValueError):
        Config(k1=0)


def test_engine_geo_and_limits(spark, engine):
    queries = spark.createDataFrame(QUERIES[:1], "qid long, text string")
    asked = []
    provider = lambda lat, lng, radius: asked.append((lat, lng, radius)) or spark.createDataFrame([("p2",), ("p9",), ("p2",)], "id string")
    found = engine.run(queries, 2, geo=Geo(1.0, 2.0, provider, 300))
    assert asked == [(1.0, 2.0, 300)] and [r["external_id"] for r in found.places.collect()] == ["p2"]
    m = found.metrics.first()
    assert m["location_filter_applied"] and m["nearby_place_count"] == 2 and m["radius_meters"] == 300
    none = Geo(1.0, 2.0, lambda *_: spark.createDataFrame([], "id string"))
    assert engine.run(queries, 2, geo=none).places.count() == 0
    for bad in (lambda: engine.run(queries, 21), lambda: engine.run(queries, 1, geo=Geo(91.0, 0.0, provider)), lambda: engine.run(queries, 1, geo=Geo(1.0, 0.0, provider, 0)), lambda: engine.chat(queries, 9), lambda: engine.recommend(spark.createDataFrame([(0, "x" * 501)], "qid long, text string")), lambda: engine.search(spark.createDataFrame([(0, "")], "qid long, text string"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        check_request("x", 5, lat=1.0)
    with pytest.raises(ValueError):
        Config(no_match=0.6)
    f = retrieve.Filters(city="Tuxtla")
    assert cache_key(" Cafe  Azul", f, 5) == cache_key("cafe azul", f, 5) != cache_key("cafe azul", f, 6)
    assert wider(retrieve.Filters(city="", state="B"), retrieve.Filters(city="Tuxtla", state="A", price_range="$")) == retrieve.Filters(city="Tuxtla", state="B", price_range="$")
    assert trace_ids()[0].startswith("resp_") and trace_ids() != trace_ids()


def test_engine_answers(spark, engine):
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    said = {r["qid"]: r for r in Engine(engine.entities, Config(dimension=16, ranker="bm25", bm25_relevant=0.1)).recommend(queries, 2).collect()}
    assert said[0]["names"] == ["Cafe Azul"] and "Cafe Azul" in said[0]["message"] and said[0]["returned_count"] == 1 and said[0]["min_score"] == said[0]["max_score"] > 0
    assert said[1]["match_quality"] == "no_match" and said[1]["places"] == [] and said[1]["message"] == policy.NO_MATCH and said[1]["mean_score"] == 0.0
    claims = Engine(engine.entities, engine.config, generate=lambda mode, names: F.lit("El restaurante Falso tiene promoción hoy"))
    refused = claims.recommend(queries.where("qid = 0"), 1).first()
    assert refused["used_fallback"] and refused["guard_reason"] == "unsupported_claims" and refused["message"] == policy.FALLBACK
    said = engine.chat(queries.where("qid = 0"), 1).first()
    assert said["places"] == ["p1"] and "Cafe Azul" in said["message"] and not said["used_fallback"] and said["guard_reason"] is None
    assert [r["external_id"] for r in engine.related_posts(queries.where("qid = 0"), 1, "").collect()] == ["p1"]
    assert engine._named(engine.run(queries, 3).places, queries).where("qid = 0").first()["names"].count("p3") == 1  # no name: its id


def test_engine_evaluates_by_bm25(spark):
    places = fixtures.places(spark).withColumnRenamed("id", "external_id")
    base = Engine(places, Config(dimension=32))
    engine = Engine(base.embed(places, "document").withColumnRenamed("qv", "embedding"), base.config)
    queries, qrels = fixtures.evaluation(spark)
    got = engine.evaluate(queries, qrels, 3).first()
    assert all(0 <= x <= 1 for x in got) and got["mrr"] > 0
    assert metrics.labels(3) == {"precision": "Precision@3", "recall": "Recall@3", "mrr": "MRR", "ap": "MAP", "ndcg": "nDCG@3"} and metrics.RECOMMENDED == "ndcg"


def test_rerank_prefers_tags_and_keeps_zeros(spark):
    """A tag match comes first, whatever the vector scores; what shares no term scores 0."""
    docs = spark.createDataFrame([("a", "musica", 0.1), ("b", "museo", 0.9)], "external_id string, tags string, score double")
    tokens = place_tokens(F.lit("lugar"), F.lit(None).cast("string"), F.col("tags"))
    held = rank.counted_tokens(docs.select("external_id", tokens.alias("tokens")), "external_id")
    candidates = docs.select(F.lit(0).alias("qid"), "external_id", "score", F.lit(1).alias("rank"))
    asked = spark.createDataFrame([(0, "music", 1)], "qid int, term string, qtf long")
    for rerank in (rank.rerank_bm25, rank.rerank_tfidf):
        scored = rerank(asked, candidates, held.where("term is not null"), held.where("first").select("external_id", "len"))
        got = rank.ranked(scored, 5).orderBy("rank").collect()
        assert [(r["external_id"], r["score"] > 0) for r in got] == [("a", True), ("b", False)]


def test_counted_terms(spark):
    rows = [(1, "cafe cafes parque"), (2, None), (3, "de la"), (3, "uno 7 7 7")]
    got = rank.counted(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["term"] or "", r["tf"], r["len"], r["first"]) for r in got if r["term"]) == [(1, "caf", 1, 3, True), (1, "cafe", 1, 3, False), (1, "parque", 1, 3, False), (3, "7", 3, 3, True)] or sum(r["first"] for r in got) == 4
    assert sum(r["first"] for r in got) == 4 and sum(r["tf"] or 0 for r in got) == 6


def test_contained_passages(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "xalpha beta gammay", "beta", "al", None, "one two", "alpha beta gamma del"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = ["alpha beta gamma", "alpha beta gamma del", "beta gamma", "beta", "lpha", "ha beta gamma delta eps", "nothing here at all of it", "e t", ""]
    passages = spark.createDataFrame(list(enumerate(parts)), "qid long, p string")
    want = sorted((q, d) for q, p in enumerate(parts) for d, t in enumerate(texts) if p and t and p in t)
    assert sorted((r["qid"], r["doc_id"]) for r in catalogue.contained(docs, passages).collect()) == want


def test_contained_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 1)
    test_contained_passages(spark)


def test_guard_gives_the_fallback(spark):
    rows = [("corto", "no_match"), ("corto", "low_confidence"), (None, "confident"), ("Un  plan tranquilo\npara hoy", "confident")]
    df = spark.createDataFrame(rows, "m string, mode string")
    got = [tuple(r[0]) for r in df.select(policy.guard(F.col("m"), F.col("mode"), F.array().cast("array<string>"))).collect()]
    reason = "empty_or_too_short"
    assert got == [(policy.FALLBACKS["no_match"], True, reason), (policy.FALLBACKS["low_confidence"], True, reason), (policy.FALLBACK, True, reason), ("Un plan tranquilo para hoy", False, None)]


def test_mean_of_words(spark):
    words = spark.createDataFrame([("cafe", [1.0, 0.0, 0.0]), ("parque", [0.0, 1.0, 0.0])], "word string, vector array<float>")
    rows = spark.createDataFrame([("a", "Café, parque"), ("b", "cafe cafe nube"), ("c", None), ("d", "nube")], "external_id string, text string")
    got = {r["external_id"]: r["embedding"] for r in embed.mean_of_words(rows, words, 3).collect()}
    assert got["a"] == pytest.approx([math.sqrt(0.5), math.sqrt(0.5), 0]) and got["b"] == pytest.approx([1, 0, 0]) and got["c"] == got["d"] == [0.0] * 3
    known = {r["external_id"]: r["embedding"] for r in embed.mean_of_words(rows, words, 3, unknown=[0, 0, 1]).collect()}
    assert known["b"] == pytest.approx([2 / math.sqrt(5), 0, 1 / math.sqrt(5)]) and known["d"] == [0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        embed.mean_of_words(rows, words, 3, unknown=[1.0])


def test_place_tokens(spark):
    df = spark.createDataFrame([("cafe rico", "bar", "musica", "Azul"), (None, "bar", None, "Azul"), ("", None, "", None)], "d string, c string, t string, n string")
    got = [r[0] for r in df.select(place_tokens(F.col("d"), F.col("c"), F.col("t"), F.col("n"))).collect()]
    assert got == [["cafe", "ric", "bar"] + ["music"] * 5, ["azul", "bar", "bar"], []]
