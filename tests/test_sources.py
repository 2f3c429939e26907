import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quernel import jobs
from quernel.functions import documents as fd
from quernel.functions import projections as fp
from quernel.operators import embed
from quernel.sources import fixtures
from quernel.sources.pages import NearbyUnavailable, PagedJson, fetched, iterate, nearby_ids, nearby_places, next_page, unwrap
from quernel.sources.records import place_records, post_records
from quernel.sources.table import VersionedTable, checked_name, verification
from quernel.streaming import sync as stream_sync


def test_payload_shapes():
    assert unwrap({"data": {"items": [{"id": 1}, 3]}}, "places") == [{"id": 1}]
    assert unwrap({"data": [], "items": [{"id": 1}]}, "places") == []
    assert nearby_ids({"data": [], "items": [{"id": 0, "uuid": "u"}, {"_id": 5}, {"post_id": 9}]}) == {"u", "5"}
    assert next_page({"data": [], "nextCursor": " c ", "hasMore": True}) == ("c", True)
    assert next_page([]) == (None, False)


def test_pagination_stops():
    pages = {None: {"data": [{"id": 1}, {"id": 2}], "next_cursor": "b", "has_more": True}, "b": {"data": [{"id": 2}, {"id": 3}], "next_cursor": "c", "has_more": True}, "c": {"data": [{"id": 3}], "next_cursor": "d", "has_more": True}}
    assert [x[0] for x in iterate(lambda q: pages[q.get("cursor")], "places")] == ["1", "2", "3"]
    assert [x[0] for x in iterate(lambda q: pages[q.get("cursor")], "places", max_pages=1)] == ["1", "2"]
    rows = [{"id": i} for i in range(5)]
    assert len(list(iterate(lambda q: rows[q["offset"] : q["offset"] + q["limit"]], "posts", limit=2, mode="offset"))) == 5
    asked = []
    paged = lambda q: asked.append(q) or rows[(q["page"] - 1) * 2 : q["page"] * 2]
    assert [x[0] for x in iterate(paged, "posts", limit=2, mode="page")] == list("01234") and [q["page"] for q in asked] == [1, 2, 3]


def test_data_source_and_records(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"data": [{"id": 7, "title": " Café Uno ", "type": "cafe", "tags": ["a", " b "], "isActive": False}], "next_cursor": "2", "has_more": True}))
    (tmp_path / "2.json").write_text(json.dumps({"data": [{"uuid": "x", "name": "Dos", "tags": "q, r", "city": ""}]}))
    spark.dataSource.register(PagedJson)
    rows = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{page}}.json").load()
    got = {r["external_id"]: r for r in place_records(rows).collect()}
    assert set(got) == {"7", "x"} and got["7"]["is_active"] is False and got["x"]["is_active"] is True
    assert got["7"]["document"].startswith("Café Uno cafe cafeteria") and got["7"]["document"].endswith("a b a b a b a b a b a b")
    assert json.loads(got["x"]["metadata"]) == {"name": "Dos", "state": "Chiapas", "tags": "q,r", "is_active": True, "semantic_document_version": "weighted-tags-v2"}
    assert len(got["x"]["content_hash"]) == 64
    posts = {r["external_id"]: r for r in post_records(rows).collect()}
    assert {i: r["document"] for i, r in posts.items()} == {"7": "Café Uno Chiapas a b", "x": "Dos Chiapas q r"}
    assert posts["7"]["is_active"] is False and json.loads(posts["7"]["metadata"]) == {"title": "Café Uno", "state": "Chiapas", "tags": "a,b", "is_active": False}


def test_stream_into_versions(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/table")
    (tmp_path / "in").mkdir()
    schema = "external_id string, content_hash string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream_sync.start(spark.readStream.schema(schema).json(f"{tmp_path}/in"), table, f"{tmp_path}/ck").awaitTermination()

    run([("a", "1"), ("b", "1")])
    run([("b", "2"), ("c", "1")])
    assert {(r[0], r[1]) for r in table.read().select("external_id", "content_hash").collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    before = table.versions()
    run([("a", "1")])
    assert table.versions() == before and table.verify({"external_id", "updated_at"})


class Service(BaseHTTPRequestHandler):
    """Two pages of places behind a token, the second one after an error; ids around a point; a broken path."""

    failed = 0

    def do_GET(self):
        url, asked = urlparse(self.path), parse_qs(urlparse(self.path).query)
        if url.path == "/nearby":
            answer, code = {"data": [{"id": "a"}, {"uuid": "b"}], "asked": asked}, 200
        elif url.path != "/places" or self.headers.get("Authorization") != "Bearer inner":
            answer, code = {}, 404 if url.path != "/places" else 401
        elif "cursor" not in asked:
            answer, code = {"data": [{"id": "a", "name": "Uno"}], "next_cursor": "2", "has_more": True}, 200
        elif not Service.failed:
            Service.failed += 1
            answer, code = {}, 503
        else:
            answer, code = {"data": [{"id": "b", "name": "Dos"}, {"id": "a", "name": "Otra"}]}, 200
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_source_over_http(spark, service):
    import urllib.error

    Service.failed = 0
    spark.dataSource.register(PagedJson)
    read = lambda **o: spark.read.format("paged_json").options(url=f"{service}/places", pause="0.01", **o).load()
    assert [(r["id"], r["page"], r["pos"]) for r in read(internal_token="inner", auth_token="outer").orderBy("page", "pos").collect()] == [("a", 1, 0), ("b", 2, 0)]
    with pytest.raises(urllib.error.HTTPError):
        fetched(f"{service}/places", {}, {"auth_token": "wrong", "pause": "0.01"})
    assert sorted(r[0] for r in nearby_places(spark, f"{service}/nearby", 1.5, 2.5, 100).collect()) == ["a", "b"]
    with pytest.raises(NearbyUnavailable) as error:
        nearby_places(spark, f"{service}/missing", 1.5, 2.5, 100)
    assert (error.value.code, error.value.status) == ("nearby_places_unavailable", 502)


CATALOGUE = [(29, "Compras", "ocasion"), (187, "Ropa_barata", "compras"), (12, "Tranquilo", "ambiente")]


@pytest.mark.parametrize("mapped", [2_000, 0])
def test_place_mapping(spark, monkeypatch, mapped):
    """The values that the mapping must give, by a map of the catalogue and by a join with it."""
    monkeypatch.setattr(fd, "MAPPED_CATALOGUE", mapped)
    records = [
        {"id": "place_weighted", "name": "Nombre Ambiguo", "category": "shopping", "source": "osm", "address": "Direccion que no debe influir", "tags": [29, 187, 9999], "description": "Venta de prendas y accesorios."},
        {"id": 2, "title": " Café ", "category": "", "state": "", "is_active": "false", "tags": "compras,29, 12 ,9999,9999,COMPRAS", "occasions": ["cita", " "], "priceRange": 5, "description": "é" * 400},
        {"id": 3, "is_active": 0, "keywords": [], "city": {"a": [1]}},
    ]
    rows = spark.createDataFrame([(str(r["id"]), json.dumps(r)) for r in records] + [("4", "no json"), (None, "{}")], "id string, record string")
    got = {r["external_id"]: r for r in place_records(rows, spark.createDataFrame(CATALOGUE, "id int, name string, category string")).collect()}
    meta = {i: json.loads(r["metadata"]) for i, r in got.items()}
    first = got["place_weighted"]["document"]
    assert meta["place_weighted"] == {"name": "Nombre Ambiguo", "category": "shopping", "source": "osm", "state": "Chiapas", "is_active": True, "tags": "Compras,Ropa barata", "tag_ids": [29, 187, 9999], "tag_categories": ["ocasion", "compras"], "unknown_tag_ids": [9999], "semantic_document_version": "weighted-tags-v2", "short_description": "Venta de prendas y accesorios."}
    assert [first.count(x) for x in ("Nombre Ambiguo", "Venta de prendas y accesorios.", "Compras Ropa barata", "compras tiendas ropa", "osm", "Direccion", "9999")] == [1, 3, 6, 4, 0, 0, 0]
    assert meta["2"] == {"name": "Café", "price_range": 5, "is_active": True, "occasion": "cita", "tags": "compras,Tranquilo", "tag_ids": [29, 12, 9999], "tag_categories": ["ocasion", "ambiente"], "unknown_tag_ids": [9999], "semantic_document_version": "weighted-tags-v2", "short_description": "é" * 300}
    assert meta["3"] == {"city": '{"a":[1]}', "state": "Chiapas", "is_active": False, "semantic_document_version": "weighted-tags-v2"}
    assert set(got) == {"place_weighted", "2", "3", "4"}
    for i, r in got.items():
        whole = {"document": r["document"], "metadata": meta[i], "is_active": r["is_active"], "semantic_document_version": "weighted-tags-v2"}
        assert r["content_hash"] == hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_catalogue_file(spark, tmp_path):
    (tmp_path / "tags.json").write_text(json.dumps({"data": [{"id": 1, "name": "Uno", "category": "a"}, {"id": 2, "name": "Dos", "category": "b"}, {"id": 1, "name": "Otro", "category": "c"}]}, indent=1))
    assert sorted(map(tuple, fd.load_catalogue(spark, f"{tmp_path}/tags.json").collect())) == [(1, "Otro", "c"), (2, "Dos", "b")]


def test_sync_job(spark, tmp_path, service):
    Service.failed = 0
    table, embedder = VersionedTable(spark, f"{tmp_path}/places"), embed.HashEmbedder(8)
    run = lambda **o: jobs.sync_source(spark, "places", f"{service}/places", table, embedder, internal_token="inner", pause="0.01", **o)
    assert run(dry_run=True) == jobs.Counters(2, 0, 2, 0) and table.read() is None
    assert run() == jobs.Counters(2, 0, 2, 0)
    rows = {r["external_id"]: r for r in table.read().collect()}
    assert json.loads(rows["a"]["metadata"])["name"] == "Uno" and len(rows["a"]["embedding"]) == 8 and rows["a"]["embedding_model"] == "hash"  # the first record of an id
    assert run() == jobs.Counters(2, 2, 0, 0)
    assert table.verify({"external_id": "string", "embedding": "array<double>"}, 8) and not table.verify({"external_id": "bigint"}) and not table.verify({"external_id"}, 9)
    other = embed.HashEmbedder(8, version="v2")
    assert jobs.sync_source(spark, "places", f"{service}/places", table, other, internal_token="inner") == jobs.Counters(2, 0, 2, 0)
    assert table.read().count() == 2

    class Broken(embed.HashEmbedder):
        def embed(self, rows, text, name="embedding"):
            raise OSError("no model")

    before = table.versions()
    with pytest.raises(RuntimeError, match="2 failed records"):
        jobs.sync_source(spark, "places", f"{service}/places", table, Broken(9), internal_token="inner")
    assert table.versions() == before


def test_sync_command_and_posts(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"posts": [{"post_id": 1, "title": "Uno", "is_active": False}, {"id": 2, "name": "Dos"}]}))
    arguments = ["posts", "--source", f"file://{tmp_path}/{{page}}.json", "--table", f"{tmp_path}/posts", "--dimension", "4"]
    assert jobs.main(arguments, lambda: spark) == jobs.Counters(2, 0, 2, 0)
    (tmp_path / "1.json").write_text(json.dumps({"posts": [{"post_id": 1, "title": "Uno", "is_active": True}, {"id": 2, "name": "Dos"}]}))
    assert jobs.main(arguments, lambda: spark) == jobs.Counters(2, 1, 1, 0)
    assert {r["external_id"]: r["is_active"] for r in VersionedTable(spark, f"{tmp_path}/posts").read().collect()} == {"1": True, "2": True}
    with pytest.raises(ValueError):
        embed.create("nothing")
    with pytest.raises(ValueError):
        embed.create("words")


def test_word_embedder(spark):
    words = spark.createDataFrame([("cafe", [1.0, 0.0]), ("parque", [0.0, 1.0])], "word string, vector array<float>")
    rows = spark.createDataFrame([("a", "café"), ("a", "café"), ("b", None)], "external_id string, document string")
    got = embed.create("Words", 2, words).embed(rows, "document").collect()
    assert sorted((r["external_id"], r["embedding"]) for r in got) == [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0])]


def test_stream_takes_the_first_record(spark, tmp_path):
    table, told = VersionedTable(spark, f"{tmp_path}/table"), {}
    (tmp_path / "in").mkdir()
    schema = "external_id string, content_hash string, page int, pos int"
    spark.createDataFrame([("a", "0", 1, 1), ("a", "9", 1, 0), ("b", "1", 2, 0), (None, "2", 1, 0)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream_sync.start(spark.readStream.schema(schema).json(f"{tmp_path}/in"), table, f"{tmp_path}/ck", told=told.__setitem__).awaitTermination()
    assert {(r[0], r[1]) for r in table.read().select("external_id", "content_hash").collect()} == {("a", "9"), ("b", "1")}
    assert list(told.values()) == [jobs.Counters(2, 0, 2, 0)]


def test_projections(spark):
    rows = spark.createDataFrame([("1", None, '{"name":"","tags":"a, b","occasion":null}'), ("2", 0.123456, None)], "external_id string, score double, metadata string")
    got = {r["id"]: r for r in fp.answered(fp.place_candidates(rows), "score").select("*", fp.has_key("occasion").alias("key"), fp.has_text("tags").alias("text"), fp.llm_context().alias("context")).collect()}
    assert got["1"]["name"] == "1" and got["1"]["score"] == 0.0 and got["2"]["score"] == 0.1235 and got["1"]["key"] and not got["2"]["key"] and got["1"]["text"] and not got["2"]["text"]
    assert json.loads(got["1"]["context"]) == {"id": "1", "name": "1", "category": None, "city": None, "state": None, "price_range": None, "score": 0.0, "tags": "a, b"}
    assert fp.post_candidates(rows.drop("score")).where("id = '1'").first()["tags"] == ["a", "b"]
    texts = spark.createDataFrame([(["a", "b"], 5, None)], "l array<string>, n int, z string").select(fp.as_text(F.col("l"), True), fp.as_text(F.col("n")), fp.as_text(F.col("z")), fp.sorted_ids(F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()
    assert tuple(texts) == ("a b", "5", "", ["a", "b"])


def test_fixtures_and_checks(spark):
    assert fixtures.places(spark).count() == 12 and fixtures.posts(spark).first()["document"].startswith("Cafés para leer Tuxtla")
    assert [(r["cluster_id"], r["position"], r["post_id"]) for r in fixtures.cluster_posts(fixtures.clusters(spark)).orderBy("cluster_id", "position").collect()] == [("cluster_food", 0, "post_1"), ("cluster_food", 1, "post_3"), ("cluster_views", 0, "post_2")]
    table = spark.createDataFrame([([3.0, 4.0], "m", "v1"), ([1.0], "m", "v2")], "embedding array<double>, embedding_model string, embedding_version string")
    assert [tuple(r) for r in verification({"x": table, "y": table.limit(0)}).collect()] == [("x", 2, 1, 2, "m", "v1", 1.0, 5.0), ("y", 0, None, None, None, None, None, None)]
    assert checked_name("place_embeddings") == "place_embeddings"
    with pytest.raises(ValueError):
        checked_name("x; drop table y")


def test_shared_folder():
    """The named folder; without one a temporary folder on a local master only, the warehouse on a cluster, or an error."""
    from types import SimpleNamespace

    from quernel.sources.written import shared_dir

    def session(master, context=None, **conf):
        sc = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: held.get("dir", context), setCheckpointDir=lambda x: held.update(dir=x))
        held = {}
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda name, default=None: conf.get(name.replace(".", "_"), default)))

    assert shared_dir(session("spark://x", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert shared_dir(session("yarn", spark_sql_warehouse_dir="hdfs://w")) == "hdfs://w"
    assert shared_dir(session("yarn", "hdfs://c", spark_sql_warehouse_dir="hdfs://w")) == "hdfs://c"
    assert "quernel-" in shared_dir(session("local[2]", spark_sql_warehouse_dir="hdfs://w"))
    with pytest.raises(ValueError):
        shared_dir(session("local-cluster[2,1,512]"))
