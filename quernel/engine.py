"""The public calls: search, recommendation, chat, related posts and evaluation over tables of entities."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.documents import PLACE_WEIGHTS
from .functions.projections import filled_or
from .functions.text import CATEGORY_EXTRA, TAGS_EXTRA, place_tokens
from .operators import embed, metrics, policy, rank, retrieve
from .sources.written import Scratch

#: Rankers: semantic and vector keep the order of the vector scores (vector prefers the asked city, then category, among equal
#: scores), bm25 and tfidf rank each query's candidates by their terms.
RANKERS = ("semantic", "vector", "bm25", "tfidf")


@dataclass(frozen=True)
class Config:
    """Thresholds of a match are those of the ranker: no_match and relevant for vector scores, the bm25_ ones for BM25."""

    dimension: int = 300
    no_match: float = 0.30
    relevant: float = 0.50
    overfetch: int = 3
    ranker: str = "semantic"
    k1: float = 1.5
    b: float = 0.75
    bm25_no_match: float = 0.0
    bm25_relevant: float = 3.0

    def __post_init__(self) -> None:
        if self.dimension < 1 or not -1 <= self.no_match <= self.relevant <= 1:
            raise ValueError("dimension must be positive, thresholds in order and within -1..1")
        if self.k1 <= 0 or not 0 <= self.b <= 1 or not 0 <= self.bm25_no_match <= self.bm25_relevant:
            raise ValueError("k1 must be positive, b within 0..1, thresholds of BM25 in order and not negative")
        if self.ranker not in RANKERS:
            raise ValueError(f"there is no ranker {self.ranker}")

    def thresholds(self) -> tuple[float, float]:
        return (self.bm25_no_match, self.bm25_relevant) if self.ranker == "bm25" else (self.no_match, self.relevant)

    def described(self) -> dict[str, object]:
        """What the metrics say of the ranker."""
        words = {"tags": TAGS_EXTRA + 1, "category": CATEGORY_EXTRA + 1, "other_text": 1}
        weights = {"semantic": dict(PLACE_WEIGHTS), "vector": {"other_text": 1}}.get(self.ranker, words)
        parameters = {"bm25": {"k1": self.k1, "b": self.b}, "semantic": {"dimension": float(self.dimension)}}.get(self.ranker, {})
        return {"engine": self.ranker, "score_metric": "bm25" if self.ranker == "bm25" else "cosine_similarity", "field_weights": weights, "ranking_parameters": parameters}


def check_request(text: str, limit: int, lat: float | None = None, lng: float | None = None, radius_m: int | None = None, most_letters: int = 500, most: int = 20) -> None:
    """The limits of a request; ValueError beyond them."""
    if not 1 <= len(text) <= most_letters:
        raise ValueError(f"a text has 1 to {most_letters} letters")
    check_limits(limit, lat, lng, radius_m, most)


def check_limits(limit: int, lat: float | None = None, lng: float | None = None, radius_m: int | None = None, most: int = 20) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"a limit is 1 to {most}")
    if (lat is None) != (lng is None) or (lat is not None and not (-90 <= lat <= 90 and -180 <= lng <= 180)):
        raise ValueError("latitude and longitude come together and within their ranges")
    if radius_m is not None and not 1 <= radius_m <= 50_000:
        raise ValueError("a radius has 1 to 50000 metres")


def check_texts(queries: DataFrame, most_letters: int) -> None:
    """ValueError if a query's text is missing, empty or too long."""
    bad = queries.where(F.col("text").isNull() | ~F.length("text").between(1, most_letters)).select("qid").limit(1).collect()
    if bad:
        raise ValueError(f"the text of query {bad[0][0]} doesn't have 1 to {most_letters} letters")


@dataclass(frozen=True)
class Geo:
    """A point and radius, and what gives the ids around it as a table (its first column)."""

    lat: float
    lng: float
    provider: Callable[[float, float, int], DataFrame]
    radius_m: int = 5_000


@dataclass(frozen=True)
class Result:
    """places: qid, rank, external_id, score, vector_score; metrics: a row for each query."""

    places: DataFrame
    metrics: DataFrame


def cache_key(query: str, filters: retrieve.Filters, limit: int, geo: Geo | None = None) -> str:
    """One text for equal requests: the normalised query, the filters that are set, limit and place. ids are no part of it."""
    asked = {k: v for k, v in asdict(replace(filters, ids=None)).items() if v is not None}
    place = (geo.lat, geo.lng) if geo else (None, None)
    return json.dumps({"query": " ".join(query.lower().split()), "filters": asked, "limit": limit, "latitude": place[0], "longitude": place[1], "radius_meters": geo.radius_m if geo else 5_000}, sort_keys=True)


def post_cache_key(query: str, city: str | None, limit: int) -> str:
    return f"posts:{' '.join(query.lower().split())}:{city}:{limit}"


class Expiring:
    """Values under keys for a number of seconds each; what is older is gone."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: str) -> object | None:
        value, until = self.held.get(key, (None, 0.0))
        if until > self.clock():
            return value
        self.held.pop(key, None)
        return None

    def set(self, key: str, value: object) -> None:
        self.held[key] = value, self.clock() + self.seconds

    def clear(self) -> None:
        self.held.clear()


def wider(top: retrieve.Filters, nested: retrieve.Filters) -> retrieve.Filters:
    """The nested filters with city and state of the request itself where it names them; an empty one doesn't count."""
    return replace(nested, city=top.city or nested.city, state=top.state or nested.state)


def trace_ids() -> tuple[str, str]:
    """A new id of a response and of its trace."""
    return f"resp_{uuid.uuid4().hex}", f"trace_{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Engine:
    """entities: external_id, name, document, embedding, is_active and filter columns (category and tags count for term rankers).

    generate: what writes the message of an answer from the columns mode and names; the output guard passes or replaces it.
    """

    entities: DataFrame
    config: Config = Config()
    embedder: embed.Embedder | None = None
    generate: Callable[[Column, Column], Column] = policy.template_message
    source_name: str = "table"

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return (self.embedder or embed.HashEmbedder(self.config.dimension)).embed(rows, text, "qv")

    def _text(self, name: str) -> Column:
        return F.col(name).cast("string") if name in self.entities.columns else F.lit(None).cast("string")

    def run(self, queries: DataFrame, limit: int = 10, filters: retrieve.Filters | None = None, mode: str = "sql", geo: Geo | None = None) -> Result:
        """Search for every query (qid, text): overfetch * limit candidates by vector, ranked, the best `limit` returned."""
        c, filters, scratch = self.config, filters or retrieve.Filters(), Scratch(queries.sparkSession)
        check_limits(limit, *((geo.lat, geo.lng, geo.radius_m) if geo else ()))
        check_texts(queries, 1_000)
        if mode == "sql":  # a stored table is asked for active rows, whatever the request says
            filters = replace(filters, is_active=True)
        near = None
        if geo:
            near = scratch.keep(geo.provider(geo.lat, geo.lng, geo.radius_m))
            filters = replace(filters, ids=near)
        pool = retrieve.apply(self.entities, filters, mode)
        found = scratch.keep(retrieve.batch_top_k(pool, self.embed(queries), c.overfetch * limit, key="external_id"))
        asked = rank.terms(queries, "qid", "text").select("qid", "term", F.col("tf").alias("qtf"))
        docs = self.entities.join(found.select("external_id").distinct(), "external_id", "left_semi")
        tokens = place_tokens(self._text("document"), self._text("category"), self._text("tags"), *(self._text(n) for n in ("name", "city", "state", "occasion", "short_description")))
        held = scratch.keep(rank.counted_tokens(docs.select("external_id", tokens.alias("tokens")), "external_id"))
        doc_terms, lens = held.where("term is not null").select("external_id", "term", "tf", "len"), held.where("first").select("external_id", "len")
        if c.ranker == "bm25":
            scored = rank.rerank_bm25(asked, found, doc_terms, lens, c.k1, c.b)
        elif c.ranker == "tfidf":
            scored = rank.rerank_tfidf(asked, found, doc_terms, lens)
        else:
            scored = found.withColumn("rank_score", F.col("score"))
        ties: list[Column] = []
        if c.ranker == "vector" and {"city", "category"} & set(self.entities.columns):
            scored = scored.join(docs.select("external_id", *(x for x in ("city", "category") if x in self.entities.columns)), "external_id")
            ties = [t for t, x in zip(retrieve.tie_boost(scored, filters.city, filters.category)[1:], ("city", "category"), strict=True) if x in scored.columns]
        places = scratch.keep(rank.ranked(scored, limit, *ties).select("qid", "rank", "external_id", "score", "vector_score"))
        stats = metrics.score_stats(queries, found, places)
        stats = stats.join(metrics.coverage(asked, found, doc_terms), "qid", "left")
        none, relevant = c.thresholds()
        said = c.described()
        fixed = {"engine": F.lit(said["engine"]), "candidate_retrieval": F.lit(self.source_name), "score_metric": F.lit(said["score_metric"]), "field_weights": F.lit(json.dumps(said["field_weights"])), "ranking_parameters": F.lit(json.dumps(said["ranking_parameters"])), "relevance_threshold": F.lit(float(relevant))}
        place = {"location_filter_applied": F.lit(geo is not None), "nearby_place_count": F.lit(near.distinct().count() if near is not None else None).cast("int"), "radius_meters": F.lit(geo.radius_m if geo else None).cast("int")}
        counts = {n: F.coalesce(F.col(o), F.lit(z)) for n, o, z in (("query_token_count", "query_terms", 0), ("matched_query_token_count", "matched_terms", 0), ("query_coverage", "coverage", 0.0))}
        told = stats.withColumns(fixed | counts | place | {"match_quality": metrics.match_quality(F.col("max_score"), none, relevant), "scope": F.lit("current_query"), "ground_truth_available": F.lit(False)})
        return Result(places, told.drop("query_terms", "matched_terms", "coverage").withColumnRenamed("nonzero_count", "nonzero_score_count"))

    def search(self, queries: DataFrame, limit: int = 10, filters: retrieve.Filters | None = None, mode: str = "sql", geo: Geo | None = None) -> DataFrame:
        """qid, rank, external_id, score, match_quality for every query (qid, text); a query without candidates has one row with
        a null rank and no_match."""
        found = self.run(queries, limit, filters, mode, geo)
        return found.metrics.select("qid", "match_quality").join(found.places, "qid", "left").select("qid", "rank", "external_id", "score", "match_quality")

    def _named(self, places: DataFrame, queries: DataFrame) -> DataFrame:
        """qid, places and names in order, and scores, of every query."""
        name = filled_or(self._text("name"), F.col("external_id").cast("string"))
        met = places.join(self.entities.select("external_id", name.alias("name")), "external_id")
        top = met.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("external_id").cast("string").alias("id"), "name", "score"))).alias("top"))  # limit rows
        of = lambda f, kind: F.coalesce(F.transform("top", lambda x: x[f]), F.array().cast(f"array<{kind}>")).alias({"id": "places", "name": "names", "score": "scores"}[f])
        return queries.select("qid").join(top, "qid", "left").select("qid", of("id", "string"), of("name", "string"), of("score", "double"))

    def _answered(self, rows: DataFrame, mode: Column, guard_mode: Column) -> DataFrame:
        guarded = policy.guard(self.generate(mode, F.col("names")), guard_mode, F.col("names"))
        return rows.withColumn("_g", guarded).withColumns({"message": F.col("_g.message"), "used_fallback": F.col("_g.used_fallback"), "guard_reason": F.col("_g.reason")}).drop("_g")

    def recommend(self, queries: DataFrame, limit: int = 5, filters: retrieve.Filters | None = None, mode: str = "sql", geo: Geo | None = None) -> DataFrame:
        """qid, match_quality, places, names, message, used_fallback, guard_reason and the figures of the returned scores: nothing
        is recommended without a match or a positive score, and the message passes the output guard."""
        check_texts(queries, 500)
        found = self.run(queries, limit, filters, mode, geo)
        quality = found.metrics.select("qid", "match_quality", "candidate_count", "query_coverage")
        kept = found.places.join(quality.where("match_quality <> 'no_match'").select("qid"), "qid").where("score > 0")
        rows = self._named(kept, queries).join(quality, "qid")
        rows = self._answered(rows, F.col("match_quality"), F.col("match_quality"))
        n = F.size("scores")
        some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
        figures = {"returned_count": n, "nonzero_score_count": n, "min_score": some(F.array_min("scores")), "max_score": some(F.array_max("scores")), "mean_score": some(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / n)}
        return rows.withColumns(figures).drop("scores")

    def chat(self, queries: DataFrame, limit: int = 5, filters: retrieve.Filters | None = None, mode: str = "sql") -> DataFrame:
        """qid, places (ids in order), message, used_fallback and guard_reason: the answer, whatever the match quality, as the
        output guard lets it pass. At most 8 places."""
        check_limits(limit, most=8)
        rows = self._named(self.run(queries, limit, filters, mode).places, queries)
        return self._answered(rows, F.lit("confident"), F.lit("confident")).select("qid", "places", "message", "used_fallback", "guard_reason")

    def related_posts(self, queries: DataFrame, limit: int = 5, city: str | None = None) -> DataFrame:
        """qid, rank, external_id and score of the best entities of a city; an empty city means any."""
        found = replace(self, config=replace(self.config, ranker="semantic")).run(queries, limit, retrieve.Filters(city=city or None))
        return found.places.drop("vector_score")

    def evaluate(self, queries: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
        """One row: the averages of all metrics at k over BM25 of overfetch * k candidates for each query."""
        check_limits(k)
        found = replace(self, config=replace(self.config, ranker="bm25")).run(queries, k)
        return metrics.macro(metrics.evaluate(queries, found.places.withColumnRenamed("external_id", "doc_id"), qrels, k))
