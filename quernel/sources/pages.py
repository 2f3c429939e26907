"""A paginated JSON source as a Spark data source, and the shapes of its payloads."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Keys that may hold the records, in order, for each kind; and keys that may hold a record's id.
KEYS = {"places": ("data", "places", "items", "results"), "posts": ("data", "posts", "items", "results")}
ID_KEYS = {"places": ("id", "_id", "place_id", "uuid"), "posts": ("id", "_id", "post_id", "uuid")}


def unwrap(payload: object, kind: str, skip_empty: bool = False) -> list[dict]:
    """The records of a payload: a list's objects, else those of the first key that holds a list (with skip_empty, one that
    isn't empty), looking into nested objects on the way."""
    if isinstance(payload, list):
        return [x for x in payload if isinstance(x, dict)]
    for key in KEYS[kind] if isinstance(payload, dict) else ():
        inner = payload.get(key)
        if isinstance(inner, list) and (inner or not skip_empty):
            return [x for x in inner if isinstance(x, dict)]
        if isinstance(inner, dict) and (found := unwrap(inner, kind, skip_empty)):
            return found
    return []


def record_id(record: dict, kind: str) -> str | None:
    for key in ID_KEYS[kind]:
        if record.get(key) is not None:
            return str(record[key])
    return None


def nearby_ids(payload: object, kind: str = "places") -> set[str]:
    """Ids of a nearby answer; values that are empty or zero are passed over for the next key."""
    rows = unwrap(payload, kind, skip_empty=True)
    return {str(v) for r in rows if (v := next((r[k] for k in ID_KEYS[kind] if r.get(k)), None))}


def next_page(payload: object) -> tuple[str | None, bool]:
    """Next cursor and whether there is more."""
    if not isinstance(payload, dict):
        return None, False
    cursor = payload.get("next_cursor")
    cursor = payload.get("nextCursor") if cursor is None else cursor
    more = payload.get("has_more")
    return (str(cursor).strip() or None if cursor is not None else None), bool(payload.get("hasMore", False) if more is None else more)


def iterate(fetch: Callable[[dict], object], kind: str, limit: int = 100, mode: str = "cursor", max_pages: int | None = None) -> Iterator[tuple[str, str, int, int]]:
    """id, record as JSON, page and position of every record with a new id, page after page.

    Ends at an empty page, a page without new ids, the last allowed page, in cursor mode where no cursor or no more is
    told, and in the other modes at a short page.
    """
    seen: set[str] = set()
    cursor, page = None, 1
    while True:
        asked = {"limit": limit} | ({"cursor": cursor} if mode == "cursor" and cursor else {"offset": (page - 1) * limit} if mode == "offset" else {"page": page} if mode != "cursor" else {})
        payload = fetch(asked)
        rows = unwrap(payload, kind)
        fresh = 0
        for pos, row in enumerate(rows):
            if (rid := record_id(row, kind)) is not None and rid not in seen:
                seen.add(rid)
                fresh += 1
                yield rid, json.dumps(row, ensure_ascii=False), page, pos
        cursor, more = next_page(payload)
        if not rows or not fresh or (max_pages and page >= max_pages) or (mode == "cursor" and not (more and cursor)) or (mode != "cursor" and len(rows) < limit):
            return
        page += 1


def headers_of(options: dict) -> dict[str, str]:
    """A bearer token from the options internal_token or, without one, auth_token."""
    token = options.get("internal_token") or options.get("auth_token")
    return {"Authorization": f"Bearer {token}"} if token else {}


def fetched(url: str, asked: dict, options: dict) -> object:
    """The JSON answer to a request. A server's error (5xx) or a broken connection is tried again `retries` times, with a pause
    that doubles; other errors are raised at once."""
    import time
    import urllib.error
    import urllib.parse
    import urllib.request

    if url.startswith("http"):
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(asked)
    else:  # a template of files, for instance file:///pages/{page}.json
        url = url.format(**({"page": asked.get("page") or asked.get("cursor") or 1} | asked))
    for turn in range(int(options.get("retries", 2)) + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers_of(options) if url.startswith("http") else {}), timeout=float(options.get("timeout", 15))) as answer:
                return json.load(answer)
        except urllib.error.URLError as error:
            if turn == int(options.get("retries", 2)) or getattr(error, "code", 500) < 500:
                raise
            time.sleep(float(options.get("pause", 0.5)) * 2**turn)
    raise AssertionError


class NearbyUnavailable(RuntimeError):
    """The service of nearby places can't be reached; callers over HTTP answer 502."""

    code, status = "nearby_places_unavailable", 502


def nearby_places(spark: SparkSession, url: str, lat: float, lng: float, radius: int, **options: str) -> DataFrame:
    """external_id of the places that the service at url names around a point: the ids of a semi-join. One answer is one page,
    so its ids are a small table."""
    import urllib.error

    try:
        payload = fetched(url, {"lat": lat, "lng": lng, "radius": radius}, options)
    except urllib.error.URLError as error:
        raise NearbyUnavailable("the nearby places service is unavailable") from error
    return spark.createDataFrame([(i,) for i in sorted(nearby_ids(payload))], "external_id string")


class PagedJson(DataSource):
    """spark.read.format("paged_json").option("url", ...) with options kind, limit, mode, max_pages, internal_token or auth_token,
    timeout, retries and pause: one sequential chain of requests, as each page names the next."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "id string, record string, page int, pos int"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        yield from iterate(lambda asked: fetched(o["url"], asked, o), o.get("kind", "places"), int(o.get("limit", 100)), o.get("mode", "cursor"), int(o["max_pages"]) if o.get("max_pages") else None)
