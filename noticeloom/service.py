"""The record service: routes and status codes over a dataset; a thin shell, not part of any plan."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.operators import records
from noticeloom.plans.notices import SCHEMA_VERSION

CACHED, FRESH = "public, s-maxage=300, stale-while-revalidate=86400", "no-store"


def about() -> dict:
    return {"service": "noticeloom", "status": "ok", "schema_version": SCHEMA_VERSION, "endpoints": {"companies": "/api/companies"}}


def route(target: str, dataset: DataFrame, summary: dict, ordinal: str = "ordinal") -> tuple[int, dict, str]:
    """(status, payload, cache rule) of a GET: `/` and `/api` say what this is, `/api/companies` answers a
    record query; 400 for a bad parameter, 404 for another path, 500 if the dataset cannot be read."""
    parts = urlsplit(target)
    path = parts.path.rstrip("/") or "/"
    if path in ("/", "/api"):
        return 200, about(), CACHED
    if path != "/api/companies":
        return 404, {"error": "Endpoint not found"}, FRESH
    try:
        query = records.Query.of(parse_qs(parts.query))
    except ValueError as e:
        return 400, {"error": str(e)}, FRESH
    try:
        found = records.respond(dataset, query, ordinal)
    except (PySparkException, OSError):
        return 500, {"error": "Dataset is unavailable"}, FRESH
    return 200, {"schema_version": SCHEMA_VERSION, "dataset": summary, **found, "records": [json.loads(r) for r in found["records"]]}, CACHED


def load(spark, path: str, schema) -> tuple[DataFrame, dict]:
    """The cached records of a dataset file and its summary."""
    from noticeloom.sources import scans

    summary = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.summary").alias("s")).first()
    return scans.dataset(spark, path, schema).cache(), json.loads(summary.s) if summary and summary.s else {}


def handler(dataset: DataFrame, summary: dict) -> type[BaseHTTPRequestHandler]:
    """A request handler class over one dataset, for http.server."""

    class Handler(BaseHTTPRequestHandler):
        def _headers(self, status: int, **more: str) -> None:
            self.send_response(status)
            for name, value in more.items():
                self.send_header(name.replace("_", "-"), value)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()

        def do_GET(self) -> None:
            status, payload, cache = route(self.path, dataset, summary)
            body = json.dumps(payload, ensure_ascii=False).encode()
            self._headers(status, Content_Type="application/json; charset=utf-8", Content_Length=str(len(body)), Cache_Control=cache)
            self.wfile.write(body)

        def do_OPTIONS(self) -> None:
            self._headers(204, Access_Control_Allow_Methods="GET, OPTIONS", Access_Control_Allow_Headers="Content-Type")

        def log_message(self, *_) -> None:
            pass

    return Handler
