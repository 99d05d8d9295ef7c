"""A small HTTP service over one engine: search, documents, folders under watch, status.

One process with one Spark session answers; the work is Spark's. Requests and answers are JSON.
"""

from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from findwell.config import SearchQuery
from findwell.plans.engine import SearchEngine

ROOT = "/api/v1"
_FIELDS = {"query": str, "limit": int, "offset": int, "keyword": bool, "semantic": bool, "fuzzy": bool, "min_score": (int, float), "min_keyword_score": (int, float), "min_semantic_score": (int, float)}
_NAMES = {"keyword_enabled": "keyword", "semantic_enabled": "semantic", "fuzzy_enabled": "fuzzy"}  # other names of the same settings


class Refused(Exception):
    """A request that can't be answered, with its status."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Service:
    """The answers, apart from the transport: ``answer(method, path, body)`` gives (status, object)."""

    def __init__(self, engine: SearchEngine, rerank: bool = True):
        self.engine, self.rerank, self.lock = engine, rerank, threading.Lock()

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
        parts = urlsplit(target)
        path, asked = parts.path.rstrip("/"), parse_qs(parts.query)
        try:
            if path == "/health" and method == "GET":
                return 200, {"status": "ok"}
            if path == f"{ROOT}/status" and method == "GET":
                return 200, self.engine.status()
            if path == f"{ROOT}/search" and method == "POST":
                return 200, self.search(self.read(body))
            if path == f"{ROOT}/documents" and method == "POST":
                return 201, self.add_document(self.read(body))
            if path.startswith(f"{ROOT}/documents/") and method in ("GET", "DELETE"):
                return 200, getattr(self, f"{method.lower()}_document")(unquote(path[len(ROOT) + 11 :]))
            if path == f"{ROOT}/watch/directories" and method in ("GET", "POST", "DELETE"):
                return self.folders(method, asked, body)
            raise Refused(404, "not found")
        except Refused as e:
            return e.status, {"error": str(e)}
        except Exception as e:  # noqa: BLE001
            return 500, {"error": str(e).split("\n")[0]}

    @staticmethod
    def read(body: bytes) -> dict:
        try:
            given = json.loads(body or b"null")
        except ValueError:
            given = None
        if not isinstance(given, dict):
            raise Refused(400, "the request body must be a JSON object")
        return given

    def search(self, given: dict) -> dict:
        given = {_NAMES.get(k, k): v for k, v in given.items()}
        known = {k: v for k, v in given.items() if k in _FIELDS and v is not None}
        for k, v in known.items():
            if not isinstance(v, _FIELDS[k]) or (isinstance(v, bool) and _FIELDS[k] is not bool):
                raise Refused(400, f"{k} has the wrong type")
        try:
            query = SearchQuery(**{"query": "", **known}).validated()
        except ValueError as e:
            raise Refused(400, str(e)) from None
        return self.engine.search(query, rerank=self.rerank, auto_fuzzy=True)

    def add_document(self, given: dict) -> dict:
        spark = self.engine.spark
        row = [(given.get("id") or None, given.get("title"), given.get("content"), {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in (given.get("metadata") or {}).items()})]
        table = spark.createDataFrame(row, "id string, title string, content string, metadata map<string,string>")
        with self.lock:
            self.engine.index(table)
        return {"id": given.get("id") or self.engine.made_id(given.get("title"), given.get("content")), "status": "indexed"}

    def get_document(self, key: str) -> dict:
        try:
            return self.engine.get(key).asDict(True)
        except KeyError:
            raise Refused(404, "document not found") from None

    def delete_document(self, key: str) -> dict:
        with self.lock:
            self.engine.delete(self.engine.spark.createDataFrame([(key,)], "id string"))
        return {"status": "deleted"}

    def folders(self, method: str, asked: dict, body: bytes) -> tuple[int, object]:
        if method == "GET":
            return 200, {"directories": self.engine.watcher.directories()}
        given = self.read(body) if body else {}
        path = given.get("path") or (asked.get("path") or [""])[0]
        if not path:
            raise Refused(400, "a path is needed")
        path = os.path.abspath(path)
        if method == "DELETE":
            try:
                self.engine.unwatch(path)
            except KeyError:
                raise Refused(404, "the directory isn't watched") from None
            return 200, {"path": path, "status": "removed"}
        if not os.path.exists(path):
            raise Refused(404, "directory not found")
        if not os.path.isdir(path):
            raise Refused(400, "the path is no directory")
        self.engine.watch(path, sync=given.get("sync") is not False)
        return 201, {"path": path, "status": "added"}


def serve(engine: SearchEngine, host: str = "127.0.0.1", port: int = 8080, rerank: bool = True) -> ThreadingHTTPServer:
    """A server that is bound and ready; ``serve_forever`` runs it, ``shutdown`` ends it."""
    service = Service(engine, rerank)

    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            size = int(self.headers.get("Content-Length") or 0)
            status, thing = service.answer(self.command, self.path, self.rfile.read(size) if size else b"")
            data = json.dumps(thing, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
