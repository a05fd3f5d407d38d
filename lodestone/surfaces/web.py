"""Search over HTTP: ``/search`` (an answer), ``/retrieve`` (raw results), ``/health`` and a page that asks."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from ..config import EngineConfig
from ..functions import fixed_values as V
from ..plans import pipeline
from ..sources import indexes
from .models import Model

log = logging.getLogger(__name__)

PAGE = """<!doctype html><meta charset="utf-8"><title>Search</title>
<form><input name="q" size="60" autofocus><button>Ask</button></form><p id="scope"></p><pre id="answer"></pre><ul id="sources"></ul>
<script>
document.querySelector("form").onsubmit = async e => {
  e.preventDefault();
  const show = (id, text) => document.getElementById(id).textContent = text;
  show("answer", "..."); document.getElementById("sources").replaceChildren();
  try {
    const r = await fetch("/search", {method: "POST", body: JSON.stringify({query: new FormData(e.target).get("q"), top_k: 5})});
    const d = await r.json();
    if (!r.ok) throw new Error(d.detail);
    show("scope", d.version); show("answer", d.answer);
    for (const s of d.sources) { const li = document.createElement("li"); li.textContent = s; document.getElementById("sources").append(li); }
  } catch (error) { show("answer", error.message); }
};
</script>"""


class Failure(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def _asked(body: Any) -> tuple[str, int]:
    if not isinstance(body, dict) or not isinstance(body.get("query"), str):
        raise Failure(400, "a query is needed")
    if not body["query"].strip():
        raise Failure(400, "query must not be empty")
    k = body.get("top_k", V.TOP_K)
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= V.MAX_TOP_K:
        raise Failure(422, f"top_k must be a whole number from 1 to {V.MAX_TOP_K}")
    return body["query"], k


class Service:
    """Requests as functions from a body to a JSON object; a session and settings are all it holds."""

    def __init__(self, spark: SparkSession, config: EngineConfig, model_of: Callable[..., Model] = Model.of):
        self.spark, self.config, self.model_of = spark, config, model_of

    def search(self, body: Any) -> dict:
        query, k = _asked(body)
        used: dict[str, str | None] = {"model": None, "provider": None}

        def complete(system: str, user: str) -> str:
            model = self.model_of(self.config, body.get("provider") or "", body.get("model") or "")
            used.update(model=model.name, provider=model.provider)
            return model.complete(system, user)

        return pipeline.answer(self.spark, self.config.indexes(), query, complete, k, profile=self.config.profile) | used

    def retrieve(self, body: Any) -> dict:
        query, k = _asked(body)
        return pipeline.retrieve(self.spark, self.config.indexes(), query, k, profile=self.config.profile)

    def health(self, _: Any = None) -> dict:
        if not indexes.exists(self.spark, self.config.index_dir):
            return {"status": "no-index", "chunks": 0, "manifest": {}}
        chunks, manifest = indexes.read_many(self.spark, self.config.indexes())
        return {"status": "ok", "chunks": chunks.count(), "manifest": {k: manifest.get(k) for k in ("dim", "n_chunks", "engine_version", "engine_ref", *V.MANIFEST_FIELDS) if k in manifest}}

    def respond(self, method: str, path: str, raw: bytes = b"") -> tuple[int, dict]:
        """Status and body of the answer to a request."""
        routes = {("POST", "/search"): self.search, ("POST", "/retrieve"): self.retrieve, ("GET", "/health"): self.health}
        route = routes.get((method, path))
        try:
            if route is None:
                raise Failure(404, "not found")
            try:
                body = json.loads(raw) if method == "POST" else None
            except ValueError:
                raise Failure(400, "the body is no JSON") from None
            return 200, route(body)
        except Failure as e:
            return e.status, {"detail": str(e)}
        except ValueError as e:
            return 400, {"detail": f"configuration error: {e}"}
        except FileNotFoundError:
            return 503, {"detail": "no search index found on the server"}
        except Exception as e:
            log.exception("request failed")
            about_key = any(w in str(e).lower() for w in ("401", "auth", "api key", "api_key", "permission"))
            return 500, {"detail": "the model call failed" + (": the server has no valid key" if about_key else "")}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, data: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, body = service.respond(method, self.path, raw)
            self._send(status, "application/json", json.dumps(body, ensure_ascii=False).encode())

        def do_GET(self) -> None:
            self._send(200, "text/html; charset=utf-8", PAGE.encode()) if self.path == "/" else self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *args) -> None:
            log.info(*args)

    return ThreadingHTTPServer((host, port), Handler)
