"""An HTTP front: OTLP ingest and the Jaeger query interface."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from spanloom.engine import Engine
from spanloom.operators import jaeger as J
from spanloom.sources.otlp import DecodeError, parse_protobuf

JSON = "application/json"


def _error(code: int, text: str) -> tuple[int, str]:
    return code, json.dumps({"error": text})


def _denied(engine: Engine, headers: dict[str, str], query: dict[str, str]) -> tuple[int, str] | None:
    want = engine.store.config.bearer_token
    if want is None:
        return None
    auth = headers.get("authorization", "")
    got = auth.removeprefix("Bearer ").strip() if auth.startswith("Bearer ") else query.get("token")
    if not got:
        return _error(401, "unauthorized")
    return None if hmac.compare_digest(got.encode(), want.encode()) else _error(403, "forbidden")


def _ingest(engine: Engine, headers: dict[str, str], body: bytes) -> tuple[int, str]:
    """A batch is taken whole or not at all."""
    if len(body) > engine.store.config.max_body_bytes:
        return _error(413, "body too large")
    if "application/x-protobuf" in headers.get("content-type", JSON):
        try:
            n = len(parse_protobuf(body))
        except (DecodeError, OSError, EOFError, ValueError, AttributeError, TypeError):
            return _error(400, "invalid protobuf")
        engine.accept(body, True, n)
        return 200, "{}"
    try:
        got = json.loads(body)
    except ValueError:
        return _error(400, "invalid JSON")
    if not isinstance(got, dict) or not isinstance(got.get("resourceSpans"), list):
        return _error(400, "missing resourceSpans")
    engine.accept(body, False, body.count(b'"spanId"') + body.count(b'"span_id"'))
    return 200, "{}"


def handle(engine: Engine, method: str, url: str, headers: dict[str, str], body: bytes = b"") -> tuple[int, str]:
    """Status and JSON text of a request; headers have lower-case names."""
    u = urlparse(url)
    query = {k: v[-1] for k, v in parse_qs(u.query, keep_blank_values=True).items()}
    parts = [unquote(p) for p in u.path.strip("/").split("/")]
    if (method, parts) == ("GET", ["health"]):
        s = engine.stats()
        return 200, json.dumps({"status": "ok", "blocks": s["total_blocks"], "spans": s["total_entries"], "disk_size": s["total_bytes"]})
    denied = _denied(engine, headers, query)
    if denied:
        return denied
    match method, parts:
        case "POST", ["insert", "opentelemetry", "v1", "traces"]:
            return _ingest(engine, headers, body)
        case "GET", ["select", "jaeger", "api", "services"]:
            return 200, J.name_list(engine.services())
        case "GET", ["select", "jaeger", "api", "services", service, "operations"]:
            return 200, J.name_list(engine.operations(service))
        case "GET", ["select", "jaeger", "api", "traces"]:
            try:
                filters = J.search_filters(query)
            except ValueError as e:
                return _error(400, str(e))
            found = J.search(engine._spans(filters), query)
            return 200, J.envelope([r["json"] for r in found.collect()])
        case "GET", ["select", "jaeger", "api", "traces", trace_id]:
            got = [r["json"] for r in J.jaeger_traces(engine.trace(trace_id)).collect()]
            none = json.dumps({"traceID": trace_id, "spans": [], "processes": {}, "warnings": None})
            return 200, J.envelope(got or [none])
        case "POST", ["api", "v1", "backup"]:
            try:
                path = (json.loads(body) if body else {}).get("path")
            except (ValueError, AttributeError):
                path = None
            return 200, json.dumps({"status": "ok", **engine.backup(path or f"{engine.store.root}-backup")})
        case ("GET" | "POST"), ["api", "v1", "flush"]:
            engine.flush()
            return 200, json.dumps({"status": "ok"})
    return _error(404, "not found")


def serve(engine: Engine, port: int | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            n = int(self.headers.get("content-length") or 0)
            limit = engine.store.config.max_body_bytes
            body = self.rfile.read(min(n, limit + 1))
            code, text = handle(engine, self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, body)
            raw = text.encode()
            self.send_response(code)
            self.send_header("content-type", JSON)
            self.send_header("content-length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _do

        def log_message(self, *a) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", engine.store.config.http_port if port is None else port), Handler)
