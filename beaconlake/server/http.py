"""The HTTP server: routes, keys, slots, time limits and connection limits."""

from __future__ import annotations

import json
import re
import ssl
import threading
import time
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

import beaconlake
from beaconlake.operators import health
from beaconlake.operators.discovery import Cache, Discovery
from beaconlake.plans.model import ApiError
from beaconlake.server.adapters import Adapters, storage_health
from beaconlake.server.config import Config
from beaconlake.server.guard import CHEAP, HEAVY, Admission, check_key, timed
from beaconlake.server.metrics import Metrics
from beaconlake.sources.catalogs import CatalogTables, attach, storage_layout
from beaconlake.sources.tables import Tables

#: Scrapes read the stored gauges; counts and latest times of the tables are taken anew after so many seconds.
MEASURE_SECONDS = 60.0
MOST_LINE, MOST_HEADER_BYTES, MOST_HEADERS, MOST_KEPT_ALIVE, DRAIN_SECONDS = 8 << 10, 64 << 10, 100, 10_000, 30


@dataclass(frozen=True)
class Route:
    methods: tuple[str, ...]
    template: str
    slot: str | None
    handler: str

    def match(self, method: str, path: str) -> tuple[str, ...] | None:
        if method not in self.methods:
            return None
        found = re.fullmatch(re.sub(r":\w+", "([^/]+)", self.template), path)
        return found and found.groups()


# The routes that clients call, and the class of slot each takes.
ROUTES = (
    Route(("GET", "POST"), "/api/v1/query", CHEAP, "metric_query"),
    Route(("GET", "POST"), "/api/v1/query_range", HEAVY, "metric_range"),
    Route(("GET",), "/api/v1/labels", CHEAP, "metric_labels"),
    Route(("GET",), "/api/v1/series", CHEAP, "metric_series"),
    Route(("GET",), "/api/v1/metadata", CHEAP, "metric_metadata"),
    Route(("GET",), "/api/v1/label/:name/values", CHEAP, "metric_label_values"),
    Route(("GET",), "/loki/api/v1/query", CHEAP, "log_query"),
    Route(("GET",), "/loki/api/v1/query_range", HEAVY, "log_range"),
    Route(("GET",), "/loki/api/v1/labels", CHEAP, "log_labels"),
    Route(("GET",), "/loki/api/v1/series", CHEAP, "log_series"),
    Route(("GET",), "/loki/api/v1/label/:name/values", CHEAP, "log_label_values"),
    Route(("GET",), "/api/search", HEAVY, "trace_search"),
    Route(("GET",), "/api/search/tags", CHEAP, "tags"),
    Route(("GET",), "/api/v2/search/tags", CHEAP, "tags"),
    Route(("GET",), "/api/search/tag/:tag/values", CHEAP, "tag_values"),
    Route(("GET",), "/api/v2/search/tag/:tag/values", CHEAP, "tag_values"),
    Route(("GET",), "/api/traces/:trace_id", HEAVY, "trace"),
    Route(("GET",), "/api/v2/traces/:trace_id", HEAVY, "trace"),
    Route(("GET",), "/api/status/buildinfo", None, "buildinfo"),
)


@dataclass
class Response:
    status: int
    body: bytes
    kind: str = "application/json"
    retry_after: int | None = None


def as_json(status: int, value: object, retry_after: int | None = None) -> Response:
    return Response(status, json.dumps(value, ensure_ascii=False).encode(), retry_after=retry_after)


def body_params(query: dict[str, str], content_type: str, body: bytes) -> dict[str, str]:
    """The query's parameters, overridden by those of the body, a JSON object or a form."""
    out = dict(query)
    if not body:
        return out
    if content_type.partition(";")[0].strip().lower() == "application/json":
        try:
            values = json.loads(body)
        except ValueError:
            return out
        if isinstance(values, dict):
            out |= {k: v if isinstance(v, str) else json.dumps(v) for k, v in values.items() if v is not None}
        return out
    return out | dict(parse_qsl(body.decode("utf-8", "replace"), keep_blank_values=True))


class App:
    """Everything but the sockets."""

    def __init__(self, spark: SparkSession, config: Config, tables: Tables | None = None) -> None:
        self.spark, self.config, self.metrics = spark, config, Metrics()
        self.tables = tables if tables is not None else attach(spark, config.catalog, config.tables_dir)
        self.cache = Cache()
        self.admission = Admission(config.query_concurrency, config.cheap_query_capacity, config.query_admission_wait_ms / 1000, self.metrics)
        self.adapters = Adapters(self.tables, Discovery(self.tables, self.cache), self._collect)
        self.last_error: str | None = None
        self.measured = -MEASURE_SECONDS

    def _collect(self, df: DataFrame) -> list:
        return df.collect()

    def probe(self) -> tuple[bool, dict]:
        """Whether the log table can be read; reads no rows."""
        try:
            self.tables.ready()
            self.last_error = None
        except Exception as error:
            self.last_error = str(error).splitlines()[0]
        return self.last_error is None, {"healthy": self.last_error is None, "last_error": self.last_error}

    def storage(self) -> dict:
        layout: dict = {"supported": isinstance(self.tables, CatalogTables), "tables": {}}
        if layout["supported"]:
            rows = storage_layout(self.tables.metadata("ducklake_table"), self.tables.metadata("ducklake_data_file")).collect()
            layout["tables"] = {r["table_name"]: {k: r[k] for k in ("table_id", "active_data_files", "active_data_file_rows")} for r in rows}
        root = getattr(self.tables, "root", None)
        size = health.physical_bytes(self.spark, root) if root else 0
        out = storage_health(self.tables, health.logical_rows(self.tables).collect(), health.freshness(self.tables).collect(), size, layout)
        self.metrics.gauge("storage_physical_bytes", size, storage_signal="all")
        for name, n in out["logical_rows"].items():
            self.metrics.gauge("storage_logical_rows", n, storage_signal=name)
        for name, at in out["freshness_watermarks"].items():
            if at["epoch_seconds"] is not None:
                self.metrics.gauge("freshness_watermark_timestamp", at["epoch_seconds"], storage_signal=name)
        for name, t in layout["tables"].items():
            self.metrics.gauge("active_data_files", t["active_data_files"], storage_signal=name)
            self.metrics.gauge("active_data_file_rows", t["active_data_file_rows"], storage_signal=name)
        return out

    def _operator(self, path: str, headers: dict[str, str]) -> Response | None:
        if path == "/healthz":
            ok, probe = self.probe()
            return as_json(200 if ok else 503, {"status": "ok" if ok else "error", "storage": probe})
        if path == "/metrics":
            self.admission.record()
            try:
                if time.monotonic() >= self.measured + MEASURE_SECONDS:
                    self.storage()
                    self.measured = time.monotonic()
            except Exception as error:
                self.last_error = str(error).splitlines()[0]
            return Response(200, self.metrics.render().encode(), "text/plain; charset=utf-8")
        if path in ("/api/admin/health/storage", "/api/admin/health/queries"):
            check_key(headers, self.config.admin_api_key)
            ok, probe = self.probe()
            if not ok:
                return as_json(503, probe)
            if path.endswith("storage"):
                return as_json(200, self.storage())
            return as_json(200, {"timeout_seconds": self.config.query_timeout_secs, "cache_entries": len(self.cache), "admission": self.admission.snapshot()})
        return None

    def _call(self, route: Route, found: tuple[str, ...], params: dict[str, str], headers: dict[str, str]) -> Response:
        if route.handler == "buildinfo":
            about = {"version": beaconlake.__version__, "revision": "beaconlake", "branch": "local", "buildUser": "beaconlake", "buildDate": ""}
            return as_json(200, about)

        def run() -> Response:
            if route.handler != "trace":
                return as_json(200, getattr(self.adapters, route.handler)(params, *found))
            if "application/json" in headers.get("accept", ""):
                return as_json(200, self.adapters.trace_json(*found))
            return Response(200, self.adapters.trace_proto(*found), "application/protobuf")

        with self.admission.slot(route.slot):
            return timed(self.spark, self.config.query_timeout_secs, run)

    def handle(self, method: str, target: str, headers: dict[str, str], body: bytes = b"") -> Response:
        """headers have lower-case names."""
        parts = urlsplit(target)
        path = unquote(parts.path)
        route, found = next(((r, m) for r in ROUTES if (m := r.match(method, path)) is not None), (None, None))
        if route is None:
            try:
                answer = self._operator(path, headers) if method == "GET" else None
                if answer is None:
                    raise ApiError(404, "not_found", "there is no such route")
                return answer
            except ApiError as error:
                return as_json(error.status, {"error": error.reason, "message": error.message}, error.retry_after)
        began, status, reason = time.monotonic(), 200, "ok"
        try:
            check_key(headers, self.config.api_key)
            query = dict(parse_qsl(parts.query, keep_blank_values=True))
            return self._call(route, found, body_params(query, headers.get("content-type", ""), body), headers)
        except ApiError as error:
            status, reason = error.status, error.reason
            if reason == "query_timeout":
                self.metrics.count("query_timeouts_total", route_template=route.template)
            return as_json(status, {"status": "error", "errorType": reason, "error": error.message}, error.retry_after)
        finally:
            took = time.monotonic() - began
            self.metrics.count("query_requests_total", route_template=route.template, status=status, reason=reason)
            self.metrics.observe("query_duration_seconds", took, route_template=route.template)
            self.metrics.observe("phase_duration_seconds", took, route_template=route.template, phase="query_execute")


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    server: Server

    def setup(self) -> None:
        config = self.server.app.config
        self.timeout = max(config.socket_read_timeout_secs, config.socket_write_timeout_secs)
        self.served = 0
        super().setup()

    def log_message(self, *args: object) -> None:
        pass

    def _send(self, answer: Response, close: bool = False) -> None:
        self.send_response(answer.status)
        self.send_header("Content-Type", answer.kind)
        self.send_header("Content-Length", str(len(answer.body)))
        if answer.retry_after is not None:
            self.send_header("Retry-After", str(answer.retry_after))
        if close:
            self.close_connection = True
            self.send_header("Connection", "close")
        self.end_headers()
        self.wfile.write(answer.body)

    def _refuse(self, status: int, reason: str, message: str) -> None:
        self.server.app.metrics.count("http_connection_errors_total", reason=reason)
        self._send(as_json(status, {"error": reason, "message": message}), close=True)

    def _serve(self) -> None:
        app = self.server.app
        self.served += 1
        app.metrics.count("http_connection_requests_total", mode="keep_alive" if self.served > 1 else "new")
        lines = self.headers.items()
        if len(lines) > MOST_HEADERS or sum(len(k) + len(v) + 4 for k, v in lines) > MOST_HEADER_BYTES or len(self.requestline) > MOST_LINE:
            return self._refuse(431, "headers_too_large", "the request's head is too large")
        raw = self.headers.get("Content-Length", "0")
        if not raw.isdigit():
            return self._refuse(400, "invalid_content_length", "Content-Length is not a number")
        if int(raw) > app.config.max_body_bytes:
            return self._refuse(413, "payload_too_large", f"a body may have {app.config.max_body_bytes} bytes")
        body = self.rfile.read(int(raw))
        headers = {k.lower(): v for k, v in lines}
        try:
            answer = app.handle(self.command, self.path, headers, body)
        except Exception as error:
            app.last_error = str(error)
            answer = as_json(500, {"error": "internal_error", "message": "the request failed"})
        self._send(answer, close=self.served >= MOST_KEPT_ALIVE)

    do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = do_PATCH = _serve


class Server(ThreadingHTTPServer):
    daemon_threads = True
    request_queue_size = 128

    def __init__(self, app: App) -> None:
        self.app, self._open = app, threading.BoundedSemaphore(app.config.max_connections)
        host, _, port = app.config.bind.rpartition(":")
        super().__init__((host, int(port)), _Handler)
        if app.config.tls_enabled:
            context = ssl.create_default_context(ssl.Purpose.CLIENT_AUTH)
            context.load_cert_chain(app.config.tls_cert_file, app.config.tls_key_file)
            # Handshakes belong to the connection's own thread, not to the accept loop.
            self.socket = context.wrap_socket(self.socket, server_side=True, do_handshake_on_connect=False)

    def process_request(self, request, address) -> None:
        if not self._open.acquire(blocking=False):
            self.app.metrics.count("http_connection_closes_total", reason="server_overloaded")
            body = json.dumps({"error": "server_overloaded", "message": "too many connections"}).encode()
            head = f"HTTP/1.1 503 Service Unavailable\r\nContent-Type: application/json\r\nRetry-After: 5\r\nConnection: close\r\nContent-Length: {len(body)}\r\n\r\n"
            try:
                request.sendall(head.encode() + body)
            except OSError:
                pass
            self.shutdown_request(request)
            return
        super().process_request(request, address)

    def process_request_thread(self, request, address) -> None:
        try:
            super().process_request_thread(request, address)
        finally:
            self._open.release()

    def drain(self) -> None:
        """Takes no more connections and waits for those there are."""
        self.shutdown()
        end = time.monotonic() + DRAIN_SECONDS
        taken = 0
        while taken < self.app.config.max_connections and time.monotonic() < end:
            if self._open.acquire(timeout=max(0.0, end - time.monotonic())):
                taken += 1
        self.server_close()
