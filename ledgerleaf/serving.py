"""Health and metrics over HTTP, and metrics of streaming queries."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming import StreamingQueryListener

from .store import Metrics, Store


class QueryMetrics(StreamingQueryListener):
    """Rows, batches, rates and ends of streaming queries, as metrics of a store."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("streaming_queries_started")

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.metrics.add("streaming_batches")
        self.metrics.add("streaming_rows", progress.numInputRows)
        self.metrics.set("streaming_rows_per_second", progress.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("streaming_queries_failed" if event.exception else "streaming_queries_ended")


def watch(store: Store) -> QueryMetrics:
    """Adds the listener to the session of a store."""
    found = QueryMetrics(store.metrics)
    store.spark.streams.addListener(found)
    return found


def serve(store: Store, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Answers /health and /metrics from a thread; server_address tells the port and
    shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            if self.path == "/health":
                try:
                    ok = store.healthy()
                except Exception:  # noqa: BLE001  any failure is bad health
                    ok = False
                self._answer(200 if ok else 503, "application/json", json.dumps({"healthy": ok}))
            elif self.path == "/metrics":
                store.observe()
                self._answer(200, "text/plain; version=0.0.4", store.metrics.render())
            else:
                self._answer(404, "text/plain", "not found")

        def _answer(self, code: int, kind: str, text: str) -> None:
            body = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
