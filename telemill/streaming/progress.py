"""Counters of running queries: rows and batch durations from the query listener, observed metrics, and their endpoint."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class ProgressCounters(StreamingQueryListener):
    """Totals by query name, for a health endpoint: started, ended, failed, batches, rows, last batch ms."""

    def __init__(self) -> None:
        self.queries: dict[str, dict[str, float]] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the listener's interface
        name = event.name or str(event.id)
        self._names[str(event.id)] = name
        self.queries.setdefault(name, {"started": 0, "ended": 0, "failed": 0, "batches": 0, "rows": 0, "last_ms": 0})["started"] += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        counts = self.queries.setdefault(p.name or str(p.id), {"started": 0, "ended": 0, "failed": 0, "batches": 0, "rows": 0, "last_ms": 0})
        counts["batches"] += 1
        counts["rows"] += p.numInputRows
        counts["last_ms"] = p.batchDuration

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        counts = self.queries.get(self._names.get(str(event.id), ""), {})
        if counts:
            counts["failed" if event.exception else "ended"] += 1

    @contextmanager
    def batch(self, name: str) -> Iterator[None]:
        """Counts a run that is no stream."""
        counts = self.queries.setdefault(name, {"started": 0, "ended": 0, "failed": 0, "batches": 0, "rows": 0, "last_ms": 0})
        counts["started"] += 1
        began, how = time.monotonic(), "failed"
        try:
            yield
            how = "ended"
        finally:
            counts[how] += 1
            counts["batches"] += 1
            counts["last_ms"] = round(1000 * (time.monotonic() - began))

    def ready(self) -> bool:
        return any(c["started"] for c in self.queries.values())

    def text(self) -> str:
        """The counters in the text format of Prometheus."""
        lines = []
        for kind in ("started", "ended", "failed", "batches", "rows", "last_ms"):
            lines.append(f"# TYPE telemill_{kind} {'gauge' if kind == 'last_ms' else 'counter'}")
            lines += [f'telemill_{kind}{{query="{name}"}} {c[kind]}' for name, c in sorted(self.queries.items())]
        return "\n".join(lines) + "\n"

    def live(self) -> bool:
        return all(c["failed"] == 0 for c in self.queries.values())


def observed(rows: DataFrame, name: str) -> DataFrame:
    """rows, with their number reported under name in progress events and observations."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def serve(counters: ProgressCounters, address: str) -> ThreadingHTTPServer:
    """/metrics, /livez (no query failed) and /readyz (a query has started) at host:port, in a thread of its own."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802 - the server's interface
            answers = {"/metrics": (True, counters.text()), "/livez": (counters.live(), "ok"), "/readyz": (counters.ready(), "ready")}
            good, text = answers.get(self.path.split("?")[0], (None, "not found"))
            self.send_response(404 if good is None else 200 if good else 503)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.end_headers()
            self.wfile.write((text if good is not False else f"not {text}").encode())

        def log_message(self, *args: object) -> None:
            pass

    host, _, port = address.rpartition(":")
    server = ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
