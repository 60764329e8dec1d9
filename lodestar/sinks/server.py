"""A read-only HTTP view of what was published: page, snapshot, newest signals, and the state of the loop.

Every answer comes from files that ``report`` publishes in one step, or from the loop's
status; no request starts, stops or steps anything. There is no TLS: bind another address
than loopback only behind something that has it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from lodestar.sources import files

JSON, HTML = "application/json; charset=utf-8", "text/html; charset=utf-8"
#: Sent with every answer; the page has no scripts, so that none are allowed.
HEADERS = {
    "Cache-Control": "no-store", "X-Content-Type-Options": "nosniff", "X-Frame-Options": "DENY", "Referrer-Policy": "no-referrer",
    "Content-Security-Policy": "default-src 'none'; style-src 'unsafe-inline'; base-uri 'none'; form-action 'none'; frame-ancestors 'none'",
}
SIGNALS = 50


class View:
    """What each path shows. ``status`` is a loop's ``shown_status``, or None where no loop runs."""

    def __init__(self, folder: str | Path, status: Callable[[], dict] | None = None):
        self.folder, self.status = Path(folder), status
        self.paths = {"/": self.page, "/api/snapshot": self.snapshot, "/api/signals": self.signals, "/api/status": lambda q: (200, self.state()), "/livez": lambda q: (200, {"ok": True}), "/ready": self.ready, "/health": lambda q: (200, {"ok": self.published() is not None})}

    def published(self) -> dict | None:
        return files.read_snapshot(self.folder / "scanner_latest.json")

    def state(self) -> dict:
        """The status, and ``loop``: off, failing or live."""
        found = self.status() if self.status else {}
        sound = found.get("ready") and not found.get("failures")
        return found | {"loop": "off" if not found.get("running") else "live" if sound else "failing"}

    def page(self, query: dict) -> tuple[int, object]:
        try:
            return 200, (self.folder / "scanner_latest.html").read_text(encoding="utf-8")
        except OSError:
            return 503, "<!doctype html><title>Scan</title><p>Nothing has been published yet.</p>"

    def snapshot(self, query: dict) -> tuple[int, object]:
        found = self.published()
        return (200, found) if found is not None else (503, {"error": "nothing has been published yet"})

    def signals(self, query: dict) -> tuple[int, object]:
        try:
            limit = int(query.get("limit", [SIGNALS])[0])
        except ValueError:
            limit = SIGNALS
        return 200, files.newest_events(self.folder / "signal_history.jsonl", limit)

    def ready(self, query: dict) -> tuple[int, object]:
        state = self.state()
        good = state["loop"] == "live" and self.published() is not None
        return (200 if good else 503), {"ready": good, "detail": state}

    def answer(self, target: str) -> tuple[int, str, bytes]:
        """Status, type and body for a request target."""
        asked = urlsplit(target)
        show = self.paths.get(asked.path)
        code, body = show(parse_qs(asked.query)) if show else (404, {"error": "not found"})
        return (code, HTML, body.encode()) if isinstance(body, str) else (code, JSON, json.dumps(body, default=str).encode())


def server(view: View, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound but not yet serving; port 0 takes any that is free."""

    class Handler(BaseHTTPRequestHandler):
        server_version, sys_version = "lodestar", ""

        def _send(self, code: int, kind: str, body: bytes) -> None:
            self.send_response(code)
            for name, value in {"Content-Type": kind, "Content-Length": str(len(body)), **HEADERS}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(*view.answer(self.path))

        def _refuse(self) -> None:
            self._send(405, JSON, b'{"error": "read-only"}')

        do_POST = do_PUT = do_DELETE = do_PATCH = _refuse

        def log_message(self, *args) -> None:
            """Requests aren't logged."""

    return ThreadingHTTPServer((host, port), Handler)


def serve(folder: str | Path, port: int = 8765, host: str = "127.0.0.1", status: Callable[[], dict] | None = None) -> None:
    """Serve until interrupted."""
    if not 0 < port < 1 << 16 or not host.strip():
        raise ValueError(f"can't listen at {host!r}, port {port}")
    with server(View(folder, status), port, host) as bound:
        try:
            bound.serve_forever()
        except KeyboardInterrupt:
            pass
