"""HTTP service over one loaded database: POST /query /describe /validate /warm, GET /health /memory."""

from __future__ import annotations

import json
import resource
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .database import Database


def memory() -> dict[str, int]:
    return {"rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}


class Server(ThreadingHTTPServer):
    """Reads run side by side: snapshots are immutable. Refreshes take turns."""

    daemon_threads = True

    def __init__(self, db: Database, host: str = "127.0.0.1", port: int = 8080):
        super().__init__((host, port), Handler)
        self.db, self.turn = db, threading.Lock()


class Handler(BaseHTTPRequestHandler):
    server: Server

    def log_message(self, *args: Any) -> None:
        pass

    def reply(self, status: int, body: Any) -> None:
        data = json.dumps(body, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        if self.path == "/health":
            self.reply(200, {"status": "ok", "tables": sorted(self.server.db.tables)})
        elif self.path == "/memory":
            self.reply(200, memory())
        else:
            self.reply(404, {"error": f"no such path: {self.path}"})

    def do_POST(self) -> None:
        db = self.server.db
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        actions = {"/query": lambda: self.query(json.loads(body)), "/describe": db.describe, "/validate": lambda: {"violations": db.validate()}, "/warm": self.warm}
        if self.path not in actions:
            return self.reply(404, {"error": f"no such path: {self.path}"})
        try:
            self.reply(200, actions[self.path]())
        except Exception as e:  # noqa: BLE001  one failing query must not end the service
            self.reply(400, {"error": str(e.args[0]) if isinstance(e, KeyError) and e.args else str(e)})

    def query(self, directive: Any) -> Any:
        with self.server.turn:
            for name in directive if isinstance(directive, dict) else ():
                if name in self.server.db.tables:
                    self.server.db.tables[name].fresh()
        return self.server.db.execute(directive)

    def warm(self) -> Any:
        with self.server.turn:
            return {"refreshed": self.server.db.warm()}
