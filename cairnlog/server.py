"""The engine over HTTP: POST /index, GET /search, POST /prom/read.

A push is spooled as a file of its own, under its final name once it is whole, and is in the store after the next
micro-batch of the ingest that reads the spool folder; the answer only says that it was taken. The spool folder must be
one that the cluster sees. Errors are JSON: status, description, data."""

from __future__ import annotations

import json
import os
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .sources.push import decode_request

PORT = 9400


def whole_number(text: str) -> int:
    """0 where the text is no whole number."""
    try:
        return int(text)
    except ValueError:
        return 0


def failure(status: int, error: object) -> bytes:
    return json.dumps({"status": status, "description": str(error), "data": None}).encode()


def handler(engine: Engine, spool: str) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: bytes, kind: str = "application/json", **headers: str) -> None:
            self.send_response(status)
            for name, value in {"Content-Type": kind, "Content-Length": str(len(body)), **headers}.items():
                self.send_header(name.replace("_", "-"), value)
            self.end_headers()
            self.wfile.write(body)

        def body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length", 0)))

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path != "/search":
                return self.answer(404, failure(404, "no such path"))
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            mint, maxt, count = (whole_number(given.get(k, "")) for k in ("mint", "maxt", "count"))
            try:
                rows = engine.search_json(given.get("temql", ""), mint, maxt, count)
                self.answer(200, f"[{','.join(rows)}]".encode() if given.get("temql", "").strip() else b"")
            except Exception as e:
                self.answer(400, failure(400, e))

        def do_POST(self) -> None:
            data = self.body()
            try:
                if self.path == "/index":
                    decode_request(data)  # what can't be read is refused, not spooled
                    name = f"{spool}/{uuid.uuid4().hex}"
                    with open(f"{spool}/.{os.path.basename(name)}", "wb") as f:
                        f.write(data)
                        f.flush()
                        os.fsync(f.fileno())
                    os.rename(f.name, name)
                    self.answer(200, b"ok", "text/plain")
                elif self.path == "/prom/read":
                    self.answer(200, engine.remote_read(data), "application/x-protobuf", Content_Encoding="snappy")
                else:
                    self.answer(404, failure(404, "no such path"))
            except Exception as e:
                self.answer(400, failure(400, e))

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(engine: Engine, spool: str, port: int = PORT) -> ThreadingHTTPServer:
    """A server that is ready; the caller runs serve_forever()."""
    os.makedirs(spool, exist_ok=True)
    return ThreadingHTTPServer(("", port), handler(engine, spool))
