"""SQL over HTTP: POST a statement, get its rows as one JSON object a line.

Rows come partition by partition from the executors (``toLocalIterator``), so that the
driver holds one partition at a time.  Statements are read-only by the engine's own
guards; streaming ones are refused.
"""

from __future__ import annotations

import gzip
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..plans.sqlfront import SqlError

#: Rows of a chunk.
CHUNK = 1000


def _lines(engine, sql: str):
    df = engine.sql(sql)
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))
    held: list[str] = []
    for row in rows.toLocalIterator():
        held.append(row.line + "\n")
        if len(held) == CHUNK:
            yield "".join(held).encode()
            held = []
    if held:
        yield "".join(held).encode()


def _handler(engine):
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _start(self, status: int, kind: str, **headers: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            for name, value in headers.items():
                self.send_header(name.replace("_", "-"), value)
            self.end_headers()

        def do_OPTIONS(self) -> None:
            self._start(204, "text/plain", Access_Control_Allow_Methods="POST, OPTIONS", Access_Control_Allow_Headers="*")

        def do_POST(self) -> None:
            sql = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            try:
                chunks = _lines(engine, sql)
                first = next(chunks, b"")
            except (SqlError, PySparkException) as e:
                body = json.dumps({"error_code": type(e).__name__, "error_message": str(e)}).encode()
                self._start(400, "application/json", Content_Length=str(len(body)))
                self.wfile.write(body)
                return
            zipped = "gzip" in self.headers.get("Accept-Encoding", "")
            more = {"Content_Encoding": "gzip"} if zipped else {}
            self._start(200, "application/x-ndjson", Transfer_Encoding="chunked", **more)
            self._chunk(first, zipped)
            for chunk in chunks:
                self._chunk(chunk, zipped)
            self.wfile.write(b"0\r\n\r\n")

        def _chunk(self, data: bytes, zipped: bool) -> None:
            data = gzip.compress(data) if zipped and data else data
            if data:
                self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")

    return Handler


def server(engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but does not run yet; call serve_forever() on it."""
    return ThreadingHTTPServer((host, port), _handler(engine))
