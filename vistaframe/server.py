"""The engine over HTTP and WebSocket, with nothing but the standard library."""

from __future__ import annotations

import base64
import hashlib
import json
import queue
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from vistaframe.engine import Engine
from vistaframe.errors import EngineError
from vistaframe.session import DONE, Session
from vistaframe.upkeep import Upkeep

_MAGIC = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
MOST_BYTES = 1 << 24


def read_frame(stream) -> tuple[int, bytes] | None:
    """(opcode, payload) of the next WebSocket frame; None at the end or for one that is too long."""
    head = stream.read(2)
    if len(head) < 2:
        return None
    size = head[1] & 127
    if size > 125:
        n = 2 if size == 126 else 8
        size = int.from_bytes(stream.read(n), "big")
    if size > MOST_BYTES:
        return None
    mask = stream.read(4) if head[1] & 128 else b"\0\0\0\0"
    data = stream.read(size)
    return head[0] & 15, bytes(b ^ mask[i % 4] for i, b in enumerate(data))


def frame(data: bytes, opcode: int = 1) -> bytes:
    size = len(data)
    length = struct.pack("!B", size) if size < 126 else struct.pack("!BH", 126, size) if size < 1 << 16 else struct.pack("!BQ", 127, size)
    return bytes([128 | opcode]) + length + data


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    engine: Engine
    upkeep: Upkeep | None

    def log_message(self, *args) -> None:
        pass

    def _reply(self, status: int, body: object) -> None:
        raw = json.dumps(body, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _session(self) -> Session:
        return Session(self.engine, self.upkeep.after if self.upkeep else None)

    def do_POST(self) -> None:
        size = int(self.headers.get("Content-Length") or 0)
        if size > MOST_BYTES:
            return self._reply(413, {"error": "the request is too long"})
        body = self.rfile.read(size)
        try:
            request = json.loads(body)
            if not isinstance(request, dict):
                raise ValueError("an object is expected")
            if self.path == "/berry":
                return self._berry(request)
            if self.path == "/admin/register":
                info = self.engine.register(request, request["path"])
                return self._reply(200, {"dataset": info.name, "rows": info.stats.cardinality})
            if self.path == "/admin/deregister":
                return self._reply(200, {"dropped": self.engine.deregister(request)})
            if self.path == "/checkQuerySolvableByView":
                return self._reply(200, self.engine.is_solvable_by_view(request))
            return self._reply(404, {"error": f"no such path: {self.path}"})
        except (EngineError, ValueError, KeyError) as e:
            return self._reply(400, {"error": str(e)})

    def _berry(self, request: dict) -> None:
        """The answer; a sliced request's answers as lines of JSON in chunks, as they come."""
        if (request.get("option") or {}).get("sliceMillis", -1) <= 0:
            self._reply(200, self.engine.run(request))
            if self.upkeep:
                self.upkeep.after({k: v for k, v in request.items() if k not in ("option", "transform")})
            return
        found: queue.Queue = queue.Queue()
        session = self._session()
        worker = session.submit(request, found.put)
        self.send_response(200)
        self.send_header("Content-Type", "application/x-ndjson")
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        last = False
        try:
            while not last:
                try:
                    answer = found.get(timeout=0.2)
                except queue.Empty:
                    last = not worker.is_alive() and found.empty()
                    continue
                raw = json.dumps(answer, default=str).encode() + b"\n"
                self.wfile.write(f"{len(raw):x}\r\n".encode() + raw + b"\r\n")
                last = answer == DONE or "error" in answer
            self.wfile.write(b"0\r\n\r\n")
        finally:
            session.close()

    def do_GET(self) -> None:
        key = self.headers.get("Sec-WebSocket-Key")
        if self.path != "/ws" or not key:
            return self._reply(404, {"error": f"no such path: {self.path}"})
        accept = base64.b64encode(hashlib.sha1((key + _MAGIC).encode()).digest()).decode()
        self.send_response(101)
        for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", accept)):
            self.send_header(name, value)
        self.end_headers()
        self.close_connection = True
        session, lock = self._session(), threading.Lock()

        def send(answer: object, opcode: int = 1) -> None:
            raw = answer if isinstance(answer, bytes) else json.dumps(answer, default=str).encode()
            try:
                with lock:
                    self.wfile.write(frame(raw, opcode))
                    self.wfile.flush()
            except OSError:
                session.close()

        try:
            while (got := read_frame(self.rfile)) is not None and got[0] != 8:
                opcode, data = got
                if opcode == 9:
                    send(data, 10)
                elif opcode in (1, 2):
                    try:
                        session.submit(json.loads(data), send)
                    except (ValueError, AttributeError) as e:
                        send({"error": f"not a request: {e}"})
        finally:
            session.close()


class Server:
    """``POST /berry``, ``GET /ws``, ``POST /admin/register`` (with the rows' ``path``), ``/admin/deregister`` and ``/checkQuerySolvableByView``."""

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 0, upkeep: Upkeep | None = None) -> None:
        handler = type("Handler", (_Handler,), {"engine": engine, "upkeep": upkeep})
        self.http = ThreadingHTTPServer((host, port), handler)
        self.http.daemon_threads = True
        self.address = self.http.server_address

    def start(self) -> Server:
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()
