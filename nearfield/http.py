"""The service over HTTP with the standard library, and a client for it."""

from __future__ import annotations

import json
import threading
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from nearfield.service import Client, Service, ServiceError


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Answer requests in a thread of its own until shutdown(); ``server_address`` has the port. Writes go one at a time."""
    lock = threading.Lock()
    posts = {"/insert": service.insert, "/insert_batch": service.insert_batch, "/search": service.search, "/fit_quantizer": service.fit_quantizer}

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, call) -> None:
            try:
                if self.path == "/search" or self.command == "GET":
                    status, body = 200, call()
                else:
                    with lock:
                        status, body = 200, call()
            except ServiceError as e:
                status, body = e.status, {"detail": e.detail}
            except (ValueError, TypeError, AttributeError) as e:
                status, body = 422, {"detail": str(e)}
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _none(self) -> dict[str, Any]:
            raise ServiceError(404, f"no {self.command} {self.path}")

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path == "/compact":
                self._answer(service.compact)
            elif self.path in posts:
                self._answer(lambda: posts[self.path](json.loads(body or b"{}")))
            else:
                self._answer(self._none)

        def do_GET(self) -> None:
            self._answer(service.health if self.path == "/health" else self._none)

        def do_DELETE(self) -> None:
            id_ = self.path.rpartition("/")[2]
            self._answer((lambda: service.delete(int(id_))) if self.path.startswith("/delete/") else self._none)

        def log_message(self, *_: Any) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class _Remote:
    """The service's methods as requests to a server."""

    def __init__(self, url: str, timeout: float):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _ask(self, method: str, path: str, body: Mapping[str, Any] | None = None) -> dict[str, Any]:
        data = None if body is None else json.dumps(body).encode()
        try:
            with urlopen(Request(self.url + path, data, {"Content-Type": "application/json"}, method=method), timeout=self.timeout) as answer:
                return json.load(answer)
        except HTTPError as e:
            raise ServiceError(e.code, json.load(e).get("detail", "")) from e

    def insert(self, request: Mapping[str, Any]) -> dict[str, Any]:
        return self._ask("POST", "/insert", request)

    def insert_batch(self, request: Mapping[str, Any]) -> dict[str, Any]:
        return self._ask("POST", "/insert_batch", request)

    def search(self, request: Mapping[str, Any]) -> dict[str, Any]:
        return self._ask("POST", "/search", request)

    def fit_quantizer(self, request: Mapping[str, Any]) -> dict[str, Any]:
        return self._ask("POST", "/fit_quantizer", request)

    def delete(self, id: int) -> dict[str, Any]:
        return self._ask("DELETE", f"/delete/{id}")

    def compact(self) -> dict[str, Any]:
        return self._ask("POST", "/compact", {})

    def health(self) -> dict[str, Any]:
        return self._ask("GET", "/health")


class RemoteClient(Client):
    """Client of a server at a URL."""

    def __init__(self, url: str, timeout: float = 30.0):
        super().__init__(_Remote(url, timeout))
