"""HTTP endpoint: GET with the argument `query`, answers as SPARQL-results XML."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from loomgraph.model import QueryError
from loomgraph.results import to_xml
from loomgraph.sources.store import Store

PORT = 12345


def handler(store: Store, **options) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            text = parse_qs(urlsplit(self.path).query).get("query", [""])[0]
            if not text:
                return self._send(400, "text/plain; charset=utf-8", "The argument query is missing\n")
            try:
                pieces = to_xml(store.query(text, **options))
                first = next(pieces) + next(pieces)  # errors of the query show before the answer begins
            except QueryError as error:
                return self._send(400, "text/plain; charset=utf-8", f"{error}\n")
            except Exception as error:
                return self._send(500, "text/plain; charset=utf-8", f"{type(error).__name__}\n")
            self.send_response(200)
            self.send_header("Content-Type", "application/sparql-results+xml; charset=utf-8")
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(first.encode())
            for piece in pieces:
                self.wfile.write(piece.encode())

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(store: Store, port: int = PORT, host: str = "127.0.0.1", **options) -> ThreadingHTTPServer:
    """A server that answers once serve_forever() runs."""
    return ThreadingHTTPServer((host, port), handler(store, **options))
