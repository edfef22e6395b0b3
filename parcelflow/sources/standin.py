"""A stand-in for the paged service over records in memory, on this machine's loopback: for tests and for trying queries out."""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from parcelflow.sources.config import OAUTH_TOKEN_PATH, SECURE_TOKEN_PATH, ServiceConfig

_TEST = re.compile(r"(\w+)\s*(>=|<=|=)\s*'([^']*)'")
_HOLDS = {"=": str.__eq__, ">=": str.__ge__, "<=": str.__le__}


class Standin(ThreadingHTTPServer):
    """Serves records with filter, order, limit and offset, each answer in another of the usual envelopes; `asked` are the queries so far."""

    daemon_threads = True

    def __init__(self, records: list[dict]):
        super().__init__(("127.0.0.1", 0), _Handler)
        self.records, self.asked = records, []

    @property
    def config(self) -> ServiceConfig:
        return ServiceConfig(f"http://127.0.0.1:{self.server_port}", "id", "client", "secret", "entity", "dataset")

    def start(self) -> Standin:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def answer(self, asked: dict[str, str]) -> list[dict]:
        tests = _TEST.findall(asked.get("filter", ""))
        found = [r for r in self.records if all(_HOLDS[sign](str(r.get(name)), value) for name, sign, value in tests)]
        if "order_by" in asked:
            found.sort(key=lambda r: str(r.get(asked["order_by"])), reverse=asked.get("order_dir") == "desc")
        at = int(asked.get("offset", 0))
        return found[at : at + int(asked.get("limit", len(found)))]


class _Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _say(self, body) -> None:
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        self.rfile.read(int(self.headers.get("Content-Length", 0)))
        self._say({"access_token": "token"} if self.path.startswith((SECURE_TOKEN_PATH, OAUTH_TOKEN_PATH)) else {})

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.server.asked.append(asked)
        found = self.server.answer(asked)
        self._say([found, {"results": found}, {"result": {"records": found}}, {"data": found}][len(self.server.asked) % 4])
