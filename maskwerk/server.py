"""HTTP: GET /health, POST /v1/anonymize and /v1/deanonymize with {"texts": [...]} -> {"results": [{"input", "output"}]}.

One profile for each server; requests take turns, since each goes on from the mapping that the last one left.
"""

from __future__ import annotations

import hmac
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from maskwerk.profiles import Profile, anonymize_texts

#: Limits of one request.
MOST_BYTES, MOST_TEXTS = 10 << 20, 1000


class Bucket:
    """Token buckets by client: `burst` requests at once, `rate` a second; idle clients are forgotten."""

    def __init__(self, burst: int = 60, rate: float = 1.0, clients: int = 10_000, clock=time.monotonic):
        self.burst, self.rate, self.clients, self.clock = burst, rate, clients, clock
        self.held: dict[str, tuple[float, float]] = {}
        self.lock = threading.Lock()

    def wait(self, client: str) -> float:
        """Seconds until the client may ask again; 0 if it may now, and then this request counts."""
        with self.lock:
            now = self.clock()
            tokens, last = self.held.get(client, (float(self.burst), now))
            tokens = min(float(self.burst), tokens + (now - last) * self.rate)
            self.held[client] = (tokens - 1 if tokens >= 1 else tokens, now)
            if len(self.held) > self.clients:  # those that have been idle until their bucket was full count as new
                full = self.burst / self.rate
                self.held = {c: x for c, x in self.held.items() if now - x[1] < full}
            return 0.0 if tokens >= 1 else (1 - tokens) / self.rate


def server(profile: Profile, token: str, host: str = "127.0.0.1", port: int = 0, bucket: Bucket | None = None) -> ThreadingHTTPServer:
    """A server that is not yet running; call serve_forever. Requests need the bearer token, but for /health."""
    bucket, turn = bucket or Bucket(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: dict, **headers: str) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            for k, v in ({"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(raw))} | headers).items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, format: str, *args) -> None:
            """Nothing: a request line may hold what must not be logged."""

        def do_GET(self) -> None:
            self.answer(200, {"status": "ok", "profile": profile.name}) if self.path == "/health" else self.answer(404, {"error": "not found"})

        def do_POST(self) -> None:
            if not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {token}".encode()):
                return self.answer(401, {"error": "a bearer token is needed"})
            if wait := bucket.wait(self.client_address[0]):
                return self.answer(429, {"error": "too many requests"}, Retry_After=str(int(wait) + 1))
            if self.path not in ("/v1/anonymize", "/v1/deanonymize"):
                return self.answer(404, {"error": "not found"})
            try:
                size = int(self.headers.get("Content-Length", "0"))
                if size > MOST_BYTES:
                    return self.answer(413, {"error": "the request is too long"})
                texts = json.loads(self.rfile.read(size))["texts"]
                if not isinstance(texts, list) or len(texts) > MOST_TEXTS or not all(isinstance(t, str) for t in texts):
                    raise ValueError
            except (ValueError, KeyError, TypeError):
                return self.answer(400, {"error": f'the body must be {{"texts": [...]}} with {MOST_TEXTS} strings at most'})
            with turn:
                results = anonymize_texts(profile, texts, reverse=self.path.endswith("/deanonymize")) if texts else []
            self.answer(200, {"results": results})

    return ThreadingHTTPServer((host, port), Handler)
