"""HTTP façade on the standard library: GET /, POST /fit and POST /recommend, guarded by a token."""

from __future__ import annotations

import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .models.recommender import Recommender
from .sources.datasets import from_iterable


#: The texts of the answers.
RUNNING, TRAINED = "Recommender System API is running", "Training successful"
NO_TOKEN, NOT_FOUND = "Invalid X-Token header", "Not Found"
NOT_TRAINED, NOT_RECOMMENDED = "Training failed", "Recommendation failed"


class Service:
    """Requests on one model, one at a time; independent of the HTTP server, so that it can be tested without."""

    def __init__(self, model: Recommender, token: str):
        self.model, self.token, self.lock = model, token, threading.Lock()

    def handle(self, method: str, path: str, token: str | None, body: bytes) -> tuple[int, dict]:
        if (method, path) == ("GET", "/"):
            return 200, {"message": RUNNING}
        if method != "POST" or path not in ("/fit", "/recommend"):
            return 404, {"detail": NOT_FOUND}
        if token != self.token:
            return 400, {"detail": NO_TOKEN}
        try:
            given = json.loads(body or b"null")
            with self.lock:
                return 200, self.fit(given) if path == "/fit" else self.recommend(given)
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            return 422, {"detail": f"malformed request: {e}"}
        except Exception as e:  # noqa: BLE001
            logging.getLogger(__name__).error("request failed: %s", e)
            return 500, {"detail": NOT_TRAINED if path == "/fit" else NOT_RECOMMENDED}

    def fit(self, rows: list[dict]) -> dict:
        df = from_iterable(self.model.spark, [(r["user"], r["item"], r["timestamp"], r["rating"]) for r in rows])
        self.model.fit(df.withColumn("seq", df["seq"] + self.model.last_arrival + 1))
        return {"message": TRAINED}

    def recommend(self, request: dict) -> dict:
        user = request["user"]
        kind = dict(self.model.state.dtypes)["user"]
        asked = self.model.spark.createDataFrame([(user,)], f"user {kind}")
        found = self.model.recommend(asked, int(request.get("top_k", 10)), exclude_seen=bool(request.get("filter_interacted", True)))
        return {"user": user, "recommendations": [r["item"] for r in found.orderBy("rank").collect()]}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = service.handle(method, self.path, self.headers.get("X-Token"), body)
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self.answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self.answer("POST")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
