"""Calls of a local service that answers, refuses, fails for a while and hangs."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siftline.config import IngestConfig
from siftline.operators import calls
from siftline.operators.ingest import backoff_seconds


@pytest.fixture
def service():
    seen, running, most, lock = Counter(), [0], [0], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_PUT(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            with lock:
                seen[body] += 1
                running[0] += 1
                most[0] = max(most[0], running[0])
                n = seen[body]
            time.sleep(3 if body == "hang" and n < 2 else 0.05)
            code = 404 if body == "refused" else 503 if body == "down" or body == "later" and n < 3 else 200
            with lock:
                running[0] -= 1
            try:
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body.upper().encode())
            except OSError:
                pass

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen, most
    server.shutdown()


def test_answers_refusals_and_retries(spark, service):
    url, seen, most = service
    bodies = ["fine", "refused", "later", "down", "hang", None, *[f"x{i}" for i in range(20)]]
    rows = spark.createDataFrame([(i, b and b.encode()) for i, b in enumerate(bodies)], "i int, body binary").coalesce(1)
    config = IngestConfig(retries=4, retry_base_seconds=0.05, retry_cap_seconds=0.1)
    got = {r.i: (r.answer, r.call_error, r.attempts) for r in calls.call_out(rows, "body", calls.http_put(url, 1.0), 3, config).collect()}
    assert got[0] == ("FINE", None, 1) and got[1] == (None, "HTTP 404", 1) and got[2] == ("LATER", None, 3)
    assert got[3] == (None, "HTTP 503", 4) and got[4] == ("HANG", None, 2) and got[5] == (None, None, 0)
    assert all(got[6 + i] == (f"X{i}", None, 1) for i in range(20))
    assert (seen["refused"], seen["later"], seen["down"], seen["hang"]) == (1, 3, 4, 2)
    assert 1 < most[0] <= 4  # three at once, and the one that the time-out left behind


def test_waits_double_to_a_cap():
    waited = []

    def down(_):
        raise calls.Unavailable("down")

    assert backoff_seconds(IngestConfig()) == [1, 2, 4, 8]
    assert calls.attempted(down, b"", [1, 2, 4, 8, 16, 30, 30], waited.append) == (None, "down", 8) and waited == [1, 2, 4, 8, 16, 30, 30]
    nobody = calls.http_put("http://127.0.0.1:9/", 0.2)
    with pytest.raises(calls.Unavailable):
        nobody(b"x")
