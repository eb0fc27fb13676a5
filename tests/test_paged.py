"""The paginated source against a server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from palisade.sources.paged import PagedReader, labelled_rows, read_paged

ROWS = [{"id": f"r{i}" if i % 5 else None, "skill_name": f"n{i}", "content": f"täxt {i}", "label": " Benign " if i % 2 else None} for i in range(57)]
SCHEMA = "id string, skill_name string, content string, label string"


@pytest.fixture(scope="module")
def server():
    failed = set()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            at, n = int(q["offset"]), int(q["length"])
            if q.get("flaky") and self.path not in failed:  # each page fails once
                failed.add(self.path)
                self.send_error(503)
                return
            rows = [] if q.get("none") else ROWS[at : at + n]
            body = json.dumps({"rows": [{"row": r} for r in rows]} | ({"num_rows_total": len(ROWS)} if q.get("total") else {})).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/rows?offset={{offset}}&length={{length}}"
    s.shutdown()


@pytest.mark.parametrize("query", ["&total=1", "", "&total=1&flaky=1"])
def test_all_rows_in_any_way_of_paging(spark, server, query):
    x = read_paged(spark, server + query, SCHEMA, page=10, pagesPerTask=2, pause=0.01)
    assert [(r.offset, r.id, r.content) for r in x.orderBy("offset").collect()] == [(i, r["id"], r["content"]) for i, r in enumerate(ROWS)]


def test_pages_are_dealt_to_tasks(server):
    parts = PagedReader({"url": server + "&total=1", "page": "10", "pagespertask": "2"}).partitions()
    assert [(p.first, p.end) for p in parts] == [(0, 20), (20, 40), (40, 57)]


def test_limits_and_empty_pages(spark, server):
    assert read_paged(spark, server + "&total=1", page=10, maxRows=13).count() == 13
    assert read_paged(spark, server, page=10, maxRows=13).count() == 13
    assert read_paged(spark, server + "&none=1").count() == 0


def test_labelled_rows(spark, server):
    got = {r.id: r for r in labelled_rows(read_paged(spark, server + "&total=1", SCHEMA, page=50)).collect()}
    assert len(got) == len(ROWS) and got["row-0"].label == "" and got["r1"].label == "benign"


def test_failures_end(server):
    with pytest.raises(OSError):
        PagedReader({"url": "http://127.0.0.1:1/?o={offset}", "attempts": "2", "pause": "0.01"}).fetch(0)
    with pytest.raises(ValueError):
        PagedReader({"url": server.replace("{offset}", "0")})
