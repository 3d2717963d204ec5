"""Paging against a recorded server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from litsieve.sources import connectors


def respond(database, p):
    rows = [{"id": f"W{k}"} for k in range(5)] if "some" in json.dumps(p) else []
    if database in ("openalex", "crossref"):
        at = 0 if p["cursor"] == ["*"] else int(p["cursor"][0])
        size = int(p["per_page" if database == "openalex" else "rows"][0])
        part, more = rows[at : at + size], str(at + size)
        return json.dumps({"meta": {"next_cursor": more}, "results": part} if database == "openalex" else {"message": {"next-cursor": more, "items": part}})
    at, size = (int(p[k][0]) for k in (("offset", "limit") if database == "semantic_scholar" else ("start", "max_results")))
    if database == "semantic_scholar":
        return json.dumps({"total": len(rows), "data": rows[at : at + size]})
    return f"<feed xmlns:o='x'><o:totalResults>{len(rows)}</o:totalResults>{'<entry></entry>' * len(rows[at : at + size])}</feed>"


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(respond(u.path.strip("/"), parse_qs(u.query)).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_all_pages_of_all_searches(spark, server):
    spark.dataSource.register(connectors.ResultPages)
    for database in connectors.ENDPOINTS:
        read = spark.read.format("result_pages").option("database", database).option("endpoint", f"{server}/{database}").option("page_size", 2)
        got = {}
        for r in read.option("queries", json.dumps(["some", "none"])).load().collect():
            got.setdefault(r.query, []).append((r.page, r.cursor))
        n = 4 if database in ("openalex", "crossref") else 3  # a cursor shows its end by an empty page
        assert [p for p, _ in sorted(got["some"])] == list(range(n)) and dict(got["some"])[1] == "2" and got["none"] == [(0, None)], database
        assert read.option("queries", '["some"]').option("max_pages", 1).load().count() == 1


def test_dates_are_pushed_into_the_request():
    f = lambda d: connectors.request(d, "q", 5000, None, "2020-01-01", "2021-12-31")
    assert f("openalex")["filter"] == "from_publication_date:2020-01-01,to_publication_date:2021-12-31" and f("openalex")["per_page"] == 200
    assert f("crossref")["filter"] == "from-pub-date:2020-01-01,until-pub-date:2021-12-31" and f("crossref")["rows"] == 1000
    assert f("semantic_scholar")["year"] == "2020-2021" and f("semantic_scholar")["limit"] == 100
    assert connectors.request("openalex", "q", 10, None).keys() == {"search", "per_page", "cursor"}
