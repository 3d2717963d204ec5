"""Result pages of four databases as one Spark data source: a partition per search, pages fetched one after the other.

``spark.dataSource.register(ResultPages)``, then ``spark.read.format("result_pages").options(...).load()``. Options:

* ``database``: openalex, semantic_scholar, crossref or arxiv.
* ``queries``: a JSON list of searches; each is a partition, so that executors fetch several at once.
* ``start``, ``end``: ISO dates; they are pushed into the request wherever the database can filter.
* ``page_size`` (within the database's limit), ``max_pages`` (the feature: unset, all pages are fetched).
* ``endpoint``: another address than the database's own, such as a recorded server; ``retries`` of a failed request.

Rows: database, query, page (from 0), cursor (of the request), raw_response. A search without results has its one, empty
page. A request that fails ``retries`` times fails its task, which Spark tries again; no page is left out silently.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Addresses, greatest page sizes and fixed parameters of the databases (fixed values).
ENDPOINTS = {
    "openalex": "https://api.openalex.org/works", "semantic_scholar": "https://api.semanticscholar.org/graph/v1/paper/search",
    "crossref": "https://api.crossref.org/works", "arxiv": "https://export.arxiv.org/api/query",
}
LARGEST = {"openalex": 200, "semantic_scholar": 100, "crossref": 1000, "arxiv": 2000}
S2_FIELDS = "paperId,externalIds,title,abstract,authors,year,venue,publicationDate,citationCount,influentialCitationCount,referenceCount,isOpenAccess,openAccessPdf,fieldsOfStudy"


def request(database: str, query: str, size: int, at: str | int | None, start: str | None = None, end: str | None = None) -> dict[str, str | int]:
    """The parameters of one page; ``at`` is the cursor or offset."""
    size = min(size, LARGEST[database])
    dates = [(k, v) for k, v in (("from", start), ("to", end)) if v]
    if database == "openalex":
        p = {"search": query, "per_page": size, "cursor": at or "*"}
        return p | ({"filter": ",".join(f"{k}_publication_date:{v}" for k, v in dates)} if dates else {})
    if database == "crossref":
        p = {"query": query, "rows": size, "cursor": at or "*"}
        return p | ({"filter": ",".join(f"{ {'from': 'from', 'to': 'until'}[k] }-pub-date:{v}" for k, v in dates)} if dates else {})
    if database == "semantic_scholar":
        p = {"query": query, "offset": at or 0, "limit": size, "fields": S2_FIELDS}
        return p | ({"year": f"{(start or '')[:4]}-{(end or '')[:4]}"} if dates else {})
    return {"search_query": query, "start": at or 0, "max_results": size, "sortBy": "submittedDate", "sortOrder": "descending"}


def following(database: str, text: str, at: str | int | None) -> str | int | None:
    """The cursor or offset after a page, or None after the last."""
    if database == "arxiv":
        n = len(re.findall(r"<(?:\w+:)?entry[\s>]", text))
        total = re.search(r"totalResults[^>]*>\s*(\d+)", text)
        done = int(at or 0) + n
        return done if n and (not total or done < int(total[1])) else None
    page = json.loads(text)
    if database == "semantic_scholar":
        done = int(at or 0) + len(page.get("data") or ())
        return done if page.get("data") and done < int(page.get("total") or 0) else None
    if database == "openalex":
        return (page.get("meta") or {}).get("next_cursor") if page.get("results") else None
    message = page.get("message") or {}
    return message.get("next-cursor") if message.get("items") else None


class _Search(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options
        self.database = options["database"]
        if self.database not in ENDPOINTS:
            raise ValueError(f"database is one of {', '.join(ENDPOINTS)}")

    def partitions(self) -> list[_Search]:
        return [_Search(q) for q in dict.fromkeys(json.loads(self.o.get("queries", "[]")))]

    def _get(self, url: str) -> str:
        tries = int(self.o.get("retries", 3))
        for k in range(tries + 1):
            try:
                with urllib.request.urlopen(url, timeout=60) as r:
                    return r.read().decode("utf-8")
            except OSError:
                if k == tries:
                    raise
                time.sleep(min(2.0**k, 30))
        raise AssertionError

    def read(self, partition: _Search) -> Iterator[tuple]:
        base = self.o.get("endpoint") or ENDPOINTS[self.database]
        most = int(self.o["max_pages"]) if self.o.get("max_pages") else None
        at, page = None, 0
        while most is None or page < most:
            p = request(self.database, partition.query, int(self.o.get("page_size", 100)), at, self.o.get("start"), self.o.get("end"))
            text = self._get(f"{base}?{urllib.parse.urlencode(p)}")
            yield self.database, partition.query, page, None if at is None else str(at), text
            at, page = following(self.database, text, at), page + 1
            if at is None:
                return


class ResultPages(DataSource):
    """Registered as ``result_pages``."""

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> str:
        return "database string, query string, page int, cursor string, raw_response string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
