"""Deeply nested JSON texts to linked flat tables, by vectorised structural indexing.

A block of texts is looked at as one byte array. Quote, bracket, comma and colon bitmaps are built with
numpy, prefix sums over them give "inside a string" and the nesting depth of every byte, and sorted
(depth, position) keys give each span's end, its parent, its key and its array position. Only the
result rows are built one by one.

Defined results:

* null, empty, blank, scalar, ``null``, ``{}`` and ``[]`` texts have no rows;
* a text that is incomplete (its brackets or strings do not close) has no rows, as has one with
  brackets of the wrong kind;
* a byte order mark, white space, text before or after the value, and JSON texts held in a JSON string
  (any number of times) are wrapping and do not count;
* repeated rows give repeated results; a key that occurs twice in one object gives a row each;
* very long texts form a block of their own; depth is limited only by memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are indexed together.
BLOCK_BYTES = 2_000_000

OBJECTS = (
    "origin string, row_id bigint, obj_no int, parent_no int, depth int, path string, key string, array_pos int"
)
OBJECTS_WITH_FIELDS = OBJECTS + ", fields map<string,string>"

_QUOTE, _BACK, _COMMA, _COLON = 34, 92, 44, 58


def unwrap(text: str | None) -> str:
    """The JSON text without what wraps it; '' where there is no object or array in it."""
    while True:  # a string that is read gets shorter
        if not text:
            return ""
        text = text.strip(" \t\r\n﻿\x00")
        if text[:1] == '"' and text[-1:] == '"':
            try:
                text = json.loads(text)
            except ValueError:
                return ""
            continue
        break
    if not text or text[0] in "{[":
        return text or ""
    if text[0] == '"':
        return ""  # a string that doesn't close
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    return text[at:] if at >= 0 else ""


class _Index:
    """Structure of a block of unwrapped texts."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "replace") for t in texts]
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        self.raw = b"".join(parts)
        self.n = n = len(self.raw)
        b = np.frombuffer(self.raw, np.uint8)
        ends = np.cumsum(lens)
        starts = ends - lens

        quote = np.flatnonzero(b == _QUOTE)
        back = np.flatnonzero(b == _BACK)
        if len(back):  # a quote after an odd run of backslashes is part of a string
            new = np.r_[True, np.diff(back) != 1]
            first = back[np.flatnonzero(new)][np.cumsum(new) - 1]
            odd = np.zeros(n + 1, bool)
            odd[back + 1] = (back - first) % 2 == 0
            quote = quote[~odd[quote]]
        text_of_quote = np.searchsorted(ends, quote, "right")
        first_quote = np.searchsorted(quote, starts)  # quotes before each text
        opening = (np.arange(len(quote)) - first_quote[text_of_quote]) % 2 == 0

        kind = np.zeros(256, np.int8)
        for c, k in ((b"{", 1), (b"[", 2), (b"}", 3), (b"]", 4), (b",", 5), (b":", 6)):
            kind[c[0]] = k
        pos = np.flatnonzero(kind[b])
        # inside a string: an odd number of this text's quotes lie before it
        text = np.searchsorted(ends, pos, "right")
        inside = (np.searchsorted(quote, pos) - first_quote[text]) % 2 == 1
        pos, text = pos[~inside], text[~inside]
        k = kind[b[pos]]

        step = np.where(k <= 2, 1, np.where(k <= 4, -1, 0)).astype(np.int64)
        before = np.r_[0, np.cumsum(step)]
        base = before[np.searchsorted(pos, starts)]
        after = before[1:] - base[text]  # depth after this byte
        # a value ends where its depth first returns to 0; what follows is wrapping
        closed = np.full(len(parts), -1, np.int64)
        zero = np.flatnonzero((after == 0) & (k >= 3) & (k <= 4))
        if len(zero):
            t, i = np.unique(text[zero], return_index=True)
            closed[t] = pos[zero[i]]
        ok = closed >= 0
        keep = ok[text] & (pos <= closed[text])
        self.pos, self.text, self.kind = pos[keep], text[keep], k[keep]
        self.depth = np.where(self.kind <= 2, after[keep] - 1, np.where(self.kind <= 4, after[keep], after[keep] - 1))
        # spans: at one depth, brackets open and close in turn
        br = np.flatnonzero(self.kind <= 4)
        order = br[np.lexsort((self.pos[br], self.depth[br], self.text[br]))]
        o, c = order[0::2], order[1::2]
        bad = np.unique(self.text[o[: len(c)]][(self.kind[c] - self.kind[o[: len(c)]]) != 2])
        sort = np.argsort(o)
        self.o, self.c = o[sort], c[sort]
        good = ~np.isin(self.text[self.o], bad)
        self.o, self.c = self.o[good], self.c[good]
        self.quote, self.opening = quote, opening

    def rank(self, kind: int) -> np.ndarray:
        """Sorted (depth, position) keys of one kind of byte."""
        i = np.flatnonzero(self.kind == kind)
        return np.sort(self.depth[i] * (self.n + 1) + self.pos[i])

    def spans(self) -> dict[str, np.ndarray]:
        """Of every object and array, in document order: text, depth, start, end, kind, parent (span
        number or -1), array position (or -1) and the byte range of the key (or -1)."""
        p, d, t = self.pos[self.o], self.depth[self.o], self.text[self.o]
        key = d * (self.n + 1) + p
        order = np.argsort(key)
        at = np.searchsorted(key[order], (d - 1) * (self.n + 1) + p) - 1
        parent = np.where(d > 0, order[np.maximum(at, 0)], -1)
        pk = np.where(parent >= 0, self.kind[self.o][parent], 0)
        comma = self.rank(5)
        up = np.where(parent >= 0, p[parent], 0)
        # a comma's depth is that of the span it lies in
        inner = (d - 1) * (self.n + 1)
        idx = np.searchsorted(comma, inner + p) - np.searchsorted(comma, inner + up)
        q = np.searchsorted(self.quote, p)
        named = (pk == 1) & (q >= 2)
        k0 = np.where(named, self.quote[np.maximum(q - 2, 0)] + 1 if len(self.quote) else 0, -1)
        k1 = np.where(named, self.quote[np.maximum(q - 1, 0)] if len(self.quote) else 0, -1)
        return {
            "text": t, "depth": d, "start": p, "end": self.pos[self.c], "kind": self.kind[self.o],
            "parent": parent, "array_pos": np.where(pk == 2, idx, -1), "key_start": k0, "key_end": k1,
        }


def _name(raw: bytes) -> str:
    s = raw.decode("utf-8")
    return json.loads(f'"{s}"') if "\\" in s else s


def _members(ix: _Index, s: dict[str, np.ndarray], wanted: np.ndarray) -> list[dict[str, str] | None]:
    """The scalar members, and arrays without objects, of the wanted objects, as raw JSON text (strings decoded)."""
    out: list[dict[str, str] | None] = [{} if w else None for w in wanted]
    colon = np.flatnonzero(ix.kind == 6)
    nxt = ix.kind[np.minimum(colon + 1, len(ix.kind) - 1)]
    cp, cd = ix.pos[colon], ix.depth[colon]
    key = s["depth"] * (ix.n + 1) + s["start"]
    order = np.argsort(key)
    owner = order[np.searchsorted(key[order], cd * (ix.n + 1) + cp) - 1]
    q = np.searchsorted(ix.quote, cp)
    by_start = {int(a): i for i, a in enumerate(s["start"])}
    has_object = np.zeros(len(s["start"]), bool)
    for i in np.flatnonzero(s["kind"] == 1):
        while (i := s["parent"][i]) >= 0 and not has_object[i]:
            has_object[i] = True
    for j, c in enumerate(colon):
        o = owner[j]
        if out[o] is None or nxt[j] == 1:
            continue
        name = _name(ix.raw[ix.quote[q[j] - 2] + 1 : ix.quote[q[j] - 1]])
        if nxt[j] == 2:
            span = by_start.get(int(ix.pos[c + 1]))
            if span is None or has_object[span]:
                continue
            value = ix.raw[s["start"][span] : s["end"][span] + 1].decode("utf-8")
        else:
            value = ix.raw[cp[j] + 1 : ix.pos[c + 1]].decode("utf-8").strip()
            if value == "null":
                continue
            if value[:1] == '"':
                try:
                    value = json.loads(value)
                except ValueError:
                    pass
        out[o][name] = value
    return out


def _block(origin: list[str], ids: list[int], texts: list[str], fields: bool) -> pd.DataFrame:
    ix = _Index(texts)
    s = ix.spans()
    n = len(s["start"])
    parent, kind, arr, k0, k1, depth = (s[k].tolist() for k in ("parent", "kind", "array_pos", "key_start", "key_end", "depth"))
    raw, paths, keys, near, rows = ix.raw, [""] * n, [None] * n, [-1] * n, []
    for i in range(n):
        p = parent[i]
        if p < 0:
            continue
        if arr[i] >= 0:
            paths[i] = f"{paths[p]}[{arr[i]}]"
        else:
            keys[i] = _name(raw[k0[i] : k1[i]])
            paths[i] = f"{paths[p]}.{keys[i]}" if paths[p] else keys[i]
        near[i] = p if kind[p] == 1 or parent[p] < 0 else near[p]  # the nearest object above
        if kind[i] == 1:
            rows.append(i)
    r = np.array(rows, np.int64)
    t = s["text"][r]
    first = np.searchsorted(s["text"], np.arange(len(texts)))
    up = np.array(near, np.int64)[r]
    out = pd.DataFrame(
        {
            "origin": np.array(origin, object)[t], "row_id": np.array(ids, np.int64)[t],
            "obj_no": (r - first[t]).astype(np.int32), "parent_no": (up - first[t]).astype(np.int32),
            "depth": s["depth"][r].astype(np.int32), "path": [paths[i] for i in rows],
            "key": [keys[i] for i in rows], "array_pos": s["array_pos"][r].astype(np.int32),
        }
    )
    if fields:
        want = np.zeros(n, bool)
        want[r] = True
        roots = np.flatnonzero((s["parent"] < 0) & (s["kind"] == 1))
        want[roots] = True
        m = _members(ix, s, want)
        out["fields"] = [m[i] for i in rows]
        t = s["text"][roots]
        root = pd.DataFrame(
            {
                "origin": np.array(origin, object)[t], "row_id": np.array(ids, np.int64)[t], "obj_no": np.int32(0), "parent_no": np.int32(-1),
                "depth": np.int32(0), "path": "", "key": None, "array_pos": np.int32(-1), "fields": [m[i] for i in roots],
            }
        )
        out = pd.concat([root, out], ignore_index=True)
    return out


def _run(fields: bool, path_only: bool = False):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            o, ids, ts, size = [], [], [], 0
            for origin, row_id, text in zip(pdf["origin"], pdf["row_id"], pdf["text"]):
                text = unwrap(text)
                if len(text) < 3:
                    continue
                o.append(origin)
                ids.append(row_id)
                ts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield _cut(_block(o, ids, ts, fields), path_only)
                    o, ids, ts, size = [], [], [], 0
            if ts:
                yield _cut(_block(o, ids, ts, fields), path_only)

    return over


def _cut(out: pd.DataFrame, path_only: bool) -> pd.DataFrame:
    return out[["origin", "row_id", "path"]] if path_only else out


def _texts(df: DataFrame, origin: str | Column, row_id: str, text: str) -> DataFrame:
    o = F.lit(origin) if isinstance(origin, str) else origin
    t = F.col(text)
    return df.select(o.alias("origin"), F.col(row_id).cast("bigint").alias("row_id"), t.alias("text")).where(
        t.isNotNull() & (F.length(t) > 2) & F.col(row_id).isNotNull()
    )


def json_objects(texts: DataFrame, fields: bool = False) -> DataFrame:
    """One row per object below the top-level value of each text (columns origin, row_id, text).

    ``obj_no`` numbers a text's spans, ``parent_no`` is the number of the nearest object above (that of the
    top-level value where there is none). With ``fields``, the top-level object has a row too (path '') and
    every row holds its scalar members. A narrow operator: no shuffle, whatever the skew."""
    return texts.mapInPandas(_run(fields), OBJECTS_WITH_FIELDS if fields else OBJECTS)


def object_paths(texts: DataFrame) -> DataFrame:
    """(origin, row_id, path) of every object below the top level."""
    return texts.mapInPandas(_run(False, True), "origin string, row_id bigint, path string")


def corpus_texts(papers: DataFrame, cached_pages: DataFrame) -> DataFrame:
    """The JSON texts of both tables in one form."""
    return _texts(papers, "papers", "ordinal", "raw_data").unionByName(_texts(cached_pages, "cached_pages", "id", "raw_response"))


#: Where the four databases keep their records (fixed values of the payload formats), as patterns on paths.
WORK = r"^$|^results\[\d+\]$|^data\[\d+\]$|^message\.items(\[\d+\])?$|^feed\.entry(\[\d+\])?$"
AUTHOR = r"(^|\.)(authorships|authors|author)(\[\d+\])?$"
AFFILIATION = r"(^|\.)(institutions|affiliations|affiliation)(\[\d+\])?$"


def _get(*names: str) -> Column:
    return F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names])


def work_table(objects: DataFrame) -> DataFrame:
    """Works: objects in a record's place that have a title or an identifier. Key (origin, row_id, work_no)."""
    first = lambda c: F.when(c.startswith("["), F.try_element_at(F.from_json(c, "array<string>"), F.lit(1))).otherwise(c)
    title = first(_get("title"))
    ident = _get("id", "paperId", "DOI")
    return objects.where(F.col("path").rlike(WORK) & (title.isNotNull() | ident.isNotNull())).select(
        "origin", "row_id", F.col("obj_no").alias("work_no"), "path",
        ident.alias("work_id"), _get("doi", "DOI").alias("doi"), title.alias("title"),
        _get("publication_year", "year").try_cast("int").alias("year"),
        _get("cited_by_count", "citationCount", "is-referenced-by-count").try_cast("bigint").alias("citation_count"),
    )


def author_table(objects: DataFrame) -> DataFrame:
    """Author entries, each with the number of the object above it (its work, or for one of the four formats
    the authorship that holds it), its place in the list, and the record's path."""
    a = objects.where(F.col("path").rlike(AUTHOR))
    return a.select(
        "origin", "row_id", F.col("obj_no").alias("author_no"), F.col("parent_no"), "path",
        F.regexp_extract("path", r"^(results\[\d+\]|data\[\d+\]|message\.items(?:\[\d+\])?|feed\.entry(?:\[\d+\])?)?", 0).alias("work_path"),
        F.when(F.col("array_pos") >= 0, F.col("array_pos")).alias("position"),
        F.coalesce(_get("display_name", "name"), F.nullif(F.concat_ws(" ", _get("given"), _get("family")), F.lit(""))).alias("name"),
        _get("id", "authorId").alias("author_id"), _get("orcid", "ORCID").alias("orcid"),
    )


def affiliation_table(objects: DataFrame) -> DataFrame:
    """Affiliation entries, each with the number of the author entry (or authorship) above it."""
    return objects.where(F.col("path").rlike(AFFILIATION)).select(
        "origin", "row_id", F.col("obj_no").alias("affiliation_no"), "parent_no", "path",
        _get("display_name", "name").alias("name"), _get("country_code").alias("country_code"),
    )
