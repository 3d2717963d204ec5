"""Test items that leaked into training documents, with suffix arrays over the documents.

Documents are read as words, without case, markup, line-end hyphens and kinds of punctuation. Each shard of
documents gets a suffix array: its word positions sorted by the words that follow. Only positions whose next
three words occur in some passage can match three words or more, so only those are sorted (the result is that of
the full array). Every suffix of every passage is then binary-searched in it, which yields all verbatim matches,
the longest ones and their places.

A match of ``ANCHOR`` words that few families of passages have anchors a document to an item; passages that share
half of their runs of that length are one family. A match of a third of the passage anchors whatever holds it.
Around anchors, shorter matches on nearly the same diagonal are chained, which bridges light edits; shorter phrases
that many families share count within a chain only. A document has leaked an item if the chains cover at least
``SHARE`` of its passage.

The passages are a stated query set: they are searched in blocks of bounded size against all documents, in one
narrow pass each. Families and what they share are found over all passages beforehand, by joins, so that no result
depends on where a block ends; the driver streams the passages and holds one block at a time.

Defined results: null and empty texts and passages match nothing; repeated documents each match; items with
equal passages are each reported; a passage of fewer than ``ANCHOR`` words matches only as a whole; ``longest`` is the
longest verbatim match of the chains' documents, whatever its length, the first of equals; texts of any length are
read whole; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from litsieve.llm import clusters
from litsieve.session import materialize

#: A third of the passage, less the words that a light edit replaces.
SHARE = 0.27
ANCHOR = 4
#: An anchor is in at most so many families of passages, or is a third of its passage.
RARE = 2
#: Chained matches are at most so many words apart, on diagonals at most so many apart.
GAP, DRIFT = 16, 8
DEPTH = 16
#: Characters of text in one shard, and of passages in one block.
SHARD, BLOCK = 8_000_000, 20_000_000
WORD = re.compile(r"[^\W_]+")
HYPHEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,300}>")
DROP = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
FOUND = "doc_id bigint, item_id bigint, coverage double, longest int, longest_at int, pieces int"


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(DROP))
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = HYPHEN.sub("", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    return WORD.findall(text.lower())


def runs(ws: list[str]) -> list[int]:
    """Of a passage's words, the hashes of its runs of ``ANCHOR`` words."""
    return [xxh64_intdigest(" ".join(ws[k : k + ANCHOR])) - (1 << 63) for k in range(len(ws) - ANCHOR + 1)]


class Queries:
    """The passages of a block (item, text, runs that many families share) as word numbers (0: none), with keys of their
    suffixes."""

    def __init__(self, items: list[tuple[int, str, set[int]]]):
        parts = [(i, words(p), shared) for i, p, shared in items]
        shared = [x[2] for x in parts if x[1]]
        parts = [(i, w) for i, w, _ in parts if w]
        self.vocab = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, ws in parts for w in ws))}
        self.items = [i for i, _ in parts]
        self.n = np.array([len(w) for _, w in parts], np.int64)
        seq = [np.array([self.vocab[w] for w in ws], np.int64) for _, ws in parts]
        self.seq = np.concatenate([np.append(s, np.zeros(DEPTH, np.int64)) for s in seq]) if seq else np.zeros(DEPTH, np.int64)
        first = np.append(0, np.cumsum(self.n + DEPTH))[:-1].astype(np.int64) if seq else np.zeros(0, np.int64)
        self.at = np.concatenate([np.arange(f, f + n) for f, n in zip(first, self.n)]) if seq else np.zeros(0, np.int64)
        self.item = np.repeat(np.arange(len(self.items)), self.n)
        self.first = first
        self.triples = np.unique(self.hash(self.seq, self.at, 3))
        left = self.first[self.item] + self.n[self.item] - self.at if len(self.at) else self.at
        self.rare = np.zeros(len(self.at), bool)
        k = 0
        for (_, w), held in zip(parts, shared):
            own = runs(w)
            self.rare[k : k + len(own)] = [r not in held for r in own] if held else True
            k += len(w)
        # a third of the passage, where it has no rare run
        self.third = np.maximum(-(-self.n // 3), ANCHOR)
        before = np.append(0, np.cumsum(self.rare))
        k = np.arange(len(self.at))
        need = self.third[self.item] if len(k) else k
        end = np.minimum(k + need - ANCHOR + 1, len(k))
        self.common = (left >= need) & (before[end] == before[k])
        # passages too short for an anchor, by length: hash of the words and item
        few = np.flatnonzero(self.n < ANCHOR)
        self.short = {int(k): (self.hash(self.seq, first[few[self.n[few] == k]], int(k)), few[self.n[few] == k]) for k in np.unique(self.n[few])}

    @staticmethod
    def hash(seq: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + seq[at + j].astype(np.uint64)
        return h


def _less(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, depth: int, equal: bool) -> np.ndarray:
    """Whether the suffix a[i..] comes before b[j..], over ``depth`` words; ``equal``: or is equal."""
    out = np.full(len(i), equal)
    open_ = np.ones(len(i), bool)
    for d in range(depth):
        x, y = a[i + d], b[j + d]
        out = np.where(open_ & (x != y), x < y, out)
        open_ &= x == y
        if not open_.any():
            break
    return out


def bounds(seq: np.ndarray, sa: np.ndarray, q: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the suffixes q[at..] in the suffix array: the range that shares their first words."""
    out = []
    for equal in (False, True):
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
        while (busy := lo < hi).any():
            mid = (lo + hi) // 2
            go = _less(seq, sa[np.minimum(mid, len(sa) - 1)], q, at, depth, equal) & busy
            lo, hi = np.where(go, mid + 1, lo), np.where(busy & ~go, mid, hi)
        out.append(lo)
    return out[0], out[1]


def _suffix_array(seq: np.ndarray, triples: np.ndarray) -> np.ndarray:
    n = len(seq) - DEPTH
    at = np.flatnonzero((seq[:n] > 0) & (seq[1 : n + 1] > 0) & (seq[2 : n + 2] > 0))
    h = Queries.hash(seq, at, 3)
    k = np.searchsorted(triples, h)
    at = at[(k < len(triples)) & (triples[np.minimum(k, len(triples) - 1)] == h)] if len(triples) else at[:0]
    return at[np.lexsort([seq[at + d] for d in range(DEPTH - 1, -1, -1)])]


def _chains(p: np.ndarray, q: np.ndarray, anchor: np.ndarray, size: int) -> tuple[float, int]:
    """(share of the passage covered, pieces) of matches of three words at (document p, passage q)."""
    order = np.lexsort((q, p))
    p, q, anchor = p[order], q[order], anchor[order]
    chain = -np.ones(len(p), np.int64)
    good: list[bool] = []
    ends: list[tuple[int, int]] = []  # last place and diagonal of each chain
    live: list[int] = []
    for k in range(len(p)):
        d = p[k] - q[k]
        live = [c for c in live if p[k] - ends[c][0] <= GAP]
        best = min((c for c in live if abs(ends[c][1] - d) <= DRIFT), key=lambda c: abs(ends[c][1] - d), default=None)
        if best is None:
            best = len(good)
            good.append(False)
            ends.append((0, 0))
            live.append(best)
        chain[k], ends[best] = best, (p[k], d)
        good[best] = good[best] or bool(anchor[k])
    keep = np.array(good, bool)[chain]
    covered = np.zeros(size + 3, bool)
    for j in range(3):
        covered[q[keep] + j] = True
    return covered[:size].mean(), int(sum(good))


def _begins(seq: np.ndarray, p: np.ndarray, q: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the suffixes seq[p..] and q[at..] share their first ``least`` words."""
    open_ = np.arange(len(p))
    out = np.zeros(len(p), bool)
    d = 0
    while len(open_):
        done = least[open_] <= d
        out[open_[done]] = True
        open_ = open_[~done]
        x = seq[p[open_] + d]
        open_ = open_[(x == q[at[open_] + d]) & (x > 0)]
        d += 1
    return out


def _extent(seq: np.ndarray, p: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words the suffixes seq[p..] and q[at..] share."""
    out = np.zeros(len(p), np.int64)
    open_ = np.arange(len(p))
    d = 0
    while len(open_):
        x = seq[p[open_] + d]
        open_ = open_[(x == q[at[open_] + d]) & (x > 0)]
        d += 1
        out[open_] = d
    return out


def _short(queries: Queries, seq: np.ndarray, starts: np.ndarray, ids: list[int]) -> list[tuple]:
    """The passages of fewer than ``ANCHOR`` words, which match as a whole."""
    out = []
    for k, (h, item) in queries.short.items():
        n = len(seq) - DEPTH
        at = np.flatnonzero(np.logical_and.reduce([seq[d : n + d] > 0 for d in range(k)]))
        got = Queries.hash(seq, at, k)
        keep = np.isin(got, h)
        at, got = at[keep], got[keep]
        doc = np.searchsorted(starts, at, "right") - 1
        for x, i in zip(h, item):
            d, where, many = np.unique(doc[got == x], return_index=True, return_counts=True)
            places = at[got == x]
            out += [(ids[a], queries.items[i], 1.0, k, int(places[b] - starts[a]), int(c)) for a, b, c in zip(d, where, many)]
    return out


def _shard(queries: Queries, ids: list[int], texts: list[str]) -> list[tuple]:
    parts = [np.fromiter(map(queries.vocab.get, w := words(t), repeat(0)), np.int32, len(w)) for t in texts]
    gap = np.zeros(DEPTH, np.int32)
    seq = np.concatenate([x for s in parts for x in (s, gap)])
    starts = np.append(0, np.cumsum([len(s) + DEPTH for s in parts]))[:-1]
    out = _short(queries, seq, starts, ids)
    sa = _suffix_array(seq, queries.triples)
    if not len(sa):
        return out
    # anchors first: most documents have none
    rare = np.flatnonzero(queries.rare)
    lo, hi = bounds(seq, sa, queries.seq, queries.at[rare], ANCHOR)
    n = hi - lo
    k = np.repeat(rare, n)
    pos = sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    common = np.flatnonzero(queries.common)
    deep = np.minimum(queries.third[queries.item[common]], DEPTH)
    for depth in np.unique(deep):
        c = common[deep == depth]
        lo, hi = bounds(seq, sa, queries.seq, queries.at[c], int(depth))
        n = hi - lo
        kc = np.repeat(c, n)
        pc = sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        long = _begins(seq, pc, queries.seq, queries.at[kc], queries.third[queries.item[kc]])
        k, pos = np.append(k, kc[long]), np.append(pos, pc[long])
    doc = np.searchsorted(starts, pos, "right") - 1
    pairs = np.unique(doc * len(queries.items) + queries.item[k])
    if not len(pairs):
        return out
    # all matches of three words, of the anchored documents and items only
    wanted_items = np.unique(pairs % len(queries.items))
    wanted_docs = np.unique(pairs // len(queries.items))
    own = np.flatnonzero(np.isin(queries.item, wanted_items))
    d_of = np.searchsorted(starts, sa, "right") - 1
    sub = sa[np.isin(d_of, wanted_docs)]
    lo, hi = bounds(seq, sub, queries.seq, queries.at[own], 3)
    n = hi - lo
    k3 = np.repeat(own, n)
    p3 = sub[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    d3 = np.searchsorted(starts, p3, "right") - 1
    code = d3 * len(queries.items) + queries.item[k3]
    keep = np.isin(code, pairs)
    k3, p3, d3, code = k3[keep], p3[keep], d3[keep], code[keep]
    four = seq[p3 + 3] == queries.seq[queries.at[k3] + 3]
    anchor = queries.rare[k3] & four
    long = np.flatnonzero(queries.common[k3])
    anchor[long] |= _begins(seq, p3[long], queries.seq, queries.at[k3[long]], queries.third[queries.item[k3[long]]])
    length = _extent(seq, p3, queries.seq, queries.at[k3])
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order], prepend=-1))
    for g in np.split(order, edges[1:]):
        i = queries.item[k3[g[0]]]
        share, pieces = _chains(p3[g], queries.at[k3[g]] - queries.first[i], anchor[g], int(queries.n[i]))
        if share >= SHARE:
            best = g[length[g].argmax()]
            out.append((ids[d3[g[0]]], queries.items[i], float(share), int(length[best]), int(p3[best] - starts[d3[g[0]]]), pieces))
    return out


def _search(queries: Queries):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        ids, texts, size = [], [], 0
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= SHARD:
                    yield pd.DataFrame(_shard(queries, ids, texts), columns=columns)
                    ids, texts, size = [], [], 0
        if ids:
            yield pd.DataFrame(_shard(queries, ids, texts), columns=columns)

    return over


def _passage_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i, p in zip(pdf["item_id"], pdf["passage"]):
            own = set(runs(words(p)))
            yield pd.DataFrame({"item_id": np.full(len(own), i, np.int64), "run": np.fromiter(own, np.int64, len(own))})


def shared_runs(items: DataFrame) -> DataFrame:
    """(item_id, shared): of each item (item_id, passage) the runs that more than ``RARE`` families of passages hold.
    Passages that share half of the runs of either are one family."""
    held = materialize(items.mapInPandas(_passage_runs, "item_id bigint, run bigint").distinct(), "runs")
    centre = held.groupBy("run").agg(F.min("item_id").alias("a"), F.max("item_id").alias("z")).where("a < z").select("run", "a")
    size = held.groupBy("item_id").agg(F.count("*").alias("n"))
    near = held.join(centre, "run").where("item_id <> a").groupBy("a", F.col("item_id").alias("b")).agg(F.count("*").alias("k"))
    near = near.join(size.withColumnRenamed("item_id", "a"), "a").join(size.select(F.col("item_id").alias("b"), F.col("n").alias("m")), "b").where("2 * k >= least(n, m)")
    family = clusters.hash_to_min(near.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    family = family.select(F.col("v").cast("bigint").alias("item_id"), F.col("root").alias("family"))
    # an item without a family is one by itself
    name = F.coalesce(F.concat(F.lit("f"), F.col("family")), F.concat(F.lit("i"), F.col("item_id")))
    of = held.join(family, "item_id", "left").select("item_id", "run", name.alias("family"))
    many = of.groupBy("run").agg(F.count_distinct("family").alias("n")).where(f"n > {RARE}").select("run")
    # as many as the passage has words at most
    return materialize(held.join(many, "run").groupBy("item_id").agg(F.collect_list("run").alias("shared")), "shared")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, longest, longest_at, pieces): the documents that repeat a passage, the words of
    the longest verbatim match and the number of the word at which it starts."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> '' and doc_id is not null")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").where("passage is not null and item_id is not null")
    found, block, size = None, [], 0
    rows = items.join(shared_runs(items), "item_id", "left").orderBy("item_id").toLocalIterator()
    for r in chain(rows, [None]):  # the query set, block by block
        if r is not None:
            block.append((r[0], r[1], set(r[2] or ())))
            size += len(r[1])
        if r is None or size >= BLOCK:
            x = docs.mapInPandas(_search(Queries(block)), FOUND)
            found = x if found is None else found.unionByName(x)
            block, size = [], 0
    return found


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """p8_found."""
    return leaks(docs, items).select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per benchmark: items, leaked items and documents concerned."""
    x = leaked(docs, items)
    n = x.groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))
    return items.join(n, "item_id", "left").groupBy("benchmark").agg(F.count("*").alias("items"), F.count("docs").alias("leaked_items"), F.coalesce(F.sum("docs"), F.lit(0)).alias("links"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that repeat a passage."""
    return docs.join(leaked(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "source", "lang", "n_chars")
