"""Oversized documents to pieces at natural boundaries, by structure-tree packing.

A document's breaks have levels: headings by depth, paragraphs, lines and list items, sentences, words. They
nest, so they are a tree: a node is the text between two breaks of its level or above. From the top, a node that
fits is left whole; only an oversized node is descended into; then neighbouring pieces are merged as long as they
fit together. Where a text has no breaks (a long blob) the cut falls between tokens. A piece too small to hold two
overlaps is joined with its neighbour and both are parted anew.

Every piece but the first starts exactly ``overlap`` tokens (counted in the whole document) before the end of the
one before it, or up to three more where that would split a character. No piece has more than ``limit`` tokens,
counted anew in the piece itself.

Defined results: a null text has no pieces, an empty one a single empty piece; a document within the limit is one
piece; repeated rows are split alike; markup, damaged characters and texts of any length are allowed. A text of at
most ``limit`` bytes cannot exceed the limit (a token has a byte or more) and is not tokenized: its ``n_tokens`` is
null unless counts are asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.tokens import VOCABULARY, encoder

LIMIT, OVERLAP = 2048, 128
PIECES = "doc_id bigint, piece_no int, n_pieces int, start_byte bigint, end_byte bigint, n_tokens int, text string"
HEADING = re.compile(rb"^[ \t]*(#{1,6})[ \t]|^[ \t]*<h([1-6])\b|^[ \t]*(\d+(?:\.\d+){0,4})\.?[ \t]+[A-Z][^\n]{0,80}$", re.M)
PARAGRAPH = re.compile(rb"\n[ \t]*\n\s*|</?(?:p|div|section|article|ul|ol|table|blockquote)\b[^>]{0,200}>\s*", re.I)
LINE = re.compile(rb"\n|<(?:li|tr|br)\b[^>]{0,200}>", re.I)
SENTENCE = re.compile(rb"[.!?][\"')\]]{0,2}(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")  # and the ideographic marks
WORD = re.compile(rb"\s+")
LEVELS = 10  # 0-5 headings, 6 paragraphs, 7 lines, 8 sentences, 9 words


def breaks(raw: bytes, level: int) -> list[int]:
    """Byte positions at which a new node of this level may start."""
    if level < 6:
        depth = lambda m: len(m[1]) if m[1] else int(m[2]) if m[2] else m[3].count(b".") + 2
        return [m.start() for m in HEADING.finditer(raw) if min(depth(m), 6) - 1 == level]
    if level == 9:
        return [m.start() for m in WORD.finditer(raw)]
    return [m.end() for m in (PARAGRAPH, LINE, SENTENCE)[level - 6].finditer(raw)]


class _Document:
    def __init__(self, raw: bytes, off: np.ndarray):
        self.raw, self.off, self.starts = raw, off, {}
        cont = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
        self.char = np.append(~cont, True)[off]  # tokens that start at a character

    def at(self, level: int) -> list[int]:
        """Token numbers at which a node of this level may start."""
        if level not in self.starts:
            p = np.array(breaks(self.raw, level), np.int64)
            i = np.searchsorted(self.off, p, "right") - 1 if len(p) else p  # a word's token begins with its space
            self.starts[level] = np.unique(i[(p - self.off[i] <= 1) & self.char[i]]).tolist() if len(p) else []
        return self.starts[level]

    def cut(self, s: int, e: int, level: int, cap: int) -> list[tuple[int, int]]:
        if e - s <= cap:
            return [(s, e)]
        while level < LEVELS:
            a = self.at(level)
            inner = a[bisect_left(a, s + 1) : bisect_left(a, e)]
            if inner:
                nodes = zip([s, *inner], [*inner, e])
                return self.merge([p for x, y in nodes for p in self.cut(x, y, level + 1, cap)], cap)
            level += 1
        out = []
        while e - s > cap:
            m = s + cap
            while m > s + 1 and not self.char[m]:
                m -= 1
            out.append((s, m))
            s = m
        return [*out, (s, e)]

    @staticmethod
    def merge(parts: list[tuple[int, int]], cap: int) -> list[tuple[int, int]]:
        out = [parts[0]]
        for s, e in parts[1:]:
            if e - out[-1][0] <= cap:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
        return out

    def even(self, parts: list[tuple[int, int]], least: int, cap: int) -> list[tuple[int, int]]:
        """Pieces of fewer than ``least`` tokens are joined with a neighbour and the two parted again at the
        best break in their middle third, so that every piece can hold its overlap."""
        out: list[tuple[int, int]] = []
        for part in parts:
            if out and (part[1] - part[0] < least or out[-1][1] - out[-1][0] < least):
                s, e = out.pop()[0], part[1]
                if e - s <= cap:
                    out.append((s, e))
                    continue
                lo, hi = max(s + (e - s) // 3, e - cap), min(e - (e - s) // 3, s + cap)
                mid = next((m for level in range(LEVELS) if (m := self.near((s + e) // 2, lo, hi, level)) is not None), None)
                if mid is None:
                    mid = (s + e) // 2
                    while mid > lo and not self.char[mid]:
                        mid -= 1
                out += [(s, mid), (mid, e)]
            else:
                out.append(part)
        return out

    def near(self, m: int, lo: int, hi: int, level: int) -> int | None:
        a = self.at(level)
        inner = a[bisect_left(a, lo) : bisect_left(a, hi + 1)]
        return min(inner, key=lambda x: abs(x - m)) if inner else None


def split(text: str, enc, lengths: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of each piece."""
    raw = text.encode("utf-8", "replace")
    ids = np.array(enc.encode_ordinary(text), np.int64)
    if len(ids) <= limit:
        return [(0, len(raw), len(ids))]
    off = np.append(0, np.cumsum(lengths[ids]))
    doc = _Document(raw, off)
    cap = limit - overlap - 4
    while True:
        out, ok = [], True
        for k, (s, e) in enumerate(doc.even(doc.cut(0, len(ids), 0, cap), 2 * overlap, cap)):
            if k:
                s = max(0, s - overlap)
                while s > 0 and not doc.char[s]:
                    s -= 1
            n = e - s
            if n > limit - 64:  # a piece that starts or ends within a word may count differently by itself
                n = len(enc.encode_ordinary(raw[off[s] : off[e]].decode("utf-8", "replace")))
                ok = ok and n <= limit
            out.append((int(off[s]), int(off[e]), n))
        if ok:
            return out
        if cap <= overlap:
            raise ValueError("a piece cut within a word counts more tokens by itself than the limit, however short it is")
        cap -= 64


def _splitter(path: str, limit: int, overlap: int, texts: bool, count_short: bool):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        lengths = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if not isinstance(text, str):
                    continue
                raw = text.encode("utf-8", "replace")
                if len(raw) <= limit:
                    rows.append((doc, 0, 1, 0, len(raw), len(enc.encode_ordinary(text)) if count_short else None, text if texts else None))
                    continue
                parts = split(text, enc, lengths, limit, overlap)
                for k, (s, e, n) in enumerate(parts):
                    rows.append((doc, k, len(parts), s, e, n, raw[s:e].decode("utf-8", "replace") if texts else None))
            out = pd.DataFrame(rows, columns=["doc_id", "piece_no", "n_pieces", "start_byte", "end_byte", "n_tokens", "text"])
            out["n_tokens"] = out["n_tokens"].astype("Int32")
            yield out

    return over


def pieces(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY, texts: bool = True, count_short: bool = False) -> DataFrame:
    """The pieces of every document (columns doc_id, text). Narrow: no shuffle, whatever the skew."""
    if not 0 <= overlap <= limit // 4:
        raise ValueError("the overlap may be at most a quarter of the limit")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null").mapInPandas(
        _splitter(path, limit, overlap, texts, count_short), PIECES
    )


def oversized(docs: DataFrame) -> DataFrame:
    """p10_found: the documents that were split."""
    return pieces(docs, texts=False).where("n_pieces > 1 and piece_no = 0").select("doc_id")


def piece_report(docs: DataFrame) -> DataFrame:
    """Per split document: its pieces, their tokens, and the greatest piece."""
    return (
        pieces(docs, texts=False).where("n_pieces > 1").groupBy("doc_id")
        .agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    )
