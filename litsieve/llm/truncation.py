"""Texts that were cut off by a field limit, found with a backward character n-gram model.

Read backwards from a position, the last n characters are its context. The model counts, per language and
context, how often a position with that context is a boundary (a sentence's end, with or without its final
mark, or a text's end) and how often the text goes on. For a text's final context the score is

    log P(context | boundary) - log P(context | any position)

from the longest context that was seen often enough; a text is cut if the score lies below the threshold of
its language, which expectation-maximisation sets from the column's own scores.

Only contexts that end some text are ever looked up, so only those are counted: their hashes are gathered in a
bit set of fixed size first (a full bit set filters nothing but changes no count). All texts are counted, a text that
several records share once with its number of copies.

A trailing ellipsis or "(more)" is taken off before the text is scored. Such texts have a threshold of their own: the two
distributions of their language are weighted by the share of cut ones among them, which is estimated like the others.

Defined results: null, blank and placeholder texts ("n/a", "No abstract available.") are not cut; markup and
white space at the end is ignored, however long; repeated rows are scored alike; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.session import join_checked, materialize, release

#: Each order's hash is made of two shorter ones: (order, the longer part, the part before it).
PARTS = ((3, 0, 0), (4, 3, 1), (6, 3, 3), (8, 4, 4), (11, 8, 3), (14, 11, 3), (18, 14, 4), (22, 18, 4), (30, 22, 8))
ORDERS = tuple(p[0] for p in PARTS)
#: Characters at the end of a text that its score depends on.
TAIL = 200
#: Occurrences from which a context's counts are trusted.
SEEN = 8
BITS = 1 << 22
BASE = 0x9E3779B97F4A7C15
#: Characters that are counted together.
CHUNK = 3_000_000

#: Words by which the language of a text's end is told (fixed values).
WORDS = {
    "en": {"the", "of", "and", "was", "were", "with", "to", "for", "by", "that", "than"},
    "es": {"el", "los", "las", "de", "la", "fue", "con", "una", "del", "en", "al"},
    "fr": {"le", "les", "des", "et", "une", "du", "dans", "par", "ont", "été", "chez"},
    "de": {"der", "die", "das", "und", "mit", "bei", "den", "von", "auf", "im", "wurden"},
}
LANGUAGES = [*WORDS, "other"]
PLACEHOLDER = re.compile(r"(?i)^\W*(n/?a|none|null|unknown|abstract|no abstract( available)?|not available|abstract (is )?not available)\W*$")
MARK = re.compile(r"(?:\s*(?:\.{3,}|…|[\[(](?:\.{3}|…|(?:read |see |show )?more|(?:text |abstract )?truncated|cut|cut off|continued)[\])]))+\s*$", re.I)
TAGS = re.compile(r"<[^<>]{0,200}>")
WORD = re.compile(r"[^\W\d_]+")
DIGITS = {ord(c): "0" for c in "123456789"}


def _clean(text: str) -> str:
    if "<" in text:
        text = TAGS.sub("", text)
    if "&" in text:
        text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&").replace("&quot;", '"')
    return " ".join(text.split())


def _language(end: str) -> int:
    words = WORD.findall(end.lower())
    best, most = len(WORDS), 1
    for i, known in enumerate(WORDS.values()):
        n = sum(w in known for w in words)
        if n > most:
            best, most = i, n
    return best


def _end(text: str) -> str:
    """The cleaned text, or of a long one at least its last ``TAIL`` cleaned characters."""
    size = 4 * TAIL
    while size < len(text):
        # a tag or entity cut at the window's start leaves less than 250 characters of it
        t = _clean(text[-size:])[250:]
        if len(t) >= TAIL + 60:
            return t
        size *= 4
    return _clean(text)


def _read(text: str | None, tail: bool = False) -> tuple[str, bool, int] | None:
    """(cleaned text with all digits 0, whether an ellipsis ended it, language), or None for no text. With
    ``tail``, only what its end depends on."""
    if not isinstance(text, str) or len(text) < 2:
        return None
    t = _end(text) if tail else _clean(text)
    if len(t) < 2 or len(t) < 60 and PLACEHOLDER.match(t):
        return None
    cut = MARK.search(t[-40:]) if t[-1] in ".…)]" else None
    if cut:
        t = t[: max(len(t) - 40, 0) + cut.start()].rstrip()
        if not t:
            return None
    end = t[-TAIL:]
    return (end if tail else t).translate(DIGITS), bool(cut), _language(end)


class _Block:
    """Cleaned texts as one array of UTF-16 code units with the ends and languages of the texts."""

    def __init__(self, read: list[tuple[str, bool, int]]):
        pad = "\x00" * max(ORDERS)  # contexts never reach into the text before
        self.marked = np.array([r[1] for r in read], bool)
        self.lang = np.array([r[2] for r in read], np.int64)
        parts = [r[0] for r in read]
        self.a = np.frombuffer((pad + pad.join(parts) + "\x00").encode("utf-16-le", "replace"), np.uint16)
        lens = np.array([len(p) if p.isascii() else len(p.encode("utf-16-le", "replace")) // 2 for p in parts], np.int64)
        self.ends = np.cumsum(lens + len(pad)) - 1  # last character of each text
        self.starts = self.ends - lens + 1
        self.full: dict[int, np.ndarray] = {}

    def _dense(self, order: int) -> np.ndarray:
        """Of every position, the hash of the ``order`` characters that end there (orders up to 6)."""
        if order not in self.full:
            a = self.a.astype(np.uint64)
            with np.errstate(over="ignore"):
                if order == 1:
                    h = a * np.uint64(BASE)
                elif order == 3:
                    one = self._dense(1)
                    h = one.copy()
                    h[1:] += one[:-1] * _power(1)
                    h[2:] += one[:-2] * _power(2)
                else:
                    _, long, rest = next(p for p in PARTS if p[0] == order)
                    h = self._dense(long).copy()
                    h[long:] += self._dense(rest)[:-long] * _power(long)
            self.full[order] = h
        return self.full[order]

    def _sparse(self, order: int, at: np.ndarray) -> np.ndarray:
        if order <= 4:
            return self._dense(order)[at]
        _, long, rest = next(p for p in PARTS if p[0] == order)
        with np.errstate(over="ignore"):
            return self._sparse(long, at) + self._sparse(rest, at - long) * _power(long)

    def contexts(self, at: np.ndarray, wanted=None):
        """Per order the hashes at the positions ``at``; with ``wanted``, only of positions whose shorter contexts
        were wanted too (a final context's endings are final contexts). Yields (order number, positions, hashes)."""
        short: dict[int, np.ndarray] = {}
        for k, (order, long, rest) in enumerate(PARTS):
            with np.errstate(over="ignore"):
                h = self._sparse(order, at) if order <= 4 else short[long] + self._sparse(rest, at - long) * _power(long)
                x = h ^ (h >> np.uint64(29))
                x = x * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                x ^= x >> np.uint64(32)
            if wanted is not None:
                keep = np.flatnonzero(wanted[(x & np.uint64(BITS - 1)).astype(np.int64)])
                at, h, x = at[keep], h[keep], x[keep]
                short = {o: v[keep] for o, v in short.items()}
            short[order] = h
            yield k, at, x

    def boundaries(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that count, and which of all positions are boundaries."""
        a = self.a
        text = a != 0
        nxt, nxt2 = np.append(a[1:], 0), np.append(a[2:], [0, 0])
        final = (a == 46) | (a == 33) | (a == 63)
        upper = ((nxt2 >= 65) & (nxt2 <= 90)) | ((nxt2 >= 0xBF) & (nxt2 <= 0xDE)) | (nxt2 == 0x201C)
        end = final & (nxt == 32) & upper | text & (nxt == 0)
        bare = np.append((end & final)[1:], False) & text & ~final  # its final mark may be left out
        return np.flatnonzero(text & (a != 32)), end | bare


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[_Block, np.ndarray]]:
    """Blocks of texts with the number of copies of each."""
    got, copies, size = [], [], 0
    for pdf in batches:
        for t, n in zip(pdf["text"], pdf["copies"]):
            r = _read(t)
            if r:
                got.append(r)
                copies.append(n)
                size += len(r[0])
                if size >= CHUNK:
                    yield _Block(got), np.array(copies)
                    got, copies, size = [], [], 0
    if got:
        yield _Block(got), np.array(copies)


def _counter(bits: np.ndarray):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)
        for b, copies in _chunks(batches):
            at, end = b.boundaries()
            lang, times = np.zeros(len(b.a), np.uint8), np.zeros(len(b.a), np.int32)
            for s, e, g, c in zip(b.starts.tolist(), b.ends.tolist(), b.lang.tolist(), copies.tolist()):
                lang[s : e + 1] = g
                times[s : e + 1] = c
            n = np.bincount(lang[at], weights=times[at], minlength=len(LANGUAGES)).astype(np.int64)
            e = np.bincount(lang[at], weights=end[at] * times[at], minlength=len(LANGUAGES)).astype(np.int64)
            out = [pd.DataFrame({"lang": np.arange(len(LANGUAGES)), "ord": -1, "hash": 0, "n": n, "ends": e})]  # totals
            for k, pos, x in b.contexts(at, wanted):
                key = (x & ~np.uint64(7)) | lang[pos]  # the language in the low bits
                codes, keys = pd.factorize(key)
                n = np.bincount(codes, weights=times[pos], minlength=len(keys)).astype(np.int64)
                ends = end[pos]
                e = np.bincount(codes[ends], weights=times[pos[ends]], minlength=len(keys)).astype(np.int64)
                out.append(pd.DataFrame({"lang": (keys & np.uint64(7)).astype(np.int32), "ord": k, "hash": (keys & ~np.uint64(7)).view(np.int64), "n": n, "ends": e}))
            yield pd.concat(out, ignore_index=True)

    return count


def _finals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [_read(t, tail=True) for t in pdf["text"]]
        row = [i for i, r in enumerate(got) if r]
        if not row:
            continue
        b = _Block([got[i] for i in row])
        out = pd.DataFrame({"digest": pdf["digest"].to_numpy()[row], "lang": b.lang.astype(np.int32), "marked": b.marked})
        for k, _, x in b.contexts(b.ends):
            out[f"b{k}"] = (x & np.uint64(BITS - 1)).astype(np.int32)
            out[f"h{k}"] = (x & ~np.uint64(7)).view(np.int64)
        yield out


def truncation_scores(texts: DataFrame) -> DataFrame:
    """(id, source, lang, length, digest, marked, score) of every text (columns id, source, text) that isn't null, blank or a
    placeholder. ``marked``: an ellipsis ended it; ``score`` is that of the text before it."""
    spark = texts.sparkSession
    texts = texts.where(F.length("text") > 1)
    rows = texts.select("id", "source", F.length("text").alias("length"), F.xxhash64("text").alias("digest"))
    texts = materialize(texts.groupBy("text").agg(F.count("*").alias("copies")).select("text", F.col("copies").cast("int").alias("copies"), F.xxhash64("text").alias("digest")), "texts")
    ks = range(len(ORDERS))
    names = [f"h{k}" for k in ks]
    ctx = texts.select("text", "digest").mapInPandas(_finals, "digest bigint, lang int, marked boolean, " + ", ".join(f"b{k} int, h{k} bigint" for k in ks))
    ctx = materialize(ctx, "finals")
    # 512 kB at most, whatever the number of texts
    b = ctx.select(F.explode(F.array(*[f"b{k}" for k in ks])).alias("b"))
    held = b.groupBy(F.shiftright("b", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, b & 63))").alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[held["word"].to_numpy(int)] = held["bits"].to_numpy(np.int64)
    counts = texts.select("text", "copies").mapInPandas(_counter(bits), "lang int, ord int, hash bigint, n bigint, ends bigint")
    counts = materialize(counts.groupBy("lang", "ord", "hash").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "contexts")
    totals = {r.lang: (r.n, r.ends) for r in counts.where("ord = -1 and n > 0").collect()}  # a row per language
    # texts that end alike are scored once: contexts that many share stay small
    finals = ctx.select("lang", *names).distinct()
    long = finals.select("lang", F.col(names[-1]).alias("last"), F.posexplode(F.array(*names)).alias("ord", "hash"))
    # a context too rare in its language is judged by all languages, if they hold a longer one
    either = counts.groupBy("ord", "hash").agg(F.sum("n").alias("all_n"), F.sum("ends").alias("all_ends"), F.collect_list(F.struct("lang", "n", "ends")).alias("by"))
    own = F.try_element_at(F.filter("by", lambda x: x["lang"] == F.col("lang")), F.lit(1))
    parts = long.join(either.where("ord >= 0"), ["ord", "hash"]).withColumn("own", own)
    seen = F.when(F.col("own.n") >= SEEN, F.struct(F.col("ord"), F.lit(1).alias("same"), F.col("own.n").alias("n"), F.col("own.ends").alias("ends"))).when(
        F.col("all_n") >= SEEN, F.struct(F.col("ord"), F.lit(0).alias("same"), F.col("all_n").alias("n"), F.col("all_ends").alias("ends"))
    )
    least = F.struct(F.col("ord"), F.lit(0).alias("same"), F.col("all_n").alias("n"), F.col("all_ends").alias("ends"))
    best = parts.groupBy("lang", "last").agg(F.max(seen).alias("b"), F.min(least).alias("short")).select("lang", "last", F.coalesce("b", "short").alias("b"))
    total = {-1: tuple(map(sum, zip(*totals.values()))) or (1, 1)} | totals
    total = spark.createDataFrame([(g, float(n), float(e)) for g, (n, e) in total.items()], "g int, total_n double, total_e double")
    score = (
        best.withColumn("g", F.when(F.col("b.same") == 1, F.col("lang")).otherwise(-1)).join(F.broadcast(total), "g")
        .select("lang", F.col("last"), (F.log((F.col("b.ends") - 0.95) / F.col("total_e")) - F.log((F.col("b.n") - 0.95) / F.col("total_n"))).alias("score"))
    )  # fmt: skip  # less the text's own end
    # a final context may be shared by any number of texts: salted
    salt = 8
    score = score.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    ctx_ = ctx.withColumn("last", F.col(names[-1])).withColumn("salt", F.pmod("digest", F.lit(salt)).cast("int"))
    by_text = ctx_.join(score, ["lang", "last", "salt"], "left").select("digest", F.element_at(F.array(*map(F.lit, LANGUAGES)), F.col("lang") + 1).alias("lang"), "marked", "score")
    # so may a text: adaptive execution splits it
    out = materialize(rows.join(by_text, "digest").select("id", "source", "length", "digest", "lang", "marked", "score"), "scores")
    for x in (texts, ctx, counts):
        release(x)
    return out


#: Where the fit begins: means, deviations and shares of cut and whole texts; as many texts as it counts for.
BEGIN, WEIGHT = ((-1.0, 3.5), (1.2, 1.0), (0.1, 0.9)), 30
#: How sure a mark alone makes a cut before any marked text is seen, and as many texts as that counts for.
MARKED, MARKED_WEIGHT = 0.95, 20


def _density(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.exp(-(((x[:, None] - mu) / sd) ** 2) / 2) / sd + 1e-12


def _fit(x: np.ndarray, w: np.ndarray, begin, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mixture of two normal distributions; ``begin`` counts as ``WEIGHT`` texts."""
    mu0, sd0, pi0 = (np.array(b, float) for b in begin)
    mu, sd, pi = mu0, sd0, pi0
    for _ in range(rounds):
        p = pi * _density(x, mu, sd)
        r = p / p.sum(1, keepdims=True) * w[:, None]
        k = WEIGHT * pi0
        s = r.sum(0) + k
        pi, mu = s / s.sum(), ((r * x[:, None]).sum(0) + k * mu0) / s
        spread = (r * (x[:, None] - mu) ** 2).sum(0) + k * (sd0**2 + (mu0 - mu) ** 2)
        sd = np.maximum(np.sqrt(spread / s), 0.8)  # whole texts have nearly one score
    return mu, sd, pi


def _crossing(mu: np.ndarray, sd: np.ndarray, pi: np.ndarray) -> float:
    """The score from which a text is more likely whole than cut."""
    grid = np.linspace(mu[0] - 3 * sd[0], mu[1] + 3 * sd[1], 2000)
    p = pi * _density(grid, mu, sd)
    cut = np.flatnonzero(p[:, 0] > p[:, 1])
    return float(grid[cut[cut <= np.searchsorted(grid, mu[1])].max(initial=0)]) if pi[0] <= 0.5 else float(grid[cut.max(initial=0)])


def thresholds(scores: DataFrame, rounds: int = 12) -> dict[tuple[str, bool], float]:
    """Per language, and whether a mark ended the text, the score below which a text is more likely cut than whole: a
    mixture of two normal distributions is fitted to the histogram of scores (tenths: of bounded size). All languages
    together are the beginning for each."""
    hist = scores.where("score is not null").groupBy("lang", "marked", F.round("score", 1).alias("x")).count().toPandas()
    x, w, plain = hist["x"].to_numpy(float), hist["count"].to_numpy(float), ~hist["marked"].to_numpy(bool)
    begin = _fit(x[plain], w[plain], BEGIN, rounds)
    out = {}
    for lang in LANGUAGES:
        own = (hist["lang"] == lang).to_numpy(bool)
        mu, sd, pi = _fit(x[own & plain], w[own & plain], begin, rounds)
        out[lang, False] = _crossing(mu, sd, pi)
        share, xm, wm = MARKED, x[own & ~plain], w[own & ~plain]
        for _ in range(rounds):
            p = np.array([share, 1 - share]) * _density(xm, mu, sd)
            share = float(((p[:, 0] / p.sum(1)) @ wm + MARKED * MARKED_WEIGHT) / (wm.sum() + MARKED_WEIGHT))
        out[lang, True] = _crossing(mu, sd, np.array([share, 1 - share]))
    return out


def field_limits(scores: DataFrame) -> DataFrame:
    """(source, length, bonus): lengths that many different texts of a source have and few have nearly: limits of
    the field. ``bonus`` is the logarithm of how much more often the length occurs than its neighbours."""
    per = scores.groupBy("source", "length").agg(F.count_distinct("digest").alias("n")).withColumn("block", F.floor(F.col("length") / 40))
    blocks = per.groupBy("source", "block").agg(F.sum("n").alias("m"))
    near = blocks.select("source", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), "m").groupBy("source", "block").agg(F.sum("m").alias("m"))
    usual = (F.col("m") - F.col("n") + 1) / 119.0
    return per.where("n >= 8").join(near, ["source", "block"]).where(F.col("n") > 8 * usual).select("source", "length", F.least(F.log(F.col("n") / usual), F.lit(2.5)).alias("bonus"))


def truncated(texts: DataFrame) -> DataFrame:
    """(id, source, lang, score, is_cut) of every text that was scored. A text as long as its source's field
    limit is judged cut at a higher score than others."""
    scores = truncation_scores(texts)
    limit = F.lit(0.0)
    for (lang, marked), t in thresholds(scores).items():
        limit = F.when((F.col("lang") == lang) & (F.col("marked") == marked), F.lit(t)).otherwise(limit)
    # each source has a few limits; their number is checked before they are broadcast
    x = join_checked(scores, field_limits(scores), ["source", "length"], "left")
    limit = limit + F.coalesce("bonus", F.lit(0.0))
    return x.select("id", "source", "lang", "score", (F.coalesce("score", F.lit(0.0)) < limit).alias("is_cut"))


def paper_abstracts(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("ordinal").alias("id"), F.col("source.database").alias("source"), F.col("abstract").alias("text"))


def cut_abstracts(papers: DataFrame) -> DataFrame:
    """p1_found: the records whose abstract is cut."""
    return truncated(paper_abstracts(papers)).where("is_cut").select(F.col("id").alias("ordinal"))


def truncation_report(papers: DataFrame) -> DataFrame:
    """Per database: abstracts, cut abstracts and their share."""
    return (
        truncated(paper_abstracts(papers)).groupBy("source")
        .agg(F.count("*").alias("abstracts"), F.count_if("is_cut").alias("cut"))
        .select("source", "abstracts", "cut", (F.col("cut") / F.col("abstracts")).alias("share"))
    )
