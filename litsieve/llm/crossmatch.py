"""Records of two tables that describe the same works but share no key: loopy belief propagation.

Candidate pairs come from selective blocking keys (identifiers, the whole title, the title less any one word, its two
rarest words, its beginning, and for titles that name nothing, title with author or year and venue). Each pair gets prior
log-odds from title, identifiers, year, author and venue. The pairs are the variables of a factor graph: a factor
per library record, and a softer one per work, says that at most one of its pairs is true. Messages are exchanged
through joins until none changes; the marginals are the confidences.

Works, not rows, are matched: rows linked by identifiers or earlier matches are one work, described by its most
frequent title, year, author and venue, and by all its identifiers. A hot work is a single candidate, whatever
its rows.

Defined results: null attributes say nothing; a record with neither title nor identifier matches nothing;
placeholders identify nothing; equal library records are matched alike; ties leave both with half the belief, so
none is chosen; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.ids import arxiv_key, doi_key
from litsieve.llm import clusters
from litsieve.session import materialize, release

TOLERANCE, DAMPING = 1e-2, 0.3
#: Rounds after which damping grows, and the damping at which messages that still change are an error.
PATIENCE, MOST_DAMPING = 20, 0.95
#: How strongly a work's pairs exclude each other (a library may hold a work twice).
WORK_FACTOR = 0.3
GENERIC = 20  # letters under which a title names nothing
#: What makes another work of a title (fixed values).
KINDS = {
    "protocol": r"\bprotocol\b", "comment": r"\bcomment(ary|s)?\b|\brejoinder\b", "reply": r"\b(reply|response) (to|from|by)\b|\bauthors? s? ?reply\b|\breply\b",
    "followup": r"\bfollow ?up( study)?$|\b\w+ (year|month) follow ?up\b", "update": r"\b(first|second|third|fourth|\d+\w\w)? ?update\b", "correction": r"\b(erratum|corrigendum|correction|retraction|addendum)\b",
    "part1": r"\bpart (i|1|one)\b", "part2": r"\bpart (ii|2|two)\b", "part3": r"\bpart (iii|3|three)\b", "feasibility": r"\bfeasibility\b",
}
KINDS = {k: re.compile(v) for k, v in KINDS.items()}


def title_words(c: Column) -> Column:
    """A title as an array of words: no case, markup, entities and punctuation."""
    x = F.lower(F.regexp_replace(c, r"<[^<>]{0,40}>", ""))
    x = F.regexp_replace(F.replace(F.replace(x, F.lit("&amp;"), F.lit(" and ")), F.lit("&"), F.lit(" and ")), r"\bw/", "with ")
    x = F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(x) > 0, F.split(x, " "))


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions, replacements or swaps of neighbours part two words."""
    if abs(len(a) - len(b)) > most:
        return False
    last, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, last[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return False
        last, row = row, new
    return row[-1] <= most


def alike(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or n >= 3 and a[0].isalpha() and near(a, b, 2 if n >= 9 else 1)


def kinds(text: str) -> set[str]:
    return {k for k, p in KINDS.items() if p.search(text)}


def title_odds(a: list[str], aw: list[float], b: list[str], bw: list[float], clipped: bool) -> tuple[float, bool]:
    """Log-odds that two titles name one work, and whether they name anything. ``a`` is the library's; ``aw`` and
    ``bw`` weigh the words by rarity."""
    free = list(range(len(b)))
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    for i, x in enumerate(a):
        j = next((j for j in free if b[j] == x), None)
        if j is not None:
            free.remove(j)
            hit_a[i] = hit_b[j] = True
    for i, x in enumerate(a):
        if not hit_a[i]:
            j = next((j for j in free if alike(x, b[j]) or clipped and i == len(a) - 1 and b[j].startswith(x)), None)
            if j is not None:
                free.remove(j)
                hit_a[i] = hit_b[j] = True
    # words split or joined by a slip ("five year" and "fiveyear") even out here
    if not all(hit_a) and "".join(a) == "".join(b):
        hit_a, hit_b = [True] * len(a), [True] * len(b)
    names = sum(map(len, a)) >= GENERIC and sum(map(len, b)) >= GENERIC
    cov_a = sum(w for w, h in zip(aw, hit_a) if h) / (sum(aw) or 1)
    cov_b = sum(w for w, h in zip(bw, hit_b) if h) / (sum(bw) or 1)
    ka, kb = kinds(" ".join(a)), kinds(" ".join(b))
    odds = 0.0
    if ka != kb:
        odds -= 3.0 if clipped and ka < kb else 12.0
    rare = [w for w, h in zip(aw, hit_a) if not h and w > 4.0]
    if not names:
        return odds + (1.0 if alike("".join(a), "".join(b)) else -6.0), False
    if rare and [w for w, h in zip(bw, hit_b) if not h and w > 4.0]:
        odds -= 7.0  # each names something that the other doesn't
    if cov_a > 0.97 and cov_b > 0.97:
        odds += 9.0
    elif cov_a > 0.97:  # the library's title is part of the other
        odds += 5.5 if clipped else 1.0 + 5.0 * cov_b
    elif cov_b > 0.97:
        odds += 1.0 + 5.0 * cov_a
    else:
        odds += 12.0 * (min(cov_a, cov_b) - 0.75)
    return odds, True


def pair_odds(r: dict) -> float:
    odds = -2.0
    names = False
    if r["l_words"] is not None and r["u_words"] is not None:
        t, names = title_odds(list(r["l_words"]), list(r["l_weights"]), list(r["u_words"]), list(r["u_weights"]), bool(r["clipped"]))
        odds += t
    doi = r["l_doi"] is not None and len(r["u_dois"])
    if doi:
        odds += 6.5 if r["l_doi"] in r["u_dois"] else -1.0
    if r["l_arxiv"] is not None and len(r["u_arxivs"]):
        odds += 6.5 if r["l_arxiv"] in r["u_arxivs"] else -1.5
    if not math.isnan(r["l_year"]) and not math.isnan(r["u_year"]):
        d = abs(r["l_year"] - r["u_year"])
        odds += 1.5 if d == 0 else 0.2 if d == 1 else -2.5
    if r["l_author"] and r["u_author"]:
        a, b = (max(re.findall(r"\w+", _fold(x)), key=len, default="") for x in (r["l_author"], r["u_author"]))
        whole = {w for w in re.findall(r"\w+", _fold(r["u_author"])) if len(w) > 2}
        same = any(alike(x, y) for x in re.findall(r"\w+", _fold(r["l_author"])) if len(x) > 2 for y in whole)
        odds += (3.0 if alike(a, b) else 2.0) if same else -2.5
    if not names and r["l_venue"] and r["u_venue"]:
        a, b = _fold(r["l_venue"]), _fold(r["u_venue"])
        odds += 1.5 if a == b else 0.0 if a[0] == b[0] else -2.0
    return max(min(odds, 15.0), -15.0)


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["l_year"] = pdf["l_year"].astype(float)
        pdf["u_year"] = pdf["u_year"].astype(float)
        yield pd.DataFrame({"lib_id": pdf["lib_id"], "work": pdf["work"], "prior": [pair_odds(r) for r in pdf.to_dict("records")]})


def works(papers: DataFrame, match_pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((ordinal, work) of every row, a row per work with what describes it)."""
    pairs = match_pairs if match_pairs is not None else papers.select(F.col("paper_id").alias("paper_id_a"), F.col("paper_id").alias("paper_id_b")).limit(0)
    roots = materialize(clusters.groups(papers, pairs), "roots")
    p = papers.select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "paper_id", title_words(F.col("title")).alias("words"), doi_key("doi").alias("doi"), arxiv_key("arxiv_id").alias("arxiv"),
        F.col("year").cast("int").alias("year"), F.try_element_at("authors", F.lit(1))["name"].alias("author"), "venue",
    )
    p = p.join(roots, "paper_id", "left").withColumn("work", F.coalesce(F.concat(F.lit("group "), F.col("root").cast("string")), F.coalesce("paper_id", F.concat(F.lit("row "), F.col("ordinal").cast("string"))))).drop("root", "paper_id")
    p = materialize(p.withColumn("venue", F.when(~F.col("venue").rlike(r"(?i)^\s*(unknown|arxiv|n/?a|-*)\s*$|\.\.\.$"), F.col("venue"))), "rows")
    w = p.groupBy("work").agg(
        F.mode("words", True).alias("words"), F.mode("year", True).alias("year"), F.mode("author", True).alias("author"), F.mode("venue", True).alias("venue"),
        F.collect_set("doi").alias("dois"), F.collect_set("arxiv").alias("arxivs"),
    )
    return p.select("ordinal", "work"), materialize(w, "works")


def _weighed(titles: DataFrame, df: DataFrame, n: Column, key: str) -> DataFrame:
    """Adds weights (by rarity) of the words and the two rarest words that the works' titles have."""
    w = titles.where("words is not null").select(key, F.posexplode("words").alias("pos", "word"))
    w = w.join(df, "word", "left").withColumn("weight", F.least(F.log(n / F.coalesce("df", F.lit(1))) + 0.1, F.lit(7.0)))
    g = w.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("x"), F.sort_array(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "word")))).alias("r"))
    rarest = F.sort_array(F.transform(F.slice(F.array_distinct("r"), 1, 2), lambda s: s["word"]))
    return titles.join(g.select(key, F.col("x.weight").alias("weights"), rarest.alias("rarest")), key, "left")


def _keys(t: DataFrame, key: str, dois: Column, arxivs: Column) -> DataFrame:
    """(key of the record, blocking key): hashes, a chance collision is only one more candidate."""
    words, letters = F.col("words"), F.array_join("words", "")
    long = words.isNotNull() & (F.length(letters) >= GENERIC)
    short = words.isNotNull() & ~long
    tag = lambda p, *c: F.xxhash64(F.lit(p), *c)

    def less_one(part) -> Column:
        """The title less one word, with a part of that word that a slip elsewhere in it leaves as it is."""
        rest = lambda i: F.array_join(F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words))), " ")
        return F.transform(words, lambda w, i: tag("less", rest(i), part(w)))

    # short words need no part: what is left of the title names the work
    head = lambda w: F.when(F.length(w) >= 9, F.substr(w, F.lit(1), F.lit(2))).otherwise("")
    inner = lambda w: F.when(F.length(w) >= 9, F.substr(w, F.length(w) - 8, F.lit(4))).otherwise("")
    surname = F.element_at(F.sort_array(F.transform(F.split(F.regexp_replace(F.lower("author"), r"[^\p{L}]+", " "), " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), False), 1)["w"]
    many = long & (F.size("words") >= 5)
    begin = F.slice("weights", 1, 10)  # a title cut short keeps its beginning, up to the rarest of the first words
    start = F.slice(words, F.lit(1), F.array_position(begin, F.array_max(begin)).cast("int"))
    parts = [
        F.when(long, F.array(tag("all", letters))), F.when(many, less_one(head)), F.when(many, less_one(inner)),
        F.when(long & (F.size("rarest") == 2), F.array(tag("two", F.array_join("rarest", " ")))), F.when(long, F.array(tag("start", F.array_join(start, " ")))), F.transform(F.filter(dois, lambda d: d.isNotNull()), lambda d: tag("doi", d)),
        F.transform(F.filter(arxivs, lambda d: d.isNotNull()), lambda d: tag("arxiv", d)), F.when(short & F.col("author").isNotNull(), F.array(tag("by", letters, surname))),
        F.when(short & F.col("year").isNotNull() & F.col("venue").isNotNull(), F.array(tag("in", letters, F.col("year"), F.lower("venue")))),
    ]
    none = F.array().cast("array<bigint>")
    return t.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(p, none) for p in parts])))).alias("key"))


def candidates(library: DataFrame, papers: DataFrame, match_pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((ordinal, work), (lib_id, work, prior)): the candidate pairs with their prior log-odds."""
    rows, u = works(papers, match_pairs)
    u = u.withColumnRenamed("work", "id")
    df = u.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = materialize(df, "words")
    n = F.lit(float(max(u.count(), 2)))
    l = library.select(
        F.col("lib_id").cast("bigint").alias("id"), title_words(F.col("title")).alias("words"), (F.length("title").between(30, 60) & ~F.col("title").rlike(r"[.)\]]\s*$")).alias("clipped"),
        doi_key("doi").alias("doi"), arxiv_key("arxiv_id").alias("arxiv"), F.col("year").cast("int").alias("year"), F.col("first_author").alias("author"), "venue",
    ).where("id is not null")
    u, l = materialize(_weighed(u, df, n, "id"), "u"), materialize(_weighed(l, df, n, "id"), "l")
    ku = _keys(u, "id", F.col("dois"), F.col("arxivs")).withColumnRenamed("id", "work")
    kl = _keys(l, "id", F.array("doi"), F.array("arxiv")).withColumnRenamed("id", "lib_id")
    pairs = kl.join(ku, "key").select("lib_id", "work").distinct()
    left = l.select(F.col("id").alias("lib_id"), F.col("words").alias("l_words"), F.col("weights").alias("l_weights"), "clipped", F.col("doi").alias("l_doi"), F.col("arxiv").alias("l_arxiv"), F.col("year").alias("l_year"), F.col("author").alias("l_author"), F.col("venue").alias("l_venue")).distinct()
    right = u.select(F.col("id").alias("work"), F.col("words").alias("u_words"), F.col("weights").alias("u_weights"), F.col("dois").alias("u_dois"), F.col("arxivs").alias("u_arxivs"), F.col("year").alias("u_year"), F.col("author").alias("u_author"), F.col("venue").alias("u_venue"))
    full = pairs.join(left, "lib_id").join(right, "work")
    scored = full.mapInPandas(_scored, "lib_id bigint, work string, prior double").groupBy("lib_id", "work").agg(F.max("prior").alias("prior"))
    return rows, materialize(scored, "pairs")


def beliefs(pairs: DataFrame) -> DataFrame:
    """(lib_id, work, prior, belief): marginals of the factor graph, by sum-product messages in log-odds.

    ``a`` and ``b`` are the messages from the library's and from the work's factor to a pair; a factor's message to
    one pair is -log(1 + sum of exp(incoming log-odds) of its other pairs). Pairs whose record and work have no other
    get no messages. Rounds go on until no message changes by ``TOLERANCE``; where that takes long, messages are
    damped more; messages that never settle raise an error."""
    of_l, of_w = (pairs.groupBy(k).agg(F.count("*").alias(n)).where(f"{n} > 1") for k, n in (("lib_id", "n_l"), ("work", "n_w")))
    state = pairs.join(of_l, "lib_id", "left").join(of_w, "work", "left").select("lib_id", "work", "prior", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), (F.col("n_l").isNotNull() | F.col("n_w").isNotNull()).alias("linked"))
    state = materialize(state, "messages")
    alone, state = state.where("not linked").drop("linked"), state.where("linked").drop("linked")
    old, damping, rounds = None, DAMPING, 0
    while True:
        rounds += 1
        if rounds % PATIENCE == 0:
            damping = (1 + damping) / 2
            if damping > MOST_DAMPING:
                raise RuntimeError(f"the messages still change after {rounds} rounds")
        to_l = state.withColumn("x", F.exp(F.least(F.col("prior") + F.col("b"), F.lit(30.0))))
        to_w = state.withColumn("y", F.exp(F.least(F.col("prior") + F.col("a"), F.lit(30.0))))
        sl = to_l.groupBy("lib_id").agg(F.sum("x").alias("sx"))
        sw = to_w.groupBy("work").agg(F.sum("y").alias("sy"))
        new = to_l.withColumn("y", F.exp(F.least(F.col("prior") + F.col("a"), F.lit(30.0)))).join(sl, "lib_id").join(sw, "work")
        na = -F.log(1 + F.greatest(F.col("sx") - F.col("x"), F.lit(0.0)))
        nb = -F.lit(WORK_FACTOR) * F.log(1 + F.greatest(F.col("sy") - F.col("y"), F.lit(0.0)))
        mix = lambda was, now: F.lit(damping) * was + F.lit(1 - damping) * now
        new = new.select("lib_id", "work", "prior", mix(F.col("a"), na).alias("a"), mix(F.col("b"), nb).alias("b"), F.greatest(F.abs(F.col("a") - na), F.abs(F.col("b") - nb)).alias("change"))
        new = materialize(new, "messages")
        release(old)
        change = new.agg(F.max("change")).first()[0]
        old = new
        state = new.drop("change")
        if change is None or change < TOLERANCE:
            break
    return state.unionByName(alone).select("lib_id", "work", "prior", (1 / (1 + F.exp(-(F.col("prior") + F.col("a") + F.col("b"))))).alias("belief"))


def matches(library: DataFrame, papers: DataFrame, match_pairs: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(lib_id, ordinal, confidence): library records and all rows of the work they most probably describe."""
    rows, pairs = candidates(library, papers, match_pairs)
    best = beliefs(pairs).where(F.col("belief") > least)
    return rows.join(best, "work").select("lib_id", "ordinal", F.col("belief").alias("confidence"))


def matched(library: DataFrame, papers: DataFrame, match_pairs: DataFrame | None = None) -> DataFrame:
    """p4_found."""
    return matches(library, papers, match_pairs).select("lib_id", "ordinal")
