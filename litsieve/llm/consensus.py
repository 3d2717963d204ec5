"""One decision per item from several annotators who disagree: the competence-and-spamming mixture.

A label of annotator j is the item's true label with probability c_j, and otherwise drawn from j's own guess
distribution g_j. Expectation-maximisation yields the labels' posterior, c_j and g_j. Votes are laid out once as
one row per item; a round is one narrow pass over them and a small aggregate per (annotator, label).

Defined results: absent, unreadable and null decisions are no votes, an item without a vote has no row; a
person's equal decisions on an item count once, unequal ones each count; votes by nobody in particular
("unknown", null) share one annotator; exact ties go to the label that is more frequent overall, then to the
first of LABELS; repeated rows change nothing; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.session import materialize

LABELS = ("include", "exclude", "maybe")
#: Ways to write them (fixed values), after trimming and lower-casing.
SPELLINGS = {
    "include": "include", "included": "include", "yes": "include", "accept": "include",
    "exclude": "exclude", "excluded": "exclude", "no": "exclude", "reject": "exclude",
    "maybe": "maybe", "unsure": "maybe", "uncertain": "maybe", "unclear": "maybe",
}
#: Annotators whose parameters the driver holds (a few numbers each).
MAX_ANNOTATORS = 1_000_000
TOLERANCE = 1e-4


def decision(c: Column) -> Column:
    """The label that a typed decision means, or null."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^screening_?decision[.:]", "")
    x = F.regexp_replace(x, r"[^a-z]", "")
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in SPELLINGS.items() for v in kv]), x)


def votes(conflicts: DataFrame) -> DataFrame:
    """(item, annotator, label), each once."""
    pair = lambda who, what: F.struct(F.coalesce(F.nullif(F.trim(F.lower(F.col(who))), F.lit("")), F.lit("unknown")).alias("annotator"), decision(F.col(what)).alias("label"))
    v = conflicts.select(
        F.col("paper_id").alias("item"),
        F.explode(F.array(pair("reviewer1_id", "reviewer1_decision"), pair("reviewer2_id", "reviewer2_decision"), pair("resolved_by", "final_decision"))).alias("v"),
    )
    return v.select("item", "v.annotator", "v.label").where("item is not null and label is not null").distinct()


class _Model:
    def __init__(self, names: list[str], counts: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        k = len(LABELS)
        self.c = np.full(len(names), 0.7)
        self.g = (counts + 1.0) / (counts.sum(1, keepdims=True) + k)
        total = counts.sum(0) + 1.0
        self.prior = total / total.sum()
        self.first = total

    def likelihood(self, who: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Per vote, P(label | truth) for every truth."""
        p = np.repeat(((1 - self.c[who]) * self.g[who, label])[:, None], len(LABELS), 1)
        p[np.arange(len(who)), label] += self.c[who]
        return p

    def posterior(self, item: np.ndarray, n: int, who: np.ndarray, label: np.ndarray) -> np.ndarray:
        logs = np.zeros((n, len(LABELS)))
        np.add.at(logs, item, np.log(self.likelihood(who, label)))
        logs += np.log(self.prior)
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _flat(pdf: pd.DataFrame, m: _Model):
    size = pdf["who"].str.len().to_numpy()
    item = np.repeat(np.arange(len(pdf)), size)
    who = np.fromiter((m.index[w] for ws in pdf["who"] for w in ws), np.int64, len(item))
    label = np.fromiter((x for xs in pdf["label"] for x in xs), np.int64, len(item))
    return item, who, label, size


def _expect(m: _Model):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(LABELS)
        truthful, spam, prior = np.zeros((len(m.c), k)), np.zeros((len(m.c), k)), np.zeros(k)
        for pdf in batches:
            item, who, label, _ = _flat(pdf, m)
            post = m.posterior(item, len(pdf), who, label)
            share = post[item, label] * m.c[who] / (m.c[who] + (1 - m.c[who]) * m.g[who, label])
            np.add.at(truthful, (who, label), share)
            np.add.at(spam, (who, label), 1 - share)
            prior += post.sum(0)
        i, l = np.nonzero(truthful + spam)
        yield pd.DataFrame({"who": np.r_[i, np.full(k, -1)], "label": np.r_[l, np.arange(k)], "t": np.r_[truthful[i, l], prior], "s": np.r_[spam[i, l], np.zeros(k)]})

    return over


def _decide(m: _Model):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(LABELS, object)
        rank = m.first / m.first.sum() * 1e-9
        for pdf in batches:
            if not len(pdf):
                continue
            item, who, label, size = _flat(pdf, m)
            post = m.posterior(item, len(pdf), who, label)
            best = (post + rank).argmax(1)
            n = np.zeros((len(pdf), len(LABELS)))
            np.add.at(n, (item, label), 1)
            pairs = (n * (n - 1)).sum(1) / np.maximum(size * (size - 1), 1)
            yield pd.DataFrame(
                {"item": pdf["item"], "decision": names[best], "probability": post[np.arange(len(pdf)), best], "n_votes": size,
                 "vote_share": n[np.arange(len(pdf)), best] / size, "pair_agreement": np.where(size > 1, pairs, np.nan)}
            )

    return over


def fit(v: DataFrame) -> tuple[_Model, DataFrame]:
    """The fitted model and the votes, a row per item."""
    by_item = materialize(
        v.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("annotator", F.array_position(F.lit(list(LABELS)), F.col("label")).cast("int").alias("l")))).alias("x"))
        .select("item", F.col("x.annotator").alias("who"), F.transform("x.l", lambda i: i - 1).alias("label")), "votes",
    )
    counts = by_item.select(F.explode(F.arrays_zip("who", "label")).alias("x")).groupBy("x.who", "x.label").count()
    n = counts.select("who").distinct().count()
    if n > MAX_ANNOTATORS:
        raise ValueError(f"{n} annotators; at most {MAX_ANNOTATORS} are modelled one by one")
    rows = counts.toPandas()
    names = sorted(rows["who"].unique())
    c = np.zeros((len(names), len(LABELS)))
    for w, l, k in zip(rows["who"], rows["label"], rows["count"]):
        c[names.index(w) if len(names) < 50 else np.searchsorted(names, w), int(l)] = k
    m = _Model(names, c)
    while names:  # expectation-maximisation ends: no round lowers the likelihood
        e = by_item.select("who", "label").mapInPandas(_expect(m), "who int, label int, t double, s double").groupBy("who", "label").agg(F.sum("t").alias("t"), F.sum("s").alias("s")).toPandas()
        truthful, spam = np.zeros_like(c), np.zeros_like(c)
        own = e[e.who >= 0]
        truthful[own.who, own.label], spam[own.who, own.label] = own.t, own.s
        prior = e[e.who < 0].sort_values("label")["t"].to_numpy() + 1.0
        old = m.c
        # weak priors: an annotator with few labels stays near the mean
        m.c = (truthful.sum(1) + 3.5) / (truthful.sum(1) + spam.sum(1) + 5.0)
        m.g = (spam + 0.5) / (spam.sum(1, keepdims=True) + 0.5 * len(LABELS))
        m.prior = prior / prior.sum()
        if np.abs(m.c - old).max() < TOLERANCE:
            break
    return m, by_item


def consensus(v: DataFrame) -> DataFrame:
    """(item, decision, probability, n_votes, vote_share, pair_agreement) of votes (item, annotator, label)."""
    m, by_item = fit(v)
    kind = v.schema["item"].dataType.simpleString()
    return by_item.mapInPandas(_decide(m), f"item {kind}, decision string, probability double, n_votes bigint, vote_share double, pair_agreement double")


def annotators(v: DataFrame) -> DataFrame:
    """(annotator, n_votes, competence, guess_include, guess_exclude, guess_maybe)."""
    m, by_item = fit(v)
    n = v.groupBy("annotator").agg(F.count("*").alias("n_votes"))
    rows = [(w, float(m.c[i]), *map(float, m.g[i])) for w, i in m.index.items()]
    made = v.sparkSession.createDataFrame(rows, "annotator string, competence double, " + ", ".join(f"guess_{x} double" for x in LABELS))
    return n.join(F.broadcast(made), "annotator")


def paper_decisions(conflicts: DataFrame) -> DataFrame:
    """p7_found."""
    return consensus(votes(conflicts)).select(F.col("item").alias("paper_id"), "decision")


def paper_agreement(conflicts: DataFrame) -> DataFrame:
    return consensus(votes(conflicts)).withColumnRenamed("item", "paper_id")


def reviewer_reliability(conflicts: DataFrame) -> DataFrame:
    return annotators(votes(conflicts))
