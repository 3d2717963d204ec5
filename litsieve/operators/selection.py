"""Filters, joins and top-k lists over records, labels and decisions; matching of stated criteria by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.text import sentences


def paper_text(joint: str = ". ") -> Column:
    """Title and abstract as one text; a null part is empty."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(joint), F.coalesce("abstract", F.lit("")))


def by_decision(decided: DataFrame, *decisions: str) -> DataFrame:
    """The rows with one of the decisions, read without case; null decisions are in none."""
    return decided.where(F.lower(F.trim("decision")).isin(*decisions))


def decided_papers(papers: DataFrame, decided: DataFrame) -> DataFrame:
    """Each paper row with the decisions on its id. An id may be decided often and fetched often: every combination."""
    return papers.join(decided, "paper_id")


def training_rows(papers: DataFrame, decided: DataFrame) -> DataFrame:
    """(paper_id, text, label): the last row of each id with a binary decision, once per distinct label."""
    last = papers.groupBy("paper_id").agg(F.max("ordinal").alias("ordinal"))
    p = papers.join(last, ["paper_id", "ordinal"], "left_semi").select("paper_id", paper_text(" ").alias("text"))
    label = by_decision(decided, "include", "exclude").select("paper_id", (F.lower(F.trim("decision")) == "include").cast("int").alias("label")).distinct()
    return p.join(label, "paper_id")


def decision_shares(decided: DataFrame) -> DataFrame:
    """(decision, n, percent): how often each decision was made, null included."""
    n = decided.groupBy("decision").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("decision", "n", F.round(100.0 * F.col("n") / F.nullif("total", F.lit(0)), 4).alias("percent"))


def coverage(papers: DataFrame) -> DataFrame:
    """(field, filled, percent) of the fields that a report names; blank texts and empty lists are not filled."""
    filled = {
        "doi": F.length(F.trim("doi")) > 0, "abstract": F.length(F.trim("abstract")) > 0, "year": F.col("year").isNotNull(),
        "authors": F.size("authors") > 0, "venue": F.length(F.trim("venue")) > 0, "open_access_pdf": F.length(F.trim("open_access_pdf")) > 0,
    }
    one = papers.agg(F.count("*").alias("total"), *[F.count_if(ok).alias(c) for c, ok in filled.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in filled])
    return one.select("total", F.explode(rows).alias("x")).select("x.field", "x.filled", F.round(100.0 * F.col("x.filled") / F.nullif("total", F.lit(0)), 4).alias("percent"))


def among_most_influential(papers: DataFrame, scored: DataFrame, n: int) -> DataFrame:
    """The rows of papers whose id is among the n best of scored (paper_id, influence_score): the feature is the limit."""
    best = scored.orderBy(F.desc("influence_score"), "paper_id").limit(n).select("paper_id")
    return papers.join(F.broadcast(best), "paper_id", "left_semi")


def binary_entropy(p: Column) -> Column:
    """Entropy of a yes with probability p, in nats; p is kept off 0 and 1 by 1e-10."""
    x = F.greatest(F.least(p, F.lit(1 - 1e-10)), F.lit(1e-10))
    return -(x * F.log(x) + (1 - x) * F.log(1 - x))


def most_uncertain(scored: DataFrame, n: int) -> DataFrame:
    """The n rows of (paper_id, p) with the greatest entropy: the feature is the limit."""
    return scored.select("paper_id", F.round(binary_entropy(F.col("p")), 6).alias("entropy")).orderBy(F.desc("entropy"), "paper_id").limit(n)


def next_unreviewed(queue: DataFrame, n: int) -> DataFrame:
    """The first n rows of a queue (place, human_decision, ...) that nobody reviewed: the feature is the limit."""
    return queue.where("human_decision is null").orderBy("place").limit(n)


def missing_columns(df: DataFrame, *required: str) -> list[str]:
    """Which required columns a table lacks."""
    return [c for c in required if c not in df.columns]


def _words(c: Column) -> Column:
    """The distinct words of a text without case; null has none."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine similarity of two sets of words; 0 where one is empty."""
    n = F.size(a) * F.size(b)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.sqrt(n)).otherwise(F.lit(0.0))


def criterion_matches(papers: DataFrame, criteria: DataFrame, least: float = 0.2) -> DataFrame:
    """(ordinal, criterion_id, sim, matches): title and abstract against stated criteria (criterion_id, keywords: array of
    phrases), a set of a few rows. The best phrase counts; a criterion without phrases has similarity 0. Where
    vectors are given, ``screening.similarities`` takes their place."""
    p = papers.select("ordinal", _words(paper_text()).alias("w"))
    c = criteria.select("criterion_id", F.transform("keywords", _words).alias("k"))
    sim = F.coalesce(F.array_max(F.transform("k", lambda k: likeness(F.col("w"), k))), F.lit(0.0))
    return p.crossJoin(F.broadcast(c)).select("ordinal", "criterion_id", F.round(sim, 6).alias("sim")).withColumn("matches", F.col("sim") >= least)


def evidence(papers: DataFrame, criteria: DataFrame, k: int = 3) -> DataFrame:
    """(ordinal, criterion_id, place, sentence, sim): the k sentences of each paper that are most like a criterion's phrases;
    ties go to the earlier sentence. Sentences of up to 20 characters are none. The feature is the limit."""
    s = papers.select("ordinal", F.posexplode(sentences(paper_text())).alias("at", "sentence")).withColumn("w", _words(F.col("sentence")))
    c = criteria.select("criterion_id", _words(F.array_join("keywords", " ")).alias("k"))
    x = s.crossJoin(F.broadcast(c)).select("ordinal", "criterion_id", "at", F.trim("sentence").alias("sentence"), F.round(likeness(F.col("w"), F.col("k")), 6).alias("sim"))
    place = F.row_number().over(Window.partitionBy("ordinal", "criterion_id").orderBy(F.desc("sim"), "at"))  # a paper's sentences
    return x.withColumn("place", place.cast("bigint")).where(F.col("place") <= k).drop("at")


def vocabulary_tags(papers: DataFrame, terms: DataFrame, least: float = 0.2) -> DataFrame:
    """(ordinal, concept, sim): each concept (terms: concept, term; synonyms are further terms) whose best term is at least
    ``least`` like title and abstract."""
    x = criterion_matches(papers, terms.groupBy(F.col("concept").alias("criterion_id")).agg(F.collect_list("term").alias("keywords")), least)  # a stated vocabulary
    return x.where("matches").select("ordinal", F.col("criterion_id").alias("concept"), "sim")
