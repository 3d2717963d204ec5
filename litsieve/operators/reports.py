"""Corpus reports: counts, completeness, identifier and date checks, reviewer assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.text import normalize_title


def filled(c: str) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def by_source(papers: DataFrame) -> DataFrame:
    return papers.groupBy(F.col("source.database").alias("database")).agg(F.count("*").alias("papers"))


def corpus_stats(papers: DataFrame) -> DataFrame:
    return papers.agg(
        F.count("*").alias("total"), F.count_if(filled("doi")).alias("with_doi"), F.count_if(filled("abstract")).alias("with_abstract"),
        F.count_if(F.col("is_open_access")).alias("open_access"), F.min("year").cast("bigint").alias("first_year"), F.max("year").cast("bigint").alias("last_year"), F.sum("citation_count").alias("citations"),
    )


def completeness_profile(papers: DataFrame) -> DataFrame:
    """(field, missing, percent): a denominator of 1 where there are no rows."""
    miss = {
        "title": ~filled("title") | (F.lower(F.trim("title")) == "untitled"), "authors": F.coalesce(F.size("authors"), F.lit(0)) <= 0, "abstract": ~filled("abstract"),
        "year": F.col("year").isNull(), "identifier": ~filled("doi") & ~filled("arxiv_id"),
    }
    row = papers.agg(F.count("*").alias("n"), *[F.count_if(m).alias(k) for k, m in miss.items()])
    long = row.unpivot(["n"], list(miss), "field", "missing")
    return long.select("field", "missing", F.round(100.0 * F.col("missing") / F.greatest("n", F.lit(1)), 4).alias("percent"))


def identifier_issues(papers: DataFrame) -> DataFrame:
    """(ordinal, field, value): DOIs that don't start with 10. and arXiv ids of another shape."""
    doi, arxiv = F.nullif("doi", F.lit("")), F.nullif("arxiv_id", F.lit(""))
    bad = F.array(
        F.when(doi.isNotNull() & ~doi.startswith("10."), F.struct(F.lit("doi").alias("field"), doi.alias("value"))),
        F.when(arxiv.isNotNull() & ~arxiv.rlike(r"^[0-9]{4}\.[0-9]{4,5}$"), F.struct(F.lit("arxiv_id").alias("field"), arxiv.alias("value"))),
    )
    return papers.select("ordinal", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("x")).select("ordinal", "x.field", "x.value")


def date_issues(papers: DataFrame, this_year: int) -> DataFrame:
    y = F.col("year")
    return papers.agg(F.count_if(y.isNull()).alias("missing"), F.count_if(y > this_year + 1).alias("future"), F.count_if(y < 1900).alias("ancient"))


def coverage_by_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy("year").agg(F.count("*").alias("papers"), F.round(F.avg("citation_count"), 6).alias("mean_citations"), F.count_if(F.col("is_open_access")).alias("open_access"))


def date_range(papers: DataFrame, start: str, end: str) -> DataFrame:
    """Records dated in the range, or undated."""
    d = F.col("publication_date")
    return papers.where(d.isNull() | d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("ordinal", d.cast("string").alias("publication_date"))


def page(papers: DataFrame, number: int, size: int) -> DataFrame:
    """One page over the order of ingestion, with the number of pages."""
    total = papers.agg(F.ceil(F.count("*") / size).alias("total_pages"))
    return papers.select("ordinal", "paper_id").orderBy("ordinal").offset((number - 1) * size).limit(size).crossJoin(total)


def top_cited(papers: DataFrame, n: int = 20) -> DataFrame:
    return papers.select("ordinal", "paper_id", "citation_count").orderBy(F.desc_nulls_last("citation_count"), "ordinal").limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key: the feature is the limit per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def recent_queries(searches: DataFrame, n: int = 50) -> DataFrame:
    return searches.select("query_id", "source", "query_text", "created_at").orderBy(F.desc("created_at"), "query_id").limit(n)


def query_id(source: str, query: str, start: str, end: str) -> Column:
    """The first 16 hex digits of a hash of the search's parts."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.substr(F.sha2(F.concat_ws("|", part(source), part(query), part(start), part(end)), 256), F.lit(1), F.lit(16))


def conflicts(votes: DataFrame) -> DataFrame:
    """Papers with two or more reviews and more than one decision, with the first two reviewers in the order of column
    ``place`` (votes: paper_id, reviewer, decision, place)."""
    g = votes.groupBy("paper_id").agg(F.count("*").alias("reviews"), F.count_distinct("decision").alias("decisions"))
    first = votes.groupBy("paper_id", "reviewer").agg(F.min("place").alias("place"))
    one = first.groupBy("paper_id").agg(F.min(F.struct("place", "reviewer")).alias("x"))
    two = first.join(one, "paper_id").where("reviewer <> x.reviewer").groupBy("paper_id").agg(F.min(F.struct("place", "reviewer")).alias("y"))
    x = g.where("reviews >= 2 and decisions > 1").join(one, "paper_id", "left").join(two, "paper_id", "left")
    return x.select("paper_id", "reviews", "decisions", F.col("x.reviewer").alias("reviewer_1"), F.col("y.reviewer").alias("reviewer_2"))


def round_robin(papers: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Record k in order goes to reviewer k mod n. Positions are counted in two steps, by ranges of ``ordinal``, so
    that no task sees all rows. Without reviewers nothing is assigned."""
    block = (F.col("ordinal") / 10_000).cast("bigint")
    p = papers.select("ordinal", "paper_id", block.alias("block"))
    before = p.groupBy("block").agg(F.count("*").alias("n"))
    before = before.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    p = p.join(before, "block").withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("ordinal")) - 1 + F.col("before"))
    r = reviewers.select("user_id", (F.row_number().over(Window.orderBy("user_id")) - 1).alias("i"))
    n = reviewers.agg(F.count("*").alias("n_reviewers"))
    return p.crossJoin(n).where("n_reviewers > 0").withColumn("i", F.pmod(F.col("k"), F.col("n_reviewers")).cast("int")).join(F.broadcast(r), "i").select("ordinal", "paper_id", "user_id")


def dual_review(papers: DataFrame, reviewers: DataFrame) -> DataFrame:
    two = reviewers.select("user_id").orderBy("user_id").limit(2)
    return papers.select("ordinal", "paper_id").crossJoin(F.broadcast(two))


def simplified(papers: DataFrame) -> DataFrame:
    """Rows for a flat file: authors joined, abstract cut to 200 characters."""
    cut = F.when(F.length("abstract") > 200, F.concat(F.substr("abstract", F.lit(1), F.lit(200)), F.lit("..."))).otherwise(F.coalesce("abstract", F.lit("")))
    return papers.select("ordinal", "title", F.array_join(F.transform("authors", lambda a: a["name"]), "; ").alias("authors"), "year", cut.alias("abstract"))
