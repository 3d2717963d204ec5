"""Search strings from term lists, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Built-in term lists (fixed values): domain, group, terms in order.
DOMAINS = (
    ("ai_bias", "core", ("artificial intelligence", "machine learning", "algorithmic bias", "fairness", "discrimination", "equity")),
    ("ai_bias", "method", ("detection", "mitigation", "measurement", "evaluation", "testing")), ("ai_bias", "context", ("hiring", "criminal justice", "healthcare", "education", "finance")),
    ("climate_adaptation", "core", ("climate change", "adaptation", "resilience", "vulnerability", "mitigation")),
    ("climate_adaptation", "method", ("modeling", "assessment", "planning", "policy")), ("climate_adaptation", "context", ("urban", "coastal", "agriculture", "infrastructure")),
)


def domain_terms(spark: SparkSession, domain: str | None = None) -> DataFrame:
    rows = [(d, g, i, t) for d, g, ts in DOMAINS for i, t in enumerate(ts) if domain in (None, d)]
    return spark.createDataFrame(rows, "domain string, kind string, place int, term string")


def pairs(terms: DataFrame) -> DataFrame:
    """All combinations of two terms of a domain, in order. Term lists are short by nature."""
    a, b = terms.select("domain", F.col("place").alias("i"), F.col("term").alias("a")), terms.select("domain", F.col("place").alias("j"), F.col("term").alias("b"))
    return a.join(b, "domain").where("i < j").select("domain", F.concat_ws(" ", "a", "b").alias("query"))


def augmented(core: DataFrame, terms: DataFrame) -> DataFrame:
    """The core searches, and each with every pair of further terms (or with the only term)."""
    n = terms.groupBy("domain").agg(F.count("*").alias("n"))
    one = terms.join(n.where("n = 1"), "domain").select("domain", F.col("term").alias("more"))
    more = pairs(terms).select("domain", F.col("query").alias("more")).unionByName(one)
    return core.unionByName(core.join(more, "domain").select("domain", F.concat_ws(" ", "query", "more").alias("query")))


def systematic(terms: DataFrame) -> DataFrame:
    """(domain, query): pairs of core terms, plain and with method and context terms, each once."""
    of = lambda k: terms.where(F.col("kind") == k)
    core = pairs(of("core"))
    return augmented(core, of("method")).unionByName(augmented(core, of("context"))).distinct()


def for_source(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every query for every source; one source takes four words at most."""
    q = queries.crossJoin(F.broadcast(sources.select("source").distinct()))
    return q.withColumn("query", F.when(F.col("source") == "semantic_scholar", F.array_join(F.slice(F.split("query", r"\s+"), 1, 4), " ")).otherwise(F.col("query")))
