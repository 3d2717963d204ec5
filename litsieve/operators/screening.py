"""Screening: similarity to criteria, the decision rule, review queue and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.similarity import cosine
from litsieve.session import ranked

AUTO, MAYBE = 0.75, 0.5
CRITERION = "criterion_id string, kind string, weight double, mandatory boolean"


def similarities(vectors: DataFrame, criteria: DataFrame) -> DataFrame:
    """(paper_id, criterion_id, sim): every record against every criterion, a stated set of a few rows."""
    c = F.broadcast(criteria.select("criterion_id", F.col("vector").alias("cv")))
    return vectors.crossJoin(c).select("paper_id", "criterion_id", cosine(F.col("vector"), F.col("cv")).alias("sim"))


def decide(sims: DataFrame, criteria: DataFrame, auto: float = AUTO, maybe: float = MAYBE, match: float = MAYBE) -> DataFrame:
    """(paper_id, decision, confidence, reason). A matched exclusion criterion whose weighted similarity reaches
    ``auto`` excludes; else an unmatched mandatory one; else the mean over matched inclusion criteria decides.
    Weighted similarities are capped at 1."""
    x = sims.join(F.broadcast(criteria.select("criterion_id", "kind", "weight", "mandatory")), "criterion_id")
    hit = F.coalesce(F.col("sim") >= match, F.lit(False))
    conf = F.least(F.col("sim") * F.col("weight"), F.lit(1.0))
    g = x.groupBy("paper_id").agg(
        F.coalesce(F.max(F.when((F.col("kind") == "exclusion") & hit, conf)), F.lit(0.0)).alias("excl"),
        F.count_if(F.col("mandatory") & (F.col("kind") == "inclusion") & ~hit).alias("missed"),
        F.coalesce(F.avg(F.when((F.col("kind") == "inclusion") & hit, conf)), F.lit(0.0)).alias("incl"),
    )
    by_excl, missed = F.col("excl") >= auto, F.col("missed") > 0
    decision = F.when(by_excl | missed, "exclude").when(F.col("incl") >= auto, "include").when(F.col("incl") >= maybe, "maybe").otherwise("exclude")
    confidence = F.when(by_excl, F.col("excl")).when(missed, 1.0).when(F.col("incl") >= maybe, F.col("incl")).otherwise(1 - F.col("incl"))
    reason = F.when(by_excl, "exclusion").when(missed, "mandatory").when(F.col("incl") >= maybe, "inclusion").otherwise("no match")
    return g.select("paper_id", decision.alias("decision"), confidence.alias("confidence"), reason.alias("reason"))


def vocabulary(sims: DataFrame, terms: DataFrame, least: float = 0.5) -> DataFrame:
    """(paper_id, concept, sim): the best term of each concept that reaches ``least``. terms: criterion_id, concept."""
    return sims.join(F.broadcast(terms), "criterion_id").groupBy("paper_id", "concept").agg(F.max("sim").alias("sim")).where(F.col("sim") >= least)


def similar(vectors: DataFrame, target: object, k: int = 10) -> DataFrame:
    """The k records most similar to one: the feature is the limit."""
    t = vectors.where(F.col("paper_id") == F.lit(target)).select(F.col("vector").alias("tv")).limit(1)
    x = vectors.where(F.col("paper_id") != F.lit(target)).crossJoin(F.broadcast(t))
    return x.select("paper_id", F.round(cosine(F.col("vector"), F.col("tv")), 6).alias("sim")).orderBy(F.desc("sim"), "paper_id").limit(k)


def uncertainty(decision: Column, confidence: Column, both: Column | None = None) -> Column:
    u = 1 - 2 * F.abs(confidence - 0.5)
    u = F.when(decision == "maybe", u * 1.5).otherwise(u)
    return u if both is None else F.when(both, u * 1.3).otherwise(u)


def active_candidates(results: DataFrame, k: int = 20) -> DataFrame:
    """The k results that a human judgement would help most."""
    return results.withColumn("uncertainty", F.round(uncertainty(F.col("decision"), F.col("confidence")), 6)).orderBy(F.desc("uncertainty"), "paper_id").limit(k)


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log(x + 1e-10))


def probability_decision(p: Column) -> Column:
    return F.when(p >= 0.7, F.struct(F.lit("include").alias("decision"), p.alias("confidence"))).when(p <= 0.3, F.struct(F.lit("exclude").alias("decision"), (1 - p).alias("confidence"))).otherwise(
        F.struct(F.lit("maybe").alias("decision"), F.lit(0.5).alias("confidence"))
    )


def review_queue(results: DataFrame, priority: DataFrame | None = None, priority_only: bool = False) -> DataFrame:
    """Uncertain results (maybe, or confidence under 0.7) in review order; priority ids first, or alone."""
    q = results.where((F.col("decision") == "maybe") | (F.col("confidence") < 0.7))
    if priority is not None:
        q = results.join(priority.select("paper_id", F.lit(1).alias("priority")), "paper_id", "inner" if priority_only else "left")
        q = q.where((F.col("priority") == 1) | (F.col("decision") == "maybe") | (F.col("confidence") < 0.7))
    else:
        q = q.withColumn("priority", F.lit(0))
    return ranked(q, [F.desc(F.coalesce("priority", F.lit(0))), F.asc("confidence"), F.asc("paper_id")], "place")


def review_stats(reviewed: DataFrame) -> DataFrame:
    """One row: total, reviewed, remaining and the share of reviews that agree with the automatic decision."""
    done = F.col("human_decision").isNotNull()
    n = F.count_if(done)
    return reviewed.agg(
        F.count("*").alias("total"), n.alias("reviewed"), F.count_if(~done).alias("remaining"),
        F.round(F.count_if(done & (F.col("human_decision") == F.col("decision"))) / F.nullif(n, F.lit(0)), 8).alias("agreement"),
    )


def final_decisions(reviewed: DataFrame) -> DataFrame:
    return reviewed.select("paper_id", F.coalesce("human_decision", "decision").alias("decision"), F.when(F.col("human_decision").isNotNull(), "human").otherwise("auto").alias("decided_by"))


def flow_counts(identified: DataFrame, after: DataFrame, decisions: DataFrame) -> DataFrame:
    """The boxes of a flow diagram, one row. Decisions are read without case."""
    d = F.lower(F.trim("decision"))
    return identified.agg(F.count("*").alias("identified")).crossJoin(after.agg(F.count("*").alias("after"))).crossJoin(
        decisions.agg(F.count("*").alias("screened"), F.count_if(d.isin("exclude", "excluded")).alias("excluded"), F.count_if(d.isin("include", "included")).alias("included"))
    ).select(
        "identified", F.greatest(F.col("identified") - F.col("after"), F.lit(0)).alias("duplicates_removed"), "screened", "excluded",
        (F.col("screened") - F.col("excluded")).alias("assessed"), (F.col("screened") - F.col("excluded") - F.col("included")).alias("reports_excluded"), "included",
    )


def train(labelled: DataFrame, features: int = 5000, trees: int = 100, seed: int = 42):
    """A text classifier (columns text, label 0/1): words to trigrams, TF-IDF, random forest, calibrated. Under ten
    labelled rows there is no model (None). Behaves like, but isn't numerically equal to, other libraries' forests."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, VectorAssembler

    if labelled.limit(10).count() < 10:
        return None
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), StopWordsRemover(inputCol="words", outputCol="w1"),
        NGram(n=2, inputCol="w1", outputCol="w2"), NGram(n=3, inputCol="w1", outputCol="w3"), SQLTransformer(statement="SELECT *, concat(w1, w2, w3) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=features), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, seed=seed, rawPredictionCol="forest", probabilityCol="votes", predictionCol="vote"),
        VectorAssembler(inputCols=["votes"], outputCol="score"), LogisticRegression(labelCol="label", featuresCol="score", regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)
