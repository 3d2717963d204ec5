"""Meta-analysis: inverse-variance pooling, heterogeneity, asymmetry. Input: study_id, effect, se."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions.stats import chi2_p, normal_p, t_p

Z = 1.96


def parse_effects(raw: DataFrame, study: str, effect: str, se: str) -> DataFrame:
    """Rows whose effect and standard error are numbers; others are dropped."""
    return raw.select(F.col(study).cast("string").alias("study_id"), F.col(effect).try_cast("double").alias("effect"), F.col(se).try_cast("double").alias("se")).where("effect is not null and se is not null")


def effect_rows(effects: DataFrame) -> DataFrame:
    """Confidence limits and weight (0 where the standard error isn't positive)."""
    return effects.select(
        "study_id", "effect", "se", (F.col("effect") - Z * F.col("se")).alias("ci_lower"), (F.col("effect") + Z * F.col("se")).alias("ci_upper"),
        F.when(F.col("se") > 0, 1.0 / (F.col("se") * F.col("se"))).otherwise(0.0).alias("weight"),
    )


def _moments(effects: DataFrame) -> DataFrame:
    w = 1.0 / (F.col("se") * F.col("se"))
    e = effects.where("se > 0")
    return e.select(w.alias("w"), "effect").agg(
        F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("effect")).alias("swe"), F.sum(F.col("w") * F.col("w")).alias("sww"),
        F.sum(F.col("w") * F.col("effect") * F.col("effect")).alias("swee"),
    )


def _spread(effects: DataFrame) -> DataFrame:
    """One row: k, sums of weights, Q, tau squared. Q needs the pooled mean first, so that no digits cancel."""
    m = _moments(effects)
    e = effects.where("se > 0").crossJoin(F.broadcast(m.select("k", "sw", "sww", (F.col("swe") / F.col("sw")).alias("mean"))))  # one row
    q = e.agg(F.first("k").alias("k"), F.first("sw").alias("sw"), F.first("sww").alias("sww"), F.sum((F.col("effect") - F.col("mean")) ** 2 / (F.col("se") * F.col("se"))).alias("q"))
    c = F.col("sw") - F.col("sww") / F.col("sw")
    return q.withColumn("tau2", F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c)).otherwise(0.0))


def pooled(effects: DataFrame, model: str = "fixed") -> DataFrame:
    """Pooled effect, limits, z and p. Rows without a positive standard error don't count; no rows give nulls."""
    tau2 = _spread(effects).select("tau2") if model == "random" else effects.sparkSession.range(1).select(F.lit(0.0).alias("tau2"))
    e = effects.where("se > 0").crossJoin(F.broadcast(tau2))
    w = 1.0 / (F.col("se") * F.col("se") + F.col("tau2"))
    x = e.select(w.alias("w"), "effect").agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("effect")).alias("swe"))
    effect, se = F.col("swe") / F.nullif("sw", F.lit(0.0)), F.sqrt(1.0 / F.nullif("sw", F.lit(0.0)))
    x = x.select("k", effect.alias("effect"), se.alias("se"))
    z = F.col("effect") / F.nullif("se", F.lit(0.0))
    return x.select("k", "effect", "se", (F.col("effect") - Z * F.col("se")).alias("ci_lower"), (F.col("effect") + Z * F.col("se")).alias("ci_upper"), z.alias("z")).withColumn("p_value", normal_p(F.col("z")))


def heterogeneity(effects: DataFrame) -> DataFrame:
    """Q, degrees of freedom, p, I squared in percent, tau squared and a verbal band."""
    s = _spread(effects).select("q", (F.col("k") - 1).alias("df"), "tau2")
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), 100.0 * (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0)
    x = s.withColumn("i2", i2)
    band = F.when(F.col("i2") < 25, "low").when(F.col("i2") < 50, "moderate").when(F.col("i2") < 75, "substantial").otherwise("considerable")
    return x.select("q", "df", "i2", "tau2", band.alias("band"), chi2_p(F.col("q"), F.col("df").cast("double")).alias("p_value"))


def asymmetry(effects: DataFrame, textbook: bool = False) -> DataFrame:
    """Regression of effect on precision, judged by the slope; or, as in textbooks, of effect / se on precision,
    judged by the intercept. Fewer than three studies give nulls."""
    e = effects.where("se > 0")
    x = 1.0 / F.col("se")
    y = F.col("effect") / F.col("se") if textbook else F.col("effect")
    r = e.select(x.alias("x"), y.alias("y")).agg(
        F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_r2("y", "x").alias("r2"), F.avg("x").alias("mx"),
    )
    s2 = F.col("syy") * (1 - F.col("r2")) / F.nullif(F.col("k") - 2, F.lit(0))
    se = F.sqrt(s2 * (1.0 / F.col("k") + F.col("mx") ** 2 / F.col("sxx"))) if textbook else F.sqrt(s2 / F.col("sxx"))
    t = (F.col("intercept") if textbook else F.col("slope")) / F.nullif(se, F.lit(0.0))
    enough = F.col("k") >= 3
    out = r.select("k", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, F.col("intercept")).alias("intercept"), F.when(enough, t).alias("t"), (F.col("k") - 2).cast("double").alias("df"))
    out = out.withColumn("p_value", t_p(F.col("t"), F.col("df")))
    return out.select("k", "slope", "intercept", "t", "p_value", (F.col("p_value") < 0.10).alias("biased"))


def forest(effects: DataFrame, model: str = "fixed") -> DataFrame:
    """The studies and one row "Pooled" without weight, ready for a plot."""
    p = pooled(effects, model)
    return effect_rows(effects).unionByName(p.select(F.lit("Pooled").alias("study_id"), "effect", "se", "ci_lower", "ci_upper", F.lit(None).cast("double").alias("weight")))
