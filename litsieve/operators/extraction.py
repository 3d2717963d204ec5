"""Study statistics and design from text, and risk of bias."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists, in the order in which they're tried.
#: Sample size. The first also fires on "in 2020"; ``bounded`` prevents it.
SIZE = (r"[Nn]=?\s*(\d+)", r"(\d+)\s+participants?", r"(\d+)\s+patients?", r"sample\s+size\s+of\s+(\d+)", r"total\s+of\s+(\d+)")
P_VALUE = (r"[Pp]\s*[=<>]\s*([\d.]+)", r"[Pp]-value\s*[=<>]\s*([\d.]+)")
EFFECT = (
    ("ratio", r"(?:OR|RR|HR)\s*[=:]\s*([\d.]+)"), ("ratio", r"(?:odds ratio|relative risk|hazard ratio)\s+of\s+([\d.]+)"),
    ("cohens_d", r"Cohen\'?s?\s+d\s*[=:]\s*([\d.]+)"), ("effect_size", r"effect\s+size\s*[=:]\s*([\d.]+)"),
)
#: "[-–to]" is one character: "1.2 to 3.4" doesn't match unless ``lenient_ci``.
INTERVAL = (r"95%\s*CI\s*[:\[]?\s*([\d.]+)\s*[-–to]\s*([\d.]+)", r"\[?([\d.]+)\s*[-–]\s*([\d.]+)\]?\s*95%\s*CI")
LENIENT = (r"95\s*%\s*CI\s*[:\[(]?\s*([\d.]+)\s*(?:[-–]|to|,)\s*([\d.]+)", INTERVAL[1])
DESIGNS = (
    ("randomized controlled trial", ("randomized", "randomised", "rct")), ("cohort study", ("cohort", "longitudinal", "prospective")),
    ("case-control", ("case-control", "case control")), ("cross-sectional", ("cross-sectional", "cross sectional", "survey")),
    ("systematic review", ("systematic review", "meta-analysis")), ("case study", ("case study", "case report")),
)
METHODS = (
    "anova", "chi-square", "fixed effects", "kruskal-wallis", "mann-whitney", "meta-analysis", "mixed models", "multilevel", "random effects", "regression",
    "structural equation", "t-test", "wilcoxon",
)


def sample_size(text: Column, bounded: bool = False) -> Column:
    """The greatest match of the first pattern that matches."""
    out = []
    for k, p in enumerate(SIZE):
        p = r"\b[Nn]\s*=\s*(\d+)" if bounded and k == 0 else p
        out.append(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)), lambda x: x.try_cast("bigint"))))
    return F.coalesce(*out)


def p_values(text: Column) -> Column:
    """All readable p-values from 0 to 1, in pattern order."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in P_VALUE])
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull() & (x >= 0) & (x <= 1))


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(0)
    for w in words:
        out = out + F.when(low.contains(w), 1).otherwise(0)
    return out


def study_design(text: Column) -> Column:
    """The design with most distinct keywords; ties go to the earlier one; none is "unknown"."""
    best = F.array_max(F.array(*[F.struct(_hits(text, w).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, (d, w) in enumerate(DESIGNS)]))
    return F.when(text.isNull() | (best["n"] == 0), "unknown").otherwise(best["d"])


def methods(text: Column) -> Column:
    """Statistical methods named, in alphabetical order."""
    return F.filter(F.array(*map(F.lit, METHODS)), lambda m: F.lower(text).contains(m))


def _effects(lenient: bool):
    pats = [(k, re.compile(p, re.I)) for k, p in EFFECT]
    cis = [re.compile(p, re.I) for p in (LENIENT if lenient else INTERVAL)]

    def number(s: str) -> float | None:
        try:
            return float(s)
        except ValueError:
            return None

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                if not isinstance(t, str):
                    continue
                for kind, p in pats:
                    for m in p.finditer(t):
                        v = number(m[1])
                        if v is None:
                            continue
                        near = t[max(0, m.start() - 50) : m.end() + 50]
                        lo = hi = None
                        for c in cis:
                            x = c.search(near)
                            if x and number(x[1]) is not None and number(x[2]) is not None:
                                lo, hi = number(x[1]), number(x[2])
                                break
                        rows.append((i, kind, v, lo, hi, near))
            yield pd.DataFrame(rows, columns=["id", "type", "value", "ci_lower", "ci_upper", "context"])

    return over


def effect_sizes(texts: DataFrame, lenient_ci: bool = False) -> DataFrame:
    """(id, type, value, ci_lower, ci_upper, context) of texts (id, text): match positions need a Python worker."""
    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").where("text is not null").mapInPandas(_effects(lenient_ci), f"id {kind}, type string, value double, ci_lower double, ci_upper double, context string")


def route(design: Column, size: Column, values: Column, citations: Column, least: float = 0.6, cited: int = 50) -> tuple[Column, Column]:
    """(completeness in thirds, path): regex results suffice, or a model for much-cited papers, or a fallback."""
    third = lambda ok: F.when(ok, 1.0).otherwise(0.0)
    full = (third(design != "unknown") + third(size.isNotNull()) + third(F.size(values) > 0)) / 3.0
    return full, F.when(full >= least, "regex").when(F.coalesce(citations, F.lit(0)) >= cited, "model").otherwise("fallback")


#: Keywords per domain of two tools (fixed values); "itt" also matches "committee". Other tools have none.
ROB = {
    "rob2": (
        ("randomization", ("random", "randomized", "randomised", "computer-generated")), ("allocation_concealment", ("concealed", "sealed envelope", "central allocation")),
        ("blinding_participants", ("double-blind", "participant-blind", "masked")), ("blinding_assessors", ("assessor-blind", "outcome-blind", "independent assessor")),
        ("incomplete_data", ("intention-to-treat", "itt", "complete data", "no dropout")), ("selective_reporting", ("all outcomes", "pre-registered", "protocol")),
    ),
    "newcastle_ottawa": (
        ("selection", ("representative", "consecutive", "population-based")), ("selection", ("same population", "matched controls")),
        ("comparability", ("adjusted for", "matched", "controlled for")), ("outcome", ("independent", "blind", "validated")),
    ),
}


def risk_of_bias(text: Column, tool: str = "rob2") -> tuple[list[tuple[str, Column]], Column, Column, Column]:
    """(judgement per domain, overall, mean confidence, needs review). Two keywords: low .7; one: some .5; none:
    high .3. The overall judgement is the worst. A tool without criteria gives low, 0 and review."""
    domains = ROB.get(tool, ())
    if not domains:
        return [], F.lit("low"), F.lit(0.0), F.lit(True)
    t = F.coalesce(text, F.lit(""))
    n = [(d, _hits(t, w)) for d, w in domains]
    each = [(d, F.when(c >= 2, "low").when(c == 1, "some").otherwise("high")) for d, c in n]
    worst, total = F.lit(2), F.lit(0.0)
    for _, c in n:
        worst = F.least(worst, F.least(c, F.lit(2)))
        total = total + F.when(c >= 2, 0.7).when(c == 1, 0.5).otherwise(0.3)
    mean = total / len(n)
    overall = F.when(worst >= 2, "low").when(worst == 1, "some").otherwise("high")
    return each, overall, mean, (mean < 0.6) | (worst == 0)
