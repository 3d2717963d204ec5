"""Identifier normalisation as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes removed one after the other (fixed values).
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
#: Values that stand for "no identifier" (fixed values).
PLACEHOLDERS = ("", "-", "--", "none", "null", "nan", "n/a", "na", "unknown", "not available", "tbd", "0")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_doi(c: str | Column) -> Column:
    """Lower-cased, trimmed, without URL or ``doi:`` prefixes (each removed once, in sequence); blank is null."""
    x = F.trim(F.lower(_c(c)))
    for p in DOI_PREFIXES:
        x = F.when(x.startswith(p), F.substr(x, F.lit(len(p) + 1))).otherwise(x)
    return F.nullif(F.trim(x), F.lit(""))


def normalize_doi_model(c: str | Column) -> Column:
    """The record model's variant: three prefixes, and no trimming afterwards."""
    x = F.trim(F.lower(_c(c)))
    for p in ("https://doi.org/", "http://dx.doi.org/", "doi:"):
        x = F.when(x.startswith(p), F.substr(x, F.lit(len(p) + 1))).otherwise(x)
    return F.nullif(x, F.lit(""))


def normalize_arxiv(c: str | Column, keep_version: bool = False) -> Column:
    """Without the ``arxiv:`` prefix (any case) and, unless kept, the version; blank is null."""
    x = F.regexp_replace(F.trim(_c(c)), r"(?i)^arxiv:", "")
    if not keep_version:
        x = F.regexp_replace(x, r"v[0-9]+$", "")
    return F.nullif(F.trim(x), F.lit(""))


def doi_key(c: str | Column) -> Column:
    """A DOI that identifies something, or null: placeholders and malformed values identify nothing."""
    x = F.regexp_replace(F.lower(_c(c)), r"\s+", "")
    x = F.regexp_replace(x, r"^(?:https?:/+)?(?:dx\.)?(?:www\.)?(?:doi\.org/)?(?:doi:)?/*", "")
    x = F.regexp_replace(x, r"[.,;]+$", "")
    sound = x.rlike(r"^10\.[0-9]{4,9}(?:\.[0-9]+)*/[^\s]+$") & ~x.rlike(r"^10\.0+/|/(?:unknown|none|null|n/?a|na|tbd|test|x+|0+|-+)$")
    return F.when(sound, x)


def arxiv_key(c: str | Column) -> Column:
    """An arXiv id without prefix and version that identifies something, or null."""
    x = F.regexp_replace(F.lower(_c(c)), r"\s+", "")
    x = F.regexp_replace(x, r"^(?:https?://)?(?:www\.)?(?:arxiv\.org/(?:abs|pdf)/)?(?:arxiv:)?", "")
    x = F.regexp_replace(x, r"(?:\.pdf)?$", "")
    x = F.regexp_replace(x, r"v[0-9]+$", "")
    sound = x.rlike(r"^(?:[0-9]{2}(?:0[1-9]|1[0-2])\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})$")
    return F.when(sound, x)


def paper_id(source: str | Column, external: str | Column) -> Column:
    """``source:external``; a null part is written "None"."""
    return F.concat_ws(":", F.coalesce(_c(source), F.lit("None")), F.coalesce(_c(external), F.lit("None")))
