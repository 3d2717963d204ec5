"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted date shapes, tried in this order: (pattern, format).
DATE_SHAPES = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd", 10), (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}", "yyyy/MM/dd", 10),
    (r"^[0-9]{2}-[0-9]{2}-[0-9]{4}", "dd-MM-yyyy", 10), (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy", 10),
    (r"^[0-9]{4}-[0-9]{2}", "yyyy-MM", 7), (r"^[0-9]{4}", "yyyy", 4),
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_title(c: str | Column) -> Column:
    """Lower case, only letters, digits, underscores and single blanks."""
    x = F.regexp_replace(F.lower(_c(c)), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def title_hash(c: str | Column) -> Column:
    return F.md5(normalize_title(c))


def clean_abstract(c: str | Column, most: int = 5000) -> Column:
    """Single blanks; blank is null; longer than ``most`` is cut and marked with '...'."""
    x = F.nullif(F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " ")), F.lit(""))
    return F.when(F.length(x) > most, F.concat(F.substr(x, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(x)


def parse_date(c: str | Column, strict: bool = False) -> Column:
    """The first shape that fits and gives a year from 1900 to 2100. A day that doesn't exist falls through to the
    month's first ("2024-02-30" is 2024-02-01) unless ``strict``."""
    x = F.trim(_c(c))
    shapes = DATE_SHAPES
    got = []
    for pattern, fmt, n in shapes:
        d = F.to_date(F.try_to_timestamp(F.substr(x, F.lit(1), F.lit(n)), F.lit(fmt)))
        ok = x.rlike(pattern + ("$" if strict and n < 10 else "")) & F.year(d).between(1900, 2100)
        got.append(F.when(ok, d))
    return F.coalesce(*got)


def sentences(c: str | Column, least: int = 20) -> Column:
    """Parts between full stops, trimmed, longer than ``least`` characters."""
    return F.filter(F.transform(F.split(_c(c), "[.]"), lambda s: F.trim(s)), lambda s: F.length(s) > least)


#: Replacements for BibTeX, in this order (fixed values).
BIBTEX_ESCAPES = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\^{}"))


def bibtex_escape(c: str | Column) -> Column:
    x = _c(c)
    for a, b in BIBTEX_ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
