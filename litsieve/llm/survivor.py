"""One surviving record per group of duplicates, field by field, by currency reasoning.

What makes a value sound is given by the task; which of a group's sound values is current is found from dates:

1. Value transitions. Every sound value of a dated row is a transition to the group's last dated sound value. Over all
   groups it is counted how often the value's measure (the count itself, the length of abstract, link and venue's
   name) grew and how often it fell. If one way prevails by more than chance (two standard deviations), values of
   that field have a learned precedence: growing or falling; else they have none.
2. Partial order. A group's dated values stand in the order of their last dates, whatever was learned. An undated value
   stands before or after the last dated one, and before or after other undated ones, as the learned precedence
   says; without one, undated values stand before all dated ones and are not ordered among themselves.
3. The topologically last value survives: the last dated one, unless an undated one stands behind it. Since every value
   is comparable with the last dated one, combining aggregates find it, without a window or list over a group.
   Of values that nothing orders, the one that most rows hold survives, then the one with the greatest ordinal.

Sound values:
* citation_count: any; 0 beside positive counts is unknown.
* abstract: not null, a placeholder or cut (problem 1's model). A text that the group's longest sound one continues
  precedes it, whatever the dates.
* open_access_pdf: links with a host and a path, no login pages.
* venue: no placeholders, clipped names ("...") or preprint servers, and no abbreviations. That a name abbreviates
  another is learned from the groups that hold both.

Defined results: null fields are unsound; a date that cannot be read is no date; a group whose rows all hold the
value, or of which none is sound, has no rows for that field; equal rows with different ordinals each count; empty
tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsieve.llm import clusters, truncation
from litsieve.session import join_checked, materialize, release

FIELDS = ("abstract", "citation_count", "open_access_pdf", "venue")
#: Names that say where a preprint lies, not where the work appeared (fixed values).
PREPRINT = r"(?i)^\s*(arxiv|biorxiv|medrxiv|chemrxiv|ssrn|preprints?(\.org)?|research square|osf( preprints)?|zenodo|corr)\b.{0,20}$"
BLANK = r"(?i)^[\s\-–—.]*$|^\s*(unknown|none|null|nan|n/?a|not available|untitled|tbd|various|-+)\s*$"
LINK = r"(?i)^(https?|ftp)://[^/\s]+\.[^/\s]+/[^\s]{3,}$"
NO_LINK = r"(?i)/(login|signin|sign-in|denied|error|404)\b|[?&](login|signin)="
SMALL = {"of", "the", "and", "for", "in", "on", "de", "des", "du", "der", "die", "für", "fur", "la", "le", "et", "und", "&", "a", "an", "to", "with", "at", "y", "e"}


def _tokens(name: str) -> list[str]:
    name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.findall(r"\w+", name)


def abbreviates(short: str | None, long: str | None) -> bool:
    """Whether ``short``, word by word, is made of beginnings or initials of ``long``'s words, in order."""
    if not short or not long or len(short) >= len(long):
        return False
    a = [t for t in _tokens(short) if t.lower() not in SMALL]
    b = [t.lower() for t in _tokens(long) if t.lower() not in SMALL]
    if not a or not b or [t.lower() for t in a] == b:
        return False
    j = 0
    for t in a:
        if j >= len(b):
            return False
        low = t.lower()
        if b[j].startswith(low):
            j += 1
        elif t.isupper() and 1 < len(t) and "".join(w[0] for w in b[j : j + len(t)]) == low:
            j += len(t)
        elif low[0] == b[j][0] and len(low) < len(b[j]) and re.match(".*?".join(map(re.escape, low)), b[j]):
            j += 1
        else:
            return False
    return j >= len(b)


@F.pandas_udf(T.BooleanType())
def _abbreviates(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([abbreviates(x, y) for x, y in zip(a, b)])


def retrieved(c: Column) -> Column:
    """ISO text in any of its notations as a UTC instant; unreadable is null (undated)."""
    return c.try_cast("timestamp")


def _written(c: Column) -> Column:
    return c.isNotNull() & (F.length(F.trim(c)) > 1) & ~c.rlike(BLANK) & ~((F.length(c) < 60) & c.rlike(truncation.PLACEHOLDER.pattern))


def grouped(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """The rows of all works that have two or more: (g, ordinal, t, abstract_length, *FIELDS). ``g`` is the work. An
    abstract is carried as its digest, and as null where it is a placeholder: no text is shuffled."""
    roots = materialize(clusters.groups(papers, match_pairs), "roots")
    rows = papers.select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "paper_id", retrieved(F.col("source.timestamp")).alias("t"),
        F.when(_written(F.col("abstract")), F.md5("abstract")).alias("abstract"), F.length("abstract").alias("abstract_length"), F.col("citation_count").cast("bigint").alias("citation_count"), "open_access_pdf", "venue",
    ).where("paper_id is not null and ordinal is not null")
    rows = rows.join(roots, "paper_id", "left").withColumn("g", F.coalesce(F.concat(F.lit("group "), F.col("root").cast("string")), "paper_id")).drop("root")
    many = rows.groupBy("g").agg(F.count("*").alias("rows")).where("rows > 1")
    out = materialize(rows.join(many.select("g"), "g"), "works")
    release(roots)
    return out


def directions(values: DataFrame) -> dict[str, int]:
    """Learned from the dated rows of sound values (g, field, value, measure, t, ordinal): per field whether the measure
    grows (1) or falls (-1) towards the last value, or neither (0)."""
    dated = values.where("t is not null")
    last = dated.groupBy("g", "field").agg(F.max(F.struct("t", "ordinal", "measure")).alias("x")).select("g", "field", F.col("x.measure").alias("last"))
    rows = dated.join(last, ["g", "field"]).groupBy("field").agg(F.count_if(F.col("last") > F.col("measure")).alias("up"), F.count_if(F.col("last") < F.col("measure")).alias("down")).collect()
    out = dict.fromkeys(FIELDS, 0)
    for r in rows:
        if abs(r.up - r.down) > 2 * (r.up + r.down) ** 0.5:
            out[r.field] = 1 if r.up > r.down else -1
    return out


def current(values: DataFrame) -> DataFrame:
    """(g, field, value): of sound values (g, field, value, measure, t, ordinal) the topologically last of each group."""
    way = F.lit(0)
    for field, d in directions(values).items():
        way = F.when(F.col("field") == field, F.lit(d)).otherwise(way)
    per = values.groupBy("g", "field", "value").agg(F.max("measure").alias("measure"), F.count("*").alias("n"), F.max("t").alias("t"), F.max("ordinal").alias("o")).withColumn("rank", way * F.col("measure"))
    x = per.groupBy("g", "field").agg(
        F.max(F.when(F.col("t").isNotNull(), F.struct("t", "o", "rank", "value"))).alias("dated"),
        F.max(F.when(F.col("t").isNull(), F.struct("rank", "n", "o", "value"))).alias("undated"),
    )
    behind = (way != 0) & (F.col("undated.rank") > F.col("dated.rank"))
    return x.select("g", "field", F.when(F.col("dated").isNull() | behind, F.col("undated.value")).otherwise(F.col("dated.value")).alias("value"))


def _short_names(named: DataFrame) -> DataFrame:
    """The venues (column of ``named``) that abbreviate another name of the same work more often than not."""
    values = named.select("g", "venue").distinct()
    longest = values.groupBy("g").agg(F.max(F.struct(F.length("venue").alias("n"), "venue")).alias("x")).select("g", F.col("x.venue").alias("longest"))
    pairs = values.join(longest, "g").where("venue <> longest").groupBy("venue", "longest").count()
    short = pairs.withColumn("short", _abbreviates("venue", "longest")).groupBy("venue").agg(F.sum(F.when(F.col("short"), F.col("count")).otherwise(-F.col("count"))).alias("x")).where("x > 0")
    return short.select("venue", F.lit(True).alias("is_short"))


def sound_values(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """(g, field, value, measure, t, ordinal) of every sound value."""
    v, c, link = F.col("venue"), F.col("citation_count"), F.col("open_access_pdf")
    named = v.isNotNull() & ~v.rlike(BLANK) & ~v.rlike(r"(\.{3}|…)\s*$") & ~v.rlike(PREPRINT)
    x = rows.join(cut.select("ordinal", F.lit(True).alias("cut")), "ordinal", "left").withColumn("named", named)
    x = join_checked(x, _short_names(rows.where(named)), ["venue"], "left")
    positive = rows.where("citation_count > 0").select("g").distinct().withColumn("positive", F.lit(True))
    x = x.join(positive, "g", "left")
    of = lambda field, sound, value, measure: F.when(sound, F.struct(F.lit(field).alias("field"), value.alias("value"), measure.cast("bigint").alias("measure")))
    values = F.array(
        of("abstract", F.col("cut").isNull() & F.col("abstract").isNotNull(), F.col("abstract"), F.col("abstract_length")),
        of("citation_count", c.isNotNull() & ((c > 0) | F.col("positive").isNull()), c.cast("string"), c),
        of("open_access_pdf", link.isNotNull() & link.rlike(LINK) & ~link.rlike(NO_LINK), link, F.length(link)),
        of("venue", F.col("named") & F.col("is_short").isNull(), v, F.length(v)),
    )
    return x.select("g", "t", "ordinal", F.explode(values).alias("x")).where("x is not null").select("g", "x.field", "x.value", "x.measure", "t", "ordinal")


def _continued(values: DataFrame, papers: DataFrame) -> DataFrame:
    """(g, field, value) of the abstracts that the longest sound one of their work continues. Texts are fetched only for
    works with several sound abstracts, one row for each."""
    a = values.where("field = 'abstract'")
    several = a.groupBy("g").agg(F.min("value").alias("v1"), F.max("value").alias("v2")).where("v1 < v2").select("g")
    one = materialize(a.join(several, "g").groupBy("g", "value").agg(F.min("ordinal").alias("ordinal"), F.max("measure").alias("measure")), "several")
    bare = F.regexp_replace(F.regexp_replace(F.col("abstract"), r"<[^<>]{0,200}>|[\s\p{Z}]+", " "), r"[^\p{L}\p{N}]+$|(?<= ) +", "")
    t = one.join(papers.select(F.col("ordinal").cast("bigint").alias("ordinal"), bare.alias("text")), "ordinal")
    t = materialize(t, "texts")
    top = t.groupBy("g").agg(F.max_by(F.struct("value", "text"), F.struct("measure", "value")).alias("x")).select("g", F.col("x.value").alias("longest"), F.col("x.text").alias("whole"))
    return t.join(top, "g").where("value <> longest and startswith(whole, text)").select("g", F.lit("abstract").alias("field"), "value")


def survivors(papers: DataFrame, match_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows of the works, (g, field, value) of each surviving value)."""
    rows = grouped(papers, match_pairs)
    values = materialize(sound_values(rows, truncation.cut_abstracts(papers)), "values")
    out = materialize(current(values.join(_continued(values, papers), ["g", "field", "value"], "left_anti")), "survivors")
    release(values)
    return rows, out


def surviving_rows(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """p5_found: (field, ordinal) of the rows that hold a surviving value that others of their work do not."""
    rows, best = survivors(papers, match_pairs)
    wide = best.groupBy("g").pivot("field", list(FIELDS)).agg(F.max("value"))
    wide = wide.select("g", *[F.col(f).alias(f"best_{f}") for f in FIELDS])
    held = [F.coalesce(F.col(f).cast("string").eqNullSafe(F.col(f"best_{f}")), F.lit(False)) & F.col(f"best_{f}").isNotNull() for f in FIELDS]
    x = rows.join(wide, "g").select("g", "ordinal", *[h.alias(f"has_{f}") for f, h in zip(FIELDS, held)])
    x = materialize(x, "held")
    mixed = x.groupBy("g").agg(*[(F.bool_or(f"has_{f}") & ~F.bool_and(f"has_{f}")).alias(f"mixed_{f}") for f in FIELDS])
    y = x.join(mixed, "g")
    picks = F.filter(F.array(*[F.when(F.col(f"has_{f}") & F.col(f"mixed_{f}"), F.lit(f)) for f in FIELDS]), lambda c: c.isNotNull())
    return y.select(F.explode(picks).alias("field"), "ordinal")


def surviving_records(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """One record per work of two or more rows: its id, its number of rows and the surviving values."""
    rows, best = survivors(papers, match_pairs)
    wide = best.groupBy("g").pivot("field", list(FIELDS)).agg(F.max("value"))
    n = rows.groupBy("g").agg(F.count("*").alias("n_rows"), F.min("paper_id").alias("work_id"))
    holder = rows.join(wide.select("g", F.col("abstract").alias("best")), "g").where("abstract = best").groupBy("g").agg(F.min("ordinal").alias("ordinal"))
    text = holder.join(papers.select(F.col("ordinal").cast("bigint").alias("ordinal"), "abstract"), "ordinal").select("g", "abstract").dropDuplicates(["g"])
    return n.join(wide.drop("abstract"), "g", "left").join(text, "g", "left").select(
        "work_id", "n_rows", "abstract", F.col("citation_count").cast("bigint").alias("citation_count"), "open_access_pdf", "venue"
    )
