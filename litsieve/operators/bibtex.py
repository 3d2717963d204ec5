"""BibTeX entries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.text import bibtex_escape

#: Record type to entry type (fixed values).
TYPES = {"journal-article": "article", "proceedings-article": "inproceedings", "book-chapter": "inbook", "book": "book", "dissertation": "phdthesis", "report": "techreport"}


def authors(c: Column) -> Column:
    """"Family, Given" joined by " and "; the last word is the family name."""

    def one(a: Column) -> Column:
        w = F.filter(F.split(F.trim(a["name"]), r"\s+"), lambda x: F.length(x) > 0)
        return F.when(F.size(w) >= 2, F.concat(F.element_at(w, -1), F.lit(", "), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "))).otherwise(F.trim(a["name"]))

    return F.array_join(F.transform(c, one), " and ")


def key_base() -> Column:
    w = F.filter(F.split(F.trim(F.try_element_at("authors", F.lit(1))["name"]), r"\s+"), lambda x: F.length(x) > 0)
    t = F.filter(F.split(F.trim(F.regexp_replace("title", "[^a-zA-Z0-9 ]", "")), " +"), lambda x: F.length(x) > 0)
    return F.concat_ws("_", F.coalesce(F.lower(F.try_element_at(w, F.lit(-1))), F.lit("unknown")), F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("n.d.")), F.coalesce(F.lower(F.try_element_at(t, F.lit(1))), F.lit("untitled")))


def suffix(n: Column) -> Column:
    """a, b, ..., z, aa, ab, ... for 1, 2, ...; "" for 0. Up to eight letters: 200 thousand million."""
    letters = []
    for i in reversed(range(8)):
        least, unit = (26 ** (i + 1) - 1) // 25, 26**i
        letters.append(F.when(n >= least, F.chr(F.lit(97) + F.floor((n - least) / unit) % 26)).otherwise(""))
    return F.concat(*letters)


#: Records in one block of the order of ingestion.
BLOCK = 10_000


def keys(papers: DataFrame) -> DataFrame:
    """Adds ``cite_key``: the base, then base + a, b, ..., z, aa, ... in order of ingestion. Where that makes two records
    of different bases alike, the later has its base and number instead. Records of one base are numbered in two
    steps, by blocks of ``ordinal``, so that no task sees all of a hot base."""
    p = papers.withColumn("base", key_base()).withColumn("block", F.floor(F.col("ordinal") / BLOCK))
    n = p.groupBy("base", "block").agg(F.count("*").alias("n"))
    before = n.select("base", "block", (F.sum("n").over(Window.partitionBy("base").orderBy("block")) - F.col("n")).alias("before"))
    p = p.join(before, ["base", "block"]).withColumn("k", F.row_number().over(Window.partitionBy("base", "block").orderBy("ordinal")) - 1 + F.col("before"))
    p = p.withColumn("cite_key", F.concat("base", suffix(F.col("k"))))
    taken = p.groupBy("cite_key").agg(F.min("ordinal").alias("owner"), F.count("*").alias("n")).where("n > 1").select("cite_key", "owner")
    p = p.join(taken, "cite_key", "left")
    own = F.col("owner").isNull() | (F.col("owner") == F.col("ordinal"))
    return p.withColumn("cite_key", F.when(own, F.col("cite_key")).otherwise(F.concat_ws("_", "base", F.col("k") + 1))).drop("base", "block", "before", "k", "owner")


def entry_type() -> Column:
    raw = F.get_json_object(F.when(F.col("raw_data").startswith("{"), F.col("raw_data")), "$.type")
    v = F.lower(F.coalesce("venue", F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), raw), F.when(v.contains("thesis") | v.contains("dissertation"), "phdthesis"), F.lit("article"))


def entries(papers: DataFrame) -> DataFrame:
    """(ordinal, cite_key, entry_type, entry)."""
    p = keys(papers).withColumn("entry_type", entry_type())
    has = lambda c: F.length(c) > 0
    line = lambda name, v: F.concat(F.lit("  "), F.lit(name) if isinstance(name, str) else name, F.lit(" = {"), v, F.lit("}"))
    lines = F.array_compact(
        F.array(
            line("title", bibtex_escape("title")), F.when(F.size("authors") > 0, line("author", bibtex_escape(authors(F.col("authors"))))),
            F.when(F.col("year") != 0, line("year", F.col("year").cast("string"))),
            F.when(has("venue"), line(F.when(F.col("entry_type") == "article", "journal").otherwise("booktitle"), bibtex_escape("venue"))),
            F.when(has("publisher"), line("publisher", bibtex_escape("publisher"))), F.when(has("doi"), line("doi", F.col("doi"))), F.when(has("open_access_pdf"), line("url", F.col("open_access_pdf"))),
        )
    )
    body = F.concat(F.lit("@"), F.col("entry_type"), F.lit("{"), F.col("cite_key"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return p.select("ordinal", "cite_key", "entry_type", body.alias("entry"))
