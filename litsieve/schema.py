"""The record model: types and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTHOR = "struct<name:string,author_id:string,orcid:string,affiliation:string>"
SOURCE = "struct<database:string,query:string,timestamp:string,page:int,cursor:string>"
PAPER = (
    "ordinal bigint, paper_id string, doi string, arxiv_id string, title string, abstract string, "
    f"authors array<{AUTHOR}>, year int, publication_date date, venue string, publisher string, "
    "fields_of_study array<string>, keywords array<string>, citation_count bigint, influential_citation_count bigint, "
    f"reference_count bigint, is_open_access boolean, open_access_pdf string, external_ids map<string,string>, source {SOURCE}, raw_data string"
)
EDGE = "citing_paper_id string, cited_doi string, cited_paper_id string, cited_title string, source string, context string"
EFFECT = "study_id string, effect double, se double"


def valid() -> Column:
    """Whether a record meets the model's constraints; never null."""
    ok = (
        F.col("paper_id").isNotNull() & F.col("title").isNotNull() & F.col("source").isNotNull()
        & (F.col("year").isNull() | F.col("year").between(1900, 2100))
    )
    for c in ("citation_count", "influential_citation_count", "reference_count"):
        ok = ok & (F.coalesce(c, F.lit(0)) >= 0)
    return F.coalesce(ok, F.lit(False))


def split_valid(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that meet the constraints, the quarantine)."""
    return papers.where(valid()), papers.where(~valid())
