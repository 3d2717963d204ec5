"""Payloads of the four databases to records of the model: structured projections, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.ids import normalize_arxiv, normalize_doi
from litsieve.functions.text import clean_abstract, parse_date

OPENALEX = (
    "id string, doi string, title string, publication_year int, publication_date string, cited_by_count bigint, "
    "authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:string>>, "
    "concepts array<struct<display_name:string,score:double>>, primary_location struct<source:struct<display_name:string,host_organization_name:string>>, "
    "open_access struct<is_oa:boolean,oa_url:string>, abstract_inverted_index map<string,array<int>>"
)
S2 = (
    "paperId string, externalIds map<string,string>, title string, abstract string, year int, venue string, citationCount bigint, isOpenAccess boolean, "
    "openAccessPdf struct<url:string>, fieldsOfStudy array<string>, authors array<struct<authorId:string,name:string>>"
)
CROSSREF = (
    "DOI string, title string, abstract string, author string, published struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>, "
    "`container-title` string, publisher string, link array<struct<URL:string,`content-type`:string>>, `is-referenced-by-count` bigint"
)
ARXIV = "id string, title string, summary string, author string, published string, doi string, category string, link string"


def rebuild_abstract(index: Column) -> Column:
    """The words of an inverted index {word: [positions]} in order of position."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return clean_abstract(F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " "))


def date_parts(parts: Column) -> Column:
    """[[y, m, d]] to a date: a missing month or day is 1, an impossible one gives null."""
    p = F.try_element_at(parts, F.lit(1))
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", at(1), F.coalesce(at(2), F.lit(1)), F.coalesce(at(3), F.lit(1))), F.lit("yyyy-MM-dd")))


def listed(text: Column, element: str) -> Column:
    """A JSON text that is a list, or where one element stands without its list, that one."""
    t = F.trim(text)
    return F.when(t.startswith("["), F.from_json(t, f"array<{element}>")).when(t.startswith("{"), F.array(F.from_json(t, element)))


def first_text(text: Column) -> Column:
    return F.when(F.trim(text).startswith("["), F.try_element_at(F.from_json(text, "array<string>"), F.lit(1))).otherwise(text)


def author(name: Column, author_id: Column | None = None, orcid: Column | None = None, affiliation: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Unknown")).alias("name"), *[(none if c is None else c).alias(n) for c, n in ((author_id, "author_id"), (orcid, "orcid"), (affiliation, "affiliation"))])


def _record(df: DataFrame, database: str, **c: Column) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    kinds = {"external_id": "string", "doi": "string", "arxiv_id": "string", "title": "string", "abstract": "string", "authors": "array<struct<name:string,author_id:string,orcid:string,affiliation:string>>",
             "year": "int", "publication_date": "date", "venue": "string", "publisher": "string", "fields_of_study": "array<string>", "citation_count": "bigint", "is_open_access": "boolean", "open_access_pdf": "string"}
    out = df.select("row_id", F.lit(database).alias("database"), *[c.get(k, none(t)).cast(t).alias(k) for k, t in kinds.items()])
    out = out.where("external_id is not null and title is not null")
    return out.withColumn("paper_id", F.concat_ws(":", "database", "external_id")).withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))


def openalex(texts: DataFrame) -> DataFrame:
    """Records of texts (row_id, text). A location without a source is allowed."""
    x = texts.select("row_id", F.from_json("text", OPENALEX).alias("w"))
    w = F.col("w")
    org = lambda a: F.try_element_at(listed(a["institutions"], "struct<display_name:string>"), F.lit(1))["display_name"]
    oa = F.coalesce(w["open_access"]["is_oa"], F.lit(False))
    return _record(
        x, "openalex", external_id=F.element_at(F.split(w["id"], "/"), -1), doi=normalize_doi(w["doi"]), title=w["title"], abstract=rebuild_abstract(w["abstract_inverted_index"]),
        authors=F.transform(w["authorships"], lambda a: author(a["author"]["display_name"], a["author"]["id"], a["author"]["orcid"], org(a))), year=w["publication_year"], publication_date=parse_date(w["publication_date"]),
        venue=w["primary_location"]["source"]["display_name"], publisher=w["primary_location"]["source"]["host_organization_name"],
        fields_of_study=F.transform(F.filter(w["concepts"], lambda c: c["score"] > 0.3), lambda c: c["display_name"]), citation_count=w["cited_by_count"], is_open_access=oa, open_access_pdf=F.when(oa, w["open_access"]["oa_url"]),
    )


def semantic_scholar(texts: DataFrame) -> DataFrame:
    w = F.col("w")
    return _record(
        texts.select("row_id", F.from_json("text", S2).alias("w")), "semantic_scholar", external_id=w["paperId"], doi=normalize_doi(F.try_element_at(w["externalIds"], F.lit("DOI"))), arxiv_id=F.try_element_at(w["externalIds"], F.lit("ArXiv")),
        title=w["title"], abstract=clean_abstract(w["abstract"]), authors=F.transform(w["authors"], lambda a: author(a["name"], a["authorId"])), year=w["year"], venue=w["venue"],
        fields_of_study=w["fieldsOfStudy"], citation_count=w["citationCount"], is_open_access=w["isOpenAccess"], open_access_pdf=w["openAccessPdf"]["url"],
    )


def crossref(texts: DataFrame) -> DataFrame:
    w = F.col("w")
    d = F.coalesce(date_parts(w["published"]["date-parts"]), date_parts(w["published-print"]["date-parts"]))
    people = listed(w["author"], "struct<given:string,family:string,affiliation:string>")
    home = lambda a: F.try_element_at(listed(a["affiliation"], "struct<name:string>"), F.lit(1))["name"]
    pdf = F.try_element_at(F.filter(w["link"], lambda l: l["content-type"] == "application/pdf"), F.lit(1))["URL"]
    return _record(
        texts.select("row_id", F.from_json("text", CROSSREF).alias("w")), "crossref", external_id=normalize_doi(w["DOI"]), doi=normalize_doi(w["DOI"]), title=first_text(w["title"]), abstract=clean_abstract(w["abstract"]),
        authors=F.transform(people, lambda a: author(F.concat_ws(" ", a["given"], a["family"]), affiliation=home(a))), year=F.year(d), publication_date=d, venue=first_text(w["container-title"]), publisher=w["publisher"],
        citation_count=w["is-referenced-by-count"], is_open_access=pdf.isNotNull(), open_access_pdf=pdf,
    )


def arxiv(texts: DataFrame) -> DataFrame:
    w = F.col("w")
    i = F.element_at(F.split(w["id"], "/"), -1)
    pdf = F.try_element_at(F.filter(listed(w["link"], "struct<href:string,type:string>"), lambda l: l["type"] == "application/pdf"), F.lit(1))["href"]
    d = parse_date(w["published"])
    return _record(
        texts.select("row_id", F.from_json("text", ARXIV).alias("w")), "arxiv", external_id=i, doi=normalize_doi(w["doi"]), arxiv_id=F.regexp_replace(i, r"v[0-9]+$", ""), title=w["title"], abstract=clean_abstract(w["summary"]),
        authors=F.transform(listed(w["author"], "struct<name:string>"), lambda a: author(a["name"])), year=F.year(d), publication_date=d, venue=F.lit("arXiv"),
        fields_of_study=F.array_distinct(F.transform(listed(w["category"], "struct<term:string>"), lambda c: c["term"])), is_open_access=F.lit(True), open_access_pdf=pdf,
    )


#: An Atom feed; elements by their local names, attributes with an underscore.
ATOM = (
    "entry array<struct<id:string,title:string,summary:string,published:string,doi:string,author:array<struct<name:string>>,"
    "primary_category:struct<_term:string>,category:array<struct<_term:string>>,link:array<struct<_href:string,_title:string>>>>"
)


def arxiv_atom(feeds: DataFrame) -> DataFrame:
    """Records of Atom feeds (row_id, text), read by Spark's own XML parser. An entry without a title is "Untitled"; the
    primary category comes first; a feed that cannot be read, or has no entry, gives no rows."""
    e = feeds.select("row_id", F.explode(F.from_xml("text", ATOM, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})["entry"]).alias("w"))
    w = F.col("w")
    i = normalize_arxiv(F.element_at(F.split(F.trim(w["id"]), "/"), -1))
    terms = F.array_compact(F.concat(F.array(w["primary_category"]["_term"]), F.coalesce(F.transform(w["category"], lambda c: c["_term"]), F.array().cast("array<string>"))))
    pdf = F.try_element_at(F.filter(w["link"], lambda l: l["_title"] == "pdf"), F.lit(1))["_href"]
    d = parse_date(w["published"])
    return _record(
        e, "arxiv", external_id=i, doi=F.nullif(F.trim(w["doi"]), F.lit("")), arxiv_id=i, title=F.coalesce(F.nullif(F.trim(w["title"]), F.lit("")), F.lit("Untitled")), abstract=clean_abstract(w["summary"]),
        authors=F.transform(w["author"], lambda a: author(a["name"])), year=F.year(d), publication_date=d, venue=F.lit("arXiv"), fields_of_study=F.array_distinct(terms), is_open_access=F.lit(True), open_access_pdf=pdf,
    )


#: Where each database's pages keep their records.
LISTS = {"openalex": "$.results", "semantic_scholar": "$.data", "crossref": "$.message.items", "arxiv": "$.feed.entry"}
READERS = {"openalex": openalex, "semantic_scholar": semantic_scholar, "crossref": crossref, "arxiv": arxiv}


def page_records(pages: DataFrame) -> DataFrame:
    """Records of cached result pages (id, raw_response), whatever their database. A page's texts may be wrapped in a
    JSON string or start with a byte order mark; unreadable pages give no rows."""
    t = F.regexp_replace(F.trim(F.col("raw_response")), "^\\ufeff", "")
    t = F.when(t.startswith('"'), F.try_element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(1))).otherwise(t)
    base = pages.select(F.col("id").alias("row_id"), t.alias("t"))
    out = None
    for database, path in LISTS.items():
        items = F.get_json_object("t", path)
        texts = base.select("row_id", items.alias("x")).where("x is not null")
        x = F.when(F.col("x").startswith("["), F.from_json("x", "array<string>")).otherwise(F.array("x"))
        r = READERS[database](texts.select("row_id", F.explode(x).alias("text")))
        out = r if out is None else out.unionByName(r)
    return out


def read_papers(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """A parquet table with the model's schema: (valid records, quarantine)."""
    from litsieve.schema import PAPER, split_valid

    return split_valid(spark.read.schema(PAPER).parquet(path))


def read_effects(spark, path: str) -> DataFrame:
    """A CSV of effects; unreadable numbers are null and dropped later."""
    return spark.read.schema("study_id string, effect string, se string").option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_queries(spark, path: str) -> DataFrame:
    """Non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")
