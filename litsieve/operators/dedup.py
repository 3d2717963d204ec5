"""Deduplication in passes (DOI, arXiv id, similar titles of a year), canonical records, batch deduplication.

Order is the column ``ordinal``. Groups are judged by combining aggregates; duplicates of one ``paper_id`` are
collapsed first (the last copy stays)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.ids import normalize_arxiv, normalize_doi
from litsieve.functions.similarity import indel_ratio
from litsieve.functions.text import normalize_title
from litsieve.session import materialize, release, tidy

#: Least Indel ratio of two titles of one year that are taken for one work's.
FUZZY = 0.85


def latest_copies(papers: DataFrame) -> DataFrame:
    """One row per ``paper_id``: its last."""
    last = papers.groupBy("paper_id").agg(F.max("ordinal").alias("ordinal"))
    return papers.join(last, ["paper_id", "ordinal"], "left_semi")


def keyed(papers: DataFrame, raw_ids: bool = False) -> DataFrame:
    """Adds the keys of the passes: ``doi_n``, ``arxiv_n`` and ``title_n`` (null where they can't match)."""
    doi = F.nullif("doi", F.lit("")) if raw_ids else normalize_doi("doi")
    arxiv = normalize_arxiv("arxiv_id", keep_version=raw_ids)
    return papers.withColumns({"doi_n": doi, "arxiv_n": arxiv, "title_n": F.nullif(normalize_title("title"), F.lit(""))})


def _clusters(df: DataFrame, key: list[str], kind: str, confidence: float = 1.0) -> DataFrame:
    """(match_type, confidence, n, first ordinal) per key that two or more rows share."""
    return (
        df.groupBy(*key).agg(F.count("*").alias("n"), F.min("ordinal").alias("leader")).where("n > 1")
        .select(*key, F.lit(kind).alias("match_type"), F.lit(confidence).alias("confidence"), "n", "leader")
    )


def assignments(papers: DataFrame, raw_ids: bool = False, least: float = FUZZY) -> DataFrame:
    """(ordinal, paper_id, match_type, leader, confidence): the cluster of every record that is in one, by passes in order:
    DOI; arXiv id among the rest; titles of one year among the rest of those, equal or with an Indel ratio of at
    least ``least``. Of similar titles the earliest leads and absorbs later ones; a leader is absorbed by none, and
    records without title or year are in no title cluster."""
    p = materialize(keyed(latest_copies(papers), raw_ids).select("ordinal", "paper_id", "doi_n", "arxiv_n", "title_n", F.nullif("year", F.lit(0)).alias("year")), "keyed")
    out = None
    for key, kind in ((["doi_n"], "doi"), (["arxiv_n"], "arxiv")):
        usable = p.dropna(subset=key)
        hit = materialize(usable.join(_clusters(usable, key, kind), key).select("ordinal", "paper_id", "match_type", "leader", "confidence"), "hits")
        out = hit if out is None else out.unionByName(hit)
        p = p.join(hit.select("ordinal"), "ordinal", "left_anti")
    p = materialize(p.dropna(subset=["title_n", "year"]), "untitled")
    # records with one title are alike to all others, so titles stand for them, each with its first record
    titles = p.groupBy("year", "title_n").agg(F.min("ordinal").alias("first"), F.count("*").alias("n"))
    if least < 1:
        pairs = materialize(_similar(titles.withColumnRenamed("first", "ordinal"), least), "pairs")
        led = fuzzy_leaders(pairs).select(F.col("ordinal").alias("first"), "leader")
        ratio = pairs.select(F.col("ordinal_a").alias("leader"), F.col("ordinal_b").alias("first"), "ratio")
        titles = titles.join(led, "first", "left").join(ratio, ["leader", "first"], "left").withColumn("leader", F.coalesce("leader", "first"))
    else:
        titles = titles.withColumns({"leader": F.col("first"), "ratio": F.lit(None).cast("double")})
    size = titles.groupBy("leader").agg(F.sum("n").alias("size")).where("size > 1").select("leader")
    titles = titles.join(size, "leader").select("year", "title_n", "leader", F.when(F.col("ratio").isNull(), "title_exact").otherwise("title_fuzzy").alias("match_type"), F.coalesce("ratio", F.lit(1.0)).alias("confidence"))
    return out.unionByName(p.join(titles, ["year", "title_n"]).select("ordinal", "paper_id", "match_type", "leader", "confidence"))


def clusters_by(papers: DataFrame, kind: str) -> DataFrame:
    """One row per cluster of one pass: key, records, their ids in input order."""
    key = {"doi": "doi_n", "arxiv": "arxiv_n"}[kind]
    p = keyed(latest_copies(papers)).where(F.col(key).isNotNull())
    members = F.array_sort(F.collect_list(F.struct("ordinal", "paper_id")))
    g = p.groupBy(F.col(key).alias("cluster_key")).agg(F.count("*").alias("n"), members.alias("m")).where("n > 1")
    return g.select("cluster_key", "n", F.col("m")[0]["paper_id"].alias("first_id"), F.array_join(F.col("m.paper_id"), " ").alias("members"))


def completeness() -> Column:
    """Weighted count of filled fields."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    one = lambda ok, w: F.when(ok, w).otherwise(0.0)
    n_authors, n_fields = F.coalesce(F.size("authors"), F.lit(0)), F.coalesce(F.size("fields_of_study"), F.lit(0))
    return (
        one(has("doi"), 10.0) + one(has("arxiv_id"), 5.0) + one(has("abstract"), 5.0) + one(n_authors > 0, 2.0) + one(has("venue"), 2.0)
        + one(F.col("publication_date").isNotNull(), 1.0) + one(F.col("is_open_access") & has("open_access_pdf"), 3.0)
        + 0.5 * F.greatest(n_fields, F.lit(0)) + 0.5 * F.least(F.greatest(n_authors, F.lit(0)), F.lit(10))
    )


def canonical(papers: DataFrame, strategy: str = "best_completeness", least: float = FUZZY, found: DataFrame | None = None) -> DataFrame:
    """The deduplicated records: per cluster the canonical row with merged fields, and all rows in no cluster. ``found``:
    what ``assignments`` gave for these papers, where it is at hand.

    External ids are overlaid in input order; the PDF link is the canonical row's or else the first; fields of study
    are united and sorted; counts are the greatest. Ties go to the earlier row. Aggregates only: no list of a
    cluster's rows is built except of its distinct fields and ids."""
    p = latest_copies(papers).withColumn("score", {"best_completeness": completeness(), "most_citations": F.col("citation_count").cast("double")}.get(strategy, F.lit(0.0)))
    a = (assignments(papers, least=least) if found is None else found).select("ordinal", "leader", "match_type")
    p = p.join(a, "ordinal", "left").withColumn("leader", F.coalesce("leader", "ordinal"))
    pick = F.max(F.struct("score", (-F.col("ordinal")).alias("o")))
    pdf = F.nullif("open_access_pdf", F.lit(""))
    ids = p.select("leader", "ordinal", F.explode("external_ids")).groupBy("leader", "key").agg(F.max(F.struct("ordinal", "value")).alias("v"))
    ids = ids.groupBy("leader").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v.value")))).alias("all_ids"))
    g = p.groupBy("leader").agg(
        pick.alias("x"), F.count("*").alias("cluster_size"), F.max("match_type").alias("match_type"),
        F.min(F.when(pdf.isNotNull(), F.struct("ordinal", pdf.alias("pdf")))).alias("first_pdf"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields_of_study")))).alias("fields"),
        F.max("citation_count").alias("citations"), F.max("influential_citation_count").alias("influential"),
    ).select("*", (-F.col("x.o")).alias("ordinal"))
    best = p.drop("leader", "match_type").join(g.drop("x"), "ordinal").join(ids, "leader", "left")
    return best.withColumns(
        {
            "open_access_pdf": F.coalesce(pdf, F.col("first_pdf.pdf")), "citation_count": F.col("citations"), "influential_citation_count": F.col("influential"),
            "fields_of_study": F.when(F.col("cluster_size") > 1, F.col("fields")).otherwise(F.col("fields_of_study")),
            "external_ids": F.coalesce("all_ids", "external_ids"),
        }
    ).drop("first_pdf", "fields", "citations", "influential", "all_ids", "score")


def canonical_map(papers: DataFrame, least: float = FUZZY, found: DataFrame | None = None) -> DataFrame:
    """(paper_id, canonical_id) of every record: the id of its cluster's canonical record, or its own. ``found``: as for
    ``canonical``."""
    last = latest_copies(papers).where("paper_id is not null")
    a = materialize(assignments(papers, least=least), "assigned") if found is None else found
    best = canonical(papers, least=least, found=a).where("cluster_size > 1").select("leader", F.col("paper_id").alias("best"))
    x = last.select("ordinal", "paper_id").join(a.select("ordinal", "leader"), "ordinal", "left").join(best, "leader", "left")
    return x.select("paper_id", F.coalesce("best", "paper_id").alias("canonical_id"))


def batch_first_seen(papers: DataFrame) -> DataFrame:
    """First seen by lower-cased DOI, then among those kept by trimmed lower-cased title. A row that its DOI drops
    never registers its title."""
    doi = F.nullif(F.lower("doi"), F.lit(""))
    p = papers.withColumn("doi_l", doi)
    first = p.where("doi_l is not null").groupBy("doi_l").agg(F.min("ordinal").alias("ordinal"))
    kept = p.where("doi_l is null").unionByName(p.join(first, ["doi_l", "ordinal"], "left_semi"), allowMissingColumns=True)
    kept = kept.withColumn("title_l", F.nullif(F.lower(F.trim("title")), F.lit("")))
    by_title = kept.where("title_l is not null").groupBy("title_l").agg(F.min("ordinal").alias("ordinal"))
    return kept.where("title_l is null").unionByName(kept.join(by_title, ["title_l", "ordinal"], "left_semi"), allowMissingColumns=True).drop("doi_l", "title_l")


def summary(papers: DataFrame, least: float = FUZZY) -> DataFrame:
    """Records before and after, removed, rate in percent, clusters."""
    last = latest_copies(papers)
    a = assignments(papers, least=least)
    n = last.agg(F.count("*").alias("before"))
    c = a.agg(F.count("*").alias("clustered"), F.count_distinct("leader").alias("clusters"))
    removed = F.col("clustered") - F.col("clusters")
    return n.crossJoin(c).select("before", (F.col("before") - removed).alias("after"), removed.alias("removed"), F.round(100.0 * removed / F.nullif("before", F.lit(0)), 4).alias("rate"), "clusters")


#: Titles in one tile of the fuzzy pass.
TILE = 1500


def _tile(least: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if len(a) and not len(b):
            b = a
        same = b is a
        codes = {c: k for k, c in enumerate(sorted({c for t in pdf["title_n"] for c in t}))}

        def histogram(ts):
            h = np.zeros((len(ts), len(codes)), np.int16)
            for i, t in enumerate(ts):
                np.add.at(h[i], [codes[c] for c in t], 1)
            return h

        ta, tb = a["title_n"].tolist(), b["title_n"].tolist()
        ha, hb = histogram(ta), histogram(tb) if not same else None
        hb = ha if same else hb
        la, lb = ha.sum(1), hb.sum(1)
        oa, ob = a["ordinal"].tolist(), b["ordinal"].tolist()
        for i, t in enumerate(ta):
            lo = i + 1 if same else 0
            most = (1 - least) * (la[i] + lb[lo:]) + 1e-9
            # letters that only one of the titles has can't be matched
            near = np.flatnonzero(np.abs(hb[lo:] - ha[i]).sum(1) <= most) + lo
            for j in near:
                r = indel_ratio(t, tb[j])
                if r >= least:
                    out.append((min(oa[i], ob[j]), max(oa[i], ob[j]), r))
        return pd.DataFrame(out, columns=["ordinal_a", "ordinal_b", "ratio"])

    return compare


def _similar(titles: DataFrame, least: float) -> DataFrame:
    """(ordinal_a, ordinal_b, ratio) of distinct titles (year, title_n, ordinal) of one year with an Indel ratio of at
    least ``least``. Exact: a year's titles are cut into tiles of bounded size and every pair of tiles is one
    group, in which letter counts rule out most pairs before they're compared."""
    n = titles.groupBy("year").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    p = titles.join(F.broadcast(n), "year").withColumn("tile", F.pmod(F.xxhash64("title_n"), F.col("tiles")).cast("int"))  # a row per year
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j"), (F.col("tile") > k).cast("int").alias("side")))
    p = p.select("year", "ordinal", "title_n", F.explode(others).alias("x")).select("year", "x.i", "x.j", "x.side", "ordinal", "title_n")
    return p.groupBy("year", "i", "j").applyInPandas(_tile(least), "ordinal_a bigint, ordinal_b bigint, ratio double")


def fuzzy_title_pairs(papers: DataFrame, least: float = FUZZY) -> DataFrame:
    """(ordinal_a, ordinal_b, ratio): pairs of different normalised titles of one year with an Indel ratio of at
    least ``least``, between the first records of each title."""
    p = latest_copies(papers).select("ordinal", "year", F.nullif(normalize_title("title"), F.lit("")).alias("title_n")).dropna()
    return _similar(p.groupBy("year", "title_n").agg(F.min("ordinal").alias("ordinal")), least)


def fuzzy_leaders(pairs: DataFrame) -> DataFrame:
    """(ordinal, leader) by the sequential rule: an earlier leader that is similar absorbs a record, the earliest one
    first. Found in rounds: a record all of whose earlier neighbours are absorbed leads; one with a leader among
    them is absorbed; each round decides the earliest open record at least, so the rounds end."""
    links = materialize(pairs.select(F.col("ordinal_a").alias("a"), F.col("ordinal_b").alias("b")), "links")
    state = materialize(links.select(F.col("a").alias("v")).union(links.select("b")).distinct().withColumn("leads", F.lit(None).cast("boolean")), "state")
    while not state.where("leads is null").isEmpty():
        before = links.join(state.select(F.col("v").alias("a"), "leads"), "a").groupBy(F.col("b").alias("v")).agg(F.coalesce(F.max("leads"), F.lit(False)).alias("led"), F.count_if(F.col("leads").isNull()).alias("open"))
        x = state.join(before, "v", "left")
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        old, state = state, materialize(x.select("v", leads.alias("leads")), "state")
        release(old)
        tidy(pairs.sparkSession)
    first = links.join(state.where("leads").select(F.col("v").alias("a")), "a").groupBy(F.col("b").alias("v")).agg(F.min("a").alias("a"))
    return state.join(first, "v", "left").select(F.col("v").alias("ordinal"), F.when(F.col("leads"), F.col("v")).otherwise(F.col("a")).alias("leader"))


def duplicate_report(papers: DataFrame) -> DataFrame:
    """Values of DOI and arXiv id that several records have, as typed."""
    parts = [papers.where(F.length(c) > 0).groupBy(F.lit(c).alias("field"), F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1") for c in ("doi", "arxiv_id")]
    return parts[0].unionByName(parts[1])
