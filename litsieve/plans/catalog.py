"""Query name -> (Spark query, SQL). The SQL states the same result for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions import ids, text
from litsieve.functions.similarity import cosine
from litsieve.operators import bibtex, dedup, extraction, graph, meta, nested, reports, screening, searches, selection
from litsieve.operators import screening as sc
from litsieve.session import materialize, table, tidy
from litsieve.sources import ingest
from litsieve.streaming import living

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, fn: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, d: fn(*(table(spark, d, t) for t in tables))
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- shared SQL fragments -------------------------------------------------------------------------------------------
def _doi(c: str) -> str:
    x = f"trim(lower({c}))"
    for p in ids.DOI_PREFIXES:
        x = f"regexp_replace({x}, '^{p.replace('.', chr(92) + '.')}', '')"
    return f"nullif(trim({x}), '')"


def _arxiv(c: str, keep: bool = False) -> str:
    x = f"regexp_replace(trim({c}), '(?i)^arxiv:', '')"
    return f"nullif(trim({x if keep else f"regexp_replace({x}, 'v[0-9]+$', '')"}), '')"


def _title(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


_LAST = "last_copies AS (SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ordinal DESC) = 1)"
_KEYED = f"keyed AS (SELECT *, {_doi('doi')} AS doi_n, {_arxiv('arxiv_id')} AS arxiv_n, nullif({_title('title')}, '') AS title_n FROM last_copies)"
_ASSIGNED = f"""{_LAST}, {_KEYED},
 a AS (SELECT ordinal, paper_id, 'doi' AS match_type, min(ordinal) OVER (PARTITION BY doi_n) AS leader, count(*) OVER (PARTITION BY doi_n) AS n FROM keyed WHERE doi_n IS NOT NULL),
 a1 AS (SELECT * FROM a WHERE n > 1), k1 AS (SELECT * FROM keyed WHERE ordinal NOT IN (SELECT ordinal FROM a1)),
 b AS (SELECT ordinal, paper_id, 'arxiv' AS match_type, min(ordinal) OVER (PARTITION BY arxiv_n) AS leader, count(*) OVER (PARTITION BY arxiv_n) AS n FROM k1 WHERE arxiv_n IS NOT NULL),
 b1 AS (SELECT * FROM b WHERE n > 1), k2 AS (SELECT * FROM k1 WHERE ordinal NOT IN (SELECT ordinal FROM b1)),
 c AS (SELECT ordinal, paper_id, 'title_exact' AS match_type, min(ordinal) OVER (PARTITION BY title_n, year) AS leader, count(*) OVER (PARTITION BY title_n, year) AS n FROM k2 WHERE title_n IS NOT NULL AND year IS NOT NULL),
 c1 AS (SELECT * FROM c WHERE n > 1),
 assigned AS (SELECT ordinal, paper_id, match_type, leader, 1.0::DOUBLE AS confidence FROM a1 UNION ALL SELECT ordinal, paper_id, match_type, leader, 1.0 FROM b1 UNION ALL SELECT ordinal, paper_id, match_type, leader, 1.0 FROM c1)"""
_INDEX = f"idx AS (SELECT {_doi('doi')} AS k, arg_max(paper_id, ordinal) AS resolved FROM papers WHERE {_doi('doi')} IS NOT NULL GROUP BY 1)"
_RESOLVED = f"{_INDEX}, r AS (SELECT e.citing_paper_id, coalesce(nullif(e.cited_paper_id, ''), idx.resolved) AS cited_paper_id, e.cited_doi, e.source FROM citation_edges e LEFT JOIN idx ON {_doi('e.cited_doi')} = idx.k)"
_GRAPH = f"""{_RESOLVED},
 links AS (SELECT citing_paper_id AS src, cited_paper_id AS dst, count(*) AS weight FROM r WHERE citing_paper_id IS NOT NULL AND cited_paper_id IS NOT NULL AND citing_paper_id <> cited_paper_id GROUP BY 1, 2),
 nodes AS (SELECT paper_id AS id FROM papers WHERE paper_id IS NOT NULL UNION SELECT src FROM links UNION SELECT dst FROM links)"""

# --- normalisation --------------------------------------------------------------------------------------------------
_add("normalize_titles", lambda p: p.select("ordinal", text.normalize_title("title").alias("title_n"), text.title_hash("title").alias("title_hash")), "papers",
     sql=f"SELECT ordinal, {_title('title')} AS title_n, md5({_title('title')}) AS title_hash FROM papers")
_add("normalize_ids", lambda p: p.select("ordinal", ids.normalize_doi("doi").alias("doi_n"), ids.normalize_arxiv("arxiv_id").alias("arxiv_n"), ids.normalize_arxiv("arxiv_id", True).alias("arxiv_v")), "papers",
     sql=f"SELECT ordinal, {_doi('doi')} AS doi_n, {_arxiv('arxiv_id')} AS arxiv_n, {_arxiv('arxiv_id', True)} AS arxiv_v FROM papers")
_CLEAN = "nullif(trim(regexp_replace(abstract, '[\\s\\p{Z}]+', ' ', 'g')), '')"
_add("clean_abstracts", lambda p: p.select("ordinal", text.clean_abstract("abstract", 500).alias("abstract")), "papers",
     sql=f"SELECT ordinal, CASE WHEN length({_CLEAN}) > 500 THEN substr({_CLEAN}, 1, 500) || '...' ELSE {_CLEAN} END AS abstract FROM papers")


def _sql_date(c: str) -> str:
    duck = {"yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d", "dd-MM-yyyy": "%d-%m-%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyy-MM": "%Y-%m", "yyyy": "%Y"}
    parts = []
    for pattern, fmt, n in text.DATE_SHAPES:
        d = f"CAST(try_strptime(substr(trim({c}), 1, {n}), '{duck[fmt]}') AS DATE)"
        parts.append(f"CASE WHEN regexp_matches(trim({c}), '{pattern}') AND year({d}) BETWEEN 1900 AND 2100 THEN {d} END")
    return f"coalesce({', '.join(parts)})"


_add("parse_dates", lambda p: p.select("ordinal", text.parse_date(F.col("source.timestamp")).cast("string").alias("day")), "papers",
     sql=f"SELECT ordinal, CAST({_sql_date('source.timestamp')} AS VARCHAR) AS day FROM papers")
_add("title_sentences", lambda p: p.select("ordinal", F.size(text.sentences("abstract")).cast("bigint").alias("n")).where("n >= 0"), "papers",
     sql="SELECT ordinal, CAST(len(list_filter(string_split(abstract, '.'), lambda x: length(trim(x)) > 20)) AS BIGINT) AS n FROM papers WHERE abstract IS NOT NULL")

# --- deduplication --------------------------------------------------------------------------------------------------
for _kind, _key in (("doi", _doi("doi")), ("arxiv", _arxiv("arxiv_id"))):
    _add(f"{_kind}_clusters", lambda p, k=_kind: dedup.clusters_by(p, k), "papers",
         sql=f"WITH {_LAST}, {_KEYED} SELECT {_kind}_n AS cluster_key, count(*) AS n, arg_min(paper_id, ordinal) AS first_id, string_agg(paper_id, ' ' ORDER BY ordinal) AS members FROM keyed WHERE {_kind}_n IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
# SQL has no Indel ratio; with equal titles only it states the same
_EXACT = {"least": 1.0}
_add("dedup_assignments", dedup.assignments, "papers")
_add("dedup_assignments_exact", lambda p: dedup.assignments(p, **_EXACT), "papers", sql=f"WITH {_ASSIGNED} SELECT * FROM assigned")
_SCORE = """(CASE WHEN length(doi) > 0 THEN 10.0 ELSE 0.0 END + CASE WHEN length(arxiv_id) > 0 THEN 5.0 ELSE 0.0 END + CASE WHEN length(abstract) > 0 THEN 5.0 ELSE 0.0 END
 + CASE WHEN len(authors) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN length(venue) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN publication_date IS NOT NULL THEN 1.0 ELSE 0.0 END
 + CASE WHEN is_open_access AND length(open_access_pdf) > 0 THEN 3.0 ELSE 0.0 END + 0.5 * coalesce(len(fields_of_study), 0) + 0.5 * least(coalesce(len(authors), 0), 10))::DOUBLE"""
_add("completeness_scores", lambda p: p.select("ordinal", dedup.completeness().alias("score")), "papers", sql=f"SELECT ordinal, {_SCORE} AS score FROM papers")
_CANON = f"""WITH {_ASSIGNED},
 x AS (SELECT l.*, coalesce(s.leader, l.ordinal) AS leader, {_SCORE} AS score FROM last_copies l LEFT JOIN assigned s USING (ordinal)),
 y AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY score DESC, ordinal) AS rn, count(*) OVER (PARTITION BY leader) AS cluster_size,
   max(citation_count) OVER (PARTITION BY leader) AS cites, max(influential_citation_count) OVER (PARTITION BY leader) AS infl FROM x),
 pdfs AS (SELECT leader, arg_min(open_access_pdf, ordinal) AS pdf FROM x WHERE nullif(open_access_pdf, '') IS NOT NULL GROUP BY 1),
 fields AS (SELECT leader, list_sort(list_distinct(flatten(list(fields_of_study)))) AS f FROM x GROUP BY 1)
SELECT y.ordinal, paper_id, title, y.cluster_size, cites AS citation_count, infl AS influential_citation_count, coalesce(nullif(open_access_pdf, ''), pdf) AS open_access_pdf,
 array_to_string(CASE WHEN y.cluster_size > 1 THEN f ELSE fields_of_study END, '; ') AS fields FROM y LEFT JOIN pdfs USING (leader) LEFT JOIN fields USING (leader) WHERE rn = 1"""


def _canonical(p: DataFrame, **how: float) -> DataFrame:
    x = dedup.canonical(p, **how)
    return x.select("ordinal", "paper_id", "title", "cluster_size", "citation_count", "influential_citation_count", "open_access_pdf", F.array_join("fields_of_study", "; ").alias("fields"))


def _external(p: DataFrame, **how: float) -> DataFrame:
    return dedup.canonical(p, **how).select("ordinal", F.explode("external_ids").alias("id_type", "id_value"))


_IDS = """,
 e AS (SELECT leader, ordinal, unnest(map_entries(external_ids)) AS kv FROM x), o AS (SELECT leader, kv.key AS id_type, arg_max(kv.value, ordinal) AS id_value FROM e GROUP BY 1, 2)
SELECT y.ordinal, id_type, id_value FROM y JOIN o USING (leader) WHERE rn = 1"""
_add("dedup_canonical", _canonical, "papers")
_add("dedup_canonical_exact", lambda p: _canonical(p, **_EXACT), "papers", sql=_CANON)
_add("canonical_external_ids", _external, "papers")
_add("canonical_external_ids_exact", lambda p: _external(p, **_EXACT), "papers", sql=_CANON[: _CANON.index("\nSELECT y.ordinal")] + _IDS)
_add("canonical_map", dedup.canonical_map, "papers")
_add("canonical_map_exact", lambda p: dedup.canonical_map(p, **_EXACT), "papers",
     sql=_CANON[: _CANON.index("\nSELECT y.ordinal")] + "\nSELECT x.paper_id, y.paper_id AS canonical_id FROM x JOIN y ON x.leader = y.leader AND rn = 1 WHERE x.paper_id IS NOT NULL")
_add("batch_dedup", lambda p: dedup.batch_first_seen(p).select("ordinal", "paper_id"), "papers",
     sql="""WITH a AS (SELECT *, nullif(lower(doi), '') AS d FROM papers), b AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ordinal) AS rd FROM a),
 k AS (SELECT *, nullif(lower(trim(title)), '') AS t FROM b WHERE d IS NULL OR rd = 1), m AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ordinal) AS rt FROM k) SELECT ordinal, paper_id FROM m WHERE t IS NULL OR rt = 1""")
_add("dedup_summary", dedup.summary, "papers")
_add("dedup_summary_exact", lambda p: dedup.summary(p, **_EXACT), "papers",
     sql=f"WITH {_ASSIGNED}, n AS (SELECT count(*) AS before FROM last_copies), q AS (SELECT count(*) - count(DISTINCT leader) AS removed, count(DISTINCT leader) AS clusters FROM assigned) SELECT before, before - removed AS after, removed, round(100.0 * removed / nullif(before, 0), 4) AS rate, clusters FROM n, q")
_add("duplicate_report", dedup.duplicate_report, "papers",
     sql="SELECT 'doi' AS field, doi AS value, count(*) AS n FROM papers WHERE length(doi) > 0 GROUP BY doi HAVING count(*) > 1 UNION ALL SELECT 'arxiv_id', arxiv_id, count(*) FROM papers WHERE length(arxiv_id) > 0 GROUP BY arxiv_id HAVING count(*) > 1")
_add("latest_copies", lambda p: dedup.latest_copies(p).select("ordinal", "paper_id"), "papers", sql=f"WITH {_LAST} SELECT ordinal, paper_id FROM last_copies")
_add("fuzzy_title_pairs", dedup.fuzzy_title_pairs, "papers")
_add("fuzzy_title_leaders", lambda p: dedup.fuzzy_leaders(dedup.fuzzy_title_pairs(p)), "papers")

# --- reports --------------------------------------------------------------------------------------------------------
_add("papers_by_source", reports.by_source, "papers", sql="SELECT source.database AS database, count(*) AS papers FROM papers GROUP BY 1")
_F = lambda c: f"coalesce(length(trim({c})) > 0, false)"
_add("corpus_stats", reports.corpus_stats, "papers",
     sql=f"SELECT count(*) AS total, count(*) FILTER ({_F('doi')}) AS with_doi, count(*) FILTER ({_F('abstract')}) AS with_abstract, count(*) FILTER (is_open_access) AS open_access, min(year)::BIGINT AS first_year, max(year)::BIGINT AS last_year, sum(citation_count)::BIGINT AS citations FROM papers")
_MISS = {"title": f"NOT {_F('title')} OR lower(trim(title)) = 'untitled'", "authors": "coalesce(len(authors), 0) = 0", "abstract": f"NOT {_F('abstract')}", "year": "year IS NULL", "identifier": f"NOT {_F('doi')} AND NOT {_F('arxiv_id')}"}
_add("completeness_profile", reports.completeness_profile, "papers",
     sql=" UNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER ({m}) AS missing, round(100.0 * count(*) FILTER ({m}) / greatest(count(*), 1), 4) AS percent FROM papers" for k, m in _MISS.items()))
_add("identifier_issues", reports.identifier_issues, "papers",
     sql="SELECT ordinal, 'doi' AS field, doi AS value FROM papers WHERE nullif(doi, '') IS NOT NULL AND NOT starts_with(doi, '10.') UNION ALL SELECT ordinal, 'arxiv_id', arxiv_id FROM papers WHERE nullif(arxiv_id, '') IS NOT NULL AND NOT regexp_matches(arxiv_id, '^[0-9]{4}\\.[0-9]{4,5}$')")
_add("date_issues", lambda p: reports.date_issues(p, 2024), "papers", sql="SELECT count(*) FILTER (year IS NULL) AS missing, count(*) FILTER (year > 2025) AS future, count(*) FILTER (year < 1900) AS ancient FROM papers")
_add("papers_by_year", reports.coverage_by_year, "papers", sql="SELECT year, count(*) AS papers, round(avg(citation_count), 6) AS mean_citations, count(*) FILTER (is_open_access) AS open_access FROM papers GROUP BY 1")
_add("date_range", lambda p: reports.date_range(p, "2020-01-01", "2023-12-31"), "papers", sql="SELECT ordinal, CAST(publication_date AS VARCHAR) AS publication_date FROM papers WHERE publication_date IS NULL OR publication_date BETWEEN DATE '2020-01-01' AND DATE '2023-12-31'")
_add("results_page", lambda p: reports.page(p, 3, 50), "papers", sql="SELECT ordinal, paper_id, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM papers) AS total_pages FROM papers ORDER BY ordinal LIMIT 50 OFFSET 100")
_add("top_cited", reports.top_cited, "papers", sql="SELECT ordinal, paper_id, citation_count FROM papers ORDER BY citation_count DESC NULLS LAST, ordinal LIMIT 20")
_add("valid_records", lambda p: p.select("ordinal", __import__("litsieve.schema", fromlist=["valid"]).valid().alias("is_valid")), "papers",
     sql="SELECT ordinal, coalesce(paper_id IS NOT NULL AND title IS NOT NULL AND source IS NOT NULL AND (year IS NULL OR year BETWEEN 1900 AND 2100) AND coalesce(citation_count, 0) >= 0 AND coalesce(influential_citation_count, 0) >= 0 AND coalesce(reference_count, 0) >= 0, false) AS is_valid FROM papers")
_add("references_per_paper", lambda e: reports.first_per_key(e.where("citing_paper_id is not null").select("citing_paper_id", "cited_doi", "cited_paper_id", "cited_title", "retrieved_at").distinct(), ["citing_paper_id"], ["retrieved_at", "cited_doi", "cited_paper_id", "cited_title"], 3).select("citing_paper_id", "cited_doi", "cited_paper_id", "place"), "citation_edges",
     sql="SELECT citing_paper_id, cited_doi, cited_paper_id, row_number() OVER (PARTITION BY citing_paper_id ORDER BY retrieved_at NULLS FIRST, cited_doi NULLS FIRST, cited_paper_id NULLS FIRST, cited_title NULLS FIRST) AS place FROM (SELECT DISTINCT citing_paper_id, cited_doi, cited_paper_id, cited_title, retrieved_at FROM citation_edges WHERE citing_paper_id IS NOT NULL) QUALIFY place <= 3")
_add("recent_searches", reports.recent_queries, "search_queries", sql="SELECT query_id, source, query_text, created_at FROM search_queries ORDER BY created_at DESC, query_id LIMIT 50")
_add("search_ids", lambda s: s.select("query_id", reports.query_id("source", "query_text", "start_date", "end_date").alias("made_id")), "search_queries",
     sql="SELECT query_id, substr(sha256(concat_ws('|', coalesce(source, ''), coalesce(query_text, ''), coalesce(start_date, ''), coalesce(end_date, ''))), 1, 16) AS made_id FROM search_queries")
_add("cached_pages_per_search", lambda c, s: s.join(c.groupBy("query_id").agg(F.count("*").alias("pages"), F.sum("paper_count").alias("papers")), "query_id", "left").select("query_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("papers", F.lit(0)).alias("papers"), "completed"), "cached_pages", "search_queries",
     sql="SELECT s.query_id, coalesce(pages, 0) AS pages, coalesce(papers, 0)::BIGINT AS papers, completed FROM search_queries s LEFT JOIN (SELECT query_id, count(*) AS pages, sum(paper_count) AS papers FROM cached_pages GROUP BY 1) c USING (query_id)")
_add("simplified_rows", reports.simplified, "papers",
     sql="SELECT ordinal, title, coalesce(array_to_string(list_transform(authors, lambda a: a.name), '; '), '') AS authors, year, CASE WHEN length(abstract) > 200 THEN substr(abstract, 1, 200) || '...' ELSE coalesce(abstract, '') END AS abstract FROM papers")
_add("round_robin", reports.round_robin, "papers", "workspace_users",
     sql="WITH r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM workspace_users), p AS (SELECT ordinal, paper_id, row_number() OVER (ORDER BY ordinal) - 1 AS k FROM papers) SELECT ordinal, paper_id, user_id FROM p JOIN r ON k % n = i")
_add("dual_review", reports.dual_review, "papers", "workspace_users", sql="SELECT ordinal, paper_id, user_id FROM papers, (SELECT user_id FROM workspace_users ORDER BY user_id LIMIT 2)")


def _reviews(c: DataFrame) -> DataFrame:
    # in the order of resolution, open ones last; the first reviewer of a row before the second
    when = F.coalesce(F.unix_micros(F.col("resolved_at").cast("timestamp")), F.lit(1 << 60)) * 2

    def one(i: int) -> Column:
        decision = F.nullif(F.lower(F.trim(f"reviewer{i}_decision")), F.lit(""))
        return F.struct(F.col(f"reviewer{i}_id").alias("reviewer"), decision.alias("decision"), (when + (i - 1)).alias("place"))

    return c.select("paper_id", F.explode(F.array(one(1), one(2))).alias("x")).select("paper_id", "x.reviewer", "x.decision", "x.place").where("decision is not null")


_REVIEWS = "v AS (" + " UNION ALL ".join(
    f"SELECT paper_id, reviewer{i}_id AS reviewer, nullif(lower(trim(reviewer{i}_decision)), '') AS decision, coalesce(epoch_us(resolved_at), {1 << 60}) * 2 + {i - 1} AS place FROM conflict_resolutions"
    for i in (1, 2)
) + ")"
_add("review_conflicts", lambda c: reports.conflicts(_reviews(c)), "conflict_resolutions",
     sql=f"""WITH {_REVIEWS}, w AS (SELECT * FROM v WHERE decision IS NOT NULL), f AS (SELECT paper_id, reviewer, min(place) AS place FROM w GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY place, reviewer) AS k FROM f),
 g AS (SELECT paper_id, count(*) AS reviews, count(DISTINCT decision) AS decisions FROM w GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT decision) > 1)
SELECT g.*, a.reviewer AS reviewer_1, b.reviewer AS reviewer_2 FROM g LEFT JOIN o a ON g.paper_id = a.paper_id AND a.k = 1 LEFT JOIN o b ON g.paper_id = b.paper_id AND b.k = 2""")
_add("decision_counts", lambda c: _reviews(c).groupBy("decision").agg(F.count("*").alias("n")), "conflict_resolutions", sql=f"WITH {_REVIEWS} SELECT decision, count(*) AS n FROM v WHERE decision IS NOT NULL GROUP BY 1")

# --- graph ----------------------------------------------------------------------------------------------------------
_add("citation_resolve", lambda e, p: graph.resolve(e, p).select("citing_paper_id", "cited_paper_id", "cited_doi", "source"), "citation_edges", "papers", sql=f"WITH {_RESOLVED} SELECT citing_paper_id, cited_paper_id, cited_doi, source FROM r")
_add("citation_stats", graph.citation_stats, "citation_edges", "papers",
     sql=f"WITH {_RESOLVED}, k AS (SELECT DISTINCT paper_id FROM papers) SELECT count(*) AS total, count(k.paper_id) AS in_corpus, count(*) - count(k.paper_id) AS external, count(DISTINCT k.paper_id) AS cited_papers FROM r LEFT JOIN k ON r.cited_paper_id = k.paper_id")
_add("citation_links", lambda e, p: graph.graph(e, p)[1], "citation_edges", "papers", sql=f"WITH {_GRAPH} SELECT src, dst, weight FROM links")
_add("in_degree", lambda e, p: graph.in_degree(graph.graph(e, p)[1]), "citation_edges", "papers", sql=f'WITH {_GRAPH} SELECT dst AS id, count(*) AS in_degree, sum(weight)::BIGINT AS "references" FROM links GROUP BY 1')
_add("graph_stats", lambda e, p: graph.graph_stats(*graph.graph(e, p)), "citation_edges", "papers",
     sql=f"WITH {_GRAPH}, n AS (SELECT count(*) AS nodes FROM nodes), m AS (SELECT count(*) AS edges FROM links), i AS (SELECT count(*) AS isolated FROM nodes WHERE id NOT IN (SELECT src FROM links UNION SELECT dst FROM links)) SELECT nodes, edges, round(edges::DOUBLE / nullif(nodes::DOUBLE * (nodes::DOUBLE - 1), 0), 12) AS density, round(edges::DOUBLE / nullif(nodes, 0), 8) AS avg_degree, round(isolated::DOUBLE / nullif(nodes, 0), 8) AS isolated_share FROM n, m, i")
_W = graph.WEIGHTS
_NORM = lambda c: f"coalesce(({c} - min({c}) OVER ()) / nullif((max({c}) OVER () - min({c}) OVER ())::DOUBLE, 0), 0)"
_add("influence_simple", lambda e, p: graph.simple_influence(e, p).select("paper_id", F.round("influence_score", 6).alias("influence_score")), "citation_edges", "papers",
     sql=f"""WITH {_GRAPH}, d AS (SELECT dst, count(*) AS deg, sum(weight) AS refs FROM links GROUP BY 1), t AS (SELECT sum(weight) AS all_w FROM links),
 c AS (SELECT paper_id, coalesce(arg_max(citation_count, ordinal), 0) AS cc FROM papers GROUP BY 1),
 m AS (SELECT paper_id, ln(1 + cc) AS cit, coalesce(refs / nullif(all_w, 0)::DOUBLE, 0) AS pr, coalesce(refs, 0)::DOUBLE AS deg FROM c LEFT JOIN d ON c.paper_id = d.dst, t)
SELECT paper_id, round({_W['pagerank']} * {_NORM('pr')} + {_W['in_degree']} * {_NORM('deg')} + {_W['citations']} * {_NORM('cit')}, 6) AS influence_score FROM m""")
_add("pagerank", lambda e, p: graph.pagerank(*graph.graph(e, p)).select("id", F.round("pagerank", 12).alias("pagerank")), "citation_edges", "papers")
_add("betweenness", lambda e, p: graph.betweenness(*graph.graph(e, p)), "citation_edges", "papers")


def _influence(e: DataFrame, p: DataFrame) -> DataFrame:
    """References to and from a duplicate count for its canonical record. Duplicates are looked for once."""
    found = materialize(dedup.assignments(p), "assigned")
    tidy(p.sparkSession)
    return graph.full_influence(graph.mapped(e, p, dedup.canonical_map(p, found=found)), dedup.canonical(p, found=found))


_add("influence_ranked", lambda e, p: _influence(e, p).select("rank", "paper_id", "citation_count", "in_degree", "pagerank", "influence_score"), "citation_edges", "papers")

# --- meta-analysis: discounts per supplier as effects -----------------------------------------------------------------
_EFFECTS = "e AS (SELECT CAST(l_suppkey AS VARCHAR) AS study_id, avg(l_discount) AS effect, stddev_samp(l_discount) / sqrt(count(*)) AS se FROM lineitem GROUP BY l_suppkey), o AS (SELECT *, 1 / (se * se) AS w FROM e WHERE se > 0)"


def _effects(l: DataFrame) -> DataFrame:
    return l.groupBy(F.col("l_suppkey").cast("string").alias("study_id")).agg(F.avg("l_discount").alias("effect"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("se"))


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_add("meta_effects", lambda l: _r(meta.effect_rows(_effects(l)), 4), "lineitem", sql=f"WITH {_EFFECTS} SELECT study_id, round(effect, 4) AS effect, round(se, 4) AS se, round(effect - 1.96 * se, 4) AS ci_lower, round(effect + 1.96 * se, 4) AS ci_upper, round(CASE WHEN se > 0 THEN 1 / (se * se) ELSE 0 END, 4) AS weight FROM e")
_POOL = "SELECT count(*) AS k, round(sum(w * effect) / sum(w), 6) AS effect, round(sqrt(1 / sum(w)), 6) AS se, round(sum(w * effect) / sum(w) - 1.96 * sqrt(1 / sum(w)), 6) AS ci_lower, round(sum(w * effect) / sum(w) + 1.96 * sqrt(1 / sum(w)), 6) AS ci_upper, round(sum(w * effect) / sum(w) / sqrt(1 / sum(w)), 4) AS z FROM"
_TAU = "m AS (SELECT sum(w * effect) / sum(w) AS mu, sum(w) AS sw, sum(w * w) AS sww, count(*) AS k FROM o), q AS (SELECT sum(w * (effect - mu) ** 2) AS q, any_value(k) - 1 AS df, any_value(sw - sww / sw) AS c FROM o, m), t AS (SELECT q, df, CASE WHEN c > 0 THEN greatest(0, (q - df) / c) ELSE 0 END AS tau2 FROM q)"
for _m, _sql in (("fixed", f"WITH {_EFFECTS} {_POOL} o"), ("random", f"WITH {_EFFECTS}, {_TAU}, s AS (SELECT effect, 1 / (se * se + tau2) AS w FROM o, t) {_POOL} s")):
    _add(f"meta_{_m}", lambda l, m=_m: _r(meta.pooled(_effects(l), m).drop("p_value")).withColumn("z", F.round("z", 4)), "lineitem", sql=_sql)
_I2 = "CASE WHEN q > 0 THEN greatest(0, 100 * (q - df) / q) ELSE 0 END"
_add("heterogeneity", lambda l: _r(meta.heterogeneity(_effects(l)).drop("p_value"), 4), "lineitem",
     sql=f"WITH {_EFFECTS}, {_TAU} SELECT round(q, 4) AS q, df, round({_I2}, 4) AS i2, round(tau2, 4) AS tau2, CASE WHEN {_I2} < 25 THEN 'low' WHEN {_I2} < 50 THEN 'moderate' WHEN {_I2} < 75 THEN 'substantial' ELSE 'considerable' END AS band FROM t")
_add("asymmetry", lambda l: _r(meta.asymmetry(_effects(l)).select("k", "slope", "intercept"), 6), "lineitem", sql=f"WITH {_EFFECTS} SELECT count(*) AS k, round(regr_slope(effect, 1 / se), 6) AS slope, round(regr_intercept(effect, 1 / se), 6) AS intercept FROM o")
_add("meta_p_values", lambda l: meta.pooled(_effects(l)).select("z", "p_value").crossJoin(meta.heterogeneity(_effects(l)).select(F.col("p_value").alias("p_heterogeneity"))).crossJoin(meta.asymmetry(_effects(l), True).select(F.col("p_value").alias("p_asymmetry"), "biased")), "lineitem")
_add("forest_table", lambda l: meta.forest(_effects(l)).select("study_id", F.round("effect", 4).alias("effect"), F.round("ci_lower", 4).alias("ci_lower"), F.round("ci_upper", 4).alias("ci_upper")), "lineitem",
     sql=f"WITH {_EFFECTS} SELECT study_id, round(effect, 4) AS effect, round(effect - 1.96 * se, 4) AS ci_lower, round(effect + 1.96 * se, 4) AS ci_upper FROM e UNION ALL SELECT 'Pooled', round(sum(w * effect) / sum(w), 4), round(sum(w * effect) / sum(w) - 1.96 * sqrt(1 / sum(w)), 4), round(sum(w * effect) / sum(w) + 1.96 * sqrt(1 / sum(w)), 4) FROM o")

# --- screening on given vectors -----------------------------------------------------------------------------------------
#: Stated criteria: a vector, its kind, weight and whether it is mandatory.
CRITERIA = ((1, "inclusion", 1.0, True), (2, "inclusion", 2.0, False), (3, "exclusion", 1.5, False))


def _screen(e: DataFrame):
    v = e.select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vector"))
    spark = e.sparkSession
    c = spark.createDataFrame([(f"c{i}", i, k, w, m) for i, k, w, m in CRITERIA], "criterion_id string, vec_id bigint, kind string, weight double, mandatory boolean")
    c = e.join(F.broadcast(c), "vec_id").select("criterion_id", "kind", "weight", "mandatory", F.col("embedding").alias("vector"))
    s = sc.similarities(v, c).withColumn("sim", F.round("sim", 6))
    return s, sc.decide(s, c, auto=0.15, maybe=0.05, match=0.05)


_SIMS = "c AS (SELECT 'c' || k.i AS criterion_id, k.*, e.embedding AS cv FROM (VALUES " + ", ".join(f"({i}, '{k}', {w}, {str(m).lower()})" for i, k, w, m in CRITERIA) + ") k(i, kind, weight, mandatory) JOIN embeddings e ON e.vec_id = k.i), s AS (SELECT e.vec_id AS paper_id, criterion_id, kind, weight::DOUBLE AS weight, mandatory, round(list_cosine_similarity(e.embedding::DOUBLE[], cv::DOUBLE[]), 6) AS sim FROM embeddings e, c)"
_DECIDE = f"""{_SIMS}, g AS (SELECT paper_id, coalesce(max(CASE WHEN kind = 'exclusion' AND sim >= 0.05 THEN least(sim * weight, 1.0) END), 0) AS excl, count(*) FILTER (mandatory AND kind = 'inclusion' AND NOT coalesce(sim >= 0.05, false)) AS missed,
 coalesce(avg(CASE WHEN kind = 'inclusion' AND sim >= 0.05 THEN least(sim * weight, 1.0) END), 0) AS incl FROM s GROUP BY 1),
 d AS (SELECT paper_id, CASE WHEN excl >= 0.15 OR missed > 0 THEN 'exclude' WHEN incl >= 0.15 THEN 'include' WHEN incl >= 0.05 THEN 'maybe' ELSE 'exclude' END AS decision,
 round(CASE WHEN excl >= 0.15 THEN excl WHEN missed > 0 THEN 1.0 WHEN incl >= 0.05 THEN incl ELSE 1 - incl END, 9) AS confidence, CASE WHEN excl >= 0.15 THEN 'exclusion' WHEN missed > 0 THEN 'mandatory' WHEN incl >= 0.05 THEN 'inclusion' ELSE 'no match' END AS reason FROM g)"""
_add("criterion_similarity", lambda e: _screen(e)[0], "embeddings", sql=f"WITH {_SIMS} SELECT paper_id, criterion_id, sim FROM s")
_decided = lambda e: _screen(e)[1].withColumn("confidence", F.round("confidence", 9))
_add("screen_decisions", _decided, "embeddings", sql=f"WITH {_DECIDE} SELECT * FROM d")
_add("screen_counts", lambda e: _decided(e).groupBy("decision").agg(F.count("*").alias("n")), "embeddings", sql=f"WITH {_DECIDE} SELECT decision, count(*) AS n FROM d GROUP BY 1")
_add("similar_records", lambda e: screening.similar(e.select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vector")), 7), "embeddings",
     sql="SELECT e.vec_id AS paper_id, round(list_cosine_similarity(e.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) t WHERE e.vec_id <> 7 ORDER BY sim DESC, paper_id LIMIT 10")
_add("active_candidates", lambda e: screening.active_candidates(_decided(e)).select("paper_id", "uncertainty"), "embeddings",
     sql=f"WITH {_DECIDE} SELECT paper_id, round((1 - 2 * abs(confidence - 0.5)) * CASE WHEN decision = 'maybe' THEN 1.5 ELSE 1 END, 6) AS uncertainty FROM d ORDER BY uncertainty DESC, paper_id LIMIT 20")
_add("review_queue", lambda e: screening.review_queue(_decided(e)).select("paper_id", "decision", "place"), "embeddings",
     sql=f"WITH {_DECIDE} SELECT paper_id, decision, row_number() OVER (ORDER BY confidence, paper_id) AS place FROM d WHERE decision = 'maybe' OR confidence < 0.7")
_reviewed = lambda e: _decided(e).withColumn("human_decision", F.when(F.col("paper_id") % 3 == 0, F.when(F.col("paper_id") % 2 == 0, "include").otherwise("exclude")))
_HUMAN = f"{_DECIDE}, h AS (SELECT *, CASE WHEN paper_id % 3 = 0 THEN CASE WHEN paper_id % 2 = 0 THEN 'include' ELSE 'exclude' END END AS human FROM d)"
_add("review_stats", lambda e: screening.review_stats(_reviewed(e)), "embeddings", sql=f"WITH {_HUMAN} SELECT count(*) AS total, count(human) AS reviewed, count(*) - count(human) AS remaining, round(count(*) FILTER (human = decision) / nullif(count(human), 0)::DOUBLE, 8) AS agreement FROM h")
_add("final_decisions", lambda e: screening.final_decisions(_reviewed(e)), "embeddings", sql=f"WITH {_HUMAN} SELECT paper_id, coalesce(human, decision) AS decision, CASE WHEN human IS NOT NULL THEN 'human' ELSE 'auto' END AS decided_by FROM h")
_add("flow_counts", lambda p, c: screening.flow_counts(p, dedup.batch_first_seen(p), c.select(F.col("final_decision").alias("decision")).where("decision is not null")), "papers", "conflict_resolutions",
     sql=f"WITH {_LAST}, k AS ({_SQL['batch_dedup']}), d AS (SELECT lower(trim(final_decision)) AS x FROM conflict_resolutions WHERE final_decision IS NOT NULL), i AS (SELECT count(*) AS identified FROM papers), f AS (SELECT count(*) AS after FROM k), s AS (SELECT count(*) AS screened, count(*) FILTER (x IN ('exclude', 'excluded')) AS excluded, count(*) FILTER (x IN ('include', 'included')) AS included FROM d) SELECT identified, greatest(identified - after, 0) AS duplicates_removed, screened, excluded, screened - excluded AS assessed, screened - excluded - included AS reports_excluded, included FROM i, f, s")
# --- extraction and quality ---------------------------------------------------------------------------------------------
_SIZES = ", ".join(f"list_max(list_transform(regexp_extract_all(abstract, '(?i){p}', 1), lambda x: TRY_CAST(x AS BIGINT)))" for p in extraction.SIZE)
_add("sample_sizes", lambda p: p.select("ordinal", extraction.sample_size(F.col("abstract")).alias("n")).where("n is not null"), "papers", sql=f"SELECT * FROM (SELECT ordinal, coalesce({_SIZES}) AS n FROM papers) WHERE n IS NOT NULL")
_PV = " || ".join(f"regexp_extract_all(abstract, '{p}', 1)" for p in extraction.P_VALUE)
_add("p_values", lambda p: p.select("ordinal", F.array_join(F.transform(extraction.p_values(F.col("abstract")), lambda x: F.round(x, 6).cast("decimal(9,6)").cast("string")), " ").alias("values")).where("values <> ''"), "papers",
     sql=f"SELECT * FROM (SELECT ordinal, array_to_string(list_transform(list_filter(list_transform({_PV}, lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL AND x >= 0 AND x <= 1), lambda x: CAST(CAST(round(x, 6) AS DECIMAL(9,6)) AS VARCHAR)), ' ') AS \"values\" FROM papers) WHERE \"values\" <> ''")
_HIT = lambda words, t="lower(abstract)": " + ".join(f"CASE WHEN contains({t}, '{w}') THEN 1 ELSE 0 END" for w in words)
_DESIGN = "CASE WHEN abstract IS NULL THEN 'unknown' ELSE (WITH h(d, k, n) AS (VALUES " + ", ".join(f"('{d}', {k}, {_HIT(w)})" for k, (d, w) in enumerate(extraction.DESIGNS)) + ") SELECT CASE WHEN max(n) = 0 THEN 'unknown' ELSE arg_min(d, -n * 100 + k) END FROM h) END"
_add("study_designs", lambda p: p.select("ordinal", extraction.study_design(F.col("abstract")).alias("design")), "papers", sql=f"SELECT ordinal, {_DESIGN} AS design FROM papers")
_add("stat_methods", lambda p: p.select("ordinal", F.array_join(extraction.methods(F.col("abstract")), "; ").alias("methods")).where("methods <> ''"), "papers",
     sql="SELECT * FROM (SELECT ordinal, array_to_string(list_filter([" + ", ".join(f"'{m}'" for m in extraction.METHODS) + "], lambda m: contains(lower(abstract), m)), '; ') AS methods FROM papers) WHERE methods <> ''")
_add("effect_sizes", lambda p: extraction.effect_sizes(p.select(F.col("ordinal").alias("id"), F.col("abstract").alias("text")), lenient_ci=True), "papers")


def _routes(p: DataFrame) -> DataFrame:
    a = F.col("abstract")
    x = p.select("ordinal", "citation_count", extraction.study_design(a).alias("design"), extraction.sample_size(a).alias("size"), F.coalesce(extraction.p_values(a), F.array().cast("array<double>")).alias("values"))
    full, path = extraction.route(F.col("design"), F.col("size"), F.col("values"), F.col("citation_count"))
    return x.select("ordinal", F.round(full, 6).alias("completeness"), path.alias("path"))


_add("extraction_routes", _routes, "papers",
     sql=f"WITH x AS (SELECT ordinal, citation_count, (CASE WHEN {_DESIGN} <> 'unknown' THEN 1 ELSE 0 END + CASE WHEN coalesce({_SIZES}) IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(list_filter(list_transform({_PV}, lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL AND x >= 0 AND x <= 1)) > 0 THEN 1 ELSE 0 END) / 3.0 AS f FROM papers) SELECT ordinal, round(f::DOUBLE, 6) AS completeness, CASE WHEN f >= 0.6 THEN 'regex' WHEN coalesce(citation_count, 0) >= 50 THEN 'model' ELSE 'fallback' END AS path FROM x")


def _bias(tool: str):
    def q(p: DataFrame) -> DataFrame:
        each, overall, mean, review = extraction.risk_of_bias(F.col("abstract"), tool)
        return p.select("ordinal", F.concat_ws(" ", *[c for _, c in each]).alias("domains"), overall.alias("overall"), F.round(mean, 6).alias("confidence"), review.alias("needs_review"))

    return q


for _tool in ("rob2", "newcastle_ottawa"):
    _n = [f"({_HIT(w, 't')})" for _, w in extraction.ROB[_tool]]
    _add(f"risk_of_bias_{_tool}", _bias(_tool), "papers",
         sql="WITH p AS (SELECT ordinal, lower(coalesce(abstract, '')) AS t FROM papers), h AS (SELECT ordinal, [" + ", ".join(_n) + "] AS n FROM p), j AS (SELECT ordinal, n, list_sum(list_transform(n, lambda c: CASE WHEN c >= 2 THEN 0.7 WHEN c = 1 THEN 0.5 ELSE 0.3 END)) / len(n) AS m, list_min(n) AS w FROM h) SELECT ordinal, array_to_string(list_transform(n, lambda c: CASE WHEN c >= 2 THEN 'low' WHEN c = 1 THEN 'some' ELSE 'high' END), ' ') AS domains, CASE WHEN w >= 2 THEN 'low' WHEN w = 1 THEN 'some' ELSE 'high' END AS overall, round(m::DOUBLE, 6) AS confidence, round(m::DOUBLE, 9) < 0.6 OR w = 0 AS needs_review FROM j")

# --- bibliography and searches ------------------------------------------------------------------------------------------
#: a, b, ..., z, aa, ... for the second, third, ... record of a base
_SUFFIX = " || ".join(f"CASE WHEN k - 1 >= {(26 ** (i + 1) - 1) // 25} THEN chr(CAST(97 + ((k - 1 - {(26 ** (i + 1) - 1) // 25}) // {26**i}) % 26 AS INTEGER)) ELSE '' END" for i in reversed(range(8)))
_add("cite_keys", lambda p: bibtex.keys(p).select("ordinal", "cite_key"), "papers",
     sql="""WITH b AS (SELECT ordinal, concat_ws('_', coalesce(lower(list_filter(regexp_split_to_array(trim(authors[1].name), '\\s+'), lambda x: length(x) > 0)[-1]), 'unknown'), coalesce(CAST(nullif(year, 0) AS VARCHAR), 'n.d.'),
 coalesce(lower(list_filter(string_split(trim(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g')), ' '), lambda x: length(x) > 0)[1]), 'untitled')) AS base FROM papers), k AS (SELECT ordinal, base, row_number() OVER (PARTITION BY base ORDER BY ordinal) AS k FROM b)
""" + f", n AS (SELECT ordinal, base, k, base || {_SUFFIX} AS cite_key FROM k)," + """
 o AS (SELECT *, row_number() OVER (PARTITION BY cite_key ORDER BY ordinal) AS r FROM n)
SELECT ordinal, CASE WHEN r = 1 THEN cite_key ELSE concat_ws('_', base, k) END AS cite_key FROM o""")
_add("bibtex_entries", bibtex.entries, "papers")
_TERMS = "t(domain, kind, place, term) AS (VALUES " + ", ".join(f"('{d}', '{g}', {i}, '{t}')" for d, g, ts in searches.DOMAINS for i, t in enumerate(ts)) + "), pr AS (SELECT a.domain, a.kind, a.term || ' ' || b.term AS q FROM t a JOIN t b ON a.domain = b.domain AND a.kind = b.kind AND a.place < b.place), core AS (SELECT domain, q FROM pr WHERE kind = 'core')"
_QUERIES["query_pairs"] = lambda spark, d: searches.pairs(searches.domain_terms(spark).where("kind = 'core'"))
_SQL["query_pairs"] = f"WITH {_TERMS} SELECT domain, q AS query FROM core"
_QUERIES["query_systematic"] = lambda spark, d: searches.systematic(searches.domain_terms(spark))
_SYS = f"{_TERMS}, y AS (SELECT domain, q FROM core UNION SELECT c.domain, c.q || ' ' || p.q FROM core c JOIN pr p ON c.domain = p.domain AND p.kind IN ('method', 'context'))"
_SQL["query_systematic"] = f"WITH {_SYS} SELECT domain, q AS query FROM y"
_QUERIES["search_matrix"] = lambda spark, d: searches.for_source(searches.systematic(searches.domain_terms(spark)), table(spark, d, "search_queries"))
_SQL["search_matrix"] = f"WITH {_SYS} SELECT domain, CASE WHEN source = 'semantic_scholar' THEN array_to_string(string_split(q, ' ')[1:4], ' ') ELSE q END AS query, source FROM y, (SELECT DISTINCT source FROM search_queries)"

# --- ingestion, nested records, streams -----------------------------------------------------------------------------------
_add("ingested_records", lambda c: ingest.page_records(c).select("row_id", "database", "paper_id", "doi", "title", "year", "citation_count", F.array_join(F.transform("authors", lambda a: a["name"]), "; ").alias("authors"), F.array_join("fields_of_study", "; ").alias("fields"), "open_access_pdf"), "cached_pages")


def _unwrapped(c: str) -> str:
    """A JSON string's content; anything else as it is."""
    t = f"trim({c}, ' \t\r\n' || chr(65279) || chr(0))"
    return f"CASE WHEN {t} LIKE '\"%' THEN CASE WHEN json_valid({t}) THEN json_extract_string({t}, '$') END ELSE {c} END"


_add("p2_found", lambda p, c: nested.object_paths(nested.corpus_texts(p, c)), "papers", "cached_pages",
     sql=f"""WITH t AS (SELECT 'papers' AS origin, ordinal AS row_id, raw_data AS text FROM papers UNION ALL SELECT 'cached_pages', id, raw_response FROM cached_pages),
 u AS (SELECT origin, row_id, regexp_extract({_unwrapped(_unwrapped(_unwrapped('text')))}, '(?s)[{{\\[].*[}}\\]]') AS j FROM t),
 v AS (SELECT * FROM u WHERE json_valid(j)), w AS (SELECT v.origin, v.row_id, x.fullkey, x.type FROM v, json_tree(v.j) x)
SELECT origin, row_id, replace(regexp_replace(fullkey, '^\\$\\.?', ''), '"', '') AS path FROM w WHERE type = 'OBJECT' AND fullkey <> '$'""")
for _name, _fn in (("works", nested.work_table), ("authors", nested.author_table), ("affiliations", nested.affiliation_table)):
    _add(f"p2_{_name}", lambda p, c, f=_fn: f(nested.json_objects(nested.corpus_texts(p, c), True)), "papers", "cached_pages")
_add("living_update", living.replay, "papers",
     sql=f"""WITH h AS (SELECT max(ordinal) / 2.0 AS m FROM papers), old AS (SELECT paper_id, max(ordinal) AS ordinal FROM papers, h WHERE ordinal <= m GROUP BY 1),
 inc AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ordinal) AS rn FROM papers, h WHERE ordinal > m), f AS (SELECT * FROM inc WHERE rn = 1 AND paper_id NOT IN (SELECT paper_id FROM old)),
 a AS (SELECT *, nullif(lower(doi), '') AS d FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ordinal) AS rd FROM a), k AS (SELECT *, nullif(lower(trim(title)), '') AS t FROM b WHERE d IS NULL OR rd = 1), n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ordinal) AS rt FROM k)
SELECT paper_id, ordinal FROM old UNION ALL SELECT paper_id, ordinal FROM n WHERE t IS NULL OR rt = 1""")

# --- filters, joins and lists ---------------------------------------------------------------------------------------------
_decisions = lambda c: c.select("paper_id", F.col("final_decision").alias("decision"))
_FINAL = "d AS (SELECT paper_id, final_decision AS decision FROM conflict_resolutions)"
_add("included_papers", lambda p, c: selection.decided_papers(p.select("ordinal", "paper_id", "year"), selection.by_decision(_decisions(c), "include").select("paper_id").distinct()), "papers", "conflict_resolutions",
     sql=f"WITH {_FINAL} SELECT ordinal, paper_id, year FROM papers WHERE paper_id IN (SELECT paper_id FROM d WHERE lower(trim(decision)) = 'include')")
_add("decided_papers", lambda p, c: selection.decided_papers(p.select("ordinal", "paper_id", "year"), _decisions(c)), "papers", "conflict_resolutions",
     sql=f"WITH {_FINAL} SELECT ordinal, paper_id, year, decision FROM papers JOIN d USING (paper_id)")
_add("training_rows", lambda p, c: selection.training_rows(p, _decisions(c)), "papers", "conflict_resolutions",
     sql=f"WITH {_LAST}, {_FINAL} SELECT paper_id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS text, label FROM last_copies JOIN (SELECT DISTINCT paper_id, CASE WHEN lower(trim(decision)) = 'include' THEN 1 ELSE 0 END AS label FROM d WHERE lower(trim(decision)) IN ('include', 'exclude')) l USING (paper_id)")
_add("decision_shares", lambda c: selection.decision_shares(_decisions(c)), "conflict_resolutions",
     sql=f"WITH {_FINAL} SELECT decision, count(*) AS n, round(100.0 * count(*) / nullif(sum(count(*)) OVER (), 0), 4)::DOUBLE AS percent FROM d GROUP BY 1")
_FILLED = {"doi": "length(trim(doi)) > 0", "abstract": "length(trim(abstract)) > 0", "year": "year IS NOT NULL", "authors": "len(authors) > 0", "venue": "length(trim(venue)) > 0", "open_access_pdf": "length(trim(open_access_pdf)) > 0"}
_add("field_coverage", selection.coverage, "papers",
     sql=" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({ok}) AS filled, round(100.0 * count(*) FILTER ({ok}) / nullif(count(*), 0), 4)::DOUBLE AS percent FROM papers" for c, ok in _FILLED.items()))
_add("most_influential_papers", lambda e, p: selection.among_most_influential(p.select("ordinal", "paper_id"), graph.simple_influence(e, p).withColumn("influence_score", F.round("influence_score", 6)), 50), "citation_edges", "papers",
     sql=f"WITH s AS ({_SQL['influence_simple']}), b AS (SELECT paper_id FROM s ORDER BY influence_score DESC, paper_id LIMIT 50) SELECT ordinal, paper_id FROM papers WHERE paper_id IN (SELECT paper_id FROM b)")
_H = "greatest(least(confidence, 1 - 1e-10), 1e-10)"
_add("most_uncertain", lambda e: selection.most_uncertain(_decided(e).withColumn("p", F.col("confidence")), 20), "embeddings",
     sql=f"WITH {_DECIDE} SELECT paper_id, round(-({_H} * ln({_H}) + (1 - {_H}) * ln(1 - {_H})), 6) AS entropy FROM d ORDER BY entropy DESC, paper_id LIMIT 20")
_add("next_unreviewed", lambda e: selection.next_unreviewed(screening.review_queue(_reviewed(e)), 10).select("paper_id", "place"), "embeddings",
     sql=f"WITH {_HUMAN}, q AS (SELECT *, row_number() OVER (ORDER BY confidence, paper_id) AS place FROM h WHERE decision = 'maybe' OR confidence < 0.7) SELECT paper_id, place FROM q WHERE human IS NULL ORDER BY place LIMIT 10")
_add("distinct_queries", lambda q: q.select("query_text").distinct(), "search_queries", sql="SELECT DISTINCT query_text FROM search_queries")
_add("publication_years", lambda p: p.select("ordinal", F.year("publication_date").alias("year")), "papers", sql="SELECT ordinal, CAST(year(publication_date) AS INTEGER) AS year FROM papers")
_add("paper_texts", lambda p: p.select("ordinal", F.md5(selection.paper_text()).alias("digest")), "papers", sql="SELECT ordinal, md5(coalesce(title, '') || '. ' || coalesce(abstract, '')) AS digest FROM papers")
#: Stated criteria and a vocabulary, each with its phrases.
PHRASES = {"population": ("smallholder farmers", "older adults", "rural households"), "design": ("randomised controlled trial", "systematic review"), "outcome": ("depressive symptoms", "quality of life"), "none": ()}


def _phrases(p: DataFrame) -> DataFrame:
    return p.sparkSession.createDataFrame([(c, list(k)) for c, k in PHRASES.items()], "criterion_id string, keywords array<string>")


_W_OF = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
_LIKE = lambda a, b: f"CASE WHEN len({a}) * len({b}) > 0 THEN len(list_intersect({a}, {b})) / sqrt(len({a}) * len({b})) ELSE 0 END"
_TEXT = "coalesce(title, '') || '. ' || coalesce(abstract, '')"
_PHRASES = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{x}')" for c, k in PHRASES.items() for x in k) + ") AS t(criterion_id, phrase))"
_MATCHES = f"""{_PHRASES}, w AS (SELECT ordinal, {_W_OF(_TEXT)} AS w FROM papers), kw AS (SELECT criterion_id, {_W_OF('phrase')} AS p FROM k),
 s AS (SELECT ordinal, criterion_id, round(max({_LIKE('w', 'p')}), 6) AS sim FROM w, kw GROUP BY 1, 2)"""
_add("criterion_matches", lambda p: selection.criterion_matches(p, _phrases(p)), "papers",
     sql=f"WITH {_MATCHES} SELECT ordinal, criterion_id, sim, sim >= 0.2 AS matches FROM s UNION ALL SELECT ordinal, 'none', 0, false FROM papers")
_add("vocabulary_tags", lambda p: selection.vocabulary_tags(p, _phrases(p).select(F.col("criterion_id").alias("concept"), F.explode("keywords").alias("term"))), "papers",
     sql=f"WITH {_MATCHES} SELECT ordinal, criterion_id AS concept, sim FROM s WHERE sim >= 0.2")
_add("evidence_sentences", lambda p: selection.evidence(p, _phrases(p).where("size(keywords) > 0")).withColumn("sentence", F.md5("sentence")), "papers",
     sql=f"""WITH {_PHRASES}, kw AS (SELECT criterion_id, {_W_OF("string_agg(phrase, ' ')")} AS p FROM k GROUP BY 1),
 l AS (SELECT ordinal, list_filter(string_split({_TEXT}, '.'), lambda x: length(trim(x)) > 20) AS l FROM papers), s AS (SELECT ordinal, unnest(l) AS sentence, generate_subscripts(l, 1) AS pos FROM l),
 v AS (SELECT *, {_W_OF('sentence')} AS w FROM s), x AS (SELECT ordinal, criterion_id, pos, trim(sentence) AS sentence, round({_LIKE('w', 'p')}, 6) AS sim FROM v, kw),
 r AS (SELECT *, row_number() OVER (PARTITION BY ordinal, criterion_id ORDER BY sim DESC, pos) AS place FROM x) SELECT ordinal, criterion_id, place, md5(sentence) AS sentence, sim FROM r WHERE place <= 3""")
