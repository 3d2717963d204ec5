"""The training-data queries and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litsieve.llm import clusters, consensus, crossmatch, leakage, mixture, names, splitting, survivor, truncation
from litsieve.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(fn: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: fn(*(table(spark, d, n) for n in names))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(truncation.cut_abstracts, "papers"),
        "p1_share_by_database": _on(truncation.truncation_report, "papers"),
        "p3_found": _on(names.same_names, "authors", "affiliations", "papers", "match_pairs"),
        "p3_persons": _on(names.person_groups, "authors", "affiliations", "papers", "match_pairs"),
        "p3_organisations": _on(names.organisations, "affiliations"),
        "p4_found": _on(crossmatch.matched, "library_records", "papers", "match_pairs"),
        "p4_matches": _on(crossmatch.matches, "library_records", "papers", "match_pairs"),
        "p5_found": _on(survivor.surviving_rows, "papers", "match_pairs"),
        "p5_records": _on(survivor.surviving_records, "papers", "match_pairs"),
        "p6_found": _on(clusters.paper_groups, "papers", "match_pairs"),
        "p7_found": _on(consensus.paper_decisions, "conflict_resolutions"),
        "p7_agreement": _on(consensus.paper_agreement, "conflict_resolutions"),
        "p7_reviewers": _on(consensus.reviewer_reliability, "conflict_resolutions"),
        "p8_found": _on(leakage.leaked, "documents", "eval_items"),
        "p8_leaks": _on(leakage.leaks, "documents", "eval_items"),
        "p8_items": _on(leakage.leaked_items, "documents", "eval_items"),
        "p8_clean_documents": _on(leakage.clean_documents, "documents", "eval_items"),
        "p9_curriculum": _on(mixture.curriculum, "documents", "mixture_targets"),
        "p9_shares": _on(mixture.shares, "documents", "mixture_targets"),
        "p10_found": _on(splitting.oversized, "documents"),
        "p10_pieces": _on(splitting.pieces, "documents"),
        "p10_report": _on(splitting.piece_report, "documents"),
        "p6_group_sizes": _on(clusters.group_sizes, "papers", "match_pairs"),
    }


_DOI = r"regexp_replace(regexp_replace(regexp_replace(lower(doi), '\s+', '', 'g'), '^(https?:/+)?(dx\.)?(www\.)?(doi\.org/)?(doi:)?/*', ''), '[.,;]+$', '')"
_ARXIV = r"regexp_replace(lower(arxiv_id), '\s+', '', 'g')"
for _pattern in (r"^(https?://)?(www\.)?(arxiv\.org/(abs|pdf)/)?(arxiv:)?", r"(\.pdf)?$", "v[0-9]+$"):
    _ARXIV = f"regexp_replace({_ARXIV}, '{_pattern}', '')"
#: Every record with all that it reaches: for small tables only.
_GROUPS = rf"""WITH RECURSIVE k AS (
 SELECT paper_id, 'doi ' || x AS key FROM (SELECT paper_id, {_DOI} AS x FROM papers)
 WHERE regexp_matches(x, '^10\.[0-9]{{4,9}}(\.[0-9]+)*/[^\s]+$') AND NOT regexp_matches(x, '^10\.0+/|/(unknown|none|null|n/?a|na|tbd|test|x+|0+|-+)$')
 UNION SELECT paper_id, 'arxiv ' || x FROM (SELECT paper_id, {_ARXIV} AS x FROM papers)
 WHERE regexp_matches(x, '^([0-9]{{2}}(0[1-9]|1[0-2])\.[0-9]{{4,5}}|[a-z-]+(\.[a-z]{{2}})?/[0-9]{{7}})$')),
 e AS (SELECT paper_id_a AS a, paper_id_b AS b FROM match_pairs WHERE paper_id_a <> paper_id_b
 UNION SELECT m.a, k.paper_id FROM k JOIN (SELECT key, min(paper_id) AS a FROM k GROUP BY 1) m USING (key) WHERE k.paper_id <> m.a),
 l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(v, w) AS (SELECT a, a FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.w = l.a),
 g AS (SELECT v AS paper_id, min(w) AS group_id FROM r WHERE v IN (SELECT paper_id FROM papers) AND w IN (SELECT paper_id FROM papers) GROUP BY 1 HAVING count(*) > 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"{_GROUPS} SELECT paper_id, group_id FROM g",
        "p6_group_sizes": f"{_GROUPS}, n AS (SELECT group_id, count(*) AS records FROM g GROUP BY 1) SELECT records, count(*) AS n_groups FROM n GROUP BY 1",
    }
