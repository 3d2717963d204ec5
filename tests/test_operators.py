import itertools
import random

import pytest
from pyspark.sql import functions as F

from litsieve.functions.similarity import indel_ratio
from litsieve.operators import bibtex, dedup, extraction, graph, meta, reports, screening, searches
from litsieve.schema import PAPER, split_valid
from litsieve.sources import ingest
from litsieve.streaming import living

DEFAULTS = dict(paper_id=None, doi=None, arxiv_id=None, title="T", abstract=None, authors=None, year=None, publication_date=None, venue=None, publisher=None, fields_of_study=None, keywords=None,
                citation_count=0, influential_citation_count=0, reference_count=0, is_open_access=False, open_access_pdf=None, external_ids=None, source=("s", "q", None, None, None), raw_data=None)


def papers(spark, *rows):
    made = [tuple({**DEFAULTS, "paper_id": f"p{i}", **r}[k] if k != "ordinal" else r.get("ordinal", i) for k in ["ordinal", *DEFAULTS]) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(made, PAPER)


def test_doi_pass_and_canonical(spark):
    p = papers(spark, {"doi": "10.1/a", "citation_count": 5, "fields_of_study": ["CS", "AI"], "external_ids": {"MAG": "1", "PubMed": "2"}}, {"doi": "https://doi.org/10.1/A", "abstract": "x", "citation_count": 15, "fields_of_study": ["AI", "ML"], "external_ids": {"MAG": "3"}, "open_access_pdf": "u"}, {"doi": "10.1/c"})
    out = {r.paper_id: r for r in dedup.canonical(p).collect()}
    assert set(out) == {"p2", "p3"}
    r = out["p2"]
    assert (r.citation_count, r.fields_of_study, r.external_ids, r.open_access_pdf, r.cluster_size) == (15, ["AI", "CS", "ML"], {"MAG": "3", "PubMed": "2"}, "u", 2)
    assert {r.paper_id for r in dedup.canonical(p, "most_citations").collect()} == {"p2", "p3"}
    s = dedup.summary(p).first()
    assert (s.before, s.after, s.removed, s.clusters) == (3, 2, 1, 1)


def test_arxiv_pass_only_for_the_rest_and_ties_go_first(spark):
    p = papers(spark, {"doi": "10.1/a", "arxiv_id": "2401.00001"}, {"doi": "10.1/a"}, {"arxiv_id": "arXiv:2401.00001v2"}, {"arxiv_id": "2401.00001"})
    got = {r.paper_id: (r.match_type, r.leader) for r in dedup.assignments(p).collect()}
    assert got == {"p1": ("doi", 1), "p2": ("doi", 1), "p3": ("arxiv", 3), "p4": ("arxiv", 3)}
    assert {r.paper_id for r in dedup.canonical(p, "first").collect()} == {"p1", "p3"}


def test_latest_copy_of_an_id_stays(spark):
    p = papers(spark, {"paper_id": "x", "title": "old"}, {"paper_id": "x", "title": "new"}, {"paper_id": "y"})
    assert {r.title for r in dedup.latest_copies(p).collect()} == {"new", "T"}


def test_batch_dedup_rule(spark):
    rng = random.Random(3)
    rows = [{"doi": rng.choice([None, "", "10.1/A", "10.1/a", "10.1/b"]), "title": rng.choice(["x", " X", "y", "", "z"])} for _ in range(60)]
    seen_d, seen_t, want = set(), set(), []
    for i, r in enumerate(rows, 1):
        d, t = (r["doi"] or "").lower(), r["title"].strip().lower()
        if d and d in seen_d:
            continue
        if d:
            seen_d.add(d)
        if t and t in seen_t:
            continue
        if t:
            seen_t.add(t)
        want.append(i)
    assert sorted(r.ordinal for r in dedup.batch_first_seen(papers(spark, *rows)).collect()) == want


def test_fuzzy_pairs_against_brute_force_and_leaders(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 7)
    rng = random.Random(1)
    titles = ["".join(rng.choice("abcd ") for _ in range(12)) for _ in range(40)]
    titles += [t[:-1] + "z" for t in titles[:15]] + ["", None]
    p = papers(spark, *[{"title": t, "year": 2020 + i % 2} for i, t in enumerate(titles)], {"title": "no year"})
    got = {(r.ordinal_a, r.ordinal_b) for r in dedup.fuzzy_title_pairs(p, 0.8).collect()}
    rows = {}
    for i, t in enumerate(titles):
        n = " ".join((t or "").split())
        if n:
            rows.setdefault((2020 + i % 2, n), i + 1)
    want = {tuple(sorted((a, b))) for ((y, s), a), ((z, t), b) in itertools.combinations(rows.items(), 2) if y == z and indel_ratio(s, t) >= 0.8}
    assert got == want and want
    lead = {r.ordinal: r.leader for r in dedup.fuzzy_leaders(dedup.fuzzy_title_pairs(p, 0.8)).collect()}
    for v, l in lead.items():
        earlier = [u for u in lead if u < v and lead[u] == u and (u, v) in want]
        assert l == (min(earlier) if earlier else v)


def test_fuzzy_pass_joins_what_the_exact_passes_left(spark):
    t = "effects of early coaching on reading in rural schools"
    rows = [{"title": t, "year": 2020}, {"title": t + "s", "year": 2020}, {"title": t.upper(), "year": 2020}, {"title": t, "year": 2019}, {"title": t, "year": None}, {"title": t[:-1] + "x", "year": 2020, "doi": "10.1/a"}, {"title": "other", "year": 2020, "doi": "10.1/A"}]
    p = papers(spark, *rows)
    got = {r.ordinal: (r.leader, r.match_type, round(r.confidence, 2)) for r in dedup.assignments(p).collect()}
    assert got == {1: (1, "title_exact", 1.0), 2: (1, "title_fuzzy", 0.99), 3: (1, "title_exact", 1.0), 6: (6, "doi", 1.0), 7: (6, "doi", 1.0)}
    ids = {r.paper_id: r.canonical_id for r in dedup.canonical_map(p).collect()}
    assert len(set(ids.values())) == 4 and len(ids) == 7


def test_cite_keys_never_repeat(spark):
    p = papers(spark, *[{"title": "same", "year": 2020} for _ in range(800)], *[{"title": f"same{x}", "year": 2020} for x in ("a", "ab")])
    keys = [r.cite_key for r in bibtex.keys(p).orderBy("ordinal").collect()]
    assert len(set(keys)) == 802 and keys[:3] == ["unknown_2020_same", "unknown_2020_samea", "unknown_2020_sameb"] and keys[27] == "unknown_2020_sameaa"


def test_writers(spark, tmp_path):
    from litsieve.sources import writers

    p = papers(spark, {"title": "A, \"quoted\"", "year": 2020}, {"title": None})
    writers.write_phase(p, str(tmp_path), "dedup")
    assert spark.read.parquet(f"{tmp_path}/dedup.parquet").count() == spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/dedup.csv").count() == 2
    writers.write_json(p, f"{tmp_path}/x.json")
    writers.write_bibtex(p, f"{tmp_path}/x.bib", 1)
    assert spark.read.json(f"{tmp_path}/x.json").count() == 2
    assert sum(r.value.startswith("@") for r in spark.read.text(f"{tmp_path}/x.bib").collect()) == 1


def test_empty_tables(spark):
    e = papers(spark).limit(0)
    assert dedup.canonical(e).count() == 0 and dedup.summary(e).first().before == 0 and dedup.fuzzy_title_pairs(e).count() == 0
    assert {r.percent for r in reports.completeness_profile(e).collect()} == {0.0}


def test_constraints(spark):
    p = papers(spark, {"year": 1899}, {"year": 2101}, {"citation_count": -1}, {"title": None}, {"year": None})
    good, bad = split_valid(p)
    assert [r.paper_id for r in good.collect()] == ["p5"] and bad.count() == 4


EDGES = "citing_paper_id string, cited_doi string, cited_paper_id string, cited_title string, source string, context string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, None, b, None, "s", None) for a, b in pairs], EDGES)


def test_influence_order(spark):
    p = papers(spark, *[{"paper_id": i, "citation_count": c} for i, c in zip("ABCD", (100, 50, 10, 5))])
    r = graph.full_influence(edges(spark, ("B", "A"), ("C", "A"), ("D", "C"), ("B", "C")), p, with_betweenness=True).orderBy("rank").collect()
    assert r[0].paper_id == "A" and all(a.influence_score >= b.influence_score >= 0 for a, b in zip(r, r[1:]))


def test_the_registered_ranking_counts_betweenness(spark, tmp_path):
    from litsieve.plans import catalog

    # M is on both shortest paths; T is cited as often as M, and more by others
    papers(spark, *[{"paper_id": i, "doi": f"10.1/{i}", "title": i, "citation_count": c} for i, c in zip("ABMTX", (0, 0, 0, 1, 0))]).write.parquet(f"{tmp_path}/papers.parquet")
    edges(spark, ("A", "M"), ("B", "M"), ("M", "T"), ("X", "T")).write.parquet(f"{tmp_path}/citation_edges.parquet")
    e, p = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("citation_edges", "papers"))
    got = {r.paper_id: r.influence_score for r in catalog.queries()["influence_ranked"](spark, str(tmp_path)).collect()}
    without = {r.paper_id: r.influence_score for r in graph.full_influence(e, dedup.canonical(p), with_betweenness=False).collect()}
    assert got["M"] == pytest.approx(without["M"] + graph.WEIGHTS["betweenness"]) and got["T"] == pytest.approx(without["T"])


def test_the_registered_ranking_looks_for_duplicates_once_and_reads_written_tables(spark, tmp_path, monkeypatch):
    from litsieve import session
    from litsieve.plans import catalog

    rows = [("A", "one and the same title of a work"), ("B", "one and the same titles of a work"), ("C", "another thing"), ("D", "what nobody cites")]
    papers(spark, *[{"paper_id": i, "doi": f"10.1/{i}", "title": t, "year": 2020} for i, t in rows]).write.parquet(f"{tmp_path}/papers.parquet")
    edges(spark, ("C", "A"), ("C", "B"), ("D", "C")).write.parquet(f"{tmp_path}/citation_edges.parquet")
    did, read = [], []
    for at, f in ((dedup, "_similar"), (graph, "tidy"), (dedup, "tidy")):
        monkeypatch.setattr(at, f, lambda *a, f=f, to=getattr(session, f, dedup._similar): did.append(f) or to(*a), raising=False)
    for f in ("pagerank", "betweenness"):
        monkeypatch.setattr(graph, f, lambda n, l, to=getattr(graph, f): read.extend([*n.inputFiles(), *l.inputFiles()]) or to(n, l))
    got = {r.paper_id: (r.rank, r.in_degree) for r in catalog.queries()["influence_ranked"](spark, str(tmp_path)).collect()}
    assert {i: d for i, (_, d) in got.items()} == {"A": 1, "C": 1, "D": 0}  # B is A's
    assert did.count("_similar") == 1 and did.count("tidy") > 1
    assert read and not [x for x in read if str(tmp_path) in x]


def test_no_edges_and_self_citations(spark):
    p = papers(spark, {"paper_id": "a"}, {"paper_id": "b"})
    for e in (edges(spark, ("a", "a")), edges(spark, (None, "b")), edges(spark, ("a", None))):
        assert graph.full_influence(e, p).count() == 2


def test_resolution_takes_the_last_record_and_normalises(spark):
    p = papers(spark, {"doi": "10.1/A"}, {"doi": "10.1/a"})
    e = spark.createDataFrame([("x", "https://doi.org/10.1/A", None, None, "s", None), ("x", "10.9/none", None, None, "s", None)], EDGES)
    assert sorted(str(r.cited_paper_id) for r in graph.resolve(e, p).collect()) == ["None", "p2"]


def test_pagerank_and_betweenness_against_brute_force(spark):
    rng = random.Random(5)
    n = [f"n{i}" for i in range(9)]
    pairs = [(rng.choice(n), rng.choice(n)) for _ in range(26)]
    p = papers(spark, *[{"paper_id": x} for x in n])
    nodes, links = graph.graph(edges(spark, *pairs), p)
    w = {(r.src, r.dst): r.weight for r in links.collect()}
    rank = dict.fromkeys(n, 1 / 9)
    for _ in range(200):
        out = {x: sum(v for (a, _), v in w.items() if a == x) for x in n}
        lost = sum(rank[x] for x in n if not out[x])
        rank = {x: 0.85 * (sum(rank[a] * v / out[a] for (a, b), v in w.items() if b == x) + lost / 9) + 0.15 / 9 for x in n}
    got = {r.id: r.pagerank for r in graph.pagerank(nodes, links, tolerance=1e-12).collect()}
    assert sum(got.values()) == pytest.approx(1) and all(got[x] == pytest.approx(rank[x], abs=1e-8) for x in n)

    def shortest(s, t):
        best, count = {}, {}
        todo = [(0, [s])]
        while todo:
            d, path = todo.pop()
            if path[-1] == t:
                best.setdefault("d", []).append((d, path))
                continue
            todo += [(d + v, [*path, b]) for (a, b), v in w.items() if a == path[-1] and b not in path]
        if not best:
            return []
        m = min(d for d, _ in best["d"])
        return [q for d, q in best["d"] if d == m]

    want = dict.fromkeys(n, 0.0)
    for s, t in itertools.permutations(n, 2):
        q = shortest(s, t)
        for v in n:
            if q and v not in (s, t):
                want[v] += sum(v in x for x in q) / len(q)
    got = {r.id: r.betweenness for r in graph.betweenness(nodes, links, normalized=False).collect()}
    assert all(got[x] == pytest.approx(want[x]) for x in n)


def test_betweenness_sends_no_links_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    p = papers(spark, *[{"paper_id": i} for i in "ABCDE"])
    nodes, links = graph.graph(edges(spark, ("A", "B"), ("B", "C"), ("C", "D"), ("A", "D"), ("A", "D"), ("D", "E")), p)

    def none(*a):
        raise AssertionError("rows of the graph sent to the driver")

    with monkeypatch.context() as x:
        for f in ("toPandas", "collect", "toLocalIterator"):
            x.setattr(DataFrame, f, none)
        x.setattr(graph, "MAX_LINKS", 1, raising=False)  # however many there are
        b = graph.betweenness(nodes, links, normalized=False)
    # A reaches D by the repeated reference, two long, and not by B and C, three long
    assert {r.id: r.betweenness for r in b.collect()} == {"A": 0.0, "B": 1.0, "C": 2.0, "D": 3.0, "E": 0.0}


def test_influence_with_betweenness_sends_no_links_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def none(*a):
        raise AssertionError("rows of the graph sent to the driver")

    p = papers(spark, *[{"paper_id": i} for i in "ABC"])
    e = edges(spark, ("A", "B"), ("B", "C"))
    with monkeypatch.context() as x:
        x.setattr(DataFrame, "toPandas", none)
        x.setattr(graph, "MAX_LINKS", 1, raising=False)  # however many there are
        r = graph.full_influence(e, p)
    assert {x.paper_id: x.betweenness for x in r.collect()} == {"A": 0.0, "B": 0.5, "C": 0.0}


def effects(spark, *rows):
    return spark.createDataFrame([(f"s{i}", *r) for i, r in enumerate(rows)], "study_id string, effect double, se double")


def test_meta_by_hand(spark):
    e = effects(spark, (0.5, 0.1), (0.3, 0.2), (0.9, 0.0))
    f = meta.pooled(e).first()
    assert f.effect == pytest.approx((50 + 7.5) / 125) and f.se == pytest.approx(125**-0.5) and f.k == 2
    h = meta.heterogeneity(e).first()
    assert h.q == pytest.approx(0.8) and h.df == 1 and h.i2 == 0 and h.tau2 == 0 and h.band == "low"
    same = effects(spark, *[(0.4, 0.1)] * 3)
    assert meta.heterogeneity(same).first().q == pytest.approx(0)
    assert meta.pooled(e.limit(0)).first().effect is None
    assert meta.asymmetry(effects(spark, (0.1, 0.1), (0.2, 0.2))).first().slope is None
    assert meta.forest(e).where("study_id = 'Pooled'").first().weight is None
    assert [r.weight for r in meta.effect_rows(e).orderBy("study_id").collect()][2] == 0


def test_parse_effects_drops_unreadable(spark):
    raw = spark.createDataFrame([("a", "1.5", "x"), ("b", "2", "0.1")], "study string, e string, s string")
    assert [r.study_id for r in meta.parse_effects(raw, "study", "e", "s").collect()] == ["b"]


def test_decision_rule(spark):
    c = spark.createDataFrame([("i", "inclusion", 1.0, False), ("m", "inclusion", 1.0, True), ("x", "exclusion", 2.0, False)], "criterion_id string, kind string, weight double, mandatory boolean")
    sims = [("a", "i", 0.9), ("a", "m", 0.8), ("a", "x", 0.1), ("b", "i", 0.9), ("b", "m", 0.2), ("b", "x", 0.1), ("c", "i", 0.9), ("c", "m", 0.9), ("c", "x", 0.6), ("d", "i", 0.5), ("d", "m", 0.6), ("d", "x", None)]
    s = spark.createDataFrame(sims, "paper_id string, criterion_id string, sim double")
    got = {r.paper_id: (r.decision, round(r.confidence, 3)) for r in screening.decide(s, c).collect()}
    assert got == {"a": ("include", 0.85), "b": ("exclude", 1.0), "c": ("exclude", 1.0), "d": ("maybe", 0.55)}


def test_review_queue_priority(spark):
    r = spark.createDataFrame([("a", "maybe", 0.6), ("b", "include", 0.95), ("c", "exclude", 0.4)], "paper_id string, decision string, confidence double")
    first = spark.createDataFrame([("b",)], "paper_id string")
    assert [x.paper_id for x in screening.review_queue(r).orderBy("place").collect()] == ["c", "a"]
    assert [x.paper_id for x in screening.review_queue(r, first).orderBy("place").collect()] == ["b", "c", "a"]
    assert [x.paper_id for x in screening.review_queue(r, first, priority_only=True).collect()] == ["b"]


def test_classifier_needs_ten_labels(spark):
    few = spark.createDataFrame([("a b c", 1.0)] * 4, "text string, label double")
    assert screening.train(few) is None
    rows = [(f"randomised trial of drug {i % 3} in adults", 1.0) for i in range(12)] + [(f"opinion on museum art {i % 3} history", 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "text string, label double")
    out = screening.train(df, features=200, trees=5).transform(df)
    assert out.where("prediction = label").count() >= 22


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_extraction_patterns(spark):
    t = F.col("t")
    r = one(spark, "We saw n=120 and n = 80 people, p < 0.05. and p = .04, P=2; a randomised survey with regression and ANOVA", extraction.sample_size(t).alias("n"), extraction.p_values(t).alias("p"), extraction.study_design(t).alias("d"), extraction.methods(t).alias("m"))
    assert (r.n, r.p, r.d, r.m) == (120, [0.04], "randomized controlled trial", ["anova", "regression"])
    r = one(spark, None, extraction.sample_size(t).alias("n"), extraction.study_design(t).alias("d"))
    assert (r.n, r.d) == (None, "unknown")


def test_effect_sizes(spark):
    df = spark.createDataFrame([(1, "OR = 1.8 95% CI 1.2-2.7"), (2, "HR: 0.7 (95% CI 0.5 to 0.9)"), (3, None)], "id bigint, text string")
    got = {r.id: (r.type, r.value, r.ci_lower, r.ci_upper) for r in extraction.effect_sizes(df).collect()}
    assert got == {1: ("ratio", 1.8, 1.2, 2.7), 2: ("ratio", 0.7, None, None)}
    assert {r.id: r.ci_upper for r in extraction.effect_sizes(df, lenient_ci=True).collect()}[2] == 0.9


def test_bias(spark):
    for text_, want in (("random computer-generated concealed sealed envelope double-blind masked assessor-blind outcome-blind intention-to-treat itt all outcomes protocol", ("low", False)), ("", ("high", True)), (None, ("high", True))):
        _, overall, _, review = extraction.risk_of_bias(F.col("t"))
        r = one(spark, text_, overall.alias("o"), review.alias("r"))
        assert (r.o, r.r) == want
    _, overall, mean, review = extraction.risk_of_bias(F.col("t"), "casp")
    assert tuple(one(spark, "x", overall, mean, review)) == ("low", 0.0, True)


def test_round_robin_and_conflicts(spark):
    p = papers(spark, {}, {}, {})
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    assert [r.user_id for r in reports.round_robin(p, users).orderBy("ordinal").collect()] == ["u1", "u2", "u1"]
    assert reports.round_robin(p, users.limit(0)).count() == 0 and reports.dual_review(p, users.limit(1)).count() == 3
    v = spark.createDataFrame([("p", "a", "include", 3), ("p", "b", "include", 1), ("p", "c", "exclude", 2), ("q", "a", "include", 1)], "paper_id string, reviewer string, decision string, place int")
    r = reports.conflicts(v).collect()
    assert [(x.paper_id, x.reviewer_1, x.reviewer_2) for x in r] == [("p", "b", "c")]


def test_bibtex(spark):
    a = [("Ann B. Lee", None, None, None), ("Plato", None, None, None)]
    p = papers(spark, {"title": "A & B: study", "authors": a, "year": 2020, "venue": "J", "doi": "10.1/x"}, {"title": "A two", "authors": a, "year": 2020, "raw_data": '{"type": "book"}', "venue": "V"}, {"title": "?", "venue": "PhD thesis"})
    e = {r.ordinal: r for r in bibtex.entries(p).collect()}
    assert [e[i].cite_key for i in (1, 2, 3)] == ["lee_2020_a", "lee_2020_aa", "unknown_n.d._untitled"]
    assert e[1].entry == "@article{lee_2020_a,\n  title = {A \\& B: study},\n  author = {Lee, Ann B. and Plato},\n  year = {2020},\n  journal = {J},\n  doi = {10.1/x}\n}"
    assert e[2].entry_type == "book" and "booktitle = {V}" in e[2].entry and e[3].entry_type == "phdthesis"


def test_query_combinations(spark):
    terms = spark.createDataFrame([("d", "core", i, t) for i, t in enumerate("abcd")] + [("d", "method", 0, "m")], "domain string, kind string, place int, term string")
    got = [r.query for r in searches.systematic(terms).collect()]
    assert len(got) == len(set(got)) == 12 and "a b m" in got
    s = spark.createDataFrame([("semantic_scholar",), ("arxiv",)], "source string")
    five = spark.createDataFrame([("d", "a b c d e")], "domain string, query string")
    assert {r.query for r in searches.for_source(five, s).collect()} == {"a b c d", "a b c d e"}


def test_ingestion_of_irregular_records(spark):
    openalex = '{"id": "https://x/W1", "title": "T", "publication_year": 2020, "primary_location": {"source": null}, "concepts": [{"display_name": "A", "score": 0.2}, {"display_name": "B", "score": 0.4}], "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "open_access": {"is_oa": true, "oa_url": "u"}, "authorships": [{"author": {"display_name": ""}, "institutions": {"display_name": "U"}}]}'
    crossref = '{"DOI": "10.1/A", "title": ["First"], "author": {"given": "G", "family": "F"}, "published": {"date-parts": [[2021, 13]]}, "published-print": {"date-parts": [[2020, 2]]}, "link": [null, {"URL": "p", "content-type": "application/pdf"}], "container-title": ["J"]}'
    df = spark.createDataFrame([(1, openalex), (2, "broken")], "row_id bigint, text string")
    r = ingest.openalex(df).collect()
    assert len(r) == 1 and (r[0].paper_id, r[0].abstract, r[0].fields_of_study, r[0].open_access_pdf) == ("openalex:W1", "hello world hello", ["B"], "u")
    assert (r[0].authors[0].name, r[0].authors[0].affiliation, r[0].venue) == ("Unknown", "U", None)
    r = ingest.crossref(spark.createDataFrame([(1, crossref)], "row_id bigint, text string")).first()
    assert (r.doi, r.title, r.authors[0].name, str(r.publication_date), r.open_access_pdf, r.venue) == ("10.1/a", "First", "G F", "2020-02-01", "p", "J")


def test_atom_feeds(spark):
    feed = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>
    <entry><id>http://arxiv.org/abs/2401.00001v2</id><title> T one </title><summary>An  abstract.</summary><published>2024-01-02T03:04:05Z</published><arxiv:doi>10.1/x</arxiv:doi>
    <author><name>Ann Lee</name></author><author><name>Bo Kim</name></author><arxiv:primary_category term="cs.DL"/><category term="cs.IR"/><category term="cs.DL"/>
    <link href="http://arxiv.org/abs/2401.00001v2" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/2401.00001v2"/></entry><entry><id>http://arxiv.org/abs/2401.00002</id></entry></feed>"""
    r = ingest.arxiv_atom(spark.createDataFrame([(1, feed), (2, "<feed/>"), (3, "broken"), (4, None)], "row_id bigint, text string")).orderBy("paper_id").collect()
    assert [(x.paper_id, x.title) for x in r] == [("arxiv:2401.00001", "T one"), ("arxiv:2401.00002", "Untitled")]
    assert (r[0].doi, r[0].abstract, [a.name for a in r[0].authors], r[0].year, r[0].fields_of_study, r[0].open_access_pdf) == ("10.1/x", "An abstract.", ["Ann Lee", "Bo Kim"], 2024, ["cs.DL", "cs.IR"], "http://arxiv.org/pdf/2401.00001v2")


def test_living_update_is_repeatable(spark, tmp_path):
    cols = ["paper_id", "ordinal", "doi", "title"]
    old = spark.createDataFrame([("a", 1, None, "A")], "paper_id string, ordinal bigint, doi string, title string")
    new = spark.createDataFrame([("a", 2, None, "A"), ("b", 3, "10.1/b", "B"), ("b", 4, "10.1/b", "B"), ("c", 5, "10.1/B", "C")], old.schema)
    old.write.parquet(f"{tmp_path}/corpus")
    new.write.parquet(f"{tmp_path}/in")
    for check in ("one", "two"):  # a second stream reads all files again
        living.update(spark, f"{tmp_path}/in", f"{tmp_path}/corpus", f"{tmp_path}/{check}", cols)
        got = sorted(r.paper_id for r in spark.read.parquet(f"{tmp_path}/corpus").collect())
        assert got in (["a", "b"], ["a", "b", "c"])
    assert got.count("b") == 1
