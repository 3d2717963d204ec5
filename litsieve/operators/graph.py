"""Citation edges, the citation graph and influence scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.ids import normalize_doi
from litsieve.session import materialize, ranked, release, tidy

WEIGHTS = {"pagerank": 0.4, "in_degree": 0.3, "betweenness": 0.2, "citations": 0.1}


def resolve(edges: DataFrame, papers: DataFrame, raw_doi_match: bool = False) -> DataFrame:
    """``cited_paper_id`` filled from the DOI where it is missing: the last record of that DOI wins. A cited DOI may
    hold much of the edges; the index has each DOI once, so the join may be split on its left side."""
    key = (lambda c: F.nullif(c, F.lit(""))) if raw_doi_match else (lambda c: normalize_doi(c))
    index = papers.select(key(F.col("doi")).alias("k"), "ordinal", "paper_id").where("k is not null").groupBy("k").agg(F.max(F.struct("ordinal", "paper_id")).alias("x")).select("k", F.col("x.paper_id").alias("resolved"))
    e = edges.withColumn("k", key(F.col("cited_doi"))).join(index, "k", "left")
    return e.withColumn("cited_paper_id", F.coalesce(F.nullif("cited_paper_id", F.lit("")), "resolved")).drop("k", "resolved")


def citation_stats(edges: DataFrame, papers: DataFrame) -> DataFrame:
    r = resolve(edges, papers)
    known = papers.select(F.col("paper_id").alias("cited_paper_id")).distinct().withColumn("known", F.lit(True))
    return r.join(known, "cited_paper_id", "left").agg(
        F.count("*").alias("total"), F.count("known").alias("in_corpus"), (F.count("*") - F.count("known")).alias("external"),
        F.count_distinct(F.when(F.col("known"), F.col("cited_paper_id"))).alias("cited_papers"),
    )


def mapped(edges: DataFrame, papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Resolved edges between canonical records (ids: paper_id, canonical_id); unknown ids stay. A cited work may hold
    much of the edges; ``ids`` has each id once, so the joins may be split on their left side."""
    e = resolve(edges, papers)
    for c in ("citing_paper_id", "cited_paper_id"):
        e = e.join(ids.select(F.col("paper_id").alias(c), F.col("canonical_id").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return e.select(edges.columns)


def graph(edges: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id; links: src, dst, weight): all papers and endpoints; repeated references add weight."""
    links = _links(edges, papers)
    return _nodes(papers, links), links


def _links(edges: DataFrame, papers: DataFrame) -> DataFrame:
    e = resolve(edges, papers).where("citing_paper_id is not null and cited_paper_id is not null and citing_paper_id <> cited_paper_id")
    return e.groupBy(F.col("citing_paper_id").alias("src"), F.col("cited_paper_id").alias("dst")).agg(F.count("*").alias("weight"))


def _nodes(papers: DataFrame, links: DataFrame) -> DataFrame:
    return papers.select(F.col("paper_id").alias("id")).union(links.select("src")).union(links.select("dst")).where("id is not null").distinct()


def in_degree(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"), F.sum("weight").alias("references"))


def graph_stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"))
    m = links.agg(F.count("*").alias("edges"))
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    lone = nodes.join(ends, "id", "left_anti").agg(F.count("*").alias("isolated"))
    N, M = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return n.crossJoin(m).crossJoin(lone).select(
        "nodes", "edges", F.round(M / F.nullif(N * (N - 1), F.lit(0.0)), 12).alias("density"), F.round(M / F.nullif(N, F.lit(0.0)), 8).alias("avg_degree"),
        F.round(F.col("isolated") / F.nullif(N, F.lit(0.0)), 8).alias("isolated_share"),
    )


def pagerank(nodes: DataFrame, links: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(id, pagerank): weighted power iteration, uniform teleport, mass of nodes without links spread evenly. Each
    round joins ranks with links and cuts the lineage in the shared folder; it stops at a change below tolerance * n."""
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    share = materialize(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "shares")
    base = materialize(nodes.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")), "nodes")
    rank = base.withColumn("r", F.lit(1.0 / n))
    kept = None
    for _ in range(most):
        lost = rank.where("dangling").agg(F.sum("r")).first()[0] or 0.0
        got = share.join(rank.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("in"))
        new = rank.join(got, "id", "left").select("id", "dangling", (F.lit(alpha) * (F.coalesce("in", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)).alias("r"), F.col("r").alias("was"))
        new = materialize(new, "rank")
        change = new.agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0]
        release(kept)
        kept = new
        rank = new.drop("was")
        tidy(nodes.sparkSession)
        if change < tolerance * n:
            break
    return rank.select("id", F.col("r").alias("pagerank"))


def _brandes(path: str, n: int):
    """Brandes' algorithm for blocks of sources at once, over the links (src, dst, weight: numbers of nodes below ``n``) that
    each task reads from the shared folder. Weights are whole numbers, so nodes are settled distance by distance: of the
    links that arrive at a distance, those whose end is not settled yet are on shortest paths."""
    block = max(1, BLOCK // max(n, 1))

    def read():
        from pyarrow import dataset, fs

        system, at = fs.FileSystem.from_uri(path)
        x = dataset.dataset(at, filesystem=system, format="parquet").to_table()
        src, dst, weight = (x[c].to_numpy() for c in ("src", "dst", "weight"))
        for heavy in (False, True):  # nearly all links have weight 1; the others are kept apart
            own = np.flatnonzero((weight > 1) == heavy)
            own = own[np.lexsort((dst[own], src[own]))]
            many = np.bincount(src[own], minlength=n)
            yield np.cumsum(many) - many, many, dst[own], weight[own]

    def search(light, heavy, sources: np.ndarray) -> np.ndarray:
        own = np.arange(len(sources)) * n + sources  # a code is source * n + node
        # above: the sum over the links of shortest paths out of a node of (1 + delta) / sigma of their ends
        sigma, above = np.zeros(len(sources) * n), np.zeros(len(sources) * n)
        free, mark = np.ones(len(sources) * n, bool), np.zeros(len(sources) * n, np.int64)
        sigma[own], free[own] = 1.0, False

        def onward(new: np.ndarray, first, many, to, weight):
            """(from, to, place of the link) of the links of ``new`` to free nodes."""
            node = new % n
            k = many[node]
            ends = np.cumsum(k)
            link = np.repeat(first[node] - ends + k, k) + np.arange(ends[-1] if len(ends) else 0)
            at = np.repeat(new - node, k) + to[link]
            open_ = np.flatnonzero(free[at])
            return np.repeat(new, k)[open_], at[open_], link[open_]

        due: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        levels, new, d = [], own, 0
        while True:
            came, at, _ = onward(new, *light)
            if len(at):
                due.setdefault(d + 1, []).append((came, at))
            came, at, link = onward(new, *heavy)
            w = heavy[3][link]
            for x in np.unique(w).tolist():
                due.setdefault(d + x, []).append((came[w == x], at[w == x]))
            if not due:
                break
            d = min(due)
            came, at = (np.concatenate(x) for x in zip(*due.pop(d)))
            open_ = np.flatnonzero(free[at])
            came, at = came[open_], at[open_]
            np.add.at(sigma, at, sigma[came])
            free[at] = False
            mark[at] = np.arange(len(at))  # of the links to a node, one brings it into the next step
            new = at[mark[at] == np.arange(len(at))]
            levels.append((came, at, new))
        score = np.zeros(n)
        for came, at, new in reversed(levels):
            np.add.at(score, new % n, sigma[new] * above[new])
            above[new] += 1 / sigma[new]
            np.add.at(above, came, above[at])
        return score

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, links = np.zeros(n), None
        for pdf in batches:
            links = links or [*read()]
            k = pdf["k"].to_numpy(np.int64)
            for i in range(0, len(k), block):
                score += search(*links, k[i : i + block])
        hit = np.flatnonzero(score)
        yield pd.DataFrame({"k": hit, "b": score[hit]})

    return over


#: Nodes times sources of a block.
BLOCK = 250_000


def betweenness(nodes: DataFrame, links: DataFrame, normalized: bool = True) -> DataFrame:
    """(id, betweenness): directed, with weight as distance. Sources are spread over the tasks; each reads the links, as
    numbers, from the shared folder (any that ``pyarrow.fs`` opens), so the driver holds none of them."""
    n = nodes.count()
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    ends = materialize(ranked(ends, [F.asc("id")], "k").select("id", (F.col("k") - 1).alias("k")), "ends")
    number = lambda c: ends.select(F.col("id").alias(c), F.col("k").alias(f"{c}_k"))
    arcs = links.select("src", "dst", "weight").join(number("src"), "src").join(number("dst"), "dst")
    arcs = materialize(arcs.select(*[F.col(f"{c}_k").cast("int").alias(c) for c in ("src", "dst")], F.col("weight").cast("int").alias("weight")), "arcs")
    search = _brandes(arcs._litsieve_path, ends.count())
    # a row is one search over the graph: few bytes, much work, so the number of tasks is given; nodes without links
    # out are on no path from themselves to another
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    b = arcs.select(F.col("src").alias("k")).distinct().repartition(tasks, "k").mapInPandas(search, "k bigint, b double").groupBy("k").agg(F.sum("b").alias("b"))
    b = materialize(b.join(ends, "k").select("id", "b"), "between")  # written, or every later pass would search again
    release(arcs)
    release(ends)
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    return nodes.join(b, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def minmax(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<column>_norm``: scaled to 0..1; all equal, or null, gives 0."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        span = F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))
        out = out.withColumn(f"{c}_norm", F.coalesce((F.col(c) - F.col(f"lo_{c}")) / span, F.lit(0.0)))
    return out.drop(*[f"{p}_{c}" for c in columns for p in ("lo", "hi")])


def weighted(weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    w = {k: v / total for k, v in weights.items()} if total else {k: 1 / len(weights) for k in weights}
    out = F.lit(0.0)
    for k, v in w.items():
        out = out + F.lit(v) * F.col(f"{k}_norm")
    return out


def influence(metrics: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds the normalised metrics, ``influence_score`` and ``rank`` (ties: by id)."""
    x = minmax(metrics.withColumn("citations", F.log1p(F.col("citation_count").cast("double"))), *weights)
    x = x.withColumn("influence_score", F.round(weighted(weights), 10))
    return ranked(x, [F.desc("influence_score"), F.asc("paper_id")], "rank")


def _paper_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("paper_id").agg(F.max(F.struct("ordinal", "citation_count")).alias("x")).select("paper_id", F.coalesce("x.citation_count", F.lit(0)).alias("citation_count"))


def simple_influence(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Influence without power iteration: share of all reference weight as rank, weighted in-degree, betweenness 0."""
    nodes, links = graph(edges, papers)
    total = links.agg(F.sum("weight").alias("all"))
    d = in_degree(links)
    m = _paper_counts(papers).join(d.withColumnRenamed("id", "paper_id"), "paper_id", "left").crossJoin(F.broadcast(total))  # one row
    m = m.select("paper_id", "citation_count", F.coalesce(F.col("references") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("pagerank"), F.coalesce("references", F.lit(0)).alias("in_degree"), F.lit(0.0).alias("betweenness"))
    return influence(m)


def full_influence(edges: DataFrame, papers: DataFrame, with_betweenness: bool = True) -> DataFrame:
    """Every step reads written tables, so that none plans and runs again what ``edges`` and ``papers`` are made by."""
    papers = materialize(papers.select("ordinal", "paper_id", "doi", "citation_count"), "papers")
    links = materialize(_links(edges, papers), "links")
    nodes = materialize(_nodes(papers, links), "nodes")
    tidy(nodes.sparkSession)
    m = _paper_counts(papers)
    parts = [pagerank(nodes, links), in_degree(links).select("id", "in_degree")]
    parts.append(betweenness(nodes, links) if with_betweenness else nodes.select("id", F.lit(0.0).alias("betweenness")))
    for x in parts:
        m = m.join(x.withColumnRenamed("id", "paper_id"), "paper_id", "left")
    out = influence(m.fillna(0, ["pagerank", "in_degree", "betweenness"]))
    for x in (papers, links, nodes):  # the ranks are written
        release(x)
    return out
