"""Pairwise links to groups: hash-to-min.

Every vertex holds a cluster set, as rows (vertex, member). In each round a vertex sends its set to the set's
smallest member, and that member to all others of the set; the rounds end when no set changes. At the end the
smallest vertex of a component holds the whole component and every other vertex holds the smallest.

Sets are rows, never arrays, so a component may be of any size. The smallest member of each set is found with a
combining aggregate. Vertices whose sets are large are joined through a broadcast of at most ``MAX_HOT`` rows,
so no shuffle partition receives one vertex's whole set.

Defined results: null sides and self links link nothing; repeats and either order count once; an empty table
has no groups; a record with no link is in no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions.ids import arxiv_key, doi_key
from litsieve.session import materialize, release

#: Vertices with large sets that are joined by broadcast: a set is large from 1/MAX_HOT of all rows.
MAX_HOT = 10_000
LEAST_HOT = 100_000


def hash_to_min(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (columns a, b): ``root`` is a number that its component's vertices share.

    The rounds work on numbers, which aggregate and compare faster than strings; they are given once, in a
    written table, and are exact."""
    l = materialize(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    names = materialize(l.select(F.col("a").alias("name")).union(l.select("b")).distinct().select("name", F.monotonically_increasing_id().alias("n")), "vertices")
    l = l.join(names.select(F.col("name").alias("a"), F.col("n").alias("x")), "a").join(names.select(F.col("name").alias("b"), F.col("n").alias("y")), "b").select("x", "y")
    sets = l.select(F.col("x").alias("v"), F.col("y").alias("u")).union(l.select("y", "x"))
    sets = sets.union(sets.select("v", "v")).distinct()
    sets = materialize(sets, "sets")
    before = None
    while True:  # every round that changes a set brings a vertex nearer to its component's smallest
        small = sets.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = materialize(small, "smallest")
        # the sets' state: a round that changes none leaves both figures
        now = small.agg(F.sum("n"), F.sum(F.xxhash64("v", "m", "n").cast("decimal(38,0)")), F.count("*"), F.max("n")).first()
        if now == before or not now[2]:
            release(small)
            break
        limit = max(LEAST_HOT, (now[0] or 0) // MAX_HOT)
        if now[3] > limit:
            hot = small.where(F.col("n") > limit)
            hot_sets = sets.join(F.broadcast(hot.select("v", "m")), "v")
            cold_sets = sets.join(F.broadcast(hot.select("v")), "v", "left_anti").join(small.where(F.col("n") <= limit).select("v", "m"), "v")
            joined = hot_sets.unionByName(cold_sets)
        else:
            joined = sets.join(small.select("v", "m"), "v")
        new = joined.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
        new = materialize(new.distinct(), "sets")
        release(sets)
        release(small)
        sets, before = new, now
    root = sets.groupBy("v").agg(F.min("u").alias("root"))
    return names.join(root.withColumnRenamed("v", "n"), "n").select(F.col("name").alias("v"), "root")


def identifier_links(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """(a, b): records linked by earlier matches, by the same DOI or by the same arXiv id. A shared identifier
    is linked as a star around the smallest record that has it, so that a hot one costs a row per record."""
    out = match_pairs.select(F.col("paper_id_a").alias("a"), F.col("paper_id_b").alias("b"))
    keys = papers.select("paper_id", F.explode(F.array(F.concat(F.lit("doi "), doi_key("doi")), F.concat(F.lit("arxiv "), arxiv_key("arxiv_id")))).alias("key"))
    keys = keys.where("key is not null and paper_id is not null").distinct()
    centre = keys.groupBy("key").agg(F.min("paper_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return out.unionByName(keys.join(centre, "key").select("a", F.col("paper_id").alias("b")))


def groups(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """(paper_id, root) of every linked record, those missing from papers included."""
    return hash_to_min(identifier_links(papers, match_pairs)).select(F.col("v").alias("paper_id"), "root")


def paper_groups(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """p6_found: (paper_id, group_id) of each record of papers in a group of two or more such records;
    ``group_id`` is the smallest of them in byte order."""
    g = materialize(groups(papers, match_pairs).join(papers.select("paper_id").distinct(), "paper_id"), "groups")
    named = g.groupBy("root").agg(F.min("paper_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return g.join(named, "root").select("paper_id", "group_id")


def group_sizes(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """How many groups have how many records."""
    return paper_groups(papers, match_pairs).groupBy("group_id").count().groupBy(F.col("count").alias("records")).agg(F.count("*").alias("n_groups"))
