"""Documents of several sources in target shares, by a time-varying curriculum.

A source's weight is a piecewise linear schedule over training time 0..1 whose integral is its target share; all
weights sum to 1 at every time. Integrating it gives the source's cumulative token demand. Its documents are laid
end to end in a random but fixed order, pass after pass, and a use that begins at token offset c is trained at
the time when the demand reaches c: the inverse of the integral. Uses are range-sorted by time.

The number of tokens is the largest at which every source can reach its share within its ``max_repeats``. The
shares of sources without documents are spread over the others in proportion (the report names both figures).

Offsets are prefix sums in two steps, over hash buckets of some thousand documents and within each, so a source
may hold any part of all documents.

Defined results: null and empty texts have no tokens and are never drawn; source names are compared without case,
outer blanks and kind of dash; documents of null or unlisted sources are not drawn; repeated rows are drawn as often
as they occur; equal targets rows of one source add up; a share of 0 or null draws nothing; an empty table gives an
empty draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm.tokens import VOCABULARY, with_token_counts
from litsieve.session import materialize

#: Documents per bucket of the prefix sums, about.
BUCKET = 4096
SEED = 20240501
#: How much heavier a source weighs at the end than at the start: large sources recede, small ones come late.
TILT = 0.6


def source_name(c: Column) -> Column:
    """One spelling per source."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit(""))


def schedules(shares: DataFrame, tilt: float = TILT) -> DataFrame:
    """(source, share, slope): the weight at time t is share * (1 + slope * (2t - 1)). Slopes average to 0 by
    share, so that the weights sum to 1 at any time; sources with a greater share get the lower slope."""
    mean = shares.agg(F.sum(F.col("share") * F.col("share")).alias("mean"))
    x = shares.crossJoin(mean).withColumn("d", F.col("mean") - F.col("share"))  # one row
    top = x.agg(F.max(F.abs("d")).alias("top"))
    return x.crossJoin(top).select("source", "share", F.coalesce(F.lit(tilt) * F.col("d") / F.nullif("top", F.lit(0.0)), F.lit(0.0)).alias("slope"), *[c for c in shares.columns if c not in ("source", "share")])


def inverse(fraction: Column, slope: Column) -> Column:
    """The time t at which the integral t + slope * (t^2 - t) of a weight reaches ``fraction`` of its total."""
    b = F.lit(1.0) - slope
    root = (F.sqrt(b * b + 4 * slope * fraction) - b) / F.nullif(2 * slope, F.lit(0.0))
    return F.least(F.greatest(F.when(F.abs(slope) < 1e-9, fraction).otherwise(root), F.lit(0.0)), F.lit(1.0)) + F.lit(0.0)


def plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target source that has tokens: share (rescaled), target_share, max_repeats, tokens, demand, slope."""
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and coalesce(max_repeats, 1) > 0")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    x = t.join(have, "source")
    total = x.agg(F.sum("target_share").alias("sum"))
    x = x.crossJoin(total).withColumn("share", F.col("target_share") / F.col("sum")).drop("sum")
    size = x.agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).alias("size"))
    return schedules(x.crossJoin(size).withColumn("demand", F.col("share") * F.col("size")))


def counted(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").where("text is not null and text <> '' and source is not null and doc_id is not null")
    return materialize(with_token_counts(d, path).where("n_tokens > 0"), "tokens")


def draw(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the plan, the draw): (doc_id, source, n_tokens, use_no, at) with ``at`` the training time."""
    c = counted(docs, path)
    p = materialize(plan(c, targets), "plan")  # a row per source of the targets table
    n = c.count()
    d = c.join(F.broadcast(p), "source")
    passes = F.sequence(F.lit(1), F.col("max_repeats"))
    need = F.least(F.col("max_repeats"), F.ceil(F.col("demand") / F.col("tokens")).cast("int") + 1)  # one to fill up from
    uses = d.withColumn("pass", F.explode(F.filter(passes, lambda i: i <= F.greatest(need, F.lit(1)))))
    # each pass has its own order, so every pass is an end-to-end layout of all documents of the source
    order = F.xxhash64(F.lit(SEED), "pass", "doc_id")
    buckets = max(1, n // BUCKET)
    uses = uses.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    uses = materialize(uses.select("doc_id", "source", "n_tokens", "pass", "order", "bucket"), "uses")
    sums = uses.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("source", "pass").orderBy("bucket")) - F.col("sum")).drop("sum")
    within = Window.partitionBy("source", "pass", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    x = uses.withColumn("c", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, ["source", "pass", "bucket"]).join(F.broadcast(p), "source")
    begin = (F.col("pass") - 1) * F.col("tokens") + F.col("before") + F.col("c")
    x = materialize(x.select("doc_id", "source", "n_tokens", "pass", "demand", "slope", begin.alias("begin")), "offsets")
    fits = F.col("begin") + F.col("n_tokens") / 2 <= F.col("demand")
    # before the first use that would overshoot, something may be left: the later use that fits it best closes it
    over = x.where(~fits).groupBy("source").agg(F.min("begin").alias("gap_at"))
    late = x.join(F.broadcast(over), "source").where(F.col("begin") >= F.col("gap_at"))  # a row per source
    miss = F.abs(F.col("demand") - F.col("gap_at") - F.col("n_tokens"))
    late = late.where(miss < F.col("demand") - F.col("gap_at"))
    best = late.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "begin")).alias("x")).select("source", F.col("x.begin").alias("fill"))
    x = x.join(F.broadcast(over), "source", "left").join(F.broadcast(best), "source", "left")
    x = x.where(F.col("gap_at").isNull() | (F.col("begin") < F.col("gap_at")) | (F.col("begin") == F.col("fill")))
    x = x.withColumn("begin", F.least("begin", F.coalesce("gap_at", "begin")))
    return p, x.select("doc_id", "source", "n_tokens", F.col("pass").cast("int").alias("use_no"), inverse(F.col("begin") / F.col("demand"), F.col("slope")).alias("at"))


def curriculum(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The uses, range-sorted by training time."""
    _, d = draw(docs, targets)
    return d.repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id", "use_no")


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target share, the share aimed at, the share reached, tokens and uses, and the
    most uses of one document."""
    p, d = draw(docs, targets)
    got = d.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("u")).groupBy("source").agg(
        F.sum("t").alias("tokens_drawn"), F.sum("u").alias("uses"), F.max("u").alias("most_uses"), F.count("*").alias("docs_used"))
    total = got.agg(F.sum("tokens_drawn").alias("all"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    x = t.join(p.select("source", F.col("share").alias("share_aimed_at"), "max_repeats"), "source", "left").join(got, "source", "left").crossJoin(total)
    return x.select(
        "source", "target_share", F.coalesce("share_aimed_at", F.lit(0.0)).alias("share_aimed_at"), F.coalesce(F.col("tokens_drawn") / F.col("all"), F.lit(0.0)).alias("share_reached"),
        F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"), F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("uses", F.lit(0)).alias("uses"), "max_repeats", "most_uses",
    )
