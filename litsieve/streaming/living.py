"""Incremental corpus updates: new records are found, deduplicated and appended by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.operators.dedup import batch_first_seen
from litsieve.session import shared_dir


def new_records(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """The first copies of records whose id isn't in the corpus. The corpus' ids are the greater side; the join is
    left to the optimizer."""
    first = batch.groupBy("paper_id").agg(F.min("ordinal").alias("ordinal"))
    fresh = batch.join(first, ["paper_id", "ordinal"], "left_semi").join(corpus.select("paper_id").distinct(), "paper_id", "left_anti")
    return batch_first_seen(fresh)


def update(spark: SparkSession, incoming: str, corpus: str, checkpoint: str, columns: list[str], files_per_batch: int | None = None) -> None:
    """Run through all files that have arrived under ``incoming`` and append what is new to the parquet table
    ``corpus``. The checkpoint keeps what was read; a batch that is run again finds its ids in the corpus and adds
    nothing."""
    schema = spark.read.parquet(incoming).schema
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def append(batch: DataFrame, _: int) -> None:
        new_records(batch.select(*columns), spark.read.parquet(corpus)).select(*columns).write.mode("append").parquet(corpus)

    q = stream.parquet(incoming).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def replay(papers: DataFrame, by: str = "ordinal") -> DataFrame:
    """A review kept up to date: the corpus starts with the first half of the records (by order of ingestion) and the
    second half arrives as a file stream. Returns the corpus after the update: paper_id and ordinal."""
    spark = papers.sparkSession
    home = f"{shared_dir(spark)}/living-{uuid.uuid4().hex}"
    columns = ["paper_id", "ordinal", "doi", "title"]
    p = papers.select(*columns).where("paper_id is not null")
    middle = p.agg((F.max(by) / 2).alias("m")).first()[0] or 0
    p.where(F.col(by) <= middle).groupBy("paper_id").agg(F.max(F.struct(*[c for c in columns if c != "paper_id"])).alias("x")).select("paper_id", "x.*").select(*columns).write.parquet(f"{home}/corpus")
    p.where(F.col(by) > middle).write.parquet(f"{home}/incoming")
    update(spark, f"{home}/incoming", f"{home}/corpus", f"{home}/checkpoint", columns)
    return spark.read.parquet(f"{home}/corpus").select("paper_id", "ordinal")


def windowed_arrivals(spark: SparkSession, path: str, watermark: str = "10 days") -> DataFrame:
    """Records per day of retrieval and database, late rows up to the watermark included: an addition, for streams."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("source.timestamp").try_cast("timestamp")).where("at is not null")
    return s.withWatermark("at", watermark).groupBy(F.window("at", "1 day").alias("w"), F.col("source.database").alias("database")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "database", "n")


__all__ = ["new_records", "replay", "update", "windowed_arrivals"]
