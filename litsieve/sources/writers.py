"""Results as files: Parquet with CSV beside it, JSON lines and BibTeX. Every writer writes from the executors; a
folder of part files is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.operators import bibtex


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that have none."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_phase(df: DataFrame, folder: str, name: str) -> None:
    """``name``.parquet and ``name``.csv of one phase's result; existing ones are replaced."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    back = df.sparkSession.read.parquet(f"{folder}/{name}.parquet")  # computed once
    flat(back).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_bibtex(papers: DataFrame, path: str, most: int | None = None) -> None:
    """BibTeX entries in order of ingestion, each followed by a blank line; ``most``: only the first so many."""
    e = bibtex.entries(papers)
    if most is not None:
        e = e.orderBy("ordinal").limit(most)
    e.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select(F.concat("entry", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
