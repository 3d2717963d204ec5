"""Every query with SQL against another engine, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from litsieve.plans import catalog


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return repr(round(float(v), 8) + 0.0) if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["ingested_records", "bibtex_entries", "pagerank", "fuzzy_title_leaders", "dedup_canonical", "canonical_map", "effect_sizes", "meta_p_values"])
def test_runs_without_sql(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "rank" and df.count() > 0


def test_the_subpackage_is_optional():
    root = os.path.dirname(entry.__file__)
    own = os.path.join(root, "litsieve", "llm")
    for d, _, files in os.walk(os.path.join(root, "litsieve")):
        if d.startswith(own):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "litsieve.llm" not in open(os.path.join(d, f)).read(), f
