import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litsieve.functions import ids, similarity, stats, text


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_doi(spark):
    given_ = ["https://dx.doi.org/10.1016/J.TEST.2024", "DOI:10.5555/1234567", "  ", None, "10.1/x", "http://doi.org/10.2/Y "]
    assert column(spark, given_, ids.normalize_doi) == ["10.1016/j.test.2024", "10.5555/1234567", None, None, "10.1/x", "10.2/y"]


def test_keys_reject_placeholders(spark):
    assert column(spark, ["10.0000/unknown", "n/a", "none", "-", "", None, "DOI: 10.90022/XDF.2025.C5", " 10.90022/xdf.2025.c5"], ids.doi_key) == [None] * 6 + ["10.90022/xdf.2025.c5"] * 2
    assert column(spark, ["0000.00000", "unknown", "arXiv:2401.12345v2", "hep-th/9901001v1", None], ids.arxiv_key) == [None, None, "2401.12345", "hep-th/9901001", None]


def test_arxiv(spark):
    assert column(spark, ["arXiv:2401.12345v1", "arxiv:hep-th/9901001v1", "1234.5678v10", " "], ids.normalize_arxiv) == ["2401.12345", "hep-th/9901001", "1234.5678", None]
    assert column(spark, ["arXiv:2401.12345v1"], lambda c: ids.normalize_arxiv(c, True)) == ["2401.12345v1"]


def test_title(spark):
    assert column(spark, ["GPT-3: A Survey", "AI & ML: The Future?", "", None, "Größe　und Maß"], text.normalize_title) == ["gpt3 a survey", "ai ml the future", "", None, "größe und maß"]


def test_dates(spark):
    d = datetime.date
    values = ["2024/01/15", "15-01-2024", "2024-01", "2024", "2024-01-15T10:30:00Z", "13-13-2024", "1899-01-01", None, "2024-02-30"]
    assert column(spark, values, text.parse_date) == [d(2024, 1, 15), d(2024, 1, 15), d(2024, 1, 1), d(2024, 1, 1), d(2024, 1, 15), None, None, None, d(2024, 2, 1)]
    assert column(spark, ["2024-02-30", "2024-02"], lambda c: text.parse_date(c, strict=True)) == [None, d(2024, 2, 1)]


def test_abstract(spark):
    got = column(spark, ["a" * 5001, "a" * 5000, "  ", None, "a  \n b"], text.clean_abstract)
    assert got == ["a" * 5000 + "...", "a" * 5000, None, None, "a b"]


def test_sentences(spark):
    assert column(spark, ["Short. This one is long enough to be kept. x"], text.sentences) == [["This one is long enough to be kept"]]


def test_escape(spark):
    assert column(spark, ["50% of {A & B}"], text.bibtex_escape) == [r"50\% of \{A \& B\}"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcde ", max_size=30), st.text("abcdé ", max_size=30))
def test_lcs_matches_table(a, b):
    assert similarity.lcs_length(a, b) == lcs(a, b)


def test_indel_known_value(spark):
    assert similarity.indel_ratio("ai survey", "ai survey 2024") == pytest.approx(0.7826, abs=1e-4)
    df = spark.createDataFrame([("ab", "ab"), ("", ""), (None, "x")], "a string, b string")
    assert [r.r for r in df.select(similarity.indel(F.col("a"), F.col("b")).alias("r")).collect()] == [1.0, 1.0, None]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(similarity.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.70710678) and got[1:] == [None, None]


def test_tails_against_tables():
    assert stats.normal_sf2(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_sf2(0.0, 5) == pytest.approx(1.0)
