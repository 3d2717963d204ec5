import json

from hypothesis import given, settings
from hypothesis import strategies as st

from litsieve.operators import nested

KEYS = st.text(st.characters(blacklist_characters='"\\', blacklist_categories=("Cs", "Cc")), min_size=1, max_size=5)
VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(KEYS, c, max_size=4), max_leaves=12
)


def walk(v, path=""):
    items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
    for k, x in items:
        p = f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else k
        if isinstance(x, dict):
            yield p
        yield from walk(x, p)


def paths(texts):
    import pandas as pd

    df = pd.DataFrame({"origin": "t", "row_id": range(len(texts)), "text": texts})
    out = [(int(i), p) for b in nested._run(False, True)([df]) for i, p in zip(b["row_id"], b["path"])]
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=5), st.booleans())
def test_paths_match_a_parser(values, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only) for v in values]
    want = sorted((i, p) for i, v in enumerate(values) for p in walk(v) if len(texts[i]) > 2)
    assert paths(texts) == want


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(KEYS, VALUES, min_size=1, max_size=4), st.data())
def test_incomplete_texts_have_no_rows(value, data):
    t = json.dumps(value)
    assert paths([t[: data.draw(st.integers(0, len(t) - 1))]]) == []


def test_wrapping_does_not_count():
    t = '{"a": {"b": [1, {"c": "}]\\"{"}]}}'
    want = [(0, "a"), (0, "a.b[1]")]
    for x in (t, "﻿" + t, f"  {t}\n", json.dumps(t), json.dumps(json.dumps(t)), f"callback({t});", f"<pre>{t}</pre>"):
        assert paths([x]) == want, x
    assert paths([None, "", "null", "{}", "[]", '"', "{]}", '{"a": [}]', "no json"]) == []


def test_a_broken_text_does_not_harm_its_neighbours():
    good = '{"a": {"b": 1}}'
    assert paths([good, '{"x": "', good, '{"y": {', good]) == [(0, "a"), (2, "a"), (4, "a")]


def test_very_long_and_deep():
    deep = '{"a":' * 400 + "1" + "}" * 400
    long = json.dumps({"r": [{"i": i} for i in range(50_000)]})
    assert len(paths([deep])) == 399
    assert len(paths([long, deep])) == 50_399


def test_linked_tables(spark):
    page = {"results": [{"id": "https://x/W1", "title": "T", "publication_year": 2020, "cited_by_count": 3, "authorships": [{"author": {"display_name": "A B"}, "institutions": [{"display_name": "U"}]}]}]}
    df = spark.createDataFrame([("cached_pages", 7, json.dumps(page)), ("papers", 8, None)], "origin string, row_id bigint, text string")
    o = nested.json_objects(df, fields=True)
    w, a, f = nested.work_table(o).collect(), nested.author_table(o).collect(), nested.affiliation_table(o).collect()
    assert [(x.row_id, x.work_id, x.title, x.year, x.citation_count) for x in w] == [(7, "https://x/W1", "T", 2020, 3)]
    assert {x.path: x.parent_no for x in a}["results[0].authorships[0]"] == w[0].work_no
    assert [x.name for x in f] == ["U"] and f[0].parent_no in {x.author_no for x in a}


def test_empty_table_and_clashing_columns(spark):
    p = spark.createDataFrame([], "ordinal bigint, raw_data string, text string, origin string, path string")
    c = spark.createDataFrame([(1, '{"a": {}}', "x", 5)], "id bigint, raw_response string, path string, row_id int")
    got = nested.object_paths(nested.corpus_texts(p, c)).collect()
    assert [tuple(r) for r in got] == [("cached_pages", 1, "a")]


def test_any_number_of_wrappings():
    text = '{"a": [{}]}'
    for _ in range(12):
        text = json.dumps(text)
    assert nested.unwrap(text) == '{"a": [{}]}'
