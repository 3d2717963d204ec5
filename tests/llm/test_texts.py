"""Truncation, leakage, mixing and splitting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsieve.llm import leakage, mixture, splitting, tokens, truncation
from litsieve.session import table

SUBJECT = ["The trial", "Our review", "A second study", "The cohort", "This analysis", "The panel"]
VERB = ["compared early coaching with usual care", "found no clear difference between arms", "followed adults for many months", "reported small effects on sleep quality", "was stopped before the planned end", "included several older sources"]
TAIL = ["in rural clinics", "among older adults", "after the first wave", "with wide intervals", "despite high attrition", "at every site"]


def sentence(rng):
    return f"{rng.choice(SUBJECT)} {rng.choice(VERB)} {rng.choice(TAIL)}."


def abstracts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = " ".join(sentence(rng) for _ in range(4))
        kind = i % 10
        if kind == 0:
            t = t[: rng.randrange(60, len(t) - 12)]
            while t[-1] in ". " or t.endswith(tuple(x for x in TAIL)):
                t = t[:-1]
        elif kind == 1:
            t = t[:-1]  # complete, without its final mark
        out.append((i, "s", t, kind == 0))
    return out


def test_truncation_on_held_out_truth(spark):
    rows = abstracts(800)
    df = spark.createDataFrame(rows, "id bigint, source string, text string, cut boolean")
    got = {r.id: r.is_cut for r in truncation.truncated(df).collect()}
    truth = {r[0]: r[3] for r in rows}
    hit = sum(got[i] and truth[i] for i in got)
    assert len(got) == 800 and hit / sum(truth.values()) > 0.9 and hit / max(1, sum(got.values())) > 0.9


def test_the_end_of_a_text_does_not_depend_on_what_is_read():
    body = "The trial compared early coaching with usual care in rural clinics and found no difference. " * 30
    for tail in ("", " " * 900, "<p class='" + "x" * 150 + "'></p>" * 40, "&amp;" * 300, " cut of\n" + "\t " * 3000):
        whole, end = truncation._read(body + tail), truncation._read(body + tail, tail=True)
        assert whole[0][-truncation.TAIL :] == end[0][-truncation.TAIL :] and whole[1:] == end[1:]


def test_truncation_edge_cases(spark):
    odd = [(9001, "s", None), (9002, "s", ""), (9003, "s", "n/a"), (9004, "s", "No abstract available."), (9005, "s", "The trial compared early coaching with..."), (9006, None, "The cohort followed adults for many [truncated]"), (9007, "s", " \n "), (9008, "s", "x" * 300_000)]
    rows = [r[:3] for r in abstracts(300)] + odd + [(9005, "s", "The trial compared early coaching with...")]
    df = spark.createDataFrame(rows, "id bigint, source string, text string").withColumn("score", F.lit(1)).withColumn("lang", F.lit("x"))
    got = {}
    for r in truncation.truncated(df).collect():
        got.setdefault(r.id, []).append(r.is_cut)
    assert got[9005] == [True, True] and got[9006] == [True] and not {9001, 9002, 9003, 9004, 9007} & set(got) and 9008 in got
    assert truncation.truncated(df.limit(0)).count() == 0


def test_truncation_on_papers(spark, sf):
    p = table(spark, sf, "papers")
    r = truncation.truncation_report(p).collect()
    assert sum(x.abstracts for x in r) <= p.count() and all(0 <= x.share <= 1 for x in r)


PASSAGES = ["".join(f"word{(i * 37 + j * 11) % 997} " for j in range(60)) for i in range(4)] + ["tiny passage here"]


def naive_runs(text, passage, k=3):
    t, p = leakage.words(text), leakage.words(passage)
    seen = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    hit = set()
    for j in range(len(p) - k + 1):
        if tuple(p[j : j + k]) in seen:
            hit.update(range(j, j + k))
    return len(hit) / max(1, len(p))


def leak_tables(spark):
    filler = "plain filler sentence about nothing at all . " * 20
    w = PASSAGES[0].split()
    docs = [
        (1, filler + PASSAGES[0] + filler), (2, PASSAGES[1].upper().replace(" ", "\n  ")), (3, filler + " ".join(PASSAGES[2].split()[:8])), (4, None), (5, ""), (6, filler),
        (7, " ".join(x + (" inserted" if k % 7 == 3 else "") for k, x in enumerate(w[:30]))), (8, f"<p>{' '.join(w[:25])}</p>" + filler + "<b>" + " ".join(w[30:50]) + "</b>"), (9, PASSAGES[1]), (9, PASSAGES[1]),
    ]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame([(i, p, "b") for i, p in enumerate(PASSAGES)] + [(50, None, "b"), (51, "", "b")], "item_id bigint, passage string, text string")
    return docs, d, q


def found(spark, docs, items, column=None):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").coalesce(1)
    x = leakage.leaks(d, spark.createDataFrame(list(enumerate(items)), "item_id bigint, passage string")).collect()
    return sorted((r.doc_id, r.item_id, *([r[column]] if column else [])) for r in x)


@pytest.mark.parametrize("block", [leakage.BLOCK, 300])
def test_passages_that_many_items_share_leak(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK", block)
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    one, other, front = text(40), text(40), text(20)
    nearly = [one[:k] + [f"x{k}"] + one[k + 1 :] for k in (5, 15, 25, 35)]
    edited = [w if k % 6 else "edit" for k, w in enumerate(one)]
    assert found(spark, [" ".join(text(30) + one + text(30)), " ".join(text(60))], [" ".join(one)] * 5 + [" ".join(other)]) == [(0, k) for k in range(5)]
    assert found(spark, [" ".join(text(30) + edited + text(30))], [" ".join(x) for x in nearly]) == [(0, k) for k in range(4)]
    # what many different passages start with anchors if it is a third of them, and not if it is less
    items = [" ".join(front + text(n)) for n in (30, 30, 30, 30, 60)]
    assert found(spark, [" ".join(text(30) + front + text(30))], items) == [(0, k) for k in range(4)]
    assert found(spark, [" ".join(text(30) + front[:6] + text(30))], items) == []


def test_short_passages_match_as_a_whole(spark):
    docs = ["Alpha beta gamma, delta", "beta alpha", "gamma", ""]
    assert found(spark, docs, ["alpha beta", "Beta", "alpha beta gamma", "alpha gamma", "gamma delta epsilon"]) == [(0, 0), (0, 1), (0, 2), (1, 1)]


def test_the_longest_match_is_reported(spark):
    w = [f"w{i}" for i in range(80)]
    doc = " ".join(w[:20] + ["gap"] * 3 + w[20:60] + ["gap"] + w[60:78])
    assert found(spark, [doc, " ".join(w[:30])], [" ".join(w)] * 3, "longest") == [(0, 0, 40), (0, 1, 40), (0, 2, 40), (1, 0, 30), (1, 1, 30), (1, 2, 30)]


def test_leaks_against_naive_coverage(spark):
    docs, d, q = leak_tables(spark)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(d, q).collect()}
    want = {(i, j) for i, t in docs if t for j, p in enumerate(PASSAGES[:4]) if naive_runs(t, p) >= 1 / 3}
    assert got == want == {(1, 0), (2, 1), (7, 0), (8, 0), (9, 1)}
    r = {r.doc_id: r for r in leakage.leaks(d, q).where("doc_id in (1, 8)").collect()}
    assert r[1].longest == 60 and r[8].longest == 25 and r[8].pieces == 2
    assert leakage.leaked(d.limit(0), q).count() == 0


def test_suffix_search_matches_a_scan():
    rng = np.random.default_rng(2)
    seq = np.append(rng.integers(1, 4, 300), np.zeros(leakage.DEPTH, int))
    q = np.append(rng.integers(1, 4, 40), np.zeros(leakage.DEPTH, int))
    at = np.arange(36)
    sa = leakage._suffix_array(seq, np.unique(leakage.Queries.hash(seq, np.arange(298), 3)))
    lo, hi = leakage.bounds(seq, sa, q, at, 4)
    for i in at:
        want = [p for p in range(297) if list(seq[p : p + 4]) == list(q[i : i + 4])]
        assert sorted(x for x in sa[lo[i] : hi[i]] if x < 297) == want


def test_clean_documents(spark, sf):
    d, i = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    bad = leakage.leaked(d, i).select("doc_id").distinct().count()
    assert bad > 0 and leakage.clean_documents(d, i).count() == d.count() - bad


def check_pieces(text, limit, overlap):
    enc = tokens.encoder()
    lengths = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)])
    parts = splitting.split(text, enc, lengths, limit, overlap)
    raw = text.encode()
    ids = enc.encode_ordinary(text)
    off = np.append(0, np.cumsum(lengths[ids]))
    at = 0
    for k, (s, e, n) in enumerate(parts):
        piece = raw[s:e].decode()
        assert len(enc.encode_ordinary(piece)) <= limit and s <= at < e
        if k:
            assert overlap <= np.searchsorted(off, at) - np.searchsorted(off, s) <= overlap + 3
        at = e
    assert at == len(raw)
    return [raw[s:e].decode() for s, e, _ in parts]


@pytest.mark.parametrize("text", ["x " * 900, "deadbeef0123" * 400, "本研究共纳入参与者随访。" * 150, "\n" * 3000, "emoji 😀 " * 400, "# A\n\nText here. " * 150])
def test_pieces_keep_limit_overlap_and_text(text):
    assert len(check_pieces(text, 256, 32)) > 1


def test_cuts_fall_on_structure():
    para = "One two three four five six seven eight nine ten. " * 8
    text = "\n\n".join(f"## Part {i}\n\n{para}" for i in range(6))
    out = check_pieces(text, 256, 16)
    own = out[0]
    assert own.startswith("## Part 0") and out[0].rstrip().endswith("ten.")


def test_pieces_of_documents(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "short", 0), (4, "word " * 5000, 0), (4, "word " * 5000, 0)], "doc_id bigint, text string, piece_no int")
    got = splitting.pieces(d).collect()
    assert {r.doc_id for r in got} == {2, 3, 4} and sum(r.doc_id == 4 and r.piece_no == 0 for r in got) == 2
    assert splitting.oversized(d).distinct().collect()[0].doc_id == 4 and splitting.pieces(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(d, 100, 90)


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["token"] * rng.randrange(5, 60)), rng.choice(["Big", "big ", "BIG", "small"] if i % 9 else ["small"])) for i in range(1500)] + [(9000, None, "big"), (9001, "", "small"), (9002, "a b", None), (9003, "a b", "other")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("share", F.lit(0))
    t = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.4, 3), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixture.shares(d, t).collect()}
    assert s["big"].share_reached == pytest.approx(5 / 9, abs=0.01) and s["small"].share_reached == pytest.approx(4 / 9, abs=0.01) and s["absent"].share_reached == 0
    assert s["big"].most_uses <= 1 and s["small"].most_uses <= 3
    c = mixture.curriculum(d, t)
    at = [r.at for r in c.collect()]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1 and c.groupBy("doc_id", "use_no").count().where("count > 1").count() == 0
    # by its schedule the smaller share grows with time
    first = c.where("at < 0.5").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    early = {r.source: r.n for r in first}
    assert early["small"] / (early["small"] + early["big"]) < 4 / 9
    assert mixture.curriculum(d.limit(0), t).count() == 0


def test_inverse_of_the_schedule(spark):
    df = spark.createDataFrame([(f / 10, s) for f in range(11) for s in (-0.6, 0.0, 0.6)], "f double, s double")
    for r in df.withColumn("t", mixture.inverse(F.col("f"), F.col("s"))).collect():
        assert r.t + r.s * (r.t**2 - r.t) == pytest.approx(r.f, abs=1e-9)
