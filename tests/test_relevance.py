import re

import pytest

from fieldglass.operators import terms as M
from fieldglass.plans import relevance as R

TERMS = "family string, term string, place int, variant string, exclusion boolean"
DICTIONARY = [
    ("inputs", "dap", 1, "DAP", False), ("inputs", "dap", 1, "డీఏపీ", False), ("inputs", "dap", 1, "d.a.p", False), ("topics", "seeds", 0, "seeds", False), ("topics", "seeds", 0, "seed funding", True),
    ("topics", "seeds", 0, "విత్తన", False), ("topics", "seeds", 0, "నిధుల విత్తన", True), ("crops", "paddy", 2, "paddy purchase centre", False), ("crops", "paddy", 2, "paddy", None), ("crops", "share", 3, "100%", False),
    ("crops", "c++", 4, "c++ (new)", False), ("markers", "state", 0, "our state", False), ("districts", "warangal", 9, "Warangal", False), ("districts", "adilabad", 8, "adilabad", False), ("topics", "void", 7, "", False), ("topics", "void", 7, None, False),
]
TEXTS = [
    "An update on DAP.", "update", "dap", "xdapx", "(d.a.p) came", "d a p", "dx a.p", "seeds and seed funding", "SEEDS!", "seedsé", "éseeds", "seeds2", "కొత్తడీఏపీలు", "విత్తనాలు", "నిధుల విత్తనాలు", "seed  funding seeds", "paddy\npurchase centre",
    "the paddy purchase centre", "100% of", "1100%x", "100%", "c++ (new)", "c++ new", "warangal adilabad", "Adilabad, WARANGAL", "in our state", "our statement", "", None, "\n", "dap " * 5000, "డీ ఏపీ",
]


def brute(text, dictionary=DICTIONARY):
    hit = lambda v: v in text if re.search("[ఀ-౿]", v) else re.search("(^|[^a-z])" + re.escape(v.lower()) + "([^a-z]|$)", text.lower())
    found = {}
    for family, term, place, v, x in dictionary:
        if text and v and hit(v):
            found.setdefault((place, family, term), []).append(bool(x))
    return [t[2] for t in sorted(found) if not any(found[t])]


def test_terms(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    found = {r.k: r.terms for r in M.matched_terms(texts, spark.createDataFrame(DICTIONARY, TERMS), ["k"]).collect()}
    assert found == {k: brute(t) for k, t in enumerate(TEXTS) if brute(t)}


def test_no_terms_no_texts(spark):
    texts, known = spark.createDataFrame([(1, "dap")], "k long, text string"), spark.createDataFrame(DICTIONARY, TERMS)
    assert not M.matched_terms(texts, known.where("false"), ["k"]).collect() and not M.matched_terms(texts.where("false"), known, ["k"]).collect()


CASES = [
    # title, text, author, kind -> topical, regional, accepted
    (("Paddy sown in our state", "Paddy sown in our state early", None, None), (0.75, 0.6, True)),
    (("Minister speaks", "He named paddy once " + "x" * 600, "desk our state", None), (0.15, 0.4, False)),
    ((None, "dap and seeds in warangal", None, None), (1.0, 0.5, True)),
    ((None, "dap " + "x" * 600, None, "agriculture_programme"), (0.3, 0.4, False)),
    (("dap", "dap at guntur", None, "creator"), (0.75, 0.0, False)),
    (("dap", "dap at guntur and warangal", None, None), (0.75, 0.35, False)),
    (("dap", "dap at guntur, our state", None, None), (0.75, 0.45, True)),
    (("1 acre paddy land for sale", "our state, open plots", None, None), (0.6, 0.6, False)),
    (("", "paddy in our state", None, None), (0.15, 0.6, False)),
    ((None, None, None, None), (0.0, 0.0, False)),
    (("seeds dap paddy", "seeds dap paddy warangal our state", "Warangal desk", "creator"), (1.0, 1.0, True)),
]


def test_scores(spark):
    rows = [(k, *case) for k, (case, _) in enumerate(CASES)]
    mentions = spark.createDataFrame(rows, "id long, title string, text string, author_context string, source_kind string")
    found = {r.id: r for r in R.assess(mentions, spark.createDataFrame(DICTIONARY, TERMS), ["guntur"]).collect()}
    for k, (_, (topical, regional, accepted)) in enumerate(CASES):
        assert (found[k].topical, found[k].regional, found[k].accepted) == (pytest.approx(topical), pytest.approx(regional), accepted), (k, found[k])
    assert found[10].districts == ["warangal"] and "places outside [guntur]" in found[4].reason and found[7].listing


def test_stage_twice(spark):
    mentions = [(1, None, "dap in our state", "x", 7, "normalized", "pending"), (2, "t", None, "nothing", None, "normalized", "pending"), (3, "dap", "dap", "x", 7, "normalized", "accepted"), (4, None, "dap", "x", 8, "raw", "pending"), (5, "dap", None, "seeds", 8, "normalized", "pending")]
    before = spark.createDataFrame(mentions, "id long, title string, content_text string, original_text string, author_id long, status string, relevance_status string")
    authors = spark.createDataFrame([(7, "desk", None), (8, None, "channel-kind:creator")], "author_id long, name string, bio string")
    known = spark.createDataFrame(DICTIONARY, TERMS)
    after = R.relevance_stage(before, authors, known)
    assert {r.id: (r.status, r.relevance_status) for r in after.collect()} == {1: ("normalized", "accepted"), 2: ("rejected", "rejected"), 3: ("normalized", "accepted"), 4: ("raw", "pending"), 5: ("normalized", "accepted")}
    assert sorted((r.mention_id, r.kind) for r in R.stage_events(before, after).collect()) == [(1, "RELEVANCE_ACCEPTED"), (2, "RELEVANCE_REJECTED"), (5, "RELEVANCE_ACCEPTED")]
    again = R.relevance_stage(after.select(before.columns), authors, known)
    assert sorted(map(tuple, again.select(before.columns).collect()), key=str) == sorted(map(tuple, after.select(before.columns).collect()), key=str)
    assert not R.stage_events(after.select(before.columns), again).collect()
