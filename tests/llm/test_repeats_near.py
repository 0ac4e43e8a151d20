import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from fieldglass.llm import near, repeats
from fieldglass.llm.names import word_names
from tests.llm import brute

DOCS = "doc_id long, text string, kept string"


def documents(sf="sf0.01"):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


def invented(seed, n=60, letters=3):
    """Few different words, runs and passages in common: hard for parsing that must agree."""
    r = random.Random(seed)
    base = [[r.choice("abcdefgh"[:letters]) * r.choice([1, 1, 2]) for _ in range(r.randint(60, 200))] for _ in range(4)]
    out = []
    for d in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            if r.random() < 0.6:
                b = r.choice(base)
                i = r.randrange(len(b) - 40)
                w += b[i : i + r.randint(40, 90)]
            else:
                w += [r.choice("abcdefgh"[:letters])] * r.randint(1, 70) if r.random() < 0.4 else [r.choice("xyzuvw") for _ in range(r.randint(1, 60))]
        out.append((d * 3 - 20, " ".join(w)))
    return out


EDGES = [(5, None), (6, ""), (7, " \n\t "), (1, "one two"), (2, "one two"), (8, "Ça va " * 40), (3, "Ça va " * 40), (9, "w " * 30_000), (4, "w " * 20_000), (10, "　wide space " * 60)]


@pytest.mark.parametrize("docs", [EDGES, [], *(invented(s, letters=2 + s % 4) for s in range(4))], ids=["edges", "empty", *"abcd"])
def test_repeats(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    found = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in repeats.cut_repeats(df).collect()}
    assert found == brute.repeats(docs)


def test_repeats_documents(spark):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op2_repeats(spark, "/root/testdata/sf0.01").collect()}
    want = brute.repeats(documents())
    assert found == want
    assert sum(x[1] for x in found.values()) > 1000


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, ""), (1, text, ""), (None, text, ""), (2, "new " + text, ""), (2, text + " new", "")]
    found = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.cut_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert found == [(0, 80, 0), (1, 80, 0), (1, 80, 0), (2, 81, 80), (2, 81, 80)]


@pytest.mark.parametrize("docs", [EDGES, []], ids=["edges", "empty"])
def test_near_edges(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, 85).collect()}
    assert found == brute.near(docs)


def test_near_documents(spark):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near.op9_near(spark, "/root/testdata/sf0.01").collect()}
    want = brute.near(documents())
    assert found == want
    assert sum(d != c for d, (_, c) in found.items()) > 30


def test_near_chain(spark):
    """Neighbours are alike, the ends are not; links that no common least document shows."""
    base = [f"w{i}" for i in range(300)]
    docs = []
    for k in range(40):
        w = list(base)
        for j in range(k):
            w[(7 * j) % 300] = f"new{j}"
        docs.append((100 - k, " ".join(w)))
    docs += [(200 + k, t + f" tail{k}") for k, (_, t) in enumerate(docs[:5])] + [(d, t) for d, t in docs[:3]]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, 85).collect()}
    assert found == brute.near(docs)


def test_near_stage_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text, "k"), (2, text + " x", "k"), (2, text + " x", "k"), (None, text, "k"), (9, "else", "k"), (8, None, "k")]
    out = near.stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 8, 9]


def test_near_shared_ids(spark):
    """Rows that share an id are one vertex, whichever of their texts a link is by; sets of equal size are told apart."""
    words = [[f"{c}{i}" for i in range(80)] for c in "abcd"]
    a, b, c, d = (" ".join(w) for w in words)
    docs = [(5, a), (5, b), (7, a + " x"), (9, b + " y"), (3, c), (11, c), (11, d), (12, d + " z"), (12, None), (20, "else")]
    found = near.near_duplicates(spark.createDataFrame([(i, t, "k") for i, t in docs], DOCS), 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5), (11, 3), (11, 3), (12, 3), (12, 3), (20, 20)]


def test_near_stage_keeps_other_texts_of_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(5, a, "k"), (5, b, "k"), (7, b + " x", "k"), (5, b, "k"), (None, a, "k"), (None, a, "k")]
    out = near.stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, a), (0, a), (5, a), (5, b)]


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


HALF = "".join(chr(97 + i * i % 23) for i in range(1 << 14))
LONG_WORDS = [(HALF + "q" * (1 << 14), "q" * (1 << 14) + HALF), *((thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096))]


@pytest.mark.parametrize("one, two", LONG_WORDS, ids=["halves", "1k", "2k", "4k"])
def test_long_words_are_told_apart(spark, one, two):
    names, _ = word_names([f"{one} {two}".encode()])
    assert (names[:, 0] != names[:, 1]).all()
    rest = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"{one} {rest[:100]}"), (2, f"{two} {rest[:100]}"), (3, " ".join([one] * 30)), (4, " ".join([two] * 30)), (5, f"{rest[:150]} {one} {rest[150:]}"), (6, f"{rest[:150]} {two} {rest[150:]}")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in repeats.cut_repeats(df, width=20).collect()} == brute.repeats(docs, 20)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, 85).collect()} == brute.near(docs)


def test_texts_of_several_parts(spark):
    r = random.Random(5)
    some = [f"{r.getrandbits(200):x}" for _ in range(60_000)]  # some 3 MB
    docs = [(1, " ".join(some)), (2, " ".join(some[20_000:50_000] + some[:45_000])), (3, " ".join(some[1:] + ["x"])), (4, " ".join(some[100:180]))]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in repeats.cut_repeats(df).collect()} == brute.repeats(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, 85).collect()} == brute.near(docs)


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_anchors(seed):
    """Whatever is around a window, its anchor's place and key are those of the window."""
    r = random.Random(seed)
    base = [r.choice("ab" if seed % 2 else "abcdefghijklmnop") for _ in range(300)]
    texts = [" ".join([r.choice("abq") for _ in range(r.randint(0, 90))] + base[(i := r.randrange(200)) : i + 100] + [r.choice("ab")] * r.randint(0, 80)) for _ in range(12)]
    found = {}
    for _, _, p in repeats.parsed([t.encode() for t in texts], 50):
        for first, count, key, start in zip(p.first, p.count, p.keys(), p.anchor[2], strict=True):
            for at in range(first, first + count):
                name = int(p.window_names(np.array([at]))[0][0])
                assert found.setdefault(name, (int(key), int(start - at))) == (int(key), int(start - at))
    assert len(found) > 50
