import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import decontaminate as op
from tests.llm import brute
from tests.llm.test_repeats_near import documents

DOCS, ITEMS = "doc_id long, text string, item_id string, term string", "item_id long, text string, n int"


def digest(df):
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_hit", F.size(ids), F.sha2(F.array_join(ids, ","), 256)).collect()}


def benchmark():
    return [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()]


LONG = " ".join(f"t{i}" for i in range(3000))
CASES = {
    "edges": (
        [(1, "A b C d e f g h i j k"), (2, "x a,b.c-d e f g h i j"), (3, None), (4, ""), (5, "--- ..."), (6, "the Élan vital"), (7, "élan vital THE"), (8, "solo"), (9, LONG), (10, "z " + LONG + " " + LONG), (11, "a a a a a a a a a a a a"), (12, "...a b c d e f g h i j..."), (13, "b c d e f g h i j")],
        [(1, "a b c d e f g h i j"), (2, "the Élan"), (3, "solo"), (4, None), (5, ""), (6, "?!"), (7, LONG[500:9000]), (8, "a a a a a a a a a a a"), (9, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (20, "SOLO")],
    ),
    "empty": ([], [(1, "a")]),
    "no items": ([(1, "a")], []),
}


@pytest.mark.parametrize("name", CASES)
def test_edges(spark, name):
    docs, items = CASES[name]
    df = op.find_leaks(spark.createDataFrame([(d, t, "c", "c") for d, t in docs], DOCS), spark.createDataFrame([(*x, 0) for x in items], ITEMS))
    assert digest(df) == brute.leaks(docs, items)


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_random(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op, "BROADCAST_BYTES", broadcast)
    r = random.Random(3)
    docs = [(d, " ".join(r.choice("abcd") for _ in range(r.randint(0, 150)))) for d in range(40)]
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.choice([3, 6, 10, 14])))) for i in range(12)]
    items += [(50, docs[3][1][10:70])]
    df = op.find_leaks(spark.createDataFrame([(d, t, "c", "c") for d, t in docs], DOCS), spark.createDataFrame([(*x, 0) for x in items], ITEMS))
    assert digest(df) == brute.leaks(docs, items)


def test_documents(spark):
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in op.op1_decontaminate(spark, "/root/testdata/sf0.01").collect()}
    assert found == brute.leaks(documents(), benchmark())
    assert sum(x[1] > 0 for x in found.values()) > 5


def test_repeated_rows(spark):
    text = "a b c d e f g h i j k"
    rows = [(1, text, "", ""), (1, text, "", ""), (1, "other", "", ""), (None, text, "", "")]
    df = op.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, text, 0)], ITEMS))
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in df.collect()) == [(0, 11, 11), (1, 1, 0), (1, 11, 11), (1, 11, 11)]


def test_near_phrases(spark):
    item = [(1, "quick brown foxes jump over lazy dogs near seven rivers", 0)]
    docs = [(1, "quick brown foxes jump high over lazy dogs near seven rivers", "", ""), (2, "quick " + "pad " * 30 + "brown", "", ""), (3, None, "", "")]
    df = spark.createDataFrame(docs, DOCS)
    found = op.near_phrases(df, spark.createDataFrame(item, ITEMS), slop=2).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, "1")]


def test_one_repetitive_document(spark):
    docs = [(1, "same " * 40_000), (2, "same other " * 20_000)]
    items = [(1, "same " * 30), (2, "same " * 15 + "end"), (3, "other same " * 12)]
    df = op.find_leaks(spark.createDataFrame([(d, t, "c", "c") for d, t in docs], DOCS), spark.createDataFrame([(*x, 0) for x in items], ITEMS), slop=5)
    assert digest(df) == brute.leaks(docs, items)
    assert {r.doc_id: r.near for r in df.collect()}[2] == ["1", "2", "3"]
