import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import negatives, topk
from fieldglass.llm.vectors import numbered

VECTORS = "vec_id long, label int, embedding array<double>, v string, place int, score string"
NAN, INF = float("nan"), float("inf")


def usable(rows, labelled):
    return [(i, label, [int(np.floor(256 * x)) for x in e]) for i, label, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e) and (label is not None or not labelled)]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(found):
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def brute_top(rows, k):
    rows, out = usable(rows, False), []
    for q, (i, _, a) in enumerate(rows):
        if i is not None and i % 50 == 0:
            best = order([(product(a, b), j) for c, (j, _, b) in enumerate(rows) if c != q])[:k]
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(best)]
    return out


def brute_negatives(rows, positives=5, several=3):
    rows, out = usable(rows, True), []
    for q, (i, label, a) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = [(product(a, b), j, m) for c, (j, m, b) in enumerate(rows) if c != q]
        for p, j in order([x[:2] for x in scored if x[2] == label])[:positives]:
            fit = order([x[:2] for x in scored if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p])[:several]
            out += [(i, j, n + 1, o, p, s) for n, (s, o) in enumerate(fit)]
    return out


def invented(seed, n, width, spread):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) for _ in range(width)]
    vector = lambda: hot if r.random() < 0.3 else [round(r.gauss(0, 1) * spread, 2) for _ in range(width)]
    return [(r.choice([k, k, 50 * (k % 9)]), r.choice([0, 0, 0, 1, 2, 3]), vector()) for k in range(n)]


EDGES = [
    (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (50, None, [0.5, 0.25]), (None, 1, [1.0, 2.0]), (100, 1, None), (150, 1, [1.0, None]), (200, 2, [1.0, NAN]),
    (250, 2, [INF, 0.0]), (300, 2, []), (350, 1, [-0.001, 0.0, 7.0]), (1, 2, [0.7, 1.5]), (2, 2, [0.7, 1.5]), (3, 3, [0.0, 0.0]), (400, 1, [0.0, 0.0]), (4, 1, [-1.0, -2.0]), (450, 1, [-3.0, -2.0]),
]
TABLES = {"edges": EDGES, "empty": [], "one": [(0, 1, [1.0])], "plain": invented(1, 300, 8, 1), "wide": invented(2, 120, 40, 30.0), "short": invented(3, 250, 2, 0.2)}


def frame(spark, rows):
    return spark.createDataFrame([(*x, "v", 1, "s") for x in rows], VECTORS)


@pytest.fixture
def small_parts(monkeypatch):
    """Blocks, buckets and groups of a few rows, so that small tables have many."""
    monkeypatch.setattr(topk, "BLOCK", 70)
    monkeypatch.setattr(topk.search, "__defaults__", (7,))
    monkeypatch.setattr(topk.bit_sliced_index, "__defaults__", (70,))
    for name, n in (("BUCKET", 16), ("RUN", 2), ("GROUP", 5), ("CELLS", 100)):
        monkeypatch.setattr(negatives, name, n)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_top(spark, small_parts, name):
    found = topk.top_k(frame(spark, TABLES[name]), F.col("vec_id") % 50 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    key = lambda x: [(y is None, y or 0) for y in x]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_top(TABLES[name], 5), key=key)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_negatives(spark, small_parts, name):
    found = negatives.hard_negatives(frame(spark, TABLES[name]), F.col("vec_id") % 50 == 0)
    key = lambda x: [(y is None, y or 0) for y in x]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_negatives(TABLES[name]), key=key)


def test_short_buckets_are_skipped(monkeypatch):
    """Buckets below the bound aren't read; the result stays that of all rows."""
    import pyarrow as pa

    seen, products = [], negatives._products
    monkeypatch.setattr(negatives, "BUCKET", 10)
    monkeypatch.setattr(negatives, "_products", lambda a, x: seen.append(len(x)) or products(a, x))
    rows = [[100 - k, 0] for k in range(90)]
    left = pa.table({"place": [999], "label": [1], "v": [[100, 0]]})
    right = pa.table({"place": range(90), "vec_id": range(90), "label": [1] * 90, "v": rows})
    found = negatives._positives(5)(left, right)
    assert found["vec_id"].to_pylist() == [0, 1, 2, 3, 4] and seen == [10]


@pytest.mark.parametrize("seed", range(4))
def test_slices(seed):
    """The sum of slices is the inner product, and rows chosen from the top slice down are the best ones."""
    r = np.random.default_rng(seed)
    values, query = r.integers(-300, 300, (130, 9)), r.integers(-200, 200, 9)
    values[40:90] = values[40]
    block = topk.Block(*topk.sliced(values), len(values))
    slices, constant = block.score(query)
    bits = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    assert (constant + (bits << np.arange(len(bits))[:, None]).sum(axis=0) == values @ query).all()
    rows, scores = block.best(query, 60, np.array([40]))
    want = sorted((x for x in range(130) if x != 40), key=lambda x: (-int(values[x] @ query), x))[:60]
    assert sorted(rows) == sorted(want) and scores == [int(values[x] @ query) for x in rows]


def test_too_large(spark):
    rows = [(0, 1, [1e15, 1e15]), (1, 1, [1e15, -1e15])]
    for call in (topk.top_k, negatives.hard_negatives):
        with pytest.raises(Exception, match="too large"):
            call(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()


def test_numbered(spark):
    table, n = numbered(spark.range(1000).select((F.col("id") % 3).alias("x"), "id").repartition(7), F.desc("x"))
    rows = sorted((r.place, r.x) for r in table.collect())
    assert n == 1000 and [p for p, _ in rows] == list(range(1000)) and [x for _, x in rows] == sorted((x for _, x in rows), reverse=True)
