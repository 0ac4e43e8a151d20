import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldglass.llm import decontaminate, mixing, quality, secrets
from tests.llm import brute
from tests.llm.test_lattice_mixing_licenses import targets

SF = "/root/testdata/sf0.001"


def test_run_with_null_and_shared_ids(spark, tmp_path):
    """The whole pipeline: what passes the rules stays by text, whatever its id; rates of one source are all 1."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = decontaminate.stage(spark, quality.stage(spark, docs, SF), SF).select("text").distinct().collect()
    texts = sorted(r.text for r in clean if len(r.text.split()) > 100 and secrets.redacted(r.text) == r.text)
    apart = []
    for i, t in enumerate(texts):
        if all(brute.near([(0, t), (1, u)], 80)[1][1] == 1 for u in apart):
            apart.append(t)
        if len(apart) == 6:
            break
    a, b, c, d, e, f = apart
    ids = [(1, a), (1, b), (None, c), (None, d), (2, a + " more"), (3, e), (3, e), (4, f), (1, "bad")]
    rows = docs.limit(1).drop("doc_id", "text", "source").withColumn("source", F.lit("one"))
    named = spark.createDataFrame(ids, "doc_id long, text string")
    rows.crossJoin(named).select(docs.columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.copy) for r in found) == Counter((i, t, 1) for i, t in [(1, a), (1, b), (None, c), (None, d), (3, e), (4, f)])


def test_mixing_stage_takes_every_row(spark):
    """Copies of each row, with and without ids, are those of the mix."""
    rows = [(i % 7 if i % 3 else None, f"w{i % 11} " * (3 + i % 11), "ab"[i % 4 == 0]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    out = mixing.stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out) == want
    assert sum(want.values()) == len(out) and any(r.doc_id is None for r in out)


def rates(sizes, target, most=3.0):
    """The tilts of one source's documents by plain bisection."""
    mean = sum(sizes) / len(sizes)

    def tilted(m):
        return [1.0 if not n else min(most, math.exp(min(math.log(most), m * n / mean))) for n in sizes]

    low, high = -1e3, math.log(most) * max(mean, 1) + 1
    for _ in range(200):
        m = (low + high) / 2
        if sum(n * r for n, r in zip(sizes, tilted(m), strict=True)) < target:
            low = m
        else:
            high = m
    return tilted(high)


def test_rates(spark):
    rows = [(i, "w " * (1 + i * i % 97), s) for s, k in (("a", 40), ("b", 400), ("c", 9), ("d", 150), (None, 30)) for i in range(k)]
    found = defaultdict(list)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        found[r.source].append((r.size, r.target, r.rate))
    for s, some in found.items():
        want = rates([x[0] for x in some], some[0][1])
        assert [x[2] for x in some] == pytest.approx(want, rel=1e-4), s


def test_many_sources(spark):
    """More sources than ranges, with ties and null: numbered and filled up like a list in memory."""
    rows = [(i, "w " * (1 + i * 7919 % 400 * (i % 13 == 0)), f"host{i % 701}" if i % 701 else None) for i in range(3000)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.cyclic_targets(df.groupBy("source", mixing.n_words(F.col("text")).alias("size")).agg(F.count("*").alias("n"))).collect()
    want = targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in found} == want and len(found) == len(want)


def test_whole_pipeline(spark):
    """Every stage over all documents against plain versions of them."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left = {d: r.text for d, r in docs.items() if not any(test(quality.Doc(r.text)) for test in quality.RULES.values())}
    near = brute.near(left.items(), 80)
    left = {d: t for d, t in left.items() if near[d][1] == d}
    leaks = brute.leaks(left.items(), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    left = {d: secrets.redacted(t) for d, t in left.items() if not leaks[d][1]}
    by_source = defaultdict(list)
    for d, t in left.items():
        by_source[docs[d].source].append((d, len(brute.words(t))))
    want = targets({s: sum(n for _, n in x) for s, x in by_source.items()})
    rate = {d: r for s, x in by_source.items() for (d, _), r in zip(x, rates([n for _, n in x], want[s]), strict=True)}

    out = corpus_pipeline.run(spark, sf).collect()
    copies, taken = Counter(r.doc_id for r in out), Counter()
    assert len(left) > 20 and all(r.text == left[r.doc_id] and r.source == docs[r.doc_id].source and r.lang == docs[r.doc_id].lang for r in out)
    for d, r in rate.items():
        assert math.floor(r - 1e-4) <= copies[d] <= math.ceil(r + 1e-4)
        taken[docs[d].source] += copies[d] * len(brute.words(left[d]))
    for s, x in by_source.items():
        assert abs(taken[s] - want[s]) <= max(n for _, n in x)
    assert sorted((r.doc_id, r.copy) for r in out) == [(d, k) for d in sorted(copies) for k in range(1, copies[d] + 1)]
