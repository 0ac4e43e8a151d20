import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import collocations
from fieldglass.llm.shared import stored
from tests.llm.brute import LOWER

DOCS = "doc_id long, text string, lang string, shard string, w string, n int, f int"


def phrases(w, longest=4):
    return [(i, i + m) for m in range(1, longest + 1) for i in range(len(w) - m + 1)]


def brute(docs, least, subsumed, most):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i:j]) for i, j in phrases(w))
    for lang, c in f.items():
        cands, rows = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        inside = defaultdict(int)
        for p, a in cands.items():
            for i, j in phrases(p):
                if j - i < len(p):
                    inside[p[i:j]] = max(inside[p[i:j]], a)
        for p, a in cands.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < subsumed * a:
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def invented(seed, n=80):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") for _ in range(r.randint(2, 9))] for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [" ".join(r.choice(base)) if r.random() < 0.6 else r.choice(["x", "A b", "y\tz", "ÄÖ", "q" * 30, "\x01", "b\x01"]) for _ in range(r.randint(0, 12))]
        out.append(("".join(p + r.choice([" ", "  ", ". ", "\n", ",", "\t"]) for p in parts), r.choice(["en", "en", "fr", None])))
    return out


EDGES = [(None, "en"), ("", "en"), (" . \n ;; ", "en"), ("a a a a a a", "en"), ("a b", None), ("a b", "und"), ("A B", ""), ("one two three four five " * 3000, "de"), ("w " * 9000, "de"), ("word" * 5000, "fr")]


@pytest.mark.parametrize("docs, shard", [(EDGES, 1), (EDGES, 1 << 24), ([], 1), (invented(0), 1), (invented(1), 1 << 24)], ids=["edges", "one shard", "empty", *"ab"])
def test_collocations(spark, monkeypatch, docs, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    df = spark.createDataFrame([(k, t, lang, "s", "w", 1, 2) for k, (t, lang) in enumerate(docs)], DOCS)
    for least, subsumed, most in ((2, 80, 2000), (5, 60, 3)):
        found = collocations.collocations(df, least, subsumed, most)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == brute(docs, least, subsumed, most)


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    """States are the sets of end positions, links the longest suffixes with more, substrings and counts those there are."""
    r = random.Random(seed)
    text = np.array([r.choice([0, 1, 1, 2, 3][: 3 + seed % 3]) for _ in range(200)], np.int32)
    m = collocations.Automaton(text, 4)
    ends = defaultdict(set)
    for i in range(200):
        for k in range(1, 5):
            part = tuple(text[max(0, i - k + 1) : i + 1])
            if len(part) == k and 0 not in part:
                ends[part].add(i)
    classes = defaultdict(set)
    for p, e in ends.items():
        classes[frozenset(e)].add(p)
    own = lambda s: tuple(text[m.end[s] - m.longest[s] + 1 : m.end[s] + 1])
    assert len(m.end) == len(classes) and {own(s) for s in range(len(m.end))} == {max(c, key=len) for c in classes.values()}
    for s in range(len(m.end)):
        w = own(s)
        assert m.count[s] == len(ends[w]) and m.shortest[s] == min(map(len, classes[frozenset(ends[w])]))
        link = w[len(w) - m.shortest[s] + 1 :]
        assert own(m.link[s])[-len(link) :] == link and m.count[m.link[s]] == len(ends[link]) if link else m.link[s] == -1
    for k in range(1, 5):
        words, count = m.substrings(k)
        assert {tuple(w): c for w, c in zip(words.tolist(), count.tolist(), strict=True)} == {p: len(e) for p, e in ends.items() if len(p) == k}


def test_row_groups_of_long_rows(spark):
    """Rows of megabytes: a reader, which holds a row group decoded, meets few of them at a time."""
    df = spark.range(40, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: F.xxhash64(x, "id")).alias("numbers"))
    files = {f.removeprefix("file://") for f in stored(df, "test-long-rows", long_rows=True).inputFiles()}
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) == 40 and max(groups) <= 4
