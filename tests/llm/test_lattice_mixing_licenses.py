import math
import textwrap
import tracemalloc
import zlib
from collections import Counter

import pytest

from fieldglass.llm import lattice, licenses, mixing
from tests.llm import brute
from tests.llm.test_repeats_near import documents

DOCS = "doc_id long, text string, held_out boolean, source string, score double"
SCORES = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -1.5, "▁a": -1.0, "▁ab": -2.2, "ba": -2.1, "<0xC3>": -6.0, "<0xA9>": -6.5}


@pytest.mark.parametrize("word", ["a", "ab", "abab", "abba", "é", "aéb", "z", "a" * 12])
def test_likelihood(word):
    assert lattice.Lattice(SCORES).likelihood(word) == pytest.approx(brute.lattice(word, SCORES), rel=1e-9)


def test_expected_counts():
    """Expected pieces spell the word: their lengths sum to its length."""
    counts = Counter()
    lattice.Lattice(SCORES).expect("abba", 2.0, counts)
    assert sum(len(p) * n for p, n in counts.items()) == pytest.approx(2 * 5)


@pytest.mark.parametrize("word", ["a", "abba", "aéb", "zz", "ab" * 20])
def test_expected_counts_in_logarithms(word):
    one, two = Counter(), Counter()
    lattice.Lattice(SCORES).expect(word, 3.0, one)
    lattice.Lattice(SCORES).expect_long(word, 3.0, two)
    assert {p: n for p, n in one.items() if n > 1e-12} == {p: pytest.approx(n, rel=1e-9) for p, n in two.items() if n > 1e-12}


def test_a_word_of_many_characters_takes_bounded_memory():
    """100,000 characters without a blank: some ten numbers each, and the sums of the way by lists for shorter words."""
    counts, word = Counter(), "abbab" * 20_000
    tracemalloc.start()
    lattice.Lattice(SCORES).expect(word, 1.0, counts)
    found = lattice.Lattice(SCORES).likelihood(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(word) and math.isfinite(found)
    assert sum(len(p) * n for p, n in counts.items()) == pytest.approx(len(word) + 1, rel=1e-6)
    short = word[: lattice.LONG]
    assert lattice.Lattice(SCORES).forward(lattice.SPACE + short)[-1] == pytest.approx(lattice.Lattice(SCORES).likelihood(short), rel=1e-9)


def base_scores(docs):
    tokens = {d: [w.translate(brute.LOWER) for w in brute.words(t)] + [None] for d, t, _ in docs}
    c = Counter(x for d, _, h in docs if not h for x in tokens[d])
    n, v = sum(c.values()), len(c)
    return {d: (len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for d, t in tokens.items()}


@pytest.mark.parametrize("case", ["documents", "edges", "all held out"])
def test_base(spark, monkeypatch, case):
    monkeypatch.setattr(lattice, "HOT", 300)  # both ways of meeting the counts
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    docs = [(d, t, held(d)) for d, t in documents("sf0.001")] if case == "documents" else [(1, None, False), (2, "", True), (3, "A a É é z" + " w" * 9000, False), (4, "unseen \n a", True), (5, "x" * 3000, True)]
    if case == "all held out":
        docs = [(d, t, True) for d, t, _ in docs]
    rows = [(d, t, h, "s", 0.0) for d, t, h in docs]
    found = {r.doc_id: r for r in lattice.lattice_scores(spark.createDataFrame(rows, DOCS)).collect()}
    want = base_scores(docs)
    assert set(found) == set(want)
    for d, (n, known, total, base) in want.items():
        r = found[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score < 0


def segmentations(s):
    if not s:
        return [()]
    out = [(s[:k], *x) for k in range(1, len(s) + 1) if s[:k] in SCORES for x in segmentations(s[k:])]
    if s[0] not in SCORES:
        out += [(*(f"<0x{b:02X}>" for b in s[0].encode()), *x) for x in segmentations(s[1:])]
    return out


def test_score(spark):
    """The model and the scores, by listing all segmentations of each word."""
    docs = [(1, "ab abba a", False), (2, "bab ab", False), (3, "abab a b", True), (4, None, True), (5, "éa ab AB", False), (6, "", False)]

    def weight(pieces, scores):
        return math.exp(sum(scores.get(p, -30.0) for p in pieces))

    counts, ends = Counter(), sum(not h for _, _, h in docs)
    for _, t, h in docs:
        for w in brute.words((t or "").translate(brute.LOWER)) if not h else []:
            ways = segmentations("▁" + w)
            total = sum(weight(x, SCORES) for x in ways)
            for x in ways:
                for p in x:
                    counts[p] += weight(x, SCORES) / total
    total = sum(counts.values()) + ends + lattice.SMOOTH * (len(SCORES) + 1)
    model = {p: math.log((counts[p] + lattice.SMOOTH) / total) for p in SCORES}
    end = math.log10((ends + lattice.SMOOTH) / total)
    found = {r.doc_id: r.score for r in lattice.lattice_scores(spark.createDataFrame([(d, t, h, "s", 0.0) for d, t, h in docs], DOCS), SCORES).collect()}
    for d, t, _ in docs:
        want = end + sum(math.log10(sum(weight(x, model) for x in segmentations("▁" + w))) for w in brute.words((t or "").translate(brute.LOWER)))
        assert found[d] == pytest.approx(want, rel=1e-6), d


def test_scores_tell_text_from_noise(spark):
    """Held-out documents are likelier than the same letters in another order, and training on them helps."""
    docs = [(d, t) for d, t in documents("sf0.001") if len(t) > 300][:80]
    shuffled = [(1000 + d, " ".join(w[::-1] for w in t.split())) for d, t in docs[40:]]
    rows = [(d, t, False, "", 0.0) for d, t in docs[:40]] + [(d, t, True, "", 0.0) for d, t in docs[40:] + shuffled]
    s = {r.doc_id: r.score for r in lattice.lattice_scores(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(s[d] > s[1000 + d] for d, _ in docs[40:]) >= 0.9 * len(docs[40:])


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert lattice.lattice_scores(empty).count() == 0 == mixing.mix(empty).count()
    assert licenses.scan_licenses(empty).count() == 0


def targets(sizes, most=3):
    """Shares by weight, fixed at the limit and shared anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, left = {}, sum(sizes.values())
    free = set(sizes)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, DOCS))


def test_mix_targets_and_rates(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), False, s, 0.0) for s, k in (("a", 40), ("b", 900), ("c", 9), ("d", 300), ("Ä", 60), (None, 30)) for i in range(k)]
    rows += [(-1, None, False, "a", 0.0), (-2, "", False, "empty", 0.0), (-3, "big " * 4000, False, "b", 0.0)]
    df = mixed(spark, rows)
    found = df.collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(brute.words(t))
    want = targets(sizes)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert r.taken in (r.size * math.floor(r.rate + 1e-9), r.size * math.ceil(r.rate - 1e-9)) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, 0.01 * want[s]) for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = spark.createDataFrame(rows[::-1], DOCS).repartition(7)
    assert sorted(map(str, mixing.mix(again).collect())) == sorted(map(str, found))


def test_mix_documents(spark):
    found = mixing.op7_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 1000
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())


def normal(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower().replace("licence", "license"))


def best_units(text, templates, least=0.9):
    """{(license, template): (-dice, start, words)} by trying the whole text, every paragraph, every line and every run."""
    w = normal(text)
    spans, line_at, part_at = {(0, len(w))}, 0, 0
    for line in (text or "").split("\n"):
        n = len(normal(line))
        if not n:
            spans.add((part_at, line_at - part_at))
            part_at = line_at
        spans.add((line_at, n))
        line_at += n
    spans.add((part_at, line_at - part_at))
    pairs = list(zip(w, w[1:], strict=False))
    out = {}
    for name, texts in templates.items():
        for i, t in enumerate(texts):
            words = normal(t)
            own = set(zip(words, words[1:], strict=False))
            inside = [0]
            for p in pairs:
                inside.append(inside[-1] + (p in own))
            for start, n in sorted(spans | {(s, len(words)) for s in range(len(w) - len(words) + 1)}):
                if n < 2 or 2 * (inside[start + n - 1] - inside[start]) < len(own):
                    continue  # fewer than half of the template's pairs: far below 0.9
                found = set(pairs[start : start + n - 1])
                d = 2 * len(found & own) / (len(found) + len(own))
                if d >= least:
                    out[name, i] = min(out.get((name, i), (0, 0, 0)), (-d, start, n))
    return out


LICENSE_TEXTS = [None, "", "...", "word", "Some text.\nReleased under the MIT license\nmore", licenses.TEMPLATES["ISC"][0].replace(",", " ,\n"), "This work is licenced under the GNU General Public Licence, version 3!", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0", "noise " * 30_000, "Licensed under\nthe Apache License,\nVersion 2.0."]


MIT = licenses.TEMPLATES["MIT"]
BSD = licenses.TEMPLATES["BSD-3-Clause"][2]
LICENSE_TEXTS += [
    "A program of mine.\n" + "\n".join(textwrap.wrap(MIT[1], 72)) + "\nand more text after it\n" * 9,
    "Copyright (c) 2020 X. Released under the MIT License. All other rights stay with X.",
    "intro\n\n" + "\n".join(" * " + x for x in textwrap.wrap(BSD, 60)) + "\n\nint main() { return 0; }",
    " ".join(["before"] * 300 + MIT[3].replace("person", "human").split() + ["after"] * 300),
    "Permission is hereby granted, free of charge\n" * 40,
    "license " * 5_000,
    "\n\n\nReleased under\n\nthe MIT License.\n\n",
    " ".join(MIT[1].split()[:30] + ["cut"] * 40 + MIT[1].split()[30:]),
]


def test_licenses(spark):
    texts = dict(enumerate(LICENSE_TEXTS)) | {100 + d: t for d, t in documents("sf0.001")}
    df = spark.createDataFrame([(d, t, False, "s", 0.0) for d, t in texts.items()] + [(3, "word", False, "s", 0.0), (7, texts[7], False, "s", 0.0)], DOCS)
    found = licenses.scan_licenses(df).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        want = best_units(texts[r.doc_id], licenses.TEMPLATES)
        assert {(m.license, m.template): (pytest.approx(-m.dice), m.start, m.words) for m in r.matches} == want, r.doc_id
        assert len(r.matches) == len(want) and r.license == (r.matches[0].license if r.matches else None)
    by_id = {r.doc_id: r.license for r in found}
    assert [by_id[len(LICENSE_TEXTS) - k] for k in (8, 7, 6, 5, 2)] == ["MIT", "MIT", "BSD-3-Clause", "MIT", "MIT"]
    assert sum(r.license is not None for r in found) > 5


def test_license_query(spark):
    texts = dict(documents("sf0.001"))
    found = licenses.op10_licenses(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        want = sorted((*v[:1], *k, *v[1:]) for k, v in best_units(texts[r.doc_id], licenses.TEMPLATES).items())
        assert r.n_matches == len(want)
        first = want[0] if want else (None,) * 5
        assert (r.license, r.start, r.words) == (first[1], first[3], first[4])
        assert r.dice == (round(-first[0], 6) if want else None)

