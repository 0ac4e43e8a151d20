"""Plain versions of the operators' contracts, over rows held in lists."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(text):
    return SPLIT.findall(text or "")


def repeats(docs, width=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    first = {}
    split = {d: words(t) for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def near(docs, percent=85):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in docs}
    having = defaultdict(list)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(sets):
        seen = defaultdict(int)
        for s in sets[d]:
            for e in having[s]:
                seen[e] += 1
            having[s].append(d)
        for e, both in seen.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, width=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256)}"""
    where = defaultdict(set)
    for i, t in items:
        w = TERM.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - width + 1) if w else 0):
            where[tuple(w[s : s + width])].add(str(i))
    sizes = {len(k) for k in where}
    out = {}
    for d, t in docs:
        w = TERM.findall((t or "").translate(LOWER))
        hit, met = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in where:
                    hit.update(range(s, s + n))
                    met |= where[k]
        out[d] = (len(w), len(hit), len(met), sha(",".join(sorted(met))))
    return out


BLANK = " \t\n\x0b\x0c\r"


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else None
    n = len(repeated) if repeated is not None else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def secrets(text):
    """Base spans by the contract's patterns, scanned the long way."""
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def lattice(word, scores):
    """Log probability of a word over all segmentations, by listing them."""
    import math

    def go(s):
        if not s:
            return [0.0]
        out = [scores[s[:k]] + x for k in range(1, len(s) + 1) if s[:k] in scores for x in go(s[k:])]
        if s[0] not in scores:
            out += [sum(scores.get(f"<0x{b:02X}>", -30.0) for b in s[0].encode()) + x for x in go(s[1:])]
        return out

    return math.log(sum(map(math.exp, go("▁" + word))))
