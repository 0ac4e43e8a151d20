"""Substring deduplication by recompression.

Rounds of recompression name runs of one symbol and pairs of adjacent symbols; symbols grow to the scale of a window. A
name is a fixed function of what it replaces (words by their digests), so naming is global without a dictionary, and
each symbol knows the words that its parse depends on: its own, those that end its runs, those that decided its pairs.
A symbol whose dependence lies within a passage is interior to it and occurs wherever the passage does.

1. Every window of `width` words has as anchor the least of its interior symbols of the highest round. Equal windows
   have equal anchors at equal places, and successive windows share an anchor: all windows of one anchor together are a
   block, named from its words. The words that the anchor depends on, which all its windows hold, are the key.
   (key, block, doc_id) is all that leaves the documents: one row for some 20 words.
2. Keys that documents share reveal repeats, blocks verify them: a block that starts in an earlier document settles all
   of its windows at once. Only where one key has different blocks (at the ends of repeats) must single windows be
   compared.
3. Those windows, by their names, are grouped; a window of which the first document is an earlier one settles.
4. Each text meets what is settled in it, and its covered words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.names import CHUNK, chunks, in_pieces, mixed, paired, word_names
from fieldglass.llm.shared import drop_stored, long_id, mapped, stored, text_bytes

#: Rounds of naming runs and then pairs.
ROUNDS = 5
#: Bits of a place in an array of symbols; what is left of 64 are those of the value by which anchors are chosen.
PLACE = 28


class Symbols:
    """One round's parse of the words of several texts. lo, hi: the words that each symbol depends on."""

    def __init__(self, name, start, size, lo, hi, first, last):
        self.name, self.start, self.size, self.lo, self.hi = name, start, size, lo, hi
        self.first, self.last = first, last  # whether a symbol begins or ends its text

    def taken(self, keep: np.ndarray) -> Symbols:
        return Symbols(*(x[keep] for x in (self.name, self.start, self.size, self.lo, self.hi, self.first, self.last)))


def of_words(words: np.ndarray, bounds: np.ndarray) -> Symbols:
    at = np.arange(len(words), dtype=np.int64)
    first, last = np.zeros(len(words), bool), np.zeros(len(words), bool)
    some = bounds[:-1] < bounds[1:]
    first[bounds[:-1][some]] = True
    last[bounds[1:][some] - 1] = True
    return Symbols(words, at, np.ones(len(words), np.int64), at, at + 1, first, last)


def name_runs(s: Symbols, words: np.ndarray, most: int) -> Symbols:
    """Whole runs of one symbol become one where they have at most `most` words.

    A run depends on what ends it: mostly the one word beside it, as that alone tells the neighbour apart.
    """
    new = s.first.copy()
    new[1:] |= s.name[1:] != s.name[:-1]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(new)))
    tail = head + count - 1
    end = s.start[tail] + s.size[tail]
    before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(new) - 1)
    clear = s.first[head] | (words[s.start[head] - 1] != words[s.start[head] + s.size[head] - 1])
    lo = np.minimum(s.lo[head], np.where(clear, s.start[head] - 1, s.lo[before]))
    clear = s.last[tail] | (words[np.minimum(end, len(words) - 1)] != words[s.start[tail]])
    hi = np.maximum(s.hi[tail], np.where(clear, end + 1, s.hi[after]))
    joined = (count > 1) & (count * s.size[head] <= most)
    keep = new | np.repeat(~joined, count)
    name, size, last = s.name.copy(), s.size.copy(), s.last.copy()
    at = head[joined]
    name[at] = paired(s.name[at], mixed(count[joined].astype(np.uint64)))
    size[at] *= count[joined]
    last[at] = s.last[tail[joined]]
    return Symbols(name, s.start, size, np.repeat(lo, count), np.repeat(hi, count), s.first, last).taken(keep)


def name_pairs(s: Symbols, most: int, turn: int) -> Symbols:
    """A left symbol and a right one after it become one; a bit of the name says which a symbol is."""
    left = (mixed(s.name + np.uint64(turn)) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(left), bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~s.last[:-1] & (s.size[:-1] + s.size[1:] <= most)
    at = np.flatnonzero(pair)
    second = np.zeros(len(left), bool)
    second[at + 1] = True
    lo, hi = s.lo.copy(), s.hi.copy()
    alone = np.flatnonzero(left & ~pair)  # its right neighbour decided that
    hi[alone] = np.where(s.last[alone], s.start[alone] + s.size[alone] + 1, s.hi[np.minimum(alone + 1, len(left) - 1)])
    alone = np.flatnonzero(~left & ~second)
    lo[alone] = np.where(s.first[alone], s.start[alone] - 1, s.lo[np.maximum(alone - 1, 0)])
    hi[at] = np.maximum(s.hi[at], s.hi[at + 1])
    name, size, last = s.name.copy(), s.size.copy(), s.last.copy()
    name[at] = paired(s.name[at], s.name[at + 1])
    size[at] += s.size[at + 1]
    last[at] = s.last[at + 1]
    return Symbols(name, s.start, size, lo, hi, s.first, last).taken(~second)


def recompressed(words: np.ndarray, bounds: np.ndarray, width: int) -> list[Symbols]:
    """The words and their parses after each round; no symbol has more than half a window."""
    out = [of_words(words, bounds)]
    for turn in range(1, ROUNDS + 1):
        if len(words):
            out.append(name_pairs(name_runs(out[-1], words, width // 2), width // 2, turn))
    return out


def anchors(levels: list[Symbols], starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(round, place among its symbols) of the anchor of the window at each of starts."""
    n = len(levels[0].name)
    turns, places = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    rest = np.arange(len(starts))
    for turn in range(len(levels) - 1, -1, -1):
        s = levels[turn]
        # lo and hi rise along the symbols, so those interior to a window are neighbours.
        below = np.cumsum(np.bincount(s.lo + 1, minlength=n + 2))[starts[rest]]
        within = np.cumsum(np.bincount(s.hi, minlength=n + 2))[starts[rest] + width]
        some = within > below
        best = _least(s.name, below[some], within[some])
        turns[rest[some]], places[rest[some]] = turn, best
        rest = rest[~some]
        if not len(rest):
            break
    return turns, places


def _least(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the least mixed name in each names[a:b], the first of equal ones."""
    place = np.arange(len(names), dtype=np.uint64)
    table = (mixed(names) >> np.uint64(PLACE) << np.uint64(PLACE)) | place
    out = np.empty(len(a), np.uint64)
    length, step = b - a, 1
    while True:
        now = (length >= step) & (length < 2 * step)
        out[now] = np.minimum(table[a[now]], table[b[now] - step])
        if not len(length) or 2 * step > length.max():
            return (out & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table[:0]
        step *= 2


def spans_named(starts: np.ndarray, lengths: np.ndarray, doubled: list[np.ndarray]) -> np.ndarray:
    """The name of the `length` words from each start on; doubled: names of all sequences of 1, 2, 4 ... words."""
    out = mixed(lengths.astype(np.uint64))
    for k in range(len(doubled)):
        own = np.flatnonzero((lengths >> k) == 1)
        if len(own):
            s, n, size = starts[own], lengths[own], 1 << k
            out[own] = paired(paired(doubled[k][s], doubled[k][s + n - size]), out[own])
    return out


def doubled_names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    out, size = [words], 1
    while 2 * size <= longest and len(out[-1]) > size:
        out.append(paired(out[-1][:-size], out[-1][size:]))
        size *= 2
    return out


class Parsed:
    """The words of some texts with the blocks of their windows: runs of windows of one anchor, of at most `width`."""

    def __init__(self, lanes: np.ndarray, bounds: np.ndarray, width: int):
        self.lanes, self.bounds, self.width = lanes, bounds, width
        counts = np.maximum(0, np.diff(bounds) - width + 1)
        starts = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        turns, places = anchors(levels := recompressed(lanes[0], bounds, width), starts, width)
        new = np.ones(len(starts), bool)
        new[1:] = (turns[1:] != turns[:-1]) | (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        self.first, self.count = starts[head], np.diff(np.append(head, len(new)))
        self.of_text = np.searchsorted(self.first, bounds)  # bounds of the texts' blocks
        self.anchor = [np.empty(len(head), np.int64) for _ in range(3)]
        for turn, s in enumerate(levels):
            own = np.flatnonzero(turns[head] == turn)
            for to, found in zip(self.anchor, (s.lo, s.hi, s.start), strict=True):
                to[own] = found[places[head[own]]]
        self.doubled = [doubled_names(lane, 2 * width) for lane in lanes]

    def keys(self) -> np.ndarray:
        """The words that each anchor depends on, and its place in them."""
        lo, hi, start = self.anchor
        return paired(spans_named(lo, hi - lo, self.doubled[0]), (start - lo).astype(np.uint64))

    def blocks(self) -> list[np.ndarray]:
        return [spans_named(self.first, self.count + self.width - 1, d) for d in self.doubled]

    def window_names(self, at: np.ndarray) -> list[np.ndarray]:
        return [spans_named(at, np.full(len(at), self.width), d) for d in self.doubled]


def parsed(texts: list[bytes], width: int) -> Iterator[tuple[int, int, Parsed]]:
    """(number of the first text, words of it that come before, Parsed) of runs of texts, or of a part of a long one.

    Parts of a text overlap by all but one word of a window, so each window is in one of them and memory is bounded.
    """
    for start, end in in_pieces(texts):
        if end - start > 1 or len(texts[start]) <= 2 * CHUNK:
            yield start, 0, Parsed(*word_names(texts[start:end]), width)
            continue
        skip, tail = 0, np.empty((2, 0), np.uint64)
        for chunk in chunks(texts[start]):
            lanes = np.concatenate([tail, word_names([chunk])[0]], axis=1)
            yield start, skip, Parsed(lanes, np.array([0, lanes.shape[1]]), width)
            tail = lanes[:, max(0, lanes.shape[1] - width + 1) :]
            skip += lanes.shape[1] - tail.shape[1]


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64))


def block_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, b1, b2) of all blocks, about once a document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, one, two = [], [], [], []
        docs = np.array(batch.column(0).to_pylist(), np.int64)
        for at, _, p in parsed(text_bytes(batch.column(1)), width):
            b1, b2 = p.blocks()
            text = np.repeat(np.arange(len(p.bounds) - 1), np.diff(p.of_text))
            order = np.lexsort((b1, text))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(text[order]) > 0) | (b1[order][1:] != b1[order][:-1])
            pick = order[fresh]
            ids.append(docs[at + text[pick]].view(np.uint64))
            keys.append(p.keys()[pick])
            one.append(b1[pick])
            two.append(b2[pick])
        return pa.RecordBatch.from_arrays([_longs(x) for x in (ids, keys, one, two)], names=["doc_id", "key", "b1", "b2"])

    return mapped(docs, run, "doc_id long, key long, b1 long, b2 long", rows=1024)


def _kept(text: bytes, n: int, spans: list[tuple[np.ndarray, np.ndarray]], digest: bool) -> tuple[str, int]:
    """What stays of a text of n words without the (starts, ends) given, or its SHA-256, and how many words go."""
    drop = np.zeros(n + 1, np.int32)
    for starts, ends in spans:
        np.add.at(drop, starts, 1)
        np.add.at(drop, ends, -1)
    gone = np.cumsum(drop, dtype=np.int32) > 0
    sha, rest, at, first = hashlib.sha256(), [], 0, True
    for chunk in chunks(text):
        words = chunk.split()
        part = gone[at : at + len(words)]
        at += len(words)
        if part.any():
            words = [w for w, g in zip(words, part.tolist(), strict=True) if not g]
        if words:
            kept = (b"" if first else b" ") + b" ".join(words)
            first = False
            sha.update(kept)
            if not digest:
                rest.append(kept)
    return sha.hexdigest() if digest else b"".join(rest).decode("utf-8", "replace"), int(gone[:n].sum())


CUT = "doc_id long, n_words long, n_removed long, kept string"


def settle(docs: DataFrame, width: int, digest: bool) -> DataFrame:
    """CUT by settled blocks alone, and for texts with open blocks (then kept is null) what they still need: text,
    settled, and the names w1, w2 of their open windows. docs: doc_id, text, settled, open (arrays of b1, or null)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, settled, opened = text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        some = [i for i in range(len(texts)) if settled[i] or opened[i]]
        spans: list[list] = [[] for _ in texts]
        windows: list[list] = [[] for _ in texts]
        n = [-1] * len(texts)
        for at, skip, p in parsed([texts[i] for i in some], width):
            b1 = p.blocks()[0].view(np.int64)
            for k in range(len(p.bounds) - 1):
                i, begin = some[at + k], p.bounds[k]
                own = slice(p.of_text[k], p.of_text[k + 1])
                n[i] = skip + int(p.bounds[k + 1] - begin)
                first, count = p.first[own], p.count[own]
                if settled[i]:
                    hit = np.isin(b1[own], np.array(settled[i], np.int64))
                    spans[i].append((skip + first[hit] - begin, skip + first[hit] + count[hit] - 1 + width - begin))
                if opened[i]:
                    hit = np.isin(b1[own], np.array(opened[i], np.int64))
                    starts = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(count[hit])[:-1]]), count[hit]) + np.arange(count[hit].sum())
                    windows[i].append(p.window_names(starts.astype(np.int64)))
        rows, one, two, counts = [], [], [], []
        for i, text in enumerate(texts):
            size = sum(len(w[0]) for w in windows[i])
            if n[i] < 0:
                n[i] = sum(len(c.split()) for c in chunks(text))
            told, gone = (None, 0) if size else _kept(text, n[i], spans[i], digest)
            rows.append((n[i], gone, told, text.decode("utf-8", "replace") if size else None, settled[i] if size else None))
            one += [w[0] for w in windows[i]]
            two += [w[1] for w in windows[i]]
            counts.append(size)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
        columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, *(pa.ListArray.from_arrays(offsets, _longs(x)) for x in (one, two))], names=["doc_id", "n_words", "n_removed", "kept", "text", "settled", "w1", "w2"])

    return mapped(docs, run, f"{CUT}, text string, settled array<long>, w1 array<long>, w2 array<long>", rows=1024)


def finish(docs: DataFrame, width: int, digest: bool) -> DataFrame:
    """CUT of the texts that had open blocks; docs: doc_id, text, settled, single (array of w1, or null)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, settled, single = text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        spans: list[list] = [[] for _ in texts]
        n = [0] * len(texts)
        for at, skip, p in parsed(texts, width):
            b1 = p.blocks()[0].view(np.int64)
            for k in range(len(p.bounds) - 1):
                i, begin, end = at + k, int(p.bounds[k]), int(p.bounds[k + 1])
                own = slice(p.of_text[k], p.of_text[k + 1])
                n[i] = skip + end - begin
                if settled[i]:
                    hit = np.isin(b1[own], np.array(settled[i], np.int64))
                    spans[i].append((skip + p.first[own][hit] - begin, skip + p.first[own][hit] + p.count[own][hit] - 1 + width - begin))
                if single[i] and end - begin >= width:
                    starts = np.arange(begin, end - width + 1)
                    hit = starts[np.isin(p.window_names(starts)[0].view(np.int64), np.array(single[i], np.int64))]
                    spans[i].append((skip + hit - begin, skip + hit + width - begin))
        rows = [(n[i], *reversed(_kept(text, n[i], spans[i], digest))) for i, text in enumerate(texts)]
        columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept"])

    return mapped(docs, run, CUT, rows=1024)


def cut_repeats(docs: DataFrame, width: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept of each row of docs (doc_id, text): the text that stays, or its SHA-256.

    A word goes if it lies in a window of `width` words that also starts in a document with a smaller doc_id. Null and
    empty texts have no words and keep "". Texts shorter than a window stay whole, with single spaces. Rows that share
    a doc_id count as one document for what is earlier, and are each cut; a row without a doc_id is kept whole and
    gives nothing to others. Other columns are ignored; no rows give no rows. Long texts are parsed in parts, so memory
    is some bytes for each byte of the longest text.
    """
    if width < 2:
        raise ValueError("a window must have two words at least")
    spark = docs.sparkSession
    docs = docs.select(long_id(docs), "text")
    rows = stored(block_rows(docs.where("doc_id IS NOT NULL"), width), "blocks")
    blocks = stored(rows.groupBy("key", "b1", "b2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "block-firsts")
    several = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("several"))
    matter = blocks.join(several, "key", "left").where("first < last OR several").select("key", "b1", "b2", "first", F.coalesce("several", F.lit(False)).alias("several"))
    state = rows.join(matter, ["key", "b1", "b2"]).where("first < doc_id OR several").select("doc_id", "b1", (F.col("first") < F.col("doc_id")).alias("done"))
    lists = state.groupBy("doc_id").agg(F.collect_set(F.when(F.col("done"), F.col("b1"))).alias("settled"), F.collect_set(F.when(~F.col("done"), F.col("b1"))).alias("open"))
    lists = stored(lists, "block-states")  # a list is never longer than its own document
    drop_stored(spark, rows, blocks)
    part = stored(settle(docs.join(lists, "doc_id", "left").select("doc_id", "text", "settled", "open"), width, digest), "settled")
    opened = part.where("kept IS NULL")
    windows = opened.select("doc_id", F.explode(F.arrays_zip("w1", "w2")).alias("w")).select("doc_id", "w.w1", "w.w2")
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    late = windows.join(firsts, ["w1", "w2"]).where("first < doc_id").groupBy("doc_id").agg(F.collect_set("w1").alias("single"))
    done = finish(opened.select("doc_id", "text", "settled").join(late, "doc_id", "left").select("doc_id", "text", "settled", "single"), width, digest)
    return part.where("kept IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept").union(done)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cut_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
