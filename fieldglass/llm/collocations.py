"""Phrase collocations from suffix automata.

1. Documents of a language are gathered in shards of some megabytes, as strings of word numbers with a 0 between pieces.
   Words are counted over all shards; those too rare for any candidate become breaks, the others get global numbers.
2. In each shard a suffix automaton of bounded depth over all its strings has a state for each set of end positions, the
   size of that set, and the suffix link to the state of the longest suffix with more end positions. A state stands for
   its substrings from one word more than its link's longest to its own longest; they are enumerated with their counts.
3. Counts meet over all shards, first of two words; then strings are broken where two words are too rare together, and
   automata over what is left give three and four. Breaking loses nothing: no phrase is more frequent than a part of it.
4. A candidate goes if a candidate of one word more, whose suffix link (first word off) or prefix (last word off) it is,
   is nearly as frequent. Longer ones need no look: what lies between is at least as frequent as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import LOWER, UPPER, drop_stored, stored
from fieldglass.llm.vectors import numbered

#: Words of the longest phrase.
DEPTH = 4
#: Bytes of text of a shard; a longer document is one by itself.
SHARD = 8 << 20
#: Words of text for each part of the pairs; a part holds some of the different pairs of every shard.
PART = 2 << 20
#: Bits of a word's global number.
BITS = 31

#: A-Z to a-z, tabs to blanks, whatever ends a piece to a line feed: none of these is part of a word.
_PLAIN = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\x0b\x0c\x0d", LOWER.encode() + b" " + b"\n" * 9)


def strings(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers, words, counts): the texts as one string of numbers, k + 1 for words[k], 0 between pieces and texts."""
    plain = re.sub(rb"\n+", b" \n ", b"\n".join(texts).translate(_PLAIN))
    coded = pc.split_pattern(pa.array([plain], pa.large_binary()), b" ").values.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    real = np.array([w not in (b"", b"\n") for w in words], bool)
    number = np.where(real, np.cumsum(real), 0)
    number[[i for i, w in enumerate(words) if not w]] = -1  # two blanks
    out = number[at]
    out = out[out >= 0].astype(np.int32)
    kept = [w for w in words if w not in (b"", b"\n")]
    return out, kept, np.bincount(out, minlength=len(kept) + 1)[1:]


class Automaton:
    """The suffix automaton of strings (numbers under 2**BITS, 0 between strings), cut off at `depth` symbols.

    States: end (a position in the strings where its substrings end), longest, shortest, count (end positions), link.
    It is made from the tree of suffix links, which is the tree of reversed prefixes: level by level, positions are
    named by the symbols before them. A node with a child of its own count is no state: both have the same end positions.
    """

    def __init__(self, text: np.ndarray, depth: int = DEPTH) -> None:
        self.text, text = text, text.astype(np.int64)
        at = np.flatnonzero(text)
        parent, levels = np.zeros(len(at), np.int64), []
        for length in range(1, depth + 1):
            symbol = text[at - length + 1]
            some = (symbol > 0) & (at >= length - 1)
            at = at[some]
            key, first, name, count = np.unique((parent[some] << BITS) | symbol[some], return_index=True, return_inverse=True, return_counts=True)
            levels.append((key >> BITS, at[first], count))
            parent = name
        state_of: list[np.ndarray] = [np.empty(0, np.int64)] * depth
        parts, states = [], 0
        for k in range(depth - 1, -1, -1):
            up, end, count = levels[k]
            own = np.full(len(end), -1)
            if k + 1 < depth:  # a child with as many end positions is the only one and holds this node
                child_up, _, child_count = levels[k + 1]
                same = child_count == count[child_up]
                own[child_up[same]] = state_of[k + 1][same]
            new = np.flatnonzero(own < 0)
            own[new] = states + np.arange(len(new))
            states += len(new)
            state_of[k] = own
            parts.append((end[new], np.full(len(new), k + 1), count[new]))
        self.end, self.longest, self.count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.shortest, self.link = self.longest.copy(), np.full(states, -1)
        for k in range(depth):
            np.minimum.at(self.shortest, state_of[k], k + 1)
        for k in range(1, depth):
            top = self.shortest[state_of[k]] == k + 1  # the node whose parent belongs to another state
            self.link[state_of[k][top]] = state_of[k - 1][levels[k][0][top]]

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, a row for each substring of this length; counts)."""
        some = (self.shortest <= length) & (length <= self.longest)
        return self.text[self.end[some][:, None] + np.arange(1 - length, 1)].astype(np.int64), self.count[some]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size = made = 0
    task = TaskContext.get().partitionId() << 33

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal made
        for lang in sorted(held):
            numbers, words, counts = strings(held.pop(lang))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
            vocabulary = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary()).view(pa.string()))
            columns = [pa.array([task + made]), pa.array([lang]), pa.array([numbers], kinds[2]), vocabulary, pa.array([counts], kinds[4])]
            made += 1
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "numbers", "words", "counts"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text or b"")
            size += len(text or b"")
            if size >= SHARD:
                yield from rows()
                size = 0
    yield from rows()


def _renamed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard with global numbers; words without one, and what stands alone between such, become one break."""
    if not left.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], names=["shard", "numbers"])
    numbers = left["numbers"].combine_chunks().flatten().to_numpy()
    name = np.zeros(int(numbers.max(initial=0)) + 1, np.int32)
    name[right["local"].to_numpy()] = right["number"].to_numpy()
    text = name[numbers]
    text = _without_breaks(text)
    return pa.table([left["shard"], pa.array([text], pa.list_(pa.int32()))], names=["shard", "numbers"])


def _without_breaks(text: np.ndarray) -> np.ndarray:
    """text with single breaks only, and no symbol that has breaks on both sides."""
    near = np.concatenate([[0], text, [0]])
    text = text * ((near[:-2] > 0) | (near[2:] > 0))
    return text[(text > 0) | (np.concatenate([[0], text[:-1]]) > 0)]


def _pairs(parts: int):
    """The pairs of words of each shard, dealt into parts: equal pairs of all shards into the same one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, numbers in zip(batch.column(0), batch.column(1), strict=True):
                words, c = Automaton(numbers.values.to_numpy(), 2).substrings(2)
                gram = words[:, 0] << BITS | words[:, 1]
                part = (((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                used, first = np.unique(part[order], return_index=True)
                ends = pa.array([*first, len(order)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (gram, c)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), shard.as_py())), pa.array(used), *lists], names=["shard", "part", "grams", "counts"])

    return count


def _frequent(least: int):
    """Of a part: a row for each shard with those of its pairs that are frequent over all shards, and one without a shard
    with all of these and their counts."""

    def reduce(table: pa.Table) -> pa.Table:
        grams, counts = (table[c].combine_chunks() for c in ("grams", "counts"))
        ends = grams.offsets.to_numpy() - grams.offsets[0].as_py()
        gram, at = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        f = np.zeros(len(gram), np.int64)
        np.add.at(f, at, counts.flatten().to_numpy())
        kept = (f >= least)[at]
        own = pa.array(np.concatenate([[0], np.cumsum(kept)])[ends], pa.int32())
        back = pa.ListArray.from_arrays(own, pa.array(gram[at[kept]]))
        kinds = [pa.list_(pa.int64())] * 2
        columns = [[table["shard"].combine_chunks(), pa.array([None], pa.int64())], [back, pa.array([gram[f >= least]], kinds[0])], [pa.nulls(len(back), kinds[1]), pa.array([f[f >= least]], kinds[1])]]
        return pa.table([pa.chunked_array(x) for x in columns], names=["shard", "grams", "f"])

    return reduce


def _longer(left: pa.Table, right: pa.Table) -> pa.Table:
    """The substrings of three and four words of a shard in which all neighbours are in the right table."""
    found = []
    if left.num_rows and right.num_rows:
        text = left["numbers"].combine_chunks().flatten().to_numpy().astype(np.int64)
        known = np.sort(right["grams"].combine_chunks().flatten().to_numpy())
        gram = text[:-1] << BITS | text[1:]
        there = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram if len(known) else np.zeros(len(gram), bool)
        broken = np.zeros(2 * len(text), np.int64)  # a break after each word that doesn't go on
        broken[::2] = text
        keep = np.ones(2 * len(text), bool)
        keep[1:-1:2] = ~there
        machine = Automaton(_without_breaks(broken[keep]), DEPTH)
        for length in range(3, DEPTH + 1):
            words, count = machine.substrings(length)
            found.append((words[:, 0] << BITS | words[:, 1], words[:, 2] if length == 3 else words[:, 2] << BITS | words[:, 3], count))
    columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3)]
    return pa.table([pa.array(x) for x in columns], names=["a", "b", "c"])


def _unpacked(packed: str) -> F.Column:
    """The one or two numbers in a column, as an array."""
    high, low = F.shiftright(packed, BITS), F.col(packed).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.when(high > 0, F.array(high, low)).when(low > 0, F.array(low)).otherwise(F.array().cast("array<bigint>"))


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals) of docs (lang, text): words (number, lang, word, f) and phrases (w: array of 2 to DEPTH
    numbers, f) that occur `least` times or more in a language, and the occurrences n of all words of each lang. Written."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    shards = stored(plain.mapInArrow(_shards, "shard long, lang string, numbers array<int>, words array<string>, counts array<long>"), "shards", long_rows=True)
    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("shard", "lang", (F.col("at") + 1).alias("local"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    totals = stored(local.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    ranked, n = numbered(local.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least))
    if n >= (1 << BITS) - 1:
        raise ArithmeticError(f"{n} frequent words: more than numbers of {BITS} bits hold")
    words = stored(ranked.select((F.col("place") + 1).alias("number"), "lang", "word", "f"), "words")
    names = local.join(words.select("lang", "word", "number"), ["lang", "word"]).select(F.col("shard").alias("of"), "local", F.col("number").cast("int").alias("number"))
    named = stored(shards.select("shard", "numbers").groupBy("shard").cogroup(names.groupBy("of")).applyInArrow(_renamed, "shard long, numbers array<int>"), "named", long_rows=True)
    drop_stored(spark, shards)

    parts = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // PART))
    pairs = named.select("shard", "numbers").mapInArrow(_pairs(parts), "shard long, part long, grams array<long>, counts array<long>")
    found = stored(pairs.groupBy("part").applyInArrow(_frequent(least), "shard long, grams array<long>, f array<long>"), "pairs", long_rows=True)
    two = found.where("shard IS NULL").select(F.explode(F.arrays_zip("grams", "f")).alias("x")).select(F.col("x.grams").alias("gram"), F.col("x.f").alias("f"))
    back = found.where("shard IS NOT NULL").select(F.col("shard").alias("of"), "grams")
    longer = named.groupBy("shard").cogroup(back.groupBy("of")).applyInArrow(_longer, "a long, b long, c long")
    more = longer.groupBy("a", "b").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    both = two.select(_unpacked("gram").alias("w"), "f").union(more.select(F.concat(_unpacked("a"), _unpacked("b")).alias("w"), "f"))
    phrases = stored(both, "phrases")
    drop_stored(spark, named, found)
    return words, phrases, totals


def collocations(docs: DataFrame, least: int = 30, subsumed: int = 80, most: int = 2000) -> DataFrame:
    """The `most` best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    docs: lang (null: `und`), text (null: empty). Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces
    and those into words `[^\\x20\\x09]+`; phrases don't cross pieces. a: a phrase's occurrences, overlapping ones too,
    `least` at least; cut after its first words, l and r are those of its parts, and the cut with the least
    floor(2000000 * a / (l + r)) counts, of equal ones the earliest. A phrase inside a longer one with subsumed percent of
    its occurrences or more goes. Order: score, then a, falling, then the phrase in UTF-8 bytes. n: words of the language.
    Repeated rows count each time; other columns are ignored; no words give no rows. A document is never divided: a task
    takes some 40 bytes of memory for each byte of the longest text beyond 8 MB. Counts are exact up to 2**63.
    """
    words, phrases, totals = frequent_phrases(docs, least)
    counted = phrases.select("w", "f").union(words.select(F.array("number"), "f"))
    cuts = phrases.select("w", "f", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("w", "f", "k", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cuts = cuts.join(counted.select(F.col("w").alias("first"), F.col("f").alias("l")), "first").join(counted.select(F.col("w").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("w", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = phrases.where(F.size("w") > 2).select("f", F.explode(F.array(F.slice("w", F.lit(2), F.size("w") - 1), F.slice("w", F.lit(1), F.size("w") - 1))).alias("w"))
    best = longer.groupBy("w").agg(F.max("f").alias("within"))
    kept = scored.join(best, "w", "left").where(F.col("within").isNull() | (F.lit(100) * F.col("within") < F.lit(subsumed) * F.col("f")))

    spelt = kept.select("w", F.posexplode("w").alias("at", "number")).join(words.select("number", "lang", "word"), "number")
    texts = spelt.groupBy("w").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(texts, "w").join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
