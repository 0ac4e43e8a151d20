"""Language-model scores: the likelihood of a text over all of its segmentations into subwords.

The pieces and their order are those of a public tokenizer and stay as they are. Its file holds merge ranks, no
probabilities; so a unigram score is given to each piece by one pass of expectation maximisation over the training
documents, from a start in inverse proportion to the rank. The probability of a word is the sum over all of its
segmentations (forward recursion in log space), that of a text the product over its words and one end.

What is counted are distinct words: documents become bags of words, words get their count and their likelihood once,
and bags meet words in two ways with one result. The HOT most frequent words, a fixed number of whatever length, are
broadcast, a long one by its digest; the rest is joined by word, so no key is hot. Sums of scores are of whole numbers
of STEP, which don't depend on the order of rows.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.shared import LOWER_BYTES, drop_stored, long_id, mapped, stored, text_bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that are broadcast, of 64 bytes at most or by digest: some 8 MB.
HOT = 1 << 16
#: The unit in which scores (log10) are summed: a long then holds what a text of 1 GB can have.
STEP = 1e-9
SPACE = "▁"
#: Added to the expected count of each piece.
SMOOTH = 0.1
#: Characters of a word from which on its sums are kept in arrays: 16 bytes a character, 160 MB for a word of 10 MB.
LONG = 1_000


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Start scores (natural logarithms) of the pieces and of the bytes of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    weights = {model.id_to_piece(i): 1 / (10 - model.get_score(i)) for i in ids}
    total = math.log(sum(weights.values()))
    return {piece: math.log(w) - total for piece, w in weights.items()}


class Lattice:
    """Sums over the segmentations of a word, a space mark before it."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: The score of each piece, and None for what is only the start of pieces: a walk from a place ends where neither is.
        self.walk: dict[str, float | None] = {p[:k]: None for p in scores for k in range(1, len(p))} | scores

    def spelled(self, char: str) -> tuple[str, ...]:
        return tuple(f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogatepass"))

    def steps(self, s: str, start: int) -> Iterator[tuple[int, float, tuple[str, ...]]]:
        """(end, score, pieces) of what can come next at a place of a word. A character that is no piece is spelled by its bytes."""
        scores, get = self.scores, self.walk.get
        if s[start] not in scores:
            pieces = self.spelled(s[start])
            yield start + 1, sum([scores.get(p, -30.0) for p in pieces]), pieces
        for end in range(start + 1, len(s) + 1):
            score = get(p := s[start:end], False)
            if score is False:
                break
            if score is not None:
                yield end, score, (p,)

    def forward(self, s: str) -> array:
        """For each place, the logarithm of the sum over all ways to it: eight bytes a character."""
        alpha = array("d", [-math.inf]) * (len(s) + 1)
        alpha[0] = 0.0
        for start in range(len(s)):
            a = alpha[start]
            for end, score, _ in self.steps(s, start):
                t, old = a + score, alpha[end]
                alpha[end] = max(old, t) + math.log1p(math.exp(-abs(old - t)))
        return alpha

    def likelihood(self, word: str) -> float:
        """Natural logarithm of the probability of the word over all segmentations."""
        if len(word) > LONG:
            return self.forward(SPACE + word)[-1]
        s, scores, get, n = SPACE + word, self.scores, self.walk.get, len(word) + 1
        exp, log1p = math.exp, math.log1p
        alpha: list[float | None] = [0.0] + [None] * n
        for start in range(n):
            a = alpha[start]
            if s[start] not in scores:
                t, old = a + sum([scores.get(p, -30.0) for p in self.spelled(s[start])]), alpha[start + 1]
                alpha[start + 1] = t if old is None else old + log1p(exp(t - old)) if old > t else t + log1p(exp(old - t))
            for end in range(start + 1, n + 1):
                score = get(s[start:end], False)
                if score is False:
                    break
                if score is not None:
                    t, old = a + score, alpha[end]
                    alpha[end] = t if old is None else old + log1p(exp(t - old)) if old > t else t + log1p(exp(old - t))
        return alpha[n]

    @cached_property
    def weights(self) -> dict[str, float | None]:
        """walk, with probabilities in place of their logarithms."""
        return {p: None if score is None else math.exp(score) for p, score in self.walk.items()}

    def expect(self, word: str, times: float, into_counts: dict[str, float]) -> None:
        """Add the expected uses of each piece in `times` of the word (forward and backward).

        Probabilities as such while they are far from underflow, as they are for all but long words; then their logarithms.
        """
        s, scores, get, n = SPACE + word, self.scores, self.weights.get, len(word) + 1
        if n > 64:
            return self.expect_long(word, times, into_counts)
        alpha, edges = [1.0] + [0.0] * n, []
        for start in range(n):
            a = alpha[start]
            if s[start] not in scores:
                pieces = self.spelled(s[start])
                w = math.exp(sum([scores.get(p, -30.0) for p in pieces]))
                alpha[start + 1] += a * w
                edges.append((start, start + 1, w, pieces))
            for end in range(start + 1, n + 1):
                w = get(p := s[start:end], False)
                if w is False:
                    break
                if w is not None:
                    alpha[end] += a * w
                    edges.append((start, end, w, p))
        if alpha[n] < 1e-250:
            return self.expect_long(word, times, into_counts)
        beta = [0.0] * n + [times / alpha[n]]
        for start, end, w, piece in reversed(edges):
            through = w * beta[end]
            beta[start] += through
            if piece.__class__ is str:
                into_counts[piece] += alpha[start] * through
            else:
                for p in piece:
                    into_counts[p] += alpha[start] * through

    def expect_long(self, word: str, times: float, into_counts: dict[str, float]) -> None:
        """expect() in logarithms, in two numbers a character: what leaves a place is looked up again on the way back."""
        s = SPACE + word
        alpha = self.forward(s)
        beta = array("d", [-math.inf]) * len(alpha)
        beta[-1] = 0.0
        total = alpha[-1]
        for start in range(len(s) - 1, -1, -1):
            b = -math.inf
            for end, score, pieces in self.steps(s, start):
                through = score + beta[end]
                if through == -math.inf:
                    continue
                b = through if b == -math.inf else max(b, through) + math.log1p(math.exp(-abs(b - through)))
                p = times * math.exp(alpha[start] + through - total)
                for piece in pieces:
                    into_counts[piece] += p
            beta[start] = b


def bags(docs: DataFrame) -> DataFrame:
    """row, doc_id, held_out, n_words, words, counts of each row of docs (doc_id, text, held_out)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Counter(t.translate(LOWER_BYTES).split()) for t in text_bytes(batch.column(2))]
        words = pa.array([[w.decode("utf-8", "replace") for w in c] for c in found], pa.list_(pa.string()))
        counts = pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sum(c.values()) for c in found], pa.int64()), words, counts], names=["doc_id", "held_out", "n_words", "words", "counts"])

    made = mapped(docs.select("doc_id", "held_out", "text"), count, "doc_id long, held_out boolean, n_words long, words array<string>, counts array<int>", rows=256)
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "bags")


def trained_scores(words: DataFrame, start: dict[str, float], ends: int) -> tuple[dict[str, float], float]:
    """Scores of the pieces and of the end after one pass over words (word, c); a row a piece comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(start), defaultdict(float)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expect(word, c, counts)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.float64())})

    found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = {r.piece: r.n for r in found.collect()}  # no more than the vocabulary has
    total = math.log(sum(counts.values()) + ends + SMOOTH * (len(start) + 1))
    return {p: math.log(counts.get(p, 0.0) + SMOOTH) - total for p in start}, math.log(ends + SMOOTH) - total


def lattice_scores(docs: DataFrame, pieces: dict[str, float] | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10).

    Tokens are the words of the text, A-Z in lower case, and one end. Null, empty and blank texts have the end alone.
    Rows whose held_out is not true train the model; with none of them all counts are zero. Rows that share a doc_id
    are scored each by itself. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    start = pieces or vocabulary()
    kept = bags(docs.select(long_id(docs), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"))
    said = kept.select("row", "held_out", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", "held_out", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counted = said.groupBy("word").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("n"))).alias("c"), F.sum("n").alias("all"))
    words = stored(counted, "words")
    ends = kept.where("NOT held_out").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("c") > 0, 1)), F.lit(0)).alias("v")).first()
    tokens, kinds = sums.n + ends, sums.v + (ends > 0)
    scores, end_score = trained_scores(words, start, ends)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(scores)  # once a task
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = [lattice.likelihood(w) / math.log(10) for w in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=["word", "c", "all", "lat"])

    def base(c: Column) -> Column:
        return F.log10((c + 0.5) / F.lit(tokens + 0.5 * (kinds + 1)))

    weighed = words.mapInArrow(weigh, "word string, c long, all long, lat double").select("word", "all", (F.col("c") > 0).alias("known"), base(F.col("c")).alias("base"), "lat")
    weighed = stored(weighed, "word-scores")
    drop_stored(spark, words)

    short = F.when(F.octet_length("word") <= 64, F.col("word")).otherwise(F.sha2("word", 256))
    hot = stored(weighed.orderBy(F.desc("all"), "word").limit(HOT).select(short.alias("key"), "known", "base", "lat"), "hot-words")
    said = said.withColumn("key", short)
    n = F.col("n")
    parts = [F.sum(F.when(F.col("known"), n).otherwise(0)).alias("known"), *(F.sum(F.rint(n * F.col(x) / STEP).cast("long")).alias(x) for x in ("base", "lat"))]
    common = said.join(F.broadcast(hot), "key").groupBy("row").agg(*parts)
    rare = said.join(F.broadcast(hot.select("key")), "key", "left_anti").join(weighed.select("word", "known", "base", "lat"), "word").groupBy("row").agg(*parts)
    sums = common.union(rare).groupBy("row").agg(*(F.sum(x).alias(x) for x in ("known", "base", "lat")))
    return (
        kept.select("row", "doc_id", "held_out", "n_words")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "held_out",
            (F.col("n_words") + 1).alias("n_tokens"),
            (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.coalesce("base", F.lit(0)) * STEP + base(F.lit(ends))).alias("base_score"),
            (F.coalesce("lat", F.lit(0)) * STEP + end_score / math.log(10)).alias("score"),
        )
    )


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return lattice_scores(docs.select("doc_id", "text", held_out.alias("held_out")))
