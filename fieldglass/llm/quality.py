"""Quality rules as a short-circuit cascade.

Each rule is a cheap verdict on one document. On a bounded sample the cost of each rule (seconds a document) and
its selectivity (share of documents that it rejects) are measured; the rules then run in order of rejections per
cost, and a document meets no rule after the first that rejects it. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldglass.llm.shared import quoted, row_packed, row_unpacked

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LETTER = regex.compile(r"\p{L}")
#: Documents that the order of the rules is fitted on, at most.
SAMPLE_ROWS = 2_000


class Doc:
    """A text and its features, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANK))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        numbers: dict[bytes, int] = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, n)
        if len(numbers) == n:
            return 0
        # A window is numbered by its first two words' number and the third: exact, and eight bytes a word.
        _, pairs = np.unique(words[:-1] * n + words[1:], return_inverse=True)
        _, windows, found = np.unique(pairs[:-1] * n + words[2:], return_inverse=True, return_counts=True)
        again = found[windows] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= again
        return int(hit.sum())

    @cached_property
    def top_word(self) -> int:
        """How often the most frequent word comes."""
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def lettered(self) -> int:
        """Words that hold a letter."""
        return sum(LETTER.search(w.decode("utf-8", "replace")) is not None for w in self.words)

    def starting(self, marks: tuple[str, ...]) -> int:
        return sum(x.lstrip(BLANK).startswith(marks) for x in self.lines)

    def ending(self, marks: tuple[str, ...]) -> int:
        return sum(x.rstrip(BLANK).endswith(marks) for x in self.lines)


#: Name and test of each rule; true rejects. The first two are the base rules of the contract.
RULES: dict[str, Callable[[Doc], bool]] = {
    "too_short": lambda d: d.n_words < 50,
    "repeated_windows": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "word_length": lambda d: not 3 * d.n_words <= d.word_chars <= 10 * d.n_words,
    "repeated_lines": lambda d: 5 * d.n_dup_lines > 2 * len(d.lines),
    "few_letters": lambda d: 10 * d.lettered < 7 * d.n_words,
    "one_word": lambda d: 10 * d.top_word > 3 * d.n_words,
    "bullets": lambda d: 10 * d.starting(("-", "*", "•", "·", "‣")) > 9 * len(d.lines),
    "cut_off_lines": lambda d: 10 * d.ending(("...", "…")) > 3 * len(d.lines),
}
BASE_RULES = ("too_short", "repeated_windows")


def rule_order(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules by rejections per cost, best first, as measured on at most sample_rows documents spread over the table.

    Rows: rule, seconds (a document), rejects (share). Ties and a table without rows keep the order given.
    """
    n = docs.count()
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    names = list(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejects, rows = [0.0] * len(names), [0] * len(names), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                for i, name in enumerate(names):
                    doc, began = Doc(text), time.perf_counter()  # a new one: no rule gains by another's features
                    rejects[i] += bool(rules[name](doc))
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(names)), pa.int32()), "seconds": seconds, "rejects": pa.array(rejects, pa.int64()), "n": pa.array([rows] * len(names), pa.int64())})

    sample = docs.select("text").sample(fraction=share, seed=7).limit(sample_rows)
    found = {r.rule: r for r in sample.mapInArrow(measure, "rule int, seconds double, rejects long, n long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejects").alias("rejects"), F.sum("n").alias("n")).collect()}  # a row for each rule
    report = [{"rule": name, "seconds": found[i].seconds / found[i].n, "rejects": found[i].rejects / found[i].n} if i in found and found[i].n else {"rule": name, "seconds": 0.0, "rejects": 0.0} for i, name in enumerate(names)]
    return sorted(report, key=lambda r: -r["rejects"] / max(r["seconds"], 1e-9))


VERDICT = "failed_rule string, n_rules_run int"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_cascade(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES, order: list[str] | None = None, stats: bool = False) -> DataFrame:
    """docs with kept, failed_rule (null when kept) and n_rules_run; with stats, the base counts as well.

    Null text counts as empty and fails too_short. Each row is judged by itself: repeated rows get equal verdicts.
    Columns of docs with the names of new ones are replaced; others stay as they are. No rows give no rows. A task
    holds one text's words at a time, some twenty times the bytes of a text of short words.
    """
    order = order or [r["rule"] for r in rule_order(docs, rules)]
    kinds = f"{STATS}, {VERDICT}" if stats else f"kept boolean, {VERDICT}"
    new = [x.split()[0] for x in kinds.split(", ")]
    kept_columns = [c for c in docs.columns if c not in new]
    fields = [f for f in docs.schema if f.name in kept_columns]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    doc, failed, run = Doc(text), None, 0
                    for name in order:
                        run += 1
                        if rules[name](doc):
                            failed = name
                            break
                    row = (failed is None, failed, run)
                    if stats:
                        base = any(RULES[name](doc) for name in BASE_RULES)
                        row = (doc.n_words, doc.word_chars, doc.n_symbols, doc.n_dup_lines, doc.n_repeat_words, base, failed is None and not base, failed, run)
                    rows.append(row)
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[k.split()[1]] for k in kinds.split(", ")], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept_columns] + made, names=[*kept_columns, *new])

    return docs.select(*map(quoted, dict.fromkeys([*kept_columns, "text"]))).mapInArrow(judge, StructType([*fields, *StructType.fromDDL(kinds)]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Which rule rejects first follows measured seconds; what is returned is the same in every run.
    return quality_cascade(docs, stats=True).drop("text", "failed_rule", "n_rules_run")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, with all columns that they had."""
    return row_unpacked(quality_cascade(row_packed(docs, "text")).where("kept"), docs.columns, "text")
