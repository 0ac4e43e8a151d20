"""Exact top-k by inner product over a bit-sliced index.

1. Integer vectors are dealt into blocks. In a block each component, less its minimum, becomes one bitmap a bit (a slice
   with a bit for each row); rows stand in the order of their ids. That is the index; it is written once.
2. A query's score is a sum of slices: the slice of bit i of a component whose weight in the query has bit j counts
   2**(i+j); for a negative weight the slice's complement counts instead, and a constant makes up for both. Slices of
   one weight are added by carry-save adders, three to two, on whole bitmaps, which leaves the score itself as slices.
3. From the most significant slice of the score down, rows with a one are certain if k rows or fewer have one, else
   only they remain. What remains at the end has one and the same score: of these the least ids are taken.
4. The best of each block meet by query, and the first k stay. No quantity is rounded, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import stored
from fieldglass.llm.vectors import bound, ids, matrix, numbered, quantised, takes_part, upto

#: Rows of a block of the index, and queries that a task answers at once.
BLOCK, QUERIES = 8192, 512

_INDEX = "block long, n int, ids array<long>, places array<long>, low array<long>, widths array<int>, slices array<long>"
_FOUND = "query long, query_id long, vec_id long, score long"


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minima, widths in bits, slices) of the columns of values; slices are rows of 64-bit words, least bit first."""
    rows, width = values.shape
    low = values.min(axis=0) if rows else np.zeros(width, np.int64)
    above = (values - low).astype(np.uint64)
    widths = np.array([int(x).bit_length() for x in above.max(axis=0)] if rows else [0] * width, np.int32)
    words = (rows + 63) // 64
    bits = np.zeros((int(widths.sum()), words * 64), np.uint8)
    at = 0
    for c, w in enumerate(widths):
        for i in range(w):
            bits[at, :rows] = (above[:, c] >> np.uint64(i)) & np.uint64(1)
            at += 1
    return low, widths, np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _total(stack: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sum's slice of this weight and the carries, slices of the next, of bitmaps of one weight."""
    carries = []
    while len(stack) > 2:
        third = len(stack) // 3
        a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
        half = a ^ b
        carries.append((a & b) | (half & c))
        stack = np.concatenate([half ^ c, stack[3 * third :]])
    if len(stack) == 2:
        carries.append(stack[:1] & stack[1:])
        stack = stack[:1] ^ stack[1:]
    return stack[0], carries


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, low: np.ndarray, widths: np.ndarray, slices: np.ndarray, rows: int) -> None:
        self.low, self.widths, self.rows = low, widths, rows
        self.words = (rows + 63) // 64
        plain = slices.reshape(int(widths.sum()), self.words)
        self.both = np.concatenate([plain, ~plain])  # complements for negative weights
        self.column = np.repeat(np.arange(len(widths)), widths)
        self.bit = np.concatenate([np.arange(w) for w in widths] or [np.empty(0, np.int64)]).astype(np.int64)
        self.exists = np.full(self.words, ~np.uint64(0))
        if rows % 64:
            self.exists[-1] = np.uint64((1 << rows % 64) - 1)

    def score(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """The slices of a sum for each row, and what is to be added to it for the inner product."""
        size = np.abs(query)
        bits = np.arange(int(size.max(initial=0)).bit_length())
        on = (size[self.column][None, :] >> bits[:, None]) & 1
        j, plane = np.nonzero(on)
        weight = bits[j] + self.bit[plane]
        plane = plane + (query[self.column[plane]] < 0) * len(self.column)
        order = np.argsort(weight, kind="stable")
        plane, ends = plane[order], np.searchsorted(weight[order], np.arange(int(weight.max(initial=-1)) + 2))
        out, carries, w = [], [], 0
        while w < len(ends) - 1 or carries:
            own = self.both[plane[ends[w] : ends[w + 1]]] if w < len(ends) - 1 else self.both[:0]
            stack = np.concatenate([own, *carries])
            one, carries = _total(stack) if len(stack) else (np.zeros(self.words, np.uint64), [])
            out.append(one)
            w += 1
        constant = sum(int(q) * int(low) + (int(q) * ((1 << int(n)) - 1) if q < 0 else 0) for q, low, n in zip(query, self.low, self.widths, strict=True))
        return np.array(out, np.uint64).reshape(-1, self.words), constant

    def best(self, query: np.ndarray, k: int, without: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The rows (ascending) of the k highest scores, ties to lesser rows, and their scores. without: rows left out."""
        slices, constant = self.score(query)
        maybe = self.exists.copy()
        for row in without:
            maybe[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure, n = np.zeros(self.words, np.uint64), 0
        for one in slices[::-1]:
            ones = maybe & one
            c = int(np.bitwise_count(ones).sum())
            if n + c > k:
                maybe = ones
            else:
                sure |= ones
                n += c
                maybe &= ~one
            if n == k:
                break
        rows = np.concatenate([_rows(sure), _rows(maybe)[: k - n]])
        values = (slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        return rows, [constant + sum(int(b) << w for w, b in enumerate(values[:, x])) for x in range(len(rows))]


def _rows(bitmap: np.ndarray) -> np.ndarray:
    some = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return some[word] * 64 + bit


def _build(table: pa.Table) -> pa.Table:
    null, vec = ids(table["vec_id"])
    place = table["place"].to_numpy()
    order = np.lexsort([place, vec, null])
    low, widths, slices = sliced(matrix(table["v"])[order])
    vec_ids = table["vec_id"].combine_chunks().take(pa.array(order)).to_pylist()
    row = [[table["block"][0].as_py()], [len(order)], [vec_ids], [place[order]], [low], [widths], [slices.ravel().view(np.int64)]]
    kinds = [pa.int64(), pa.int32(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())]]
    return pa.table([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["block", "n", "ids", "places", "low", "widths", "slices"])


def bit_sliced_index(vectors: DataFrame, rows: int, block: int = BLOCK) -> DataFrame:
    """The index, written, of vectors (vec_id long, v array<long>, place long: 0 to rows - 1): a row for each block."""
    dealt = vectors.withColumn("block", F.floor(F.col("place") / block).cast("long"))
    built = dealt.groupBy("block").applyInArrow(_build, _INDEX)
    return stored(built, "bit-slices")


def search(index: DataFrame, blocks: int, queries: DataFrame, k: int, batch: int = QUERIES) -> DataFrame:
    """query (a query's number), query_id, rank, vec_id, score: the k best rows of the index for each of the queries
    (query_id, v, place: of its own row in the index, which is left out)."""
    asked, n = numbered(queries.select("query_id", "v", F.col("place").alias("own")))
    groups = (n + batch - 1) // batch
    asked = asked.withColumn("query", F.col("place")).withColumn("group", F.floor(F.col("place") / batch).cast("long"))
    asked = asked.select("query", "query_id", "v", "own", "group", F.explode(upto(blocks)).alias("block"))
    parts = index.select("*", F.explode(upto(groups)).alias("group"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=["query", "query_id", "vec_id", "score"])
        row = left.slice(0, 1)
        low, widths, slices, places = (row[c].combine_chunks().flatten().to_numpy() for c in ("low", "widths", "slices", "places"))
        asked = matrix(right["v"], len(low))
        span = np.stack([low, low + (np.int64(1) << widths.astype(np.int64)) - 1]) if len(low) else np.zeros((2, 0), np.int64)
        if bound(asked, span) >= 2.0**62:
            raise ArithmeticError("the vectors' components are too large: a score may pass 64 bits")
        block, vec_ids = Block(low, widths, slices.view(np.uint64), row["n"][0].as_py()), row["ids"].combine_chunks().flatten()
        order = np.argsort(places)
        own = right["own"].to_numpy()
        at = np.minimum(np.searchsorted(places, own, sorter=order), len(places) - 1)
        found, counts, scores = [], [], []
        for q, o, x in zip(asked, own, order[at], strict=True):
            rows, values = block.best(q, k, np.array([x] if places[x] == o else [], np.int64))
            found.append(rows)
            counts.append(len(rows))
            scores += values
        many = pa.array(np.repeat(np.arange(len(own)), counts))
        return pa.table([right["query"].take(many), right["query_id"].take(many), vec_ids.take(pa.array(np.concatenate(found))), pa.array(scores, pa.int64())], names=["query", "query_id", "vec_id", "score"])

    best = parts.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(answer, _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """For each row of vectors (vec_id long, embedding array of numbers) for which is_query holds: the k other rows of
    highest integer inner product of floor(256 * x), or all if fewer: query_id, rank, vec_id, score.

    Ties go to lesser vec_ids, a null vec_id is greatest. Rows are told apart as rows: a repeated row, also one with the
    same vec_id, is another candidate and, if a query, asked again. Null vectors and such with null or non-finite
    components take no part; vectors of different lengths count as filled up with zeros. Other columns are ignored; an
    empty table gives no rows. Components so large that a score may pass 64 bits raise ArithmeticError.
    """
    rows = vectors.where(takes_part(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    placed, n = numbered(rows)
    index = bit_sliced_index(placed, n)
    queries = placed.where("asks").select(F.col("vec_id").alias("query_id"), "v", "place")
    return search(index, (n + BLOCK - 1) // BLOCK, queries, k).drop("query")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
