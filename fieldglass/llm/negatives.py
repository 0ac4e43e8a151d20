"""Hard negatives by norm-bucketed search.

All rows are sorted by norm, longest first, and cut into buckets. For a group of anchors a task walks through a run of
buckets in that order; a bucket whose largest norm times the anchor's (Cauchy-Schwarz) lies below what an anchor still
looks for ends that anchor's walk, as all later buckets are shorter. What an anchor looks for is, for its positives, the
running k-th score of its label; for negatives, for each window the higher of its lower limit and its running k-th score.
Runs that no window of a group can reach aren't sent to that group at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import stored
from fieldglass.llm.vectors import bound, ids, matrix, numbered, quantised, takes_part, upto

#: Rows of a bucket, buckets of a run (what one task is sent at once), anchors of a group.
BUCKET, RUN, GROUP = 2048, 4, 1024
#: Windows times rows that are held as a matrix at once.
CELLS = 1 << 21
#: Norms are compared in floating point; a bucket is skipped only if its bound is below by more than this share.
SLACK = 1e-9

_FOUND = "anchor long, window int, vec_id long, place long, score long"


class Best:
    """The k best (score descending, id ascending with nulls last, place) rows found so far for each of n keys."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.rows = k, np.empty((5, 0), np.int64)  # key, score, is null, id, place
        self.limit = np.full(n, -np.inf)  # the k-th score, once there are k

    def add(self, key: np.ndarray, score: np.ndarray, null: np.ndarray, vec: np.ndarray, place: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([key, score, null.astype(np.int64), vec, place])], axis=1)
        rows = rows[:, np.lexsort([rows[4], rows[3], rows[2], -rows[1], rows[0]])]
        first = np.searchsorted(rows[0], rows[0])
        rank = np.arange(rows.shape[1]) - first
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.limit[last[0]] = last[1]


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floating point where it holds them all, else in integers."""
    most = bound(a, x)
    if most >= 2.0**56:
        raise ArithmeticError("the vectors' components are too large: scores and their windows may pass 64 bits")
    if most < 2.0**53:
        return a.astype(np.float64) @ x.astype(np.float64).T
    return a @ x.T


def _best_of(scores: np.ndarray, allowed: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the allowed scores of each row that may be among its k best: none below limit or k others."""
    held = np.where(allowed, scores, -np.inf)
    if held.shape[1] > k:
        limit = np.maximum(limit, np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k])
    return np.nonzero((held >= limit[:, None]) & allowed)


def _walk(anchors: np.ndarray, rows: pa.Table, wanted: np.ndarray, owner: np.ndarray, k: int, fits) -> Best:
    """The k best rows for each key. owner: a key's anchor; wanted: the least score it takes; fits(keys, chunk of rows,
    scores): which of these rows are right for these keys."""
    place = rows["place"].to_numpy()
    found = Best(len(owner), k)
    length = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    open_keys = np.arange(len(owner))
    for b in np.unique(place // BUCKET):
        part = rows.filter(pa.array(place // BUCKET == b))
        x = matrix(part["v"], anchors.shape[1])
        top = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())
        reach = length[owner[open_keys]] * top * (1 + SLACK)
        open_keys = open_keys[reach >= np.maximum(wanted[open_keys], found.limit[open_keys])]
        if not len(open_keys):
            break
        null, vec = ids(part["vec_id"])
        step = max(1, CELLS // len(x))
        for at in range(0, len(open_keys), step):
            keys = open_keys[at : at + step]
            who, again = np.unique(owner[keys], return_inverse=True)
            scores = _products(anchors[who], x)[again]
            r, c = _best_of(scores, fits(keys, part, scores), found.limit[keys], k)
            found.add(keys[r], scores[r, c].astype(np.int64), null[c], vec[c], part["place"].to_numpy()[c])
    return found


def _table(found: Best, key: np.ndarray, window: np.ndarray) -> pa.Table:
    at, score, null, vec, place = found.rows
    columns = [pa.array(key[at]), pa.array(window[at].astype(np.int32)), pa.array(vec, pa.int64(), mask=null.astype(bool)), pa.array(place), pa.array(score)]
    return pa.table(columns, names=["anchor", "window", "vec_id", "place", "score"])


def _both(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """The anchors' matrix, as wide as the widest vector of either side, and the rows by place."""
    right = right.sort_by("place")
    a = matrix(left["v"])
    return np.pad(a, ((0, 0), (0, max(0, matrix(right["v"]).shape[1] - a.shape[1])))), right


def _positives(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _both(left, right)
        own, label = left["place"].to_numpy(), left["label"].to_numpy()

        def fits(keys: np.ndarray, part: pa.Table, scores: np.ndarray) -> np.ndarray:
            return (part["label"].to_numpy()[None, :] == label[keys][:, None]) & (part["place"].to_numpy()[None, :] != own[keys][:, None])

        found = _walk(anchors, rows, np.full(len(own), -np.inf), np.arange(len(own)), k, fits)
        return _table(found, own, np.zeros(len(own), np.int64))

    return search


def _negatives(k: int, low: int, high: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _both(left, right)
        label = left["label"].to_numpy()
        scores = left["scores"].combine_chunks()
        counts = np.diff(scores.offsets.to_numpy())
        owner, positive = np.repeat(np.arange(len(counts)), counts), scores.flatten().to_numpy()
        window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        least, most = -((-low * positive) // 100), (high * positive) // 100

        def fits(keys: np.ndarray, part: pa.Table, scores: np.ndarray) -> np.ndarray:
            other = part["label"].to_numpy()[None, :] != label[owner[keys]][:, None]
            return other & (scores >= least[keys][:, None]) & (scores <= most[keys][:, None])

        wanted = np.where(least <= most, least, np.inf)  # an empty window is never looked into
        found = _walk(anchors, rows, wanted, owner, k, fits)
        return _table(found, left["place"].to_numpy()[owner], window)

    return search


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its positives, the first hard negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    vectors: vec_id long, label (long), embedding (array of numbers). Scores are integer inner products of floor(256 * x).
    An anchor's positives are the `positives` best other rows of its label; negatives are the best rows of other labels
    with low * positive_score <= 100 * score <= high * positive_score. Fewer rows are all returned. Ties go to lesser
    vec_ids, a null vec_id is greatest. Rows are told apart as rows: a repeated row is another row. Rows with a null label,
    a null vector or a null or non-finite component take no part; vectors of different lengths count as filled up with
    zeros. Other columns are ignored; an empty table gives no rows. Components so large that scores may pass 2**56 raise
    ArithmeticError.
    """
    ok = takes_part(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    placed, n = numbered(rows.withColumn("length", length), F.desc("length"))
    in_run = F.floor(F.col("place") / (BUCKET * RUN)).cast("long")
    runs, sent = (n + BUCKET * RUN - 1) // (BUCKET * RUN), ["place", "vec_id", "label", "v"]

    chosen, m = numbered(placed.where("anchor").withColumnRenamed("place", "own"), F.desc("length"))
    groups = (m + GROUP - 1) // GROUP
    anchors = chosen.withColumn("group", F.floor(F.col("place") / GROUP).cast("long")).withColumn("place", F.col("own")).drop("own", "anchor")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    to_runs = anchors.select("group", *sent, F.explode(upto(runs)).alias("run")).groupBy("group", "run")
    dealt = placed.select(*sent, in_run.alias("run"), F.explode(upto(groups)).alias("group")).groupBy("group", "run")
    best = to_runs.cogroup(dealt).applyInArrow(_positives(positives), _FOUND)
    best = best.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
    listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("positives"))
    known = stored(anchors.join(listed.withColumnRenamed("anchor", "place"), "place"), "positives")

    # The last run that a group must see: a window's lower limit over the anchor's length is the least norm of use.
    asked = F.ceil(F.array_min("positives.score") * low / 100.0).cast("double")
    needed = {r["group"]: r["needed"] for r in known.groupBy("group").agg(F.min(F.when(F.col("length") > 0, asked / F.col("length")).otherwise(0.0)).alias("needed")).collect()}
    tops = dict(placed.groupBy(in_run.alias("run")).agg(F.max("length").alias("top")).collect())
    last = [sum(tops[r] * (1 + SLACK) >= needed[g] for r in range(runs)) - 1 if g in needed else -1 for g in range(groups)]  # tops fall
    ends = F.array(*[F.lit(x).cast("long") for x in last or [-1]])
    to_runs = known.select("group", *sent, F.col("positives.score").alias("scores"), F.explode(F.filter(upto(runs), lambda r: r <= F.get(ends, F.col("group")))).alias("run"))
    dealt = placed.select(*sent, in_run.alias("run"), F.explode(F.filter(upto(groups), lambda g: F.get(ends, g) >= in_run)).alias("group"))
    best = to_runs.groupBy("group", "run").cogroup(dealt.groupBy("group", "run")).applyInArrow(_negatives(negatives, low, high), _FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.join(known.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"), "positives"), "anchor")
    positive = F.get("positives", F.col("window"))
    return named.select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
