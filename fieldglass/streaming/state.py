"""State that goes when its key has been quiet: stories that alert once and end after a gap; status changes as they happen."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from fieldglass.sources.keyed import KeyedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which timers need; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def merged(spans: list[list[int]], gap: int) -> list[list[int]]:
    """Spans (first, last, rows) in order, those at most a gap apart joined."""
    out: list[list[int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= gap:
            out[-1] = [out[-1][0], max(out[-1][1], last), out[-1][2] + n]
        else:
            out.append([first, last, n])
    return out


class Stories(StatefulProcessor):
    """Spans of a key's rows, in microseconds. What is kept is a span for each gap within reach of the watermark.

    A key has one timer, for its first span; when it fires, all spans that the watermark has passed end at once.
    """

    def __init__(self, keys: list[str], at: str, gap: timedelta) -> None:
        self.keys, self.at, self.gap = keys, at, gap // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, n bigint")

    def _rows(self, key: tuple, kind: str, spans: list[list[int]]) -> pd.DataFrame:
        data: dict = {k: [v] * len(spans) for k, v in zip(self.keys, key, strict=True)}
        ended = kind == "ended"
        data |= {"kind": [kind] * len(spans), "start": pd.to_datetime([s[0] for s in spans], unit="us")}
        data |= {"last": pd.to_datetime([s[1] if ended else None for s in spans], unit="us"), "n": pd.array([s[2] if ended else None for s in spans], "Int64")}
        return pd.DataFrame(data)

    def _keep(self, spans: list[list[int]]) -> None:
        self.open.put([tuple(s) for s in spans]) if spans else self.open.clear()

    def _timer(self, last: int) -> int:
        """In milliseconds, the first at which no row that isn't late can join the span."""
        return -(-(last + self.gap) // 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [[int(v) for v in s] for s in self.open.get()] if self.open.exists() else []
        seen: list[list[int]] = []
        for batch in rows:  # a batch is spans before the next one is read
            times = batch[self.at].astype("datetime64[us]").astype("int64").sort_values()
            part = (times.diff() > self.gap).cumsum()
            seen = merged(seen + [[int(t.iloc[0]), int(t.iloc[-1]), len(t)] for _, t in times.groupby(part)], self.gap)
        fresh = [s for s in seen if all(s[0] - h[1] > self.gap or h[0] - s[1] > self.gap for h in held)]
        spans = merged(held + seen, self.gap)
        if held and held[0][1] != spans[0][1]:
            self.handle.deleteTimer(self._timer(held[0][1]))
        if not held or held[0][1] != spans[0][1]:
            self.handle.registerTimer(self._timer(spans[0][1]))
        self._keep(spans)
        if fresh:
            yield self._rows(key, "began", fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = [[int(v) for v in s] for s in self.open.get()] if self.open.exists() else []
        ended = [s for s in held if self._timer(s[1]) <= now]
        left = [s for s in held if self._timer(s[1]) > now]
        self._keep(left)
        if left:
            self.handle.registerTimer(self._timer(left[0][1]))
        if ended:
            yield self._rows(key, "ended", ended)

    def close(self) -> None:
        pass


def stories(rows: DataFrame, keys: list[str], at: str, gap: timedelta, delay: str = "0 seconds") -> DataFrame:
    """The stories of a stream: runs of a key's rows that lie at most a gap apart. Start it within rocks().

    A row `began` (start) comes with the story's first batch, so that it can alert once; a row `ended` (start, last, n) once
    the watermark, delay behind the newest row, has passed the gap, and with it the story's state is dropped. Batches in
    order of time give what one run over all rows gives. Out of order within the delay, no row is lost; a row that joins
    two stories lets both have begun, and one end. Rows behind the watermark are dropped, as are rows without a time.
    """
    schema = StructType([*(rows.schema[k] for k in keys), StructField("kind", StringType()), StructField("start", TimestampType()), StructField("last", TimestampType()), StructField("n", LongType())])
    found = rows.where(F.col(at).isNotNull()).withWatermark(at, delay).select(*keys, at)
    return found.groupBy(*keys).transformWithStateInPandas(Stories(keys, at, gap), schema, "Append", "EventTime")


def stated(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "at", "tie", "state").dropna()


def status_changes(rows: DataFrame, last: DataFrame | None, key: str = "item") -> DataFrame:
    """The rows (key, at, tie, state) whose state isn't the one before, with that one as `was` (null: the first).

    last: each key's latest row so far. Order: at, tie. A state or anything else that is null is no statement and no row of
    the result. A row that is older than its key's latest one changes nothing: the log is only appended to.
    """
    told = stated(rows, key).distinct()
    if last is not None:
        newest = last.select(key, F.struct("at", "tie").alias("__latest"), F.col("state").alias("__was"))
        told = told.join(newest, key, "left").where(F.col("__latest").isNull() | (F.struct("at", "tie") > F.col("__latest")))
    else:
        told = told.withColumn("__was", F.lit(None).cast("string"))
    order = Window.partitionBy(key).orderBy("at", "tie", "state")
    was = F.coalesce(F.lag("state").over(order), "__was")
    return told.withColumn("was", was).where(~F.col("was").eqNullSafe(F.col("state"))).select(key, "at", "tie", "state", "was")


def status_log(stream: DataFrame, log: KeyedTable, latest: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each change of a stream of statuses (item, at, tie, state) to `log` as it happens, and keep `latest` rows.

    log has the keys item, at, tie, state, latest the key item. A batch that is run again after a failure changes nothing: the log
    takes a change once, and latest, written after it, takes each batch's number once.
    """

    def once(batch: DataFrame, number: int) -> None:
        if latest.applied("status") >= number:
            return
        known = latest.read() if latest.versions() else None
        changes = status_changes(batch, known)
        log.insert_absent(changes)
        newest = stated(batch, "item").groupBy("item").agg(F.max(F.struct("at", "tie", "state")).alias("x")).select("item", "x.at", "x.tie", "x.state")
        newer = {c: F.expr(f"IF(struct(new.at, new.tie) > struct(old.at, old.tie), new.{c}, old.{c})") for c in ("at", "tie", "state")}
        latest.upsert(newest, ("status", number), newer)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once).trigger(**(trigger or {"availableNow": True})).start()
