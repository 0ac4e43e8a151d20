"""The collection cycle: due queries, their connectors, raw items by natural key, cadence that survives restarts.

A cycle is a batch of a stream of ticks. What it did is in keyed tables: raw items are inserted where they are absent, and
the plan takes each cycle's number once, so a cycle that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldglass.sources.keyed import KeyedTable
from fieldglass.store import written

#: Reads all due queries of a connector at once: (spark, connector and query columns) to query, platform, external_id, payload.
Connector = Callable[[SparkSession, DataFrame], DataFrame]
PLAN = "connector string, query string, tier string, priority int, frequency_minutes int, enabled boolean, next_run timestamp, last_run timestamp, runs long, items long"
#: Queries that a connector runs in a cycle unless its own limit is given; limits guard costs.
LIMIT = 20


@dataclass
class Tables:
    """plans: as PLAN; raw: platform, external_id, data_origin, …; runs: one row for each query that a cycle tried."""

    plans: KeyedTable
    raw: KeyedTable
    runs: KeyedTable

    @classmethod
    def below(cls, spark: SparkSession, path: str, buckets: int = 64) -> Tables:
        keys = {"plans": ["connector", "query"], "raw": ["platform", "external_id", "data_origin"], "runs": ["cycle", "connector", "query"]}
        return cls(**{k: KeyedTable(spark, f"{path}/{k}", v, buckets) for k, v in keys.items()})


def seed(tables: Tables, plans: DataFrame) -> int:
    """Add planned queries (connector, query, tier, priority, frequency_minutes, enabled) that aren't planned yet."""
    never = {"next_run": F.lit(None).cast("timestamp"), "last_run": F.lit(None).cast("timestamp"), "runs": F.lit(0).cast("long"), "items": F.lit(0).cast("long")}
    rows = plans.withColumns(never)
    kinds = [tuple(x.strip().rsplit(" ", 1)) for x in PLAN.split(",")]
    return tables.plans.insert_absent(rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds]))


def due(plans: DataFrame, now: datetime, limits: Mapping[str, int] | None = None) -> DataFrame:
    """The enabled queries whose time has come, or that never ran: tier, then priority, at most the limit a connector."""
    order = Window.partitionBy("connector").orderBy("tier", F.desc("priority"), "query")
    most = F.lit(LIMIT)
    for name, n in (limits or {}).items():
        most = F.when(F.col("connector") == name, n).otherwise(most)
    ready = plans.where(F.col("enabled") & (F.col("next_run").isNull() | (F.col("next_run") <= F.lit(now))))
    return ready.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def run_cycle(tables: Tables, connectors: Mapping[str, Connector], now: datetime, cycle: int, limits: Mapping[str, int] | None = None, origin: str = "live") -> dict[str, str]:
    """One cycle; returns what each connector with due queries came to: `ok`, or its error.

    A connector that fails has no run recorded in the plan, so its queries stay due; the others aren't touched by it.
    """
    spark = tables.plans.spark
    if tables.plans.applied("cycle") >= cycle:
        return {}
    chosen = written(due(tables.plans.read(), now, limits), "due")
    said, done, tried = {}, [], []
    for name in sorted(r["connector"] for r in chosen.select("connector").distinct().collect()):  # as many as are registered
        own = chosen.where(F.col("connector") == name)
        log = own.select(F.lit(cycle).cast("long").alias("cycle"), "connector", "query", F.lit(now).alias("started"))
        try:
            if name not in connectors:
                raise ValueError(f"unknown connector {name}")
            got = connectors[name](spark, own.select("connector", "query")).select("query", "platform", "external_id", "payload")
            items = written(got, "items")
            tables.raw.insert_absent(items.where("external_id IS NOT NULL AND platform IS NOT NULL").select("platform", "external_id", F.lit(origin).alias("data_origin"), "payload", F.lit(now).alias("collected_at"), F.lit(cycle).cast("long").alias("cycle"), F.lit(name).alias("connector"), "query"))
            counts = items.groupBy("query").agg(F.count("*").alias("n"))
            done.append(own.join(counts, "query", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
            tried.append(log.join(counts, "query", "left").select("cycle", "connector", "query", "started", F.lit("succeeded").alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("items"), F.lit(None).cast("string").alias("error")))
            said[name] = "ok"
        except Exception as e:  # one source's failure is its own
            said[name] = f"{type(e).__name__}: {e}"
            tried.append(log.select("cycle", "connector", "query", "started", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("items"), F.lit(said[name][:500]).alias("error")))
    for table, parts in ((tables.runs, tried), (tables.plans, done)):
        if not parts:
            continue
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        if table is tables.runs:
            table.insert_absent(rows)
        else:
            ran = {"next_run": F.lit(now) + F.make_interval(mins=F.col("frequency_minutes")), "last_run": F.lit(now), "runs": F.col("runs") + 1, "items": F.col("items") + F.col("n")}
            table.upsert(rows.withColumns(ran).select(*[x.strip().split(" ")[0] for x in PLAN.split(",")]), ("cycle", cycle))
    return said


def cycles(ticks: DataFrame, tables: Tables, connectors: Mapping[str, Connector], checkpoint: str, limits: Mapping[str, int] | None = None, **trigger) -> StreamingQuery:
    """Run a cycle for each batch of a stream of ticks (column at: timestamp; its greatest is the cycle's time).

    checkpoint: a folder that stays; started again with it, the stream goes on after the last finished cycle, and one that
    was cut off is run again under its number. trigger: as of writeStream.trigger, by default all that is there now.
    """

    def once(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("at")).first()[0]
        if now is not None:
            run_cycle(tables, connectors, now, number, limits)

    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once).trigger(**(trigger or {"availableNow": True})).start()


def merged(stream: DataFrame, table: KeyedTable, checkpoint: str, source: str, **trigger) -> StreamingQuery:
    """Insert each batch of a stream into a keyed table where it is absent: every row has effect once, whatever is replayed."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: table.insert_absent(batch, (source, number))).trigger(**(trigger or {"availableNow": True})).start()
