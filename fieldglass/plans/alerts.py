"""The alert stage: which findings interrupt, each narrative once, marked only where a push has arrived."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.plans.findings import findings
from fieldglass.plans.mentions import MENTIONS_SQL, event_mentions
from fieldglass.plans.rows import urgent
from fieldglass.sources.keyed import KeyedTable
from fieldglass.store import dropped, work_path, written

#: Alerts that one cycle may send, so that nobody is sent the whole backlog at once.
MOST_PER_CYCLE = 3

#: (rows of endpoint, key, title) to a status for each: called with a batch at a time.
Send = Callable[[pd.DataFrame], "pd.Series[int]"]


def candidates(ranked: DataFrame, strongest: DataFrame, origin: str = "live") -> DataFrame:
    """The findings of an origin that are worth an alert, in order: urgent ones first, then the worst rank.

    strongest: data_origin, topic, strongest: the strongest urgent event of a topic. An urgent event interrupts however the
    coverage is written; without one a finding must be a concern or escalating.
    """
    rows = ranked.where(F.col("data_origin") == origin).join(strongest.select("data_origin", "topic", "strongest"), ["data_origin", "topic"], "left")
    loud = rows.where(F.col("strongest").isNotNull() | F.col("signal").isin("concern", "escalating"))
    order = Window.partitionBy("data_origin").orderBy(F.col("strongest").isNull(), F.desc("rank"), "topic")
    title = F.concat_ws(": ", F.upper("strongest"), F.concat_ws(" ", F.lit("topic"), F.col("topic")))
    return loud.select("data_origin", "topic", "rank", "strongest", title.alias("title"), F.row_number().over(order).alias("place"))


def delivered(alerts: list[dict], endpoints: DataFrame, send: Send) -> DataFrame:
    """The outcome of each (endpoint, key) push: sent, removed for an endpoint that is gone (404, 410), else failed.

    alerts: as many as a cycle may send. A task that is run again sends again under the same key, by which a receiver puts
    the later push in the place of the earlier one. An endpoint whose push raises has failed; the others aren't touched.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                batch["status"] = send(batch).astype("int64")
            except Exception:  # one by one, so that the endpoint at fault is the only one that fails
                def one(i: int) -> int:
                    try:
                        return int(send(batch.iloc[[i]]).iloc[0])
                    except Exception:
                        return 0

                batch["status"] = [one(i) for i in range(len(batch))]
            yield batch[["endpoint", "key", "status"]]

    each = F.explode(F.array(*[F.struct(F.lit(a["key"]).alias("key"), F.lit(a["title"]).alias("title")) for a in alerts]))
    pushes = endpoints.where(F.col("endpoint").isNotNull()).select("endpoint", each.alias("a")).select("endpoint", "a.key", "a.title")
    kind = endpoints.schema["endpoint"].dataType.simpleString()
    told = pushes.mapInPandas(run, f"endpoint {kind}, key string, status long")
    outcome = F.when(F.col("status").between(200, 299), "sent").when(F.col("status").isin(404, 410), "removed").otherwise("failed")
    return told.withColumn("outcome", outcome)


def alert_stage(found: DataFrame, endpoints: DataFrame, sent: KeyedTable, send: Send, cycle: int, most: int = MOST_PER_CYCLE) -> dict[str, int]:
    """One cycle of alerts; returns candidates, alerted, recipients, skipped.

    found: as of candidates(). sent: keys data_origin, topic; a row for each narrative that a push of has arrived, with its
    cycle and number of recipients. A narrative in it is skipped for good; one whose pushes all fail is not put in, doesn't count
    toward `most`, and is tried again in the next cycle. Without endpoints nothing is done, so that the backlog
    stays for the first one. A cycle that is run again after it was recorded does nothing; one cut off before that sends
    its pushes again, with the same keys.
    """
    said = {"candidates": 0, "alerted": 0, "recipients": 0, "skipped": 0}
    if sent.applied("alerts") >= cycle or endpoints.where("endpoint IS NOT NULL").isEmpty():
        return said
    spark = found.sparkSession
    known = sent.read().select("data_origin", "topic").withColumn("known", F.lit(True)) if sent.versions() else None
    marked = found.join(known, ["data_origin", "topic"], "left") if known else found.withColumn("known", F.lit(None).cast("boolean"))
    queue = written(marked, "alerts")
    n, skipped = queue.agg(F.count("*"), F.count("known")).first()
    said |= {"candidates": n, "skipped": skipped}
    at, done = 0, []
    while len(done) < most:
        wave = queue.where(F.col("known").isNull() & (F.col("place") > at)).orderBy("place").limit(most - len(done)).collect()
        if not wave:
            break
        at = wave[-1]["place"]
        keyed = [{"key": f"narrative-{r['data_origin']}-{r['topic']}", "title": r["title"], "row": r} for r in wave]
        told = written(delivered(keyed, endpoints, send), "pushes")
        arrived = {r["key"]: r["n"] for r in told.where("outcome = 'sent'").groupBy("key").agg(F.count("*").alias("n")).collect()}
        done += [(a["row"]["data_origin"], a["row"]["topic"], cycle, arrived[a["key"]]) for a in keyed if arrived.get(a["key"])]
        dropped(told)
    topic = found.schema["topic"].dataType.simpleString()
    rows = spark.createDataFrame(done, f"data_origin string, topic {topic}, cycle long, recipients long")
    said["alerted"] = sent.insert_absent(rows, ("alerts", cycle))
    said["recipients"] = sum(d[3] for d in done)
    dropped(queue)
    return said


def _status(pushes: pd.DataFrame) -> pd.Series:
    """Stands for the network: endpoints by their number, and no push of a narrative of each third topic arrives."""
    topic = pushes["key"].str.rsplit("-", n=1).str[1].astype("int64")
    status = pd.Series(201, pushes.index).mask(pushes["endpoint"] % 5 == 0, 410).mask(pushes["endpoint"] % 7 == 0, 500)
    return status.mask(topic % 3 == 1, 503)


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cycles over the findings of all events, pushed to all customers: what was sent, when, to how many."""
    mentions = event_mentions(spark, sf_dir)
    found = written(candidates(findings(mentions), urgent(mentions, 6)), "candidates")
    endpoints = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("endpoint"))
    sent = KeyedTable(spark, work_path(spark, "sent"), ["data_origin", "topic"], 4)
    for cycle in (1, 2):
        alert_stage(found, endpoints, sent, _status, cycle)
    return sent.read()


QUERIES = {"stg09_alert_stage": _cycles}


def sql(findings_sql: str) -> dict[str, str]:
    """The statement; findings_sql is the part that defines ranked over the mentions."""
    urgent_sql = ", we AS (SELECT data_origin, max(seen_at) AS e FROM live GROUP BY 1), u AS (SELECT DISTINCT data_origin, topic FROM live JOIN we USING (data_origin) WHERE stance IN ('critical', 'mixed', 'supportive') AND seen_at >= e - INTERVAL 6 HOURS)"
    return {
        "stg09_alert_stage": MENTIONS_SQL + findings_sql + urgent_sql + ", c AS (SELECT r.data_origin, r.topic, row_number() OVER (ORDER BY u.topic IS NULL, rank DESC, r.topic) AS place FROM ranked r LEFT JOIN u ON u.data_origin = r.data_origin AND u.topic = r.topic WHERE r.data_origin = 'live' AND (u.topic IS NOT NULL OR signal IN ('concern', 'escalating')) AND r.topic % 3 <> 1), k AS (SELECT data_origin, topic, row_number() OVER (ORDER BY place) AS n FROM c QUALIFY n <= 6) SELECT data_origin, topic, (n + 2) // 3 AS cycle, (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) AS recipients FROM k",
    }
