"""What leaves the system: alert texts, share texts, pushes; and the transcript stage. QUERIES bind it to the testdata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import rules, wording
from fieldglass.plans.enrichment import finding_texts
from fieldglass.plans.mentions import MENTIONS_SQL, event_mentions
from fieldglass.plans.read_model import live

STEPS = {"click": ["ask the source", "compare with the register"], "purchase": ["see the receipt"], "error": ["read the log", "repeat the step", "report it"]}


def alert_texts(mentions: DataFrame) -> DataFrame:
    prefix = F.concat_ws(" ", "data_origin", F.concat(F.col("topic").cast("string"), F.lit(": ")))
    return finding_texts(mentions).select("data_origin", "topic", wording.bounded(prefix, F.concat_ws("; ", "growth_text", "stance_text"), 48).alias("title"))


def district_phrases(mentions: DataFrame) -> DataFrame:
    """The districts of each topic in order, three by name. A topic has at most as many as there are districts."""
    named = live(mentions).where("district IS NOT NULL").groupBy("data_origin", "topic").agg(F.array_sort(F.collect_set("district")).alias("districts"))
    return named.select("data_origin", "topic", wording.list_phrase(F.col("districts")).alias("phrase"))


def verification_steps(kind: Column, steps: dict[str, list[str]]) -> Column:
    """The steps of a kind in order; kinds without an entry have the general one."""
    table = F.create_map(*(c for k, v in steps.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, kind), F.array(F.lit("look for a second source")))


def pushed(endpoints: DataFrame, send: Callable[[int], int]) -> DataFrame:
    """(endpoint, status, outcome) of each endpoint: sent, removed for an endpoint that is gone (404, 410), else failed.

    A task that is run again sends again, so receivers drop what they have by the alert's key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"endpoint": batch["endpoint"], "status": [send(e) for e in batch["endpoint"]]})

    told = endpoints.select(F.col("endpoint").cast("long")).mapInPandas(run, "endpoint long, status long")
    outcome = F.when(F.col("status").between(200, 299), "sent").when(F.col("status").isin(404, 410), "removed").otherwise("failed")
    return told.withColumn("outcome", outcome)


def transcript_stage(items: DataFrame, transcripts: DataFrame, cap: int) -> DataFrame:
    """Accepted items (item, source, accepted) look their transcript up, `cap` a source and run: the spend's limit.

    With one they are opened again for enrichment, without one they are done; the rest waits for the next run.
    """
    order = Window.partitionBy("source").orderBy("item")
    asked = items.where("accepted").withColumn("place", F.row_number().over(order))
    found = asked.join(transcripts, "item", "left")
    status = F.when(F.col("place") > cap, "waiting").when(F.col("transcript").isNotNull(), "reopened").otherwise("done")
    return found.select("item", "source", status.alias("status"))


def _table(name: str, plan: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _events(plan: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: plan(event_mentions(spark, sf_dir))


def _times(orders: DataFrame) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    shaped = lambda pattern: F.date_format(day, pattern)
    said = [
        shaped("yyyy-MM-dd'T'10:30:00'Z'"), F.concat(F.lit("Tue, "), shaped("dd MMM yyyy"), F.lit(" 10:30:00 +0530")), shaped("yyyy-MM-dd"), F.lit("soon"), shaped("yyyy-MM-dd'T'10:30:00.123+05:30"), F.concat(shaped("d MMM yyyy"), F.lit(" 10:30 GMT")),
        F.concat(F.lit("Tuesday, "), shaped("d MMMM yyyy"), F.lit(" 10:30:00 EST")), F.concat(shaped("EEE MMM dd"), F.lit(" 10:30:00 +0530 "), shaped("yyyy")), shaped("yyyy-MM-dd 10:30"), shaped("yyyy-02-30"), shaped("d 'Foo' yyyy"),
    ]
    text = F.get(F.array(*said), (key % len(said)).cast("int"))
    return orders.select("o_orderkey", F.date_format(wording.tolerant_time(text), "yyyy-MM-dd HH:mm").alias("at"))


def _shown(orders: DataFrame) -> DataFrame:
    now, then = F.lit("1998-08-03 00:00:00").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    return orders.select("o_orderkey", wording.grouped_number(F.col("o_orderkey") * 1237).alias("number"), wording.ago(then - F.make_dt_interval(mins=F.col("o_orderkey") % 1000), now).alias("ago"))


def _stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("item"), "source", (F.col("lang") == "en").alias("accepted"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("item")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    return transcript_stage(docs, turns.select("item", rules.transcript(F.transform("s", lambda x: x["text"])).alias("transcript")), 20)


def _answer(endpoint: int) -> int:
    return (200, 404, 500, 201, 410)[endpoint % 5]


QUERIES = {
    "dat06_shown_numbers": _table("orders", _shown),
    "dat07_tolerant_time": _table("orders", _times),
    "scr23_alert_texts": _events(alert_texts),
    "scr24_district_phrases": _events(district_phrases),
    "scr25_verification_steps": _table("events", lambda e: e.groupBy("event_type").agg(F.count("*").alias("n")).select(F.col("event_type"), "n", F.array_join(verification_steps(F.col("event_type"), STEPS), "; ").alias("steps"))),
    "snk17_push_delivery": _table("customer", lambda c: pushed(c.select(F.col("c_custkey").alias("endpoint")), _answer)),
    "stg03_transcript_stage": _stage,
}


def sql(texts_sql: str, transcripts_sql: str) -> dict[str, str]:
    """The statements; texts_sql selects the finding texts, transcripts_sql conv_id and the hash of its transcript."""
    digits = "CAST(o_orderkey * 1237 AS VARCHAR)"
    pairs = f"reverse(regexp_replace(reverse(left({digits}, length({digits}) - 3)), '(\\d\\d)', '\\1,', 'g'))"
    minutes = "date_diff('minute', CAST(o_orderdate AS TIMESTAMP) - to_minutes(o_orderkey % 1000), TIMESTAMP '1998-08-03')"
    prefix = "(data_origin || ' ' || topic || ': ')"
    head, room = "(growth_text || '; ' || stance_text)", f"greatest(24, 48 - length({prefix}))"
    steps = " ".join(f"WHEN '{k}' THEN '{'; '.join(v)}'" for k, v in STEPS.items())
    return {
        "dat06_shown_numbers": f"SELECT o_orderkey, CASE WHEN length({digits}) <= 3 THEN {digits} ELSE ltrim({pairs}, ',') || ',' || right({digits}, 3) END AS number, CASE WHEN m < 60 THEN m || ' min ago' WHEN m < 2880 THEN (m // 60) || ' h ago' ELSE (m // 1440) || ' d ago' END AS ago FROM (SELECT *, {minutes} AS m FROM orders)",
        "dat07_tolerant_time": "SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + to_minutes([630, 300, 0, NULL, 300, 630, 930, 300, 630, NULL, NULL][o_orderkey % 11 + 1]), '%Y-%m-%d %H:%M') AS at FROM orders",
        "scr23_alert_texts": f"SELECT data_origin, topic, {prefix} || CASE WHEN length({head}) > {room} THEN rtrim(left({head}, {room} - 1)) || '…' ELSE {head} END AS title FROM ({texts_sql})",
        "scr24_district_phrases": MENTIONS_SQL + ", d AS (SELECT data_origin, topic, list_sort(list(DISTINCT district)) AS ds FROM live WHERE district IS NOT NULL GROUP BY 1, 2) SELECT data_origin, topic, array_to_string(ds[1:3], ', ') || CASE WHEN len(ds) > 3 THEN ' and ' || (len(ds) - 3) || ' more' ELSE '' END AS phrase FROM d",
        "scr25_verification_steps": f"SELECT event_type, count(*) AS n, CASE event_type {steps} ELSE 'look for a second source' END AS steps FROM events GROUP BY 1",
        "snk17_push_delivery": "SELECT endpoint, status, CASE WHEN status < 300 THEN 'sent' WHEN status IN (404, 410) THEN 'removed' ELSE 'failed' END AS outcome FROM (SELECT CAST(c_custkey AS BIGINT) AS endpoint, CAST([200, 404, 500, 201, 410][c_custkey % 5 + 1] AS BIGINT) AS status FROM customer)",
        "stg03_transcript_stage": f"SELECT doc_id AS item, source, CASE WHEN place > 20 THEN 'waiting' WHEN text_hash IS NOT NULL THEN 'reopened' ELSE 'done' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE lang = 'en') LEFT JOIN ({transcripts_sql}) ON conv_id = doc_id",
    }
