"""Naming of narratives by a costly function, asked once for each content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.plans.mentions import event_mentions
from fieldglass.plans.read_model import live
from fieldglass.sources.keyed import KeyedTable
from fieldglass.store import work_path, written

#: Takes a batch (content_key, content) and returns title and explanation for each of its rows, in their order.
Ask = Callable[[pd.DataFrame], pd.DataFrame]
LONGEST_TITLE = 120


def answered(contents: DataFrame, ask: Ask) -> DataFrame:
    """content_key, title, explanation, failure: what `ask` says of each batch. A batch that raises, or whose answer has
    another number of rows, fails as a whole; an empty or overlong title fails its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"content_key": batch["content_key"], "title": None, "explanation": None, "failure": None}, dtype=object)
            try:
                said = ask(batch).reset_index(drop=True)
                if len(said) != len(batch):
                    raise ValueError(f"{len(said)} answers to {len(batch)} questions")
                title = said["title"].map(lambda x: x.strip() if isinstance(x, str) else "").to_numpy()
                good = [0 < len(x) <= LONGEST_TITLE for x in title]
                out["title"] = [t if g else None for t, g in zip(title, good, strict=True)]
                out["explanation"] = [e if g and isinstance(e, str) else None for e, g in zip(said["explanation"], good, strict=True)]
                out["failure"] = [None if g else "contract" for g in good]
            except Exception as e:  # the others' answers stay
                out["failure"] = type(e).__name__
            yield out

    return contents.select("content_key", "content").mapInPandas(run, "content_key string, title string, explanation string, failure string")


def adjudicated(narratives: DataFrame, ask: Ask, cache: KeyedTable, least: int = 3) -> DataFrame:
    """narratives (narrative_key, mentions, title, content) with the titles that `ask` has given their contents.

    Only those with `least` mentions or more and some content are asked about, and each content once and for all: answers
    are kept in the cache by a hash of the content, failures aren't, so a rerun asks for these again and for nothing else.
    Where there is no answer the old title stays. Narratives of one content share its answer.
    """
    keyed = narratives.withColumn("content_key", F.when((F.col("mentions") >= least) & (F.col("content") != ""), F.sha2("content", 256)))
    open_ones = keyed.where("content_key IS NOT NULL").groupBy("content_key").agg(F.min("content").alias("content"))
    if cache.versions():
        open_ones = open_ones.join(cache.read().select("content_key"), "content_key", "left_anti")
    said = written(answered(open_ones, ask), "answers")  # asked once, whatever is read of it later
    cache.insert_absent(said.where("failure IS NULL").select("content_key", F.col("title").alias("given"), "explanation"))
    out = keyed.join(cache.read(), "content_key", "left").join(said.select("content_key", "failure"), "content_key", "left")
    return out.select("narrative_key", "mentions", F.coalesce("given", "title").alias("title"), "explanation", "failure")


def named_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each origin as narratives, whose content is their counts by stance; every fourth answer breaks the contract."""
    found = live(event_mentions(spark, sf_dir)).groupBy("data_origin", "topic").agg(F.count("*").alias("mentions"), F.count_if(F.col("stance") == "critical").alias("critical"))
    key = F.concat_ws("/", "data_origin", F.col("topic").cast("string"))
    narratives = found.select(key.alias("narrative_key"), "mentions", F.concat(F.lit("topic "), "topic").alias("title"), F.concat_ws(" ", F.col("topic").cast("string"), "mentions", "critical").alias("content"))

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        topic = batch["content"].str.split(" ").str[0].astype(int)
        return pd.DataFrame({"title": [" " if t % 4 == 0 else f"About {c}" for t, c in zip(topic, batch["content"], strict=True)], "explanation": "counted"})

    cache = KeyedTable(spark, work_path(spark, "answers"), ["content_key"], 8)
    for _ in range(2):  # the second run asks only what failed
        out = adjudicated(narratives, ask, cache)
    return out


QUERIES = {"stg07_adjudication": named_topics}


def sql(mentions: str) -> dict[str, str]:
    return {
        "stg07_adjudication": mentions + """, f AS (SELECT data_origin, topic, count(*) AS mentions, count(*) FILTER (stance = 'critical') AS critical FROM live GROUP BY 1, 2)
SELECT data_origin || '/' || topic AS narrative_key, mentions, CASE WHEN topic % 4 = 0 OR mentions < 3 THEN 'topic ' || topic ELSE 'About ' || topic || ' ' || mentions || ' ' || critical END AS title,
  CASE WHEN topic % 4 > 0 AND mentions >= 3 THEN 'counted' END AS explanation, CASE WHEN topic % 4 = 0 AND mentions >= 3 THEN 'contract' END AS failure FROM f"""
    }
