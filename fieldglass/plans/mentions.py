"""The canonical mention rows that the analytical plans read, from the testdata's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGINS = ("live", "verified_snapshot", "demo_seed")
PLATFORMS = ("youtube", "x", "news", "official", "web")
AUTHOR_TYPES = ("farmer", "fpo", "media", "government", "expert", "citizen", "unknown")
STANCES = {"error": "critical", "purchase": "supportive", "click": "mixed", "view": "neutral"}


def cases(value: Column, found: dict) -> Column:
    """value mapped by a small fixed dictionary, null where it has no entry."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, to in found.items():
        out = out.when(value == F.lit(key), F.lit(to))
    return out


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention for each event, with its district (null: unlocated)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("district"))
    origin = F.when(F.col("user_id") % 10 == 8, "verified_snapshot").when(F.col("user_id") % 10 == 9, "demo_seed").otherwise("live")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select(
        F.col("event_id").alias("mention_id"),
        F.col("user_id").alias("author_id"),
        F.col("ts").alias("seen_at"),
        "value",
        origin.alias("data_origin"),
        cases(F.col("event_id") % 5, dict(enumerate(PLATFORMS))).alias("platform"),
        cases(F.col("user_id") % 7, dict(enumerate(AUTHOR_TYPES))).alias("author_type"),
        cases(F.col("event_type"), STANCES).alias("stance"),
        (k % 13).alias("topic"),
        (k % 3).alias("subtopic"),
        (F.col("event_id") % 11 == 0).alias("is_duplicate"),
        (F.col("user_id") % 30).cast("int").alias("place"),
    )
    return rows.join(F.broadcast(nation), "place", "left").drop("place")  # nation: a fixed dimension of 25 rows


def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention for each document, with time, title (its first line) and label-derived stance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    minutes = (F.col("doc_id") * 7919 % 43200).cast("int")
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))
    origin = F.when(F.col("doc_id") % 10 == 8, "verified_snapshot").when(F.col("doc_id") % 10 == 9, "demo_seed").otherwise("live")
    stance = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "mixed").when(F.col("doc_id") % 3 == 0, "supportive").when(F.col("quality").isNotNull(), "neutral")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("mention_id"),
        F.col("source").alias("author_id"),
        F.when(F.col("doc_id") % 17 != 0, at).alias("seen_at"),
        "text",
        "lang",
        F.element_at(F.split("text", "\n"), 1).alias("title"),
        origin.alias("data_origin"),
        cases(F.col("doc_id") % 5, dict(enumerate(PLATFORMS))).alias("platform"),
        F.when(F.col("quality").isNotNull(), stance).alias("stance"),
    )


_MENTIONS = """
mentions AS (
  SELECT e.event_id AS mention_id, e.user_id AS author_id, e.ts AS seen_at, e.value, n.n_name AS district,
    e.event_id % 11 = 0 AS is_duplicate,
    CASE e.user_id % 10 WHEN 8 THEN 'verified_snapshot' WHEN 9 THEN 'demo_seed' ELSE 'live' END AS data_origin,
    CASE e.event_id % 5 WHEN 0 THEN 'youtube' WHEN 1 THEN 'x' WHEN 2 THEN 'news' WHEN 3 THEN 'official' ELSE 'web' END AS platform,
    CASE e.user_id % 7 WHEN 0 THEN 'farmer' WHEN 1 THEN 'fpo' WHEN 2 THEN 'media' WHEN 3 THEN 'government' WHEN 4 THEN 'expert' WHEN 5 THEN 'citizen' ELSE 'unknown' END AS author_type,
    CASE e.event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'supportive' WHEN 'click' THEN 'mixed' WHEN 'view' THEN 'neutral' END AS stance,
    CAST(json_extract_string(e.props, '$.k') AS INT) % 13 AS topic, CAST(json_extract_string(e.props, '$.k') AS INT) % 3 AS subtopic
  FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 30),
live AS (SELECT * FROM mentions WHERE NOT is_duplicate)"""

#: Start of a DuckDB query over the same mentions.
MENTIONS_SQL = f"WITH {_MENTIONS.strip()}"

DOCUMENTS_SQL = """WITH mentions AS (
  SELECT d.doc_id AS mention_id, d.source AS author_id, d.text, d.lang, split_part(d.text, chr(10), 1) AS title,
    CASE WHEN d.doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id * 7919 % 43200 AS INT)) END AS seen_at,
    CASE d.doc_id % 10 WHEN 8 THEN 'verified_snapshot' WHEN 9 THEN 'demo_seed' ELSE 'live' END AS data_origin,
    CASE d.doc_id % 5 WHEN 0 THEN 'youtube' WHEN 1 THEN 'x' WHEN 2 THEN 'news' WHEN 3 THEN 'official' ELSE 'web' END AS platform,
    CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 'critical' WHEN l.quality = 0 THEN 'mixed' WHEN d.doc_id % 3 = 0 THEN 'supportive' ELSE 'neutral' END AS stance
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
