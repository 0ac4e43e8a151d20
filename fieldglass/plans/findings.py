"""Narratives and findings: the windowed metrics of each topic, their signals and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import scoring as S
from fieldglass.plans.read_model import live, n_if

WINDOW_DAYS, BASE_WEEKS = 7, 4


def window_ends(mentions: DataFrame) -> DataFrame:
    """The newest evidence time of each origin; its windows end there."""
    return live(mentions).groupBy("data_origin").agg(F.max("seen_at").alias("window_end"))


def window_metrics(mentions: DataFrame) -> DataFrame:
    """One pass over each topic: its last week against the four weeks before, half-open windows."""
    ends = window_ends(mentions)
    rows = live(mentions).join(F.broadcast(ends), "data_origin")  # a row for each of three origins
    end = F.col("window_end")
    start, base = end - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS"), end - F.expr(f"INTERVAL {WINDOW_DAYS * (1 + BASE_WEEKS)} DAYS")
    rows = rows.withColumn("now", (F.col("seen_at") > start) & (F.col("seen_at") <= end)).withColumn("before", (F.col("seen_at") > base) & (F.col("seen_at") <= start))
    now, before = F.col("now"), F.col("before")
    carrying, was_carrying = now & F.col("stance").isNotNull(), before & F.col("stance").isNotNull()
    official, public = F.col("author_type") == "government", F.col("author_type") != "government"
    out = rows.groupBy("data_origin", "topic").agg(
        n_if(now).alias("mentions"),
        F.count("*").alias("lifetime"),
        F.count_distinct(F.when(now, F.col("author_id"))).alias("voices"),
        F.count_distinct(F.when(now, F.col("district"))).alias("districts"),
        F.count_distinct(F.when(now, F.col("platform"))).alias("source_types"),
        (n_if(before) / F.lit(float(BASE_WEEKS))).alias("weekly"),
        n_if(carrying).alias("carrying"),
        F.round(S.share(n_if(now & (F.col("stance") == "critical")), n_if(carrying)), 6).alias("concern"),
        F.round(S.share(n_if(now & (F.col("stance") == "supportive")), n_if(carrying)), 6).alias("supportive"),
        F.round(S.share(n_if(before & (F.col("stance") == "critical")), n_if(was_carrying)), 6).alias("base_concern"),
        n_if(now & official & (F.col("stance") == "supportive")).alias("official_support"),
        F.round(S.share(n_if(carrying & public & (F.col("stance") == "critical")), n_if(carrying & public)), 6).alias("public_concern"),
    )
    return out.where("mentions > 0")


def findings(mentions: DataFrame, seasonal: float = 1.0) -> DataFrame:
    """Ranked findings of each origin: category, signal, trajectory, divergence, confidence and score."""
    m = window_metrics(mentions)
    growth = F.try_divide(F.col("mentions").cast("double"), F.col("weekly"))
    scored = m.select(
        "data_origin",
        "topic",
        "mentions",
        "voices",
        "districts",
        "source_types",
        S.category(F.col("mentions"), F.col("districts"), F.col("source_types")).alias("category"),
        S.signal(F.col("carrying"), F.col("concern"), F.col("supportive"), F.col("base_concern")).alias("signal"),
        S.trajectory(F.col("mentions"), F.col("weekly"), F.col("lifetime")).alias("trajectory"),
        ((F.col("official_support") > 0) & (F.coalesce("public_concern", F.lit(0.0)) >= 0.5)).alias("divergence"),
        F.round(S.finding_confidence(F.col("voices"), F.col("source_types")), 6).alias("confidence"),
        F.round(S.rank_score(F.col("mentions"), F.col("voices"), F.col("districts"), growth, S.stance_contribution(F.col("concern"), F.col("base_concern")), F.lit(seasonal)), 4).alias("score"),
    ).where("category IS NOT NULL")
    order = Window.partitionBy("data_origin").orderBy(F.desc("score"), "topic")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def stance_by_voice(mentions: DataFrame) -> DataFrame:
    """The two-level mix of a topic in long form."""
    return live(mentions).groupBy("data_origin", "topic", "author_type", F.coalesce("stance", F.lit("none")).alias("stance")).agg(F.count("*").alias("n"))


def narrative_metrics(mentions: DataFrame) -> DataFrame:
    return live(mentions).groupBy("data_origin", "topic").agg(F.count("*").alias("mentions"), F.count_distinct(F.coalesce("author_id", "mention_id")).alias("voices"), n_if(F.col("platform") == "official").alias("official"), F.round(F.sum("value"), 2).alias("value"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"))


def topic_candidates(mentions: DataFrame, subtopic_least: int = 3, base_least: int = 2) -> DataFrame:
    """Subtopics with enough canonical mentions, and base topics of what no such subtopic claims."""
    rows = live(mentions)
    subs = rows.groupBy("data_origin", "topic", "subtopic").agg(F.count("*").alias("n")).where(F.col("n") >= subtopic_least)
    free = rows.join(subs.select("data_origin", "topic", "subtopic"), ["data_origin", "topic", "subtopic"], "left_anti")
    base = free.groupBy("data_origin", "topic").agg(F.count("*").alias("n")).where(F.col("n") >= base_least)
    return subs.unionByName(base.withColumn("subtopic", F.lit(None).cast("int")))


def trend_status(mentions: DataFrame) -> DataFrame:
    """emerging, resurfacing, rising, falling or stable, by the last two days and the two before."""
    ends = window_ends(mentions)
    rows = live(mentions).join(F.broadcast(ends), "data_origin")  # a row for each of three origins
    end = F.col("window_end")
    recent = F.col("seen_at") > end - F.expr("INTERVAL 2 DAYS")
    earlier = ~recent & (F.col("seen_at") > end - F.expr("INTERVAL 4 DAYS"))
    found = rows.groupBy("data_origin", "topic", "window_end").agg(n_if(recent).alias("recent"), n_if(earlier).alias("earlier"), F.min("seen_at").alias("first_at"), F.max(F.when(~recent, F.col("seen_at"))).alias("last_before"), F.max("seen_at").alias("last_at"))
    status = (
        F.when(F.col("first_at") > end - F.expr("INTERVAL 2 DAYS"), "emerging")
        .when((F.col("recent") > 0) & (F.col("last_before") <= F.col("last_at") - F.expr("INTERVAL 7 DAYS")), "resurfacing")
        .when((F.col("recent") > 0) & (F.col("recent") >= 1.5 * F.col("earlier")), "rising")
        .when(F.col("recent") <= 0.5 * F.col("earlier"), "falling")
        .otherwise("stable")
    )
    return found.select("data_origin", "topic", "recent", "earlier", status.alias("status"))


def snapshot_delta(mentions: DataFrame) -> DataFrame:
    """Daily snapshots of each topic's running count, and what is new since the one before."""
    days = live(mentions).groupBy("data_origin", "topic", F.date_format("seen_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("data_origin", "topic").orderBy("day")
    count = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = days.withColumn("mentions", count)
    return out.withColumn("new", F.greatest(F.lit(0), F.col("mentions") - F.lag("mentions", 1, 0).over(by))).drop("n")


def alerts(ranked: DataFrame, sent: DataFrame, most: int = 3) -> DataFrame:
    """The findings to send: not sent before, worst rank first within urgent ones (divergent) and the others."""
    new = ranked.join(sent, ["data_origin", "topic"], "left_anti")
    order = Window.partitionBy("data_origin").orderBy(F.desc("divergence"), F.desc("rank"))
    return new.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("data_origin", "topic", "place", "rank")
