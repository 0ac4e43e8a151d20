"""Read-model queries: coverage, composition, districts, feeds, briefs, provenance.

Every plan takes mention rows (see mentions.py) and groups by origin first: origins never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.scoring import share, shade

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def live(mentions: DataFrame) -> DataFrame:
    """Duplicates are kept and linked elsewhere, and count nowhere."""
    return mentions.where(~F.col("is_duplicate"))


def n_if(test: Column) -> Column:
    return F.count_if(test)


def favourable(stance: Column) -> Column:
    return stance == "supportive"


def coverage_counts(mentions: DataFrame) -> DataFrame:
    """Grand total (district null, level 1) and each district (level 0) of an origin, in one pass."""
    rows = live(mentions)
    sets = rows.groupingSets([["data_origin"], ["data_origin", "district"]], "data_origin", "district")
    out = sets.agg(F.grouping("district").cast("long").alias("level"), F.count("*").alias("mentions"), F.count_distinct("author_id").alias("voices"), n_if(F.col("stance") == "critical").alias("critical"))
    return out.where("level = 1 OR district IS NOT NULL").select("data_origin", "district", "level", "mentions", "voices", "critical")


def composition_mix(mentions: DataFrame) -> DataFrame:
    """Counts by author type and by platform, with their share of the origin."""
    rows = live(mentions).withColumn("voice", F.coalesce("author_type", F.lit("unknown")))
    parts = [rows.groupBy("data_origin", F.lit(kind).alias("kind"), F.col(c).alias("bucket")).agg(F.count("*").alias("n")) for kind, c in (("voice", "voice"), ("platform", "platform"))]
    return parts[0].unionByName(parts[1]).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("data_origin", "kind")), 6))


def district_overview(mentions: DataFrame) -> DataFrame:
    """Located mentions by district: voices and the critical share among those that carry a stance."""
    rows = live(mentions).where("district IS NOT NULL")
    carrying = n_if(F.col("stance").isNotNull())
    return rows.groupBy("data_origin", "district").agg(
        F.count("*").alias("mentions"),
        F.count_distinct(F.coalesce("author_id", "mention_id")).alias("voices"),
        carrying.alias("carrying"),
        F.round(share(n_if(F.col("stance") == "critical"), carrying), 6).alias("critical_share"),
    )


def coverage_balance(mentions: DataFrame) -> DataFrame:
    """Favourable, unfavourable and other by district, balance, shade step, and the topic with most mentions."""
    rows = live(mentions).where("district IS NOT NULL")
    by = rows.groupBy("data_origin", "district").agg(n_if(favourable(F.col("stance"))).alias("favourable"), n_if(F.col("stance") == "critical").alias("unfavourable"), F.count("*").alias("mentions"))
    first = Window.partitionBy("data_origin", "district").orderBy(F.desc("n"), "topic")
    top = rows.groupBy("data_origin", "district", "topic").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(first)).where("r = 1").select("data_origin", "district", F.col("topic").alias("top_topic"))
    balance = share(F.col("favourable") - F.col("unfavourable"), F.col("favourable") + F.col("unfavourable"))
    out = by.withColumn("balance", F.round(balance, 6)).withColumn("step", shade(balance).cast("long"))
    return out.join(top, ["data_origin", "district"])


def environment(mentions: DataFrame) -> DataFrame:
    """One row: mentions, relevant ones, origins, the origin shown (live before snapshot before seed), newest time."""
    order = F.when(F.col("data_origin") == "live", 0).when(F.col("data_origin") == "verified_snapshot", 1).otherwise(2)
    return mentions.agg(F.count("*").alias("mentions"), n_if(~F.col("is_duplicate")).alias("relevant"), F.count_distinct("data_origin").alias("origins"), F.min_by("data_origin", order).alias("active_origin"), F.max("seen_at").alias("newest"))


def daily_histogram(mentions: DataFrame) -> DataFrame:
    return live(mentions).groupBy("data_origin", F.date_format("seen_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def voice_classes(mentions: DataFrame) -> DataFrame:
    """Author types rolled up into five classes."""
    kind = F.when(F.col("author_type").isin("farmer", "fpo"), "producers").when(F.col("author_type") == "media", "media").when(F.col("author_type") == "government", "government").when(F.col("author_type").isin("expert", "citizen"), "public").otherwise("unknown")
    return live(mentions).groupBy("data_origin", kind.alias("voice_class")).agg(F.count("*").alias("n"))


def feed(mentions: DataFrame, limit: int = 30) -> DataFrame:
    """The newest mentions of each origin, those without time first."""
    order = Window.partitionBy("data_origin").orderBy(F.desc_nulls_first("seen_at"), "mention_id")
    return mentions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("data_origin", F.col("place").cast("long").alias("place"), "mention_id", "seen_at")


def evidence_order(mentions: DataFrame, limit: int = 6) -> DataFrame:
    """Evidence of each topic: voices before officials, then newest, no time as the epoch."""
    order = Window.partitionBy("data_origin", "topic").orderBy(F.col("platform") == "official", F.desc(F.coalesce("seen_at", F.expr(EPOCH))), "mention_id")
    return live(mentions).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).select("data_origin", "topic", "place", "mention_id")


def argmax_topic(mentions: DataFrame) -> DataFrame:
    order = Window.partitionBy("data_origin", "platform").orderBy(F.desc("n"), "topic")
    return live(mentions).groupBy("data_origin", "platform", "topic").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def top_districts(mentions: DataFrame, most: int = 3) -> DataFrame:
    """For each topic its districts by evidence, `most` of them joined, and how many more there are."""
    counts = live(mentions).where("district IS NOT NULL").groupBy("data_origin", "topic", "district").agg(F.count("*").alias("n"))
    order = Window.partitionBy("data_origin", "topic").orderBy(F.desc("n"), "district")
    ranked = counts.withColumn("r", F.row_number().over(order))
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "district"))))
    named = ranked.groupBy("data_origin", "topic").agg(F.array_join(F.transform(top, lambda x: x["district"]), ", ").alias("districts"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return named


def first_topic(mentions: DataFrame) -> DataFrame:
    """The first topic of each author in an origin, by time and id."""
    return live(mentions).groupBy("data_origin", "author_id").agg(F.min_by("topic", F.struct("seen_at", "mention_id")).alias("topic"))


def brief_totals(mentions: DataFrame) -> DataFrame:
    rows = live(mentions)
    return rows.groupBy("data_origin").agg(F.count("*").alias("mentions"), F.count_distinct("district").alias("districts"), F.count_distinct("topic").alias("topics"))


def quality(mentions: DataFrame) -> DataFrame:
    """Data quality of each origin, in shares that are null where there is nothing."""
    n = F.count("*")
    return mentions.groupBy("data_origin").agg(n.alias("mentions"), F.round(share(n_if(F.col("is_duplicate")), n), 6).alias("duplicate_share"), F.round(share(n_if(F.col("district").isNotNull()), n), 6).alias("located_share"), F.round(share(n_if(F.col("stance").isNotNull()), n), 6).alias("stance_share"))


def lens(coverage: DataFrame) -> DataFrame:
    """Coverage rows under each lens: all, concern, positive."""
    rows = coverage.select("data_origin", "district", "favourable", "unfavourable", "mentions")
    views = [("all", F.col("mentions")), ("concern", F.col("unfavourable")), ("positive", F.col("favourable"))]
    parts = [rows.select("data_origin", "district", F.lit(name).alias("lens"), total.alias("total")) for name, total in views]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("total > 0")


def snapshot_copy(mentions: DataFrame, origin: str = "live") -> DataFrame:
    """A copy of an origin's mentions under new deterministic ids, as a verified snapshot."""
    rows = mentions.where(F.col("data_origin") == origin)
    new_id = F.sha2(F.concat(F.lit("snap:"), F.col("mention_id").cast("string")), 256)
    return rows.select(new_id.alias("mention_key"), F.lit("verified_snapshot").alias("data_origin"), "platform", "seen_at")


def manifest(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("data_origin").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"))
