"""Row-level operators: payload projections, filters, look-ups and joins, orders and limits.

QUERIES are bound to the testdata's tables; SQL has the DuckDB statement of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.operators import dedup
from fieldglass.plans.findings import findings
from fieldglass.plans.mentions import DOCUMENTS_SQL, MENTIONS_SQL, document_mentions, event_mentions
from fieldglass.plans.read_model import live


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence_time(published: Column, collected: Column) -> Column:
    return F.coalesce(published, collected)


def joined_text(title: Column, body: Column) -> Column:
    """Headline and body with a blank line between; empty parts leave none."""
    return F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))


def shown_title(title: Column, text: Column, most: int = 160) -> Column:
    """The title, or the first line of the text, cut to `most` characters."""
    return F.coalesce(title, F.substring(F.split(text, "\n")[0], 1, most))


def number_or_null(value: Column) -> Column:
    return value.try_cast("double")


def broadcast_state_of(flag: Column, started: Column, ended: Column) -> Column:
    """live, upcoming or ended of a broadcast; null for what never was one. The flag alone doesn't tell a finished one."""
    return F.when(flag.isin("live", "upcoming"), flag).when(started.isNotNull() | ended.isNotNull(), "ended")


def media(mentions: DataFrame, image: Column, limit: int = 24) -> DataFrame:
    """The newest mentions of each origin that carry an image, without time first."""
    order = Window.partitionBy("data_origin").orderBy(F.desc_nulls_first("seen_at"), "mention_id")
    shown = mentions.withColumn("image", image).where(F.length(F.coalesce("image", F.lit(""))) > 0)
    return shown.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def nested_duplicates(groups: DataFrame) -> DataFrame:
    """(data_origin, canonical_id, copies, n_copies): the copies of each canonical mention in order."""
    copies = F.array_sort(F.collect_list(F.when(F.col("mention_id") != F.col("canonical_id"), F.col("mention_id"))))
    return groups.groupBy("data_origin", "canonical_id").agg(F.array_join(F.transform(copies, lambda x: x.cast("string")), ",").alias("copies"), F.count_if(F.col("mention_id") != F.col("canonical_id")).alias("n_copies"))


def base_topics(mentions: DataFrame, least: int = 3) -> DataFrame:
    """What a topic keeps once subtopics with enough mentions have claimed theirs."""
    rows = live(mentions)
    claimed = rows.groupBy("data_origin", "topic", "subtopic").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = rows.groupBy("data_origin", "topic", "subtopic").agg(F.count("*").alias("n"))
    return counts.join(claimed.drop("n"), ["data_origin", "topic", "subtopic"], "left_anti").groupBy("data_origin", "topic").agg(F.sum("n").alias("n"))


def found_with_evidence(mentions: DataFrame) -> DataFrame:
    """Each ranked finding with the number of its canonical and of its duplicate mentions."""
    counts = mentions.groupBy("data_origin", "topic").agg(F.count_if(~F.col("is_duplicate")).alias("evidence"), F.count_if(F.col("is_duplicate")).alias("duplicates"))
    ranked = findings(mentions).select("data_origin", "topic", "rank")
    return ranked.join(counts, ["data_origin", "topic"], "left").select("data_origin", "topic", "rank", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


def brief(mentions: DataFrame, most: int = 5) -> DataFrame:
    """The morning brief of each origin: concerns, then escalating ones, then the rest, each by rank."""
    order = F.when(F.col("signal") == "concern", 0).when(F.col("signal") == "escalating", 1).otherwise(2)
    by = Window.partitionBy("data_origin").orderBy(order, "rank")
    return findings(mentions).withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= most).select("data_origin", "place", "topic", "signal")


def by_views(mentions: DataFrame, most: int = 6) -> DataFrame:
    order = Window.partitionBy("data_origin", "topic").orderBy(F.desc(F.coalesce("value", F.lit(0.0))), "mention_id")
    return live(mentions).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("data_origin", "topic", "place", "mention_id")


def urgent(mentions: DataFrame, hours: int = 48) -> DataFrame:
    """The strongest event of each topic in the last hours before the newest evidence of its origin."""
    ends = live(mentions).groupBy("data_origin").agg(F.max("seen_at").alias("end"))
    severity = F.when(F.col("stance") == "critical", 0).when(F.col("stance") == "mixed", 1).when(F.col("stance") == "supportive", 2)
    rows = live(mentions).withColumn("severity", severity).where("severity IS NOT NULL").join(F.broadcast(ends), "data_origin")  # a row for each of three origins
    recent = rows.where((F.col("seen_at") >= F.col("end") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("seen_at") <= F.col("end")))
    return recent.groupBy("data_origin", "topic").agg(F.min_by("stance", "severity").alias("strongest"), F.count("*").alias("n"))


def evidence_roles(mentions: DataFrame) -> DataFrame:
    role = F.when(F.col("is_duplicate"), "duplicate").otherwise("evidence")
    return mentions.groupBy("data_origin", "topic", role.alias("role")).agg(F.count("*").alias("n"))


def audit_totals(mentions: DataFrame) -> DataFrame:
    """Collected, accepted, rejected and their shares in percent, a row for each origin."""
    accepted, rejected = F.count_if(F.col("stance").isNotNull() & ~F.col("is_duplicate")), F.count_if(F.col("stance").isNull())
    n = F.count("*")
    percent = lambda part: F.round(F.coalesce(F.try_divide(100.0 * part, n), F.lit(0.0)), 6)
    return mentions.groupBy("data_origin").agg(n.alias("collected"), accepted.alias("accepted"), rejected.alias("rejected"), percent(accepted).alias("accepted_share"), percent(rejected).alias("rejected_share"))


def unlocated(mentions: DataFrame) -> DataFrame:
    """Mentions without a district, as the remainder of all less the located ones of each topic."""
    rows = live(mentions).groupBy("data_origin", "topic").agg(F.count("*").alias("mentions"), F.count("district").alias("located"))
    return rows.select("data_origin", "topic", "mentions", (F.col("mentions") - F.col("located")).alias("unlocated"))


def authors_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by their author's segment; authors that nobody knows are unknown. Counted by author before the join."""
    said = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    found = said.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "left")
    return found.groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment")).agg(F.sum("n").alias("n"))


def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi")


def districts_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts as written, looked up in the dimension whatever their case; unknown ones are dropped."""
    dim = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("district_id"))
    seen = event_mentions(spark, sf_dir).groupBy(F.initcap("district").alias("written")).agg(F.count("*").alias("n"))
    return seen.join(F.broadcast(dim), F.lower("written") == F.col("name")).select("district_id", "n")  # the dimension has 25 rows


def earliest_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.exact_groups(document_mentions(spark, sf_dir))
    return groups.groupBy("data_origin", "canonical_id").agg(F.count("*").alias("members"))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    missing = F.get_json_object("props", "$.nothing.here")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(k.isNotNull()).alias("with_k"), F.count_if(missing.isNotNull()).alias("with_missing"), F.sum(F.coalesce(k, F.lit(0))).alias("total"))


def stance_maps(mentions: DataFrame) -> DataFrame:
    """The stance mix of each topic as a sorted map, in JSON."""
    counts = live(mentions).where("stance IS NOT NULL").groupBy("data_origin", "topic", "stance").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("stance", "n")))
    return counts.groupBy("data_origin", "topic").agg(F.to_json(F.map_from_entries(entries)).alias("mix"), F.sum("n").alias("carrying"))


def word_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.get(words, F.lit(0)).alias("first"), F.array_join(F.slice(words, 2, 3), " ").alias("next"), F.size(F.array_distinct(words)).cast("long").alias("kinds"), F.array_contains(words, "the").alias("has_the"))


def poll_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll plans of three connectors in one table; keys that are already planned stay out."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    plan = lambda df, kind, name, tier: df.select(F.lit(kind).alias("connector"), F.lower(name).alias("query"), F.lit(tier).alias("tier"))
    rows = plan(nations, "news", "n_name", "B").unionByName(plan(regions, "video", "r_name", "A")).unionByName(plan(nations.where("n_regionkey = 2"), "search", "n_name", "C"))
    planned = plan(nations.where("n_nationkey < 5"), "news", "n_name", "B")
    return rows.join(planned.select("connector", "query"), ["connector", "query"], "left_anti")


def stage_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors with an audit event of one kind in the log, by a semi join on the JSON detail."""
    events = table(spark, sf_dir, "events")
    failed = events.where((F.get_json_object("props", "$.k").cast("int") < 10) & (F.col("event_type") == "error")).select("user_id")
    return events.select("user_id").distinct().join(failed, "user_id", "left_semi")


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_mentions(spark, sf_dir)
    return media(docs, F.when(F.col("mention_id") % 4 == 0, F.concat(F.lit("img/"), F.col("mention_id").cast("string"))).when(F.col("mention_id") % 4 == 1, "")).select("data_origin", "place", "mention_id", "image")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Item "), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", shown_title(title, F.col("text")).alias("title"), F.length(joined_text(title, F.col("text"))).cast("long").alias("chars"))


def _events(plan):
    return lambda spark, sf_dir: plan(event_mentions(spark, sf_dir))


QUERIES = {
    "agg03_evidence_counts": _events(found_with_evidence),
    "agg23_unlocated": _events(unlocated),
    "agg24_audit_totals": _events(audit_totals),
    "arr01_array_ops": word_arrays,
    "flt12_media": media_query,
    "jn03_left_author": authors_of_events,
    "jn05_semi": orders_with_returns,
    "jn10_nested_duplicates": lambda spark, sf_dir: nested_duplicates(dedup.exact_groups(document_mentions(spark, sf_dir))),
    "jn13_dim_lookup": districts_by_name,
    "jn18_base_topic_antijoin": _events(base_topics),
    "jn25_stage_semi": stage_rejections,
    "jsn01_json_paths": json_paths,
    "map01_map_ops": _events(stance_maps),
    "prj11_titles": titles,
    "set03_poll_plans": poll_plans,
    "set04_evidence_roles": _events(evidence_roles),
    "srt06_brief": _events(brief),
    "srt08_by_views": _events(by_views),
    "win07_urgent": _events(urgent),
    "win10_canonical_earliest": earliest_canonicals,
}


def sql(findings_sql: str, exact_sql: str) -> dict[str, str]:
    """The statements; findings_sql and exact_sql are the parts that define ranked and ex over the mentions."""
    m = MENTIONS_SQL
    return {
        "agg03_evidence_counts": m + findings_sql + ", c AS (SELECT data_origin, topic, count(*) FILTER (NOT is_duplicate) AS evidence, count(*) FILTER (is_duplicate) AS duplicates FROM mentions GROUP BY 1, 2) SELECT data_origin, topic, rank, evidence, duplicates FROM ranked JOIN c USING (data_origin, topic)",
        "agg23_unlocated": m + " SELECT data_origin, topic, count(*) AS mentions, count(*) - count(district) AS unlocated FROM live GROUP BY 1, 2",
        "agg24_audit_totals": m + " SELECT *, round(100.0::DOUBLE * accepted / collected, 6) AS accepted_share, round(100.0::DOUBLE * rejected / collected, 6) AS rejected_share FROM (SELECT data_origin, count(*) AS collected, count(*) FILTER (stance IS NOT NULL AND NOT is_duplicate) AS accepted, count(*) FILTER (stance IS NULL) AS rejected FROM mentions GROUP BY 1)",
        "arr01_array_ops": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, w[1] AS first, array_to_string(w[2:4], ' ') AS next, len(list_distinct(w)) AS kinds, list_contains(w, 'the') AS has_the FROM w",
        "flt12_media": DOCUMENTS_SQL + " SELECT data_origin, place, mention_id, image FROM (SELECT *, 'img/' || mention_id AS image, row_number() OVER (PARTITION BY data_origin ORDER BY seen_at DESC NULLS FIRST, mention_id) AS place FROM mentions WHERE mention_id % 4 = 0) WHERE place <= 24",
        "jn03_left_author": "SELECT coalesce(c_mktsegment, 'unknown') AS segment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1",
        "jn05_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
        "jn10_nested_duplicates": exact_sql + " SELECT data_origin, canonical_id, coalesce(string_agg(CAST(mention_id AS VARCHAR), ',' ORDER BY mention_id) FILTER (mention_id <> canonical_id), '') AS copies, count(*) FILTER (mention_id <> canonical_id) AS n_copies FROM ex GROUP BY 1, 2",
        "jn13_dim_lookup": m + " SELECT n_nationkey AS district_id, count(*) AS n FROM mentions JOIN nation ON lower(district) = lower(n_name) GROUP BY 1",
        "jn18_base_topic_antijoin": m + " SELECT data_origin, topic, CAST(sum(n) AS BIGINT) AS n FROM (SELECT data_origin, topic, subtopic, count(*) AS n FROM live GROUP BY 1, 2, 3 HAVING count(*) < 3) GROUP BY 1, 2",
        "jn25_stage_semi": "SELECT DISTINCT user_id FROM events e WHERE EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND CAST(json_extract_string(f.props, '$.k') AS INT) < 10)",
        "jsn01_json_paths": "SELECT event_type, count(CAST(json_extract_string(props, '$.k') AS INT)) AS with_k, count(json_extract_string(props, '$.nothing.here')) AS with_missing, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0)) AS BIGINT) AS total FROM events GROUP BY 1",
        "map01_map_ops": m + " SELECT data_origin, topic, '{' || string_agg('\"' || stance || '\":' || n, ',' ORDER BY stance) || '}' AS mix, CAST(sum(n) AS BIGINT) AS carrying FROM (SELECT data_origin, topic, stance, count(*) AS n FROM live WHERE stance IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2",
        "prj11_titles": "WITH t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Item ' || doc_id END AS t FROM documents) SELECT doc_id, coalesce(t, left(split_part(text, chr(10), 1), 160)) AS title, length(concat_ws(chr(10) || chr(10), t, nullif(text, ''))) AS chars FROM t",
        "set03_poll_plans": "WITH p AS (SELECT 'news' AS connector, lower(n_name) AS query, 'B' AS tier FROM nation UNION ALL SELECT 'video', lower(r_name), 'A' FROM region UNION ALL SELECT 'search', lower(n_name), 'C' FROM nation WHERE n_regionkey = 2) SELECT * FROM p WHERE NOT (connector = 'news' AND query IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 5))",
        "set04_evidence_roles": m + " SELECT data_origin, topic, CASE WHEN is_duplicate THEN 'duplicate' ELSE 'evidence' END AS role, count(*) AS n FROM mentions GROUP BY 1, 2, 3",
        "srt06_brief": m + findings_sql + " SELECT data_origin, place, topic, signal FROM (SELECT *, row_number() OVER (PARTITION BY data_origin ORDER BY CASE signal WHEN 'concern' THEN 0 WHEN 'escalating' THEN 1 ELSE 2 END, rank) AS place FROM ranked) WHERE place <= 5",
        "srt08_by_views": m + " SELECT data_origin, topic, place, mention_id FROM (SELECT *, row_number() OVER (PARTITION BY data_origin, topic ORDER BY coalesce(value, 0) DESC, mention_id) AS place FROM live) WHERE place <= 6",
        "win07_urgent": m + ", e AS (SELECT data_origin, max(seen_at) AS e FROM live GROUP BY 1) SELECT data_origin, topic, CASE min(CASE stance WHEN 'critical' THEN 0 WHEN 'mixed' THEN 1 WHEN 'supportive' THEN 2 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'mixed' ELSE 'supportive' END AS strongest, count(*) AS n FROM live JOIN e USING (data_origin) WHERE stance IN ('critical', 'mixed', 'supportive') AND seen_at >= e - INTERVAL 48 HOURS GROUP BY 1, 2",
        "win10_canonical_earliest": exact_sql + " SELECT data_origin, canonical_id, count(*) AS members FROM ex GROUP BY 1, 2",
    }
