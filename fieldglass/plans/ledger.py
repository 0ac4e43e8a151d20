"""Bookkeeping around the mentions: what is got or created, upserted, logged, counted, listed and reported.

Every operator takes and returns DataFrames; writes are the caller's append or overwrite of what is returned, so a
repeated run adds nothing. QUERIES are bound to the testdata's tables; SQL has the DuckDB statement of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import text as T
from fieldglass.operators import dedup
from fieldglass.plans.findings import findings
from fieldglass.plans.mentions import DOCUMENTS_SQL, MENTIONS_SQL, document_mentions, event_mentions
from fieldglass.plans.read_model import brief_totals, coverage_balance, live
from fieldglass.sources.sinks import absent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Get or create, upsert, append


def authors_to_create(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """platform, author_key, first_mention: authors not in known, by lower(handle or name), as first met; never updated."""
    key = F.lower(F.coalesce("handle", "name"))
    met = mentions.where(key.isNotNull()).groupBy("platform", key.alias("author_key")).agg(F.min("mention_id").alias("first_mention"))
    return absent(met, known, ["platform", "author_key"])


def sources_to_create(items: DataFrame, known: DataFrame) -> DataFrame:
    return absent(items.groupBy("platform", "source").agg(F.min("mention_id").alias("first_item")), known, ["platform", "source"])


def location_tree(regions: DataFrame, districts: DataFrame) -> DataFrame:
    """Nodes of the tree: regions, and the districts under each."""
    top = regions.select(F.lit("region").alias("level"), T.slug(F.col("region")).alias("id"), F.lit(None).cast("string").alias("parent"))
    return top.unionByName(districts.select(F.lit("district").alias("level"), T.slug(F.col("district")).alias("id"), T.slug(F.col("region")).alias("parent")))


def upserted(prior: DataFrame, new: DataFrame, keys: list[str], kept: str, kept_if: str) -> DataFrame:
    """new with its column `kept` taken from prior wherever prior has a value in `kept_if`; prior rows without new ones stay."""
    held = prior.select(*keys, F.when(F.col(kept_if).isNotNull(), F.col(kept)).alias("held"), F.col(kept_if).alias("reason"))
    out = new.join(held, keys, "left").withColumns({kept: F.coalesce("held", kept), kept_if: F.coalesce("reason", kept_if)}).drop("held", "reason")
    return out.unionByName(prior.join(new, keys, "left_anti"), allowMissingColumns=True)


def reset_stale(rows: DataFrame, version: Column, current: Column, most: int, by: list[str]) -> DataFrame:
    """rows with status 'pending' on the first `most` of each group whose version is distinct from the current one."""
    stale = ~version.eqNullSafe(current)
    place = F.row_number().over(Window.partitionBy(*by, stale).orderBy("mention_id"))
    return rows.withColumn("status", F.when(stale & (place <= most), "pending").otherwise("done"))


def transitions(mentions: DataFrame) -> DataFrame:
    """The append-only log: an event for each change of state that a mention went through."""
    steps = F.array(
        F.lit("NORMALIZED"),
        F.when(F.col("stance").isNull(), "RELEVANCE_REJECTED").otherwise("RELEVANCE_ACCEPTED"),
        F.when(F.col("is_duplicate"), "DEDUPED"),
        F.when(F.col("stance").isNotNull() & F.col("district").isNotNull(), "ENRICHED"),
    )
    return mentions.select("data_origin", "mention_id", F.posexplode(F.array_compact(steps)).alias("step", "event"))


def counters(runs: DataFrame, every_days: Column) -> DataFrame:
    """Counters of each plan recomputed from its run log: runs, items and when the next one is due."""
    return runs.groupBy("plan").agg(F.count("*").alias("runs"), F.sum("items").alias("items"), F.max("at").alias("last")).withColumn("next_run", F.date_add("last", every_days.cast("int")))


# Filters and joins


def pending(mentions: DataFrame) -> DataFrame:
    return mentions.where((F.col("status") == "normalized") & (F.col("relevance") == "pending"))


def claims(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("claim").isNotNull()).withColumn("author_type", F.coalesce("author_type", F.lit("unknown")))


def to_adjudicate(links: DataFrame, explained: DataFrame, least: int = 3) -> DataFrame:
    """Narratives with `least` evidence rows or more that nothing explains yet."""
    return absent(links.where("role = 'evidence'").groupBy("data_origin", "topic").agg(F.count("*").alias("n")).where(F.col("n") >= least), explained, ["data_origin", "topic"])


def last_finding(found: DataFrame) -> DataFrame:
    """The finding of each narrative; of several active ones the last, by time and then id."""
    return found.groupBy("narrative").agg(F.max_by("finding", F.struct("generated_at", "finding")).alias("finding"), F.count("*").alias("active"))


def duplicate_audit(groups: DataFrame, log: DataFrame) -> DataFrame:
    """Every duplicate beside its canonical mention and the event that marked it; without an event, 'unlogged'."""
    marks = log.where("event = 'DEDUPED'").select("mention_id", F.lit("logged").alias("mark"))
    return groups.where("mention_id <> canonical_id").join(marks, "mention_id", "left").withColumn("mark", F.coalesce("mark", F.lit("unlogged")))


# Reports and read models


def narrative_detail(mentions: DataFrame) -> DataFrame:
    """Every narrative's detail in one row: evidence by time, duplicates, claims, a daily timeline and its snapshots."""
    item = F.struct("seen_at", "mention_id", "author_type", "stance")
    evidence = F.array_sort(F.collect_list(F.when(~F.col("is_duplicate"), item)))
    rows = mentions.groupBy("data_origin", "topic").agg(evidence.alias("evidence"), F.count_if("is_duplicate").alias("duplicates"))
    days = live(mentions).groupBy("data_origin", "topic", F.date_format("seen_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("count"))
    lines = days.groupBy("data_origin", "topic").agg(F.array_sort(F.collect_list(F.struct("date", "count"))).alias("timeline"))
    out = rows.join(lines, ["data_origin", "topic"], "left").withColumn("claims", F.filter("evidence", lambda e: e["stance"].isin("critical", "supportive")))
    first = Window.partitionBy("data_origin", "topic").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = days.withColumn("total", F.sum("count").over(first)).groupBy("data_origin", "topic").agg(F.array_sort(F.collect_list(F.struct("date", "total"))).alias("snapshots"))
    return out.join(grown, ["data_origin", "topic"], "left")


def finding_detail(mentions: DataFrame) -> DataFrame:
    """Findings with their narrative's evidence, public voices before official ones, then by time."""
    order = F.struct((F.col("author_type") == "government").alias("official"), "seen_at", "mention_id")
    evidence = live(mentions).groupBy("data_origin", "topic").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["mention_id"]).alias("evidence"))
    return findings(mentions).select("data_origin", "topic", "rank").join(evidence, ["data_origin", "topic"], "left")


def command_view(mentions: DataFrame) -> DataFrame:
    """One row for each origin: brief totals, findings in rank order, located districts and the mix of voices."""
    ranked = findings(mentions).groupBy("data_origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]).alias("findings"))
    voices = live(mentions).groupBy("data_origin", "author_type").agg(F.count("*").alias("n")).groupBy("data_origin").agg(F.array_sort(F.collect_list(F.struct("author_type", "n"))).alias("voices"))
    return brief_totals(mentions).join(ranked, "data_origin", "left").join(voices, "data_origin", "left")


def board(mentions: DataFrame, all_districts: int) -> DataFrame:
    """Quiet districts (all less those with mentions) and state-wide shares of each origin."""
    rows = coverage_balance(mentions).groupBy("data_origin").agg(F.count("*").alias("located"), F.sum("favourable").alias("favourable"), F.sum("unfavourable").alias("unfavourable"), F.sum("mentions").alias("total"))
    return rows.withColumn("quiet", F.lit(all_districts) - F.col("located")).withColumn("unfavourable_share", F.round(F.col("unfavourable") / F.col("total"), 6))


def summary(name: Column, mentions: Column, voices: Column, districts: Column) -> Column:
    """A sentence or two on a narrative, for a brief."""
    where = F.when(districts > 1, F.concat(F.lit(" in "), districts.cast("string"), F.lit(" districts"))).when(districts == 1, F.lit(" in one district")).otherwise(F.lit(""))
    return F.concat(name, F.lit(": "), mentions.cast("string"), F.when(mentions == 1, " mention").otherwise(" mentions"), F.lit(" by "), voices.cast("string"), F.when(voices == 1, " voice").otherwise(" voices"), where, F.lit("."))


def finding_copy(ranked: DataFrame) -> DataFrame:
    """Headline, reason and recommendation of every finding, in words of our own."""
    topic = F.concat(F.lit("Topic "), F.col("topic").cast("string"))
    headline = F.concat(topic, F.when(F.col("category") == "emerging", " is emerging").when(F.col("trajectory") == "rising", " is rising").otherwise(" continues"))
    reason = F.concat_ws("; ", F.concat(F.col("mentions").cast("string"), F.lit(" mentions")), F.when(F.col("divergence"), "official and public voices differ"), F.when(F.col("districts") >= 2, "several districts"))
    return ranked.select("data_origin", "topic", headline.alias("headline"), reason.alias("reason"), summary(topic, F.col("mentions"), F.col("voices"), F.col("districts")).alias("summary"))


def brief_signals(ranked: DataFrame, lifetime: DataFrame) -> DataFrame:
    """The signal of each narrative: its finding's, else from the stance over all time."""
    fallback = F.when(F.col("critical") > F.col("supportive"), "concern").when(F.col("supportive") > F.col("critical"), "positive").otherwise("factual")
    return lifetime.join(ranked.select("data_origin", "topic", "signal"), ["data_origin", "topic"], "left").select("data_origin", "topic", F.coalesce("signal", fallback).alias("signal"))


def backfill_cost(plans: DataFrame, per_term: int, price: float) -> DataFrame:
    """Volume and cost of polling all plans at once, whenever they are due."""
    return plans.groupBy("tier").agg(F.count("*").alias("terms"), (F.count("*") * per_term).alias("items"), F.round(F.count("*") * per_term * price, 6).alias("cost"))


def report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A line of a Markdown table for each row, as text to write; order is the reader's."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), F.lit(" |")).alias("line"))


# Bindings


def _events(plan):
    return lambda spark, sf_dir: plan(event_mentions(spark, sf_dir))


def _on(name: str, plan):
    return lambda spark, sf_dir: plan(table(spark, sf_dir, name))


def _named(m: DataFrame) -> DataFrame:
    handle = F.when(F.col("author_id") % 2 == 0, F.concat(F.lit("User"), F.col("author_id").cast("string")))
    return m.withColumns({"handle": handle, "name": F.concat(F.lit("NAME "), (F.col("author_id") % 40).cast("string"))})


def _authors(m: DataFrame) -> DataFrame:
    known = m.select("platform", F.concat(F.lit("name "), (F.col("author_id") % 10).cast("string")).alias("author_key")).distinct()
    return authors_to_create(_named(m), known)


def _narratives(m: DataFrame) -> DataFrame:
    return live(m).groupBy("data_origin", "topic").agg(F.count("*").alias("mentions")).withColumn("title", F.concat(F.lit("new "), F.col("topic").cast("string"))).withColumn("explanation", F.lit(None).cast("string"))


def _upsert(m: DataFrame) -> DataFrame:
    prior = _narratives(m.where("mention_id % 3 > 0")).withColumns({"title": F.concat(F.lit("old "), F.col("topic").cast("string")), "explanation": F.when(F.col("topic") % 2 == 0, "told"), "mentions": F.lit(0).cast("long")})
    return upserted(prior, _narratives(m), ["data_origin", "topic"], "title", "explanation")


def _versions(m: DataFrame) -> DataFrame:
    version = F.when(F.col("topic") > 1, F.col("topic") % 4)
    return reset_stale(m, version, F.lit(2), 100, ["data_origin"]).groupBy("data_origin", "status").agg(F.count("*").alias("n"), F.max("mention_id").alias("last"))


def _runs(orders: DataFrame) -> DataFrame:
    runs = orders.select((F.col("o_custkey") % 50).alias("plan"), F.to_date("o_orderdate").alias("at"), F.lit(1).alias("items"))
    return counters(runs, F.col("plan") % 3 + 1).select("plan", "runs", "items", F.date_format("next_run", "yyyy-MM-dd").alias("next_run"))


def _due(orders: DataFrame) -> DataFrame:
    """Plans whose next run is due on a day: the cadence state, by status."""
    state = orders.select((F.col("o_custkey") % 50).alias("plan"), F.to_date("o_orderdate").alias("at"), F.lit(1).alias("items"))
    due = counters(state, F.col("plan") % 3 + 1).withColumn("due", F.col("next_run") <= F.to_date(F.lit("1998-08-01")))
    return due.groupBy("due").agg(F.count("*").alias("plans"))


def _states(m: DataFrame) -> DataFrame:
    """Histories of live, upcoming and ended, appended at collection and never overwritten; the last one is the state."""
    state = F.when(F.col("stance") == "critical", "live").when(F.col("stance") == "mixed", "upcoming").when(F.col("stance") == "supportive", "ended")
    seen = m.withColumn("state", state).where("state IS NOT NULL")
    return seen.groupBy("author_id").agg(F.count("*").alias("changes"), F.max_by("state", F.struct("seen_at", "mention_id")).alias("state"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.exact_groups(document_mentions(spark, sf_dir))
    log = groups.where("mention_id % 4 > 0").select("mention_id", F.lit("DEDUPED").alias("event"))
    return duplicate_audit(groups, log).select("mention_id", "canonical_id", "mark")


def _translations(events: DataFrame) -> DataFrame:
    """The value that an event's JSON detail states, looked up for every row of its user; null where no event states one."""
    k = F.get_json_object("props", "$.k").cast("int")
    seeds = events.where((F.col("event_type") == "purchase") & (k > 40)).groupBy("user_id").agg(F.min_by(k, "event_id").alias("seed"))
    return events.select("event_id", "user_id").join(seeds, "user_id", "left").groupBy("seed").agg(F.count("*").alias("n"))


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the lines of a JSON dump, read back by an explicit schema with their dates revived."""
    dump = table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("at"))).alias("line"))
    row = F.from_json("line", "o_orderkey long, o_orderstatus string, at timestamp")
    return dump.select(row.alias("r")).groupBy("r.o_orderstatus", F.date_format("r.at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("r.o_orderkey").alias("keys"))


def _ranked(plan):
    return _events(lambda m: plan(findings(m)))


def _placed(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def _detail(m: DataFrame) -> DataFrame:
    d = narrative_detail(m)
    line = F.array_join(F.transform("timeline", lambda x: F.concat(x["date"], F.lit("="), x["count"].cast("string"))), ",")
    return d.select("data_origin", "topic", F.size("evidence").cast("long").alias("evidence"), F.col("evidence")[0]["mention_id"].alias("first"), "duplicates", F.size("claims").cast("long").alias("claims"), F.sha2(line, 256).alias("timeline"), F.element_at("snapshots", -1)["total"].alias("total"))


def _confirmed(m: DataFrame) -> DataFrame:
    """Accepted mentions stay so only where the model gives both axes half or more; without its answer they stay as they were."""
    topical, regional = F.col("value") / 100, F.when(F.col("district").isNotNull(), F.lit(0.7)).otherwise(0.4)
    verdict = F.when(F.col("value").isNull(), "accepted").when((topical >= 0.5) & (regional >= 0.5), "accepted").otherwise("demoted")
    return live(m).groupBy("data_origin", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(event_mentions(spark, sf_dir), table(spark, sf_dir, "nation").count())


QUERIES = {
    "agg14_failure_rate": _on("events", lambda e: e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("failed"))),
    "agg17_author_types": _events(lambda m: _placed(m.groupBy("data_origin", "author_type").agg(F.count_distinct("author_id").alias("authors")), ["data_origin"], F.desc("authors"), "author_type")),
    "agg22_map_totals": _events(lambda m: coverage_balance(m).groupBy("data_origin").agg(F.sum("favourable").alias("favourable"), F.sum("unfavourable").alias("unfavourable"), F.sum(F.col("mentions") - F.col("favourable") - F.col("unfavourable")).alias("neutral"))),
    "flt02_pending": _events(lambda m: pending(m.withColumns({"status": F.when(F.col("is_duplicate"), "duplicate").otherwise("normalized"), "relevance": F.when(F.col("stance").isNull() | (F.col("topic") == 3), "pending").otherwise("accepted")})).groupBy("data_origin").agg(F.count("*").alias("n"))),
    "flt07_district_drill": _events(lambda m: live(m).where(F.col("district").isNotNull()).groupBy("district", "topic").agg(F.count("*").alias("n"))),
    "flt10_claims": _events(lambda m: claims(m.withColumn("claim", F.when(F.col("stance") == "critical", F.col("topic"))).withColumn("author_type", F.nullif("author_type", F.lit("citizen")))).groupBy("author_type", "claim").agg(F.count("*").alias("n"))),
    "flt11_adjudicate": _events(lambda m: to_adjudicate(m.withColumn("role", F.when(F.col("is_duplicate"), "duplicate").otherwise("evidence")), m.where("topic % 3 = 0").select("data_origin", "topic").distinct())),
    "jn02_distinct_links": _events(lambda m: m.select("data_origin", "topic", "author_id").distinct().join(m.where("stance = 'critical'").select("author_id").distinct(), "author_id").groupBy("data_origin", "topic").agg(F.count("*").alias("authors"))),
    "jn04_limited_in": _on("orders", lambda o: o.join(_placed(o, ["o_orderstatus"], F.desc("o_totalprice"), "o_orderkey").where("place <= 25").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")),
    "jn08_last_finding": _on("orders", lambda o: last_finding(o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("narrative"), F.col("o_orderkey").alias("finding"), F.col("o_orderdate").alias("generated_at")))),
    "jn12_district_narratives": _events(lambda m: live(m).where("district IS NOT NULL").groupBy("data_origin", "district").agg(F.count_distinct("topic").alias("narratives"), F.count("*").alias("links"))),
    "jn22_duplicate_audit": _audit,
    "jn23_seed_details": _on("events", _translations),
    "prj13_topic_of_key": _events(lambda m: m.groupBy(F.split(F.concat_ws("/", F.col("topic").cast("string"), F.col("subtopic").cast("string")), "/")[0].alias("key")).agg(F.count("*").alias("n"))),
    "rm04_narrative_detail": _events(_detail),
    "rm05_finding_detail": _events(lambda m: finding_detail(m).select("data_origin", "topic", "rank", F.size("evidence").cast("long").alias("n"), F.sha2(F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","), 256).alias("evidence_hash"))),
    "rm10_command_view": _events(lambda m: command_view(m).select("data_origin", "mentions", "districts", "topics", F.array_join(F.transform("findings", lambda x: x.cast("string")), ",").alias("findings"), F.array_join(F.transform("voices", lambda v: F.concat(v["author_type"], F.lit("="), v["n"].cast("string"))), ",").alias("voices"))),
    "rm15_board": _board,
    "scr04_confirmation": _events(_confirmed),
    "scr16_finding_copy": _ranked(lambda r: finding_copy(r).select("data_origin", "topic", "headline", "reason")),
    "scr17_summaries": _ranked(lambda r: finding_copy(r).select("data_origin", "topic", "summary")),
    "scr18_brief_signals": _events(lambda m: brief_signals(findings(m).where("topic % 2 = 0"), live(m).groupBy("data_origin", "topic").agg(F.count_if(F.col("stance") == "critical").alias("critical"), F.count_if(F.col("stance") == "supportive").alias("supportive")))),
    "scr26_backfill_cost": _on("customer", lambda c: backfill_cost(c.select(F.col("c_mktsegment").alias("tier")), 15, 0.0004)),
    "set02_lens_union": _events(lambda m: live(m).where("stance = 'critical'").select("data_origin", "topic", F.lit("concern").alias("lens")).unionByName(live(m).where("stance = 'supportive'").select("data_origin", "topic", F.lit("positive").alias("lens"))).groupBy("data_origin", "lens").agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics"))),
    "snk03_authors": _events(_authors),
    "snk04_sources": lambda spark, sf_dir: sources_to_create(document_mentions(spark, sf_dir).withColumnRenamed("author_id", "source"), document_mentions(spark, sf_dir).where("mention_id % 50 = 0").select("platform", F.col("author_id").alias("source")).distinct()),
    "snk05_location_tree": lambda spark, sf_dir: location_tree(table(spark, sf_dir, "region").select(F.col("r_name").alias("region")), table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("district"), F.col("r_name").alias("region"))),
    "snk06_audit_log": _events(lambda m: transitions(m).groupBy("data_origin", "event").agg(F.count("*").alias("n"))),
    "snk07_narrative_upsert": _events(_upsert),
    "snk09_metric_snapshots": _events(lambda m: live(m).groupBy("data_origin", "topic", F.date_format("seen_at", "yyyy-MM-dd").alias("captured")).agg(F.count("*").alias("mentions"), F.count_distinct("author_id").alias("voices"))),
    "snk13_reset_stale": _events(_versions),
    "snk14_counters": _on("orders", _runs),
    "snk19_report_lines": _events(lambda m: report(m.groupBy("data_origin", "district").agg(F.count("*").alias("n")), ["data_origin", "district", "n"])),
    "src16_json_import": _imported,
    "src17_backfill_scan": _on("orders", lambda o: o.where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("date")).groupBy("o_orderpriority").agg(F.count("*").alias("plans"), F.count_distinct("o_custkey").alias("queries"))),
    "srt03_narratives": _events(lambda m: _placed(live(m).groupBy("data_origin", "topic").agg(F.count("*").alias("mentions")), ["data_origin"], F.desc("mentions"), "topic")),
    "srt11_head_samples": _events(lambda m: _placed(m.withColumn("branch", F.when(F.col("stance").isNull(), "rejected").otherwise("accepted")), ["branch"], "mention_id").where("(branch = 'accepted' AND place <= 50) OR place <= 30").select("branch", "place", "mention_id")),
    "srt12_yield_order": _on("orders", lambda o: _placed(o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("items")), ["o_orderstatus"], F.desc("items"), "o_orderpriority")),
    "srt13_children": _on("events", lambda e: e.groupBy("user_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ","), 256).alias("children"))),
    "str03_cadence": _on("orders", _due),
    "str09_states": _events(_states),
    "str10_event_log": _events(lambda m: transitions(m).select("mention_id", F.col("step").cast("long").alias("step"), "event")),
}


def sql(findings_sql: str, exact_sql: str) -> dict[str, str]:
    """The statements; findings_sql and exact_sql are the parts that define ranked and ex over the mentions."""
    m = MENTIONS_SQL
    ranked = m + findings_sql
    claim = "CASE WHEN stance IS NULL THEN 'RELEVANCE_REJECTED' ELSE 'RELEVANCE_ACCEPTED' END"
    log = f", log AS (SELECT data_origin, mention_id, list_filter(['NORMALIZED', {claim}, CASE WHEN is_duplicate THEN 'DEDUPED' END, CASE WHEN stance IS NOT NULL AND district IS NOT NULL THEN 'ENRICHED' END], lambda x: x IS NOT NULL) AS e FROM mentions)"
    balance = ", b AS (SELECT data_origin, district, count(*) AS total, count(*) FILTER (stance = 'supportive') AS favourable, count(*) FILTER (stance = 'critical') AS unfavourable FROM live WHERE district IS NOT NULL GROUP BY 1, 2)"
    runs = "WITH c AS (SELECT plan, count(*) AS runs, count(*) AS items, max(d) + (plan % 3 + 1)::INT AS next_run FROM (SELECT o_custkey % 50 AS plan, o_orderdate::DATE AS d FROM orders) GROUP BY plan)"
    copy = " FROM (SELECT *, 'Topic ' || topic AS t FROM ranked)"
    plural = lambda n, one: f"{n} || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {one}s' END"
    return {
        "agg14_failure_rate": "SELECT user_id, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failed FROM events GROUP BY 1",
        "agg17_author_types": m + " SELECT *, row_number() OVER (PARTITION BY data_origin ORDER BY authors DESC, author_type) AS place FROM (SELECT data_origin, author_type, count(DISTINCT author_id) AS authors FROM mentions GROUP BY 1, 2)",
        "agg22_map_totals": m + balance + " SELECT data_origin, CAST(sum(favourable) AS BIGINT) AS favourable, CAST(sum(unfavourable) AS BIGINT) AS unfavourable, CAST(sum(total - favourable - unfavourable) AS BIGINT) AS neutral FROM b GROUP BY 1",
        "flt02_pending": m + " SELECT data_origin, count(*) AS n FROM live WHERE stance IS NULL OR topic = 3 GROUP BY 1",
        "flt07_district_drill": m + " SELECT district, topic, count(*) AS n FROM live WHERE district IS NOT NULL GROUP BY 1, 2",
        "flt10_claims": m + " SELECT coalesce(nullif(author_type, 'citizen'), 'unknown') AS author_type, topic AS claim, count(*) AS n FROM mentions WHERE stance = 'critical' AND topic IS NOT NULL GROUP BY 1, 2",
        "flt11_adjudicate": m + " SELECT data_origin, topic, count(*) AS n FROM live WHERE topic IS NULL OR topic % 3 <> 0 GROUP BY 1, 2 HAVING count(*) >= 3",
        "jn02_distinct_links": m + " SELECT data_origin, topic, count(*) AS authors FROM (SELECT DISTINCT data_origin, topic, author_id FROM mentions WHERE author_id IN (SELECT author_id FROM mentions WHERE stance = 'critical')) GROUP BY 1, 2",
        "jn04_limited_in": "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 25",
        "jn08_last_finding": "SELECT o_custkey AS narrative, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS finding, count(*) AS active FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
        "jn12_district_narratives": m + " SELECT data_origin, district, count(DISTINCT topic) AS narratives, count(*) AS links FROM live WHERE district IS NOT NULL GROUP BY 1, 2",
        "jn22_duplicate_audit": exact_sql + " SELECT mention_id, canonical_id, CASE WHEN mention_id % 4 > 0 THEN 'logged' ELSE 'unlogged' END AS mark FROM ex WHERE mention_id <> canonical_id",
        "jn23_seed_details": "WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), s AS (SELECT user_id, arg_min(k, event_id) AS seed FROM k WHERE event_type = 'purchase' AND k > 40 GROUP BY 1) SELECT seed, count(*) AS n FROM events LEFT JOIN s USING (user_id) GROUP BY 1",
        "prj13_topic_of_key": m + " SELECT split_part(concat_ws('/', topic, subtopic), '/', 1) AS key, count(*) AS n FROM mentions GROUP BY 1",
        "rm04_narrative_detail": m + ", d AS (SELECT data_origin, topic, strftime(seen_at, '%Y-%m-%d') AS day, count(*) AS n FROM live GROUP BY 1, 2, 3), t AS (SELECT data_origin, topic, sha256(string_agg(day || '=' || n, ',' ORDER BY day)) AS timeline, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY 1, 2) SELECT data_origin, topic, count(*) FILTER (NOT is_duplicate) AS evidence, arg_min(mention_id, (seen_at, mention_id)) FILTER (NOT is_duplicate) AS first, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (NOT is_duplicate AND stance IN ('critical', 'supportive')) AS claims, any_value(timeline) AS timeline, any_value(total) AS total FROM mentions LEFT JOIN t USING (data_origin, topic) GROUP BY 1, 2",
        "rm05_finding_detail": ranked + " SELECT r.data_origin, r.topic, any_value(r.rank) AS rank, count(*) AS n, sha256(string_agg(mention_id::VARCHAR, ',' ORDER BY author_type = 'government', seen_at, mention_id)) AS evidence_hash FROM ranked r JOIN live l ON l.data_origin = r.data_origin AND l.topic = r.topic GROUP BY 1, 2",
        "rm10_command_view": ranked + ", brief AS (SELECT data_origin, count(*) AS mentions, count(DISTINCT district) AS districts, count(DISTINCT topic) AS topics FROM live GROUP BY 1), listed AS (SELECT data_origin, string_agg(topic::VARCHAR, ',' ORDER BY rank) AS findings FROM ranked GROUP BY 1), spoken AS (SELECT data_origin, string_agg(author_type || '=' || n, ',' ORDER BY author_type) AS voices FROM (SELECT data_origin, author_type, count(*) AS n FROM live GROUP BY 1, 2) GROUP BY 1) SELECT * FROM brief LEFT JOIN listed USING (data_origin) LEFT JOIN spoken USING (data_origin)",
        "rm15_board": m + balance + " SELECT data_origin, count(*) AS located, CAST(sum(favourable) AS BIGINT) AS favourable, CAST(sum(unfavourable) AS BIGINT) AS unfavourable, CAST(sum(total) AS BIGINT) AS total, (SELECT count(*) FROM nation) - count(*) AS quiet, round(sum(unfavourable) / sum(total), 6) AS unfavourable_share FROM b GROUP BY 1",
        "scr04_confirmation": m + " SELECT data_origin, CASE WHEN value IS NULL OR (value / 100 >= 0.5 AND district IS NOT NULL) THEN 'accepted' ELSE 'demoted' END AS verdict, count(*) AS n FROM live GROUP BY 1, 2",
        "scr16_finding_copy": ranked + " SELECT data_origin, topic, t || CASE WHEN category = 'emerging' THEN ' is emerging' WHEN trajectory = 'rising' THEN ' is rising' ELSE ' continues' END AS headline, concat_ws('; ', mentions || ' mentions', CASE WHEN divergence THEN 'official and public voices differ' END, CASE WHEN districts >= 2 THEN 'several districts' END) AS reason" + copy,
        "scr17_summaries": ranked + f" SELECT data_origin, topic, t || ': ' || {plural('mentions', 'mention')} || ' by ' || {plural('voices', 'voice')} || CASE WHEN districts > 1 THEN ' in ' || districts || ' districts' WHEN districts = 1 THEN ' in one district' ELSE '' END || '.' AS summary" + copy,
        "scr18_brief_signals": ranked + ", a AS (SELECT data_origin, topic, count(*) FILTER (stance = 'critical') AS c, count(*) FILTER (stance = 'supportive') AS s FROM live GROUP BY 1, 2) SELECT a.data_origin, a.topic, coalesce(r.signal, CASE WHEN c > s THEN 'concern' WHEN s > c THEN 'positive' ELSE 'factual' END) AS signal FROM a LEFT JOIN (SELECT * FROM ranked WHERE topic % 2 = 0) r USING (data_origin, topic)",
        "scr26_backfill_cost": "SELECT c_mktsegment AS tier, count(*) AS terms, count(*) * 15 AS items, round(count(*) * 15 * 0.0004::DOUBLE, 6) AS cost FROM customer GROUP BY 1",
        "set02_lens_union": m + " SELECT data_origin, CASE stance WHEN 'critical' THEN 'concern' ELSE 'positive' END AS lens, count(*) AS n, count(DISTINCT topic) AS topics FROM live WHERE stance IN ('critical', 'supportive') GROUP BY 1, 2",
        "snk03_authors": m + ", k AS (SELECT platform, mention_id, author_id, lower(CASE WHEN author_id % 2 = 0 THEN 'User' || author_id ELSE 'NAME ' || author_id % 40 END) AS author_key FROM mentions) SELECT platform, author_key, min(mention_id) AS first_mention FROM k WHERE (platform, author_key) NOT IN (SELECT platform, 'name ' || author_id % 10 FROM mentions) GROUP BY 1, 2",
        "snk04_sources": DOCUMENTS_SQL + " SELECT platform, author_id AS source, min(mention_id) AS first_item FROM mentions GROUP BY 1, 2 HAVING NOT bool_or(mention_id % 50 = 0)",
        "snk05_location_tree": "SELECT 'region' AS level, regexp_replace(lower(r_name), '\\s+', '-', 'g') AS id, NULL AS parent FROM region UNION ALL SELECT 'district', regexp_replace(lower(n_name), '\\s+', '-', 'g'), regexp_replace(lower(r_name), '\\s+', '-', 'g') FROM nation JOIN region ON n_regionkey = r_regionkey",
        "snk06_audit_log": m + log + " SELECT data_origin, event, count(*) AS n FROM (SELECT data_origin, unnest(e) AS event FROM log) GROUP BY 1, 2",
        "snk07_narrative_upsert": m + ", p AS (SELECT DISTINCT data_origin, topic FROM live WHERE mention_id % 3 > 0) SELECT l.data_origin, l.topic, count(*) AS mentions, CASE WHEN any_value(p.topic) % 2 = 0 THEN 'old ' ELSE 'new ' END || l.topic AS title, CASE WHEN any_value(p.topic) % 2 = 0 THEN 'told' END AS explanation FROM live l LEFT JOIN p ON p.data_origin = l.data_origin AND p.topic = l.topic GROUP BY 1, 2",
        "snk09_metric_snapshots": m + " SELECT data_origin, topic, strftime(seen_at, '%Y-%m-%d') AS captured, count(*) AS mentions, count(DISTINCT author_id) AS voices FROM live GROUP BY 1, 2, 3",
        "snk13_reset_stale": m + ", s AS (SELECT *, CASE WHEN topic > 1 THEN topic % 4 END IS DISTINCT FROM 2 AS stale FROM mentions), p AS (SELECT *, row_number() OVER (PARTITION BY data_origin, stale ORDER BY mention_id) AS r FROM s) SELECT data_origin, CASE WHEN stale AND r <= 100 THEN 'pending' ELSE 'done' END AS status, count(*) AS n, max(mention_id) AS last FROM p GROUP BY 1, 2",
        "snk14_counters": runs + " SELECT plan, runs, items, strftime(next_run, '%Y-%m-%d') AS next_run FROM c",
        "snk19_report_lines": m + " SELECT '| ' || data_origin || ' | ' || coalesce(district, '—') || ' | ' || count(*) || ' |' AS line FROM mentions GROUP BY data_origin, district",
        "src16_json_import": "SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2",
        "src17_backfill_scan": "SELECT o_orderpriority, count(*) AS plans, count(DISTINCT o_custkey) AS queries FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1",
        "srt03_narratives": m + " SELECT *, row_number() OVER (PARTITION BY data_origin ORDER BY mentions DESC, topic) AS place FROM (SELECT data_origin, topic, count(*) AS mentions FROM live GROUP BY 1, 2)",
        "srt11_head_samples": m + " SELECT branch, place, mention_id FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY mention_id) AS place FROM (SELECT mention_id, CASE WHEN stance IS NULL THEN 'rejected' ELSE 'accepted' END AS branch FROM mentions)) WHERE place <= CASE branch WHEN 'accepted' THEN 50 ELSE 30 END",
        "srt12_yield_order": "SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY items DESC, o_orderpriority) AS place FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS items FROM orders GROUP BY 1, 2)",
        "srt13_children": "SELECT user_id, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id)) AS children FROM events GROUP BY 1",
        "str03_cadence": runs + " SELECT next_run <= DATE '1998-08-01' AS due, count(*) AS plans FROM c GROUP BY 1",
        "str09_states": m + ", s AS (SELECT *, CASE stance WHEN 'critical' THEN 'live' WHEN 'mixed' THEN 'upcoming' WHEN 'supportive' THEN 'ended' END AS state FROM mentions) SELECT author_id, count(*) AS changes, arg_max(state, (seen_at, mention_id)) AS state FROM s WHERE state IS NOT NULL GROUP BY 1",
        "str10_event_log": m + log + " SELECT mention_id, step - 1 AS step, event FROM (SELECT mention_id, unnest(e) AS event, generate_subscripts(e, 1) AS step FROM log)",
    }
