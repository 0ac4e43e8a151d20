"""Queries over the testdata's tables, one for each implemented operator, and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import scoring as S
from fieldglass.functions import text as T
from fieldglass.operators import dedup
from fieldglass.plans import findings as N
from fieldglass.plans import read_model as R
from fieldglass.plans import adjudication, alerts as interrupts, delivery, enrichment, ledger, payloads, places, relevance as gate, rows, snapshot as copies, stored, texts
from fieldglass.plans.mentions import document_mentions, event_mentions
from fieldglass.sources import sinks
from fieldglass.streaming import mentions as stream

Query = Callable[[SparkSession, str], DataFrame]


def on_events(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(event_mentions(spark, sf_dir))


def on_documents(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(document_mentions(spark, sf_dir))


def on(table: str, plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def evidence_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as evidence: turns nested in order under each conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["role"]), ">").alias("roles"), F.count("*").alias("turns"))


def yield_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as poll plans, orders as runs, lines as items: yields recomputed, each level aggregated before the join."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("plan"), F.col("o_orderdate").alias("at"))
    items = read("lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count("*").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("rejected"))
    runs = orders.join(items, "run", "left").groupBy("plan").agg(F.count("*").alias("runs"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"), F.max("at").alias("last_run"))
    plans = read("customer").select(F.col("c_custkey").alias("plan"), F.col("c_mktsegment").alias("tier"))
    return plans.join(runs, "plan", "left").select("plan", "tier", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("rejected", F.lit(0)).alias("rejected"), "last_run")


def due_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as poll plans: open ones by priority and date, a cap for each status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    order = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return orders.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 20").select("o_orderstatus", "place", "o_orderkey")


def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of three families in documents, with an exclusion: one pattern for each term, no join."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = {"the": (["the", "der", "les"], []), "license": (["license", "licensed"], ["apache"]), "secret": (["token", "password"], [])}
    found = F.array_compact(F.array(*[F.when(T.matches_term(F.col("text"), v, x), F.lit(k)) for k, (v, x) in sorted(terms.items())]))
    return docs.select("doc_id", F.array_join(found, ",").alias("terms"))


def cross_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-tail poll queries: issue x district x language, a product of fixed small dimensions."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    issues, languages = F.array(*map(F.lit, ("prices", "water", "power", "roads"))), F.array(F.lit("en"), F.lit("te"))
    rows = nation.select("n_name", F.explode(issues).alias("issue")).select("*", F.explode(languages).alias("language"))
    return rows.select(F.concat_ws(" ", "issue", T.slug(F.col("n_name"))).alias("query"), "language", F.lit("C").alias("tier"))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier output checked against its contract: parsed, ranged; what fails is a failure row."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.from_json("props", "k int")["k"]
    valid = k.isNotNull() & k.between(0, 49) & F.col("event_type").isin("click", "view", "purchase")
    return events.groupBy(F.when(F.coalesce(valid, F.lit(False)), "accepted").otherwise("failed").alias("branch")).agg(F.count("*").alias("n"), F.sum(F.coalesce(k, F.lit(0))).alias("total"))


def relevance(docs: DataFrame) -> DataFrame:
    """Title and body scores of each document: topical words in the first line weigh more."""
    title, body = F.element_at(F.split("text", "\n"), 1), F.col("text")
    hit = lambda where, w: F.when(T.matches_term(where, [w]), 1).otherwise(0)
    in_title = sum((hit(title, w) for w in ("and", "que", "und")), F.lit(0))
    in_body = sum((hit(body, w) for w in ("with", "que", "der")), F.lit(0))
    agri = F.least(F.when(in_title > 0, 0.6).otherwise(0.0) + F.when(in_title > 1, 0.2).otherwise(0.0) + F.least(F.lit(0.3), 0.15 * in_body), F.lit(1.0))
    region = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("lang").isin("en", "de"), 0.6).otherwise(0.0) - F.when(T.matches_term(body, ["les"]), 0.15).otherwise(0.0)))
    scored = docs.select("doc_id", F.round(agri, 6).alias("topical"), F.round(region, 6).alias("regional"))
    return scored.withColumn("accepted", (F.col("topical") >= 0.5) & (F.col("regional") >= 0.4))


def seasonal(mentions: DataFrame) -> DataFrame:
    """Urgency of each topic on each day: 1.6 in its window, which may go round the year's end, else 1."""
    start, end = (F.col("topic") * 100 + 15), F.pmod(F.col("topic") + 1, F.lit(13)) * 100 + 10
    inside = S.in_season(F.col("seen_at"), start, end)
    return R.live(mentions).withColumn("urgency", F.when(inside, 1.6).otherwise(1.0)).groupBy("data_origin", "topic", "urgency").agg(F.count("*").alias("n"))


def rolling_baseline(mentions: DataFrame) -> DataFrame:
    days = R.live(mentions).groupBy("topic", F.to_date("seen_at").alias("day")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("topic").orderBy(F.datediff("day", F.lit("2024-01-01"))).rangeBetween(-7, -1)
    return days.select("topic", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round(F.sum("n").over(by) / 7.0, 6).alias("baseline"))


def html_lines(pages: DataFrame) -> DataFrame:
    text = T.html_text(F.col("html"))
    return pages.select("page_id", F.sha2(text, 256).alias("text_hash"), F.length(text).cast("long").alias("chars"))


def first_image(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.nullif(F.regexp_extract("html", '(?i)<img[^>]+src="([^"]+)"', 1), F.lit("")).alias("image"))


def shingle_counts(docs: DataFrame) -> DataFrame:
    words = T.once(docs.select("doc_id", "text"), "words", T.tokens(F.col("text")))
    return words.select("doc_id", *(F.size(T.shingles(F.col("words"), k)).cast("long").alias(f"n{k}") for k in (1, 2)))


def headline(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join(F.array_sort(T.headline_core(F.element_at(F.split("text", "\n"), 1))), " ").alias("core"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """Whole texts, each with a tail of promotion, tags and stuffing, cleaned."""
    return T.cleaned_lines(texts.with_tail(docs.select("doc_id", "text"))).select("doc_id", F.size("lines").cast("long").alias("lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("clean_hash"))


def language(docs: DataFrame) -> DataFrame:
    accents = F.round(T.script_share(F.col("text"), 0x00C0, 0x00FF), 6)
    return docs.select("doc_id", accents.alias("share"), F.when(accents > 0.15, "marked").when(accents > 0.02, "mixed").otherwise("plain").alias("kind"))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return sinks.last_wins(orders, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in process: what insert-if-absent would add."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return sinks.absent(read("customer").select("c_custkey", "c_name"), read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("generated_at"))
    return sinks.superseded(orders, ["o_custkey"]).groupBy("status").agg(F.count("*").alias("n"))


def stale(events: DataFrame) -> DataFrame:
    """Rows whose version is missing or not the current one (null-safe), by version."""
    k = F.get_json_object("props", "$.k").cast("int")
    version = F.when(k % 5 != 0, k % 5)
    return events.withColumn("version", F.coalesce(version.cast("string"), F.lit("none"))).where(~version.eqNullSafe(F.lit(3))).groupBy("version").agg(F.count("*").alias("n"))


def trace(mentions: DataFrame) -> DataFrame:
    """The chain of each author's records: running number, origin, platform."""
    order = Window.partitionBy("author_id").orderBy("seen_at", "mention_id")
    return mentions.withColumn("step", F.row_number().over(order).cast("long")).select("author_id", "step", "mention_id", "data_origin", "platform")


def alerts(mentions: DataFrame) -> DataFrame:
    ranked = N.findings(mentions)
    sent = ranked.where("topic % 4 = 0").select("data_origin", "topic")
    return N.alerts(ranked, sent)


def streamed(plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> Query:
    """The drained stream; times without a zone again, as the table has them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = stream.drained(plan(stream.event_stream(spark, sf_dir)), mode)
        return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in ("start", "end") else c for c in out.columns))

    return run


def queries() -> dict[str, Query]:
    return rows.QUERIES | interrupts.QUERIES | enrichment.QUERIES | delivery.QUERIES | texts.QUERIES | payloads.QUERIES | ledger.QUERIES | gate.QUERIES | stored.QUERIES | copies.QUERIES | places.QUERIES | adjudication.QUERIES | {
        "win01_ranked_findings": on_events(N.findings),
        "agg01_environment": on_events(R.environment),
        "agg04_daily_histogram": on_events(R.daily_histogram),
        "agg05_district_overview": on_events(R.district_overview),
        "agg06_coverage_balance": on_events(R.coverage_balance),
        "agg07_coverage_counts": on_events(R.coverage_counts),
        "agg08_composition_mix": on_events(R.composition_mix),
        "agg09_narrative_metrics": on_events(N.narrative_metrics),
        "agg09_stance_by_voice": on_events(N.stance_by_voice),
        "agg10_window_end": on_events(N.window_ends),
        "agg11_window_metrics": on_events(N.window_metrics),
        "agg12_query_yield": yield_chain,
        "agg13_quality": on_events(R.quality),
        "agg15_version_histogram": on("events", stale),
        "agg18_manifest": on_events(R.manifest),
        "agg19_voice_classes": on_events(R.voice_classes),
        "agg20_brief_totals": on_events(R.brief_totals),
        "agg21_topic_candidates": on_events(N.topic_candidates),
        "arr01_headline_core": on("documents", headline),
        "dat04_seasonal_urgency": on_events(seasonal),
        "jn09_evidence_star": evidence_star,
        "jn15_dictionary_match": dictionary_match,
        "jn17_anti_new_rows": new_rows,
        "jn21_trace": on_events(trace),
        "jsn02_contract": contract,
        "scr01_relevance": on("documents", relevance),
        "scr20_lens": on_events(lambda m: R.lens(R.coverage_balance(m))),
        "set05_cross_plan": cross_plan,
        "snk10_superseded": order_versions,
        "snk12_last_wins": latest_order,
        "snk16_snapshot_remap": on_events(R.snapshot_copy),
        "srt01_feed_topk": on_documents(R.feed),
        "srt04_evidence_order": on_events(R.evidence_order),
        "srt05_due_queries": due_queries,
        "srt07_alert_order": on_events(alerts),
        "stg05_exact_dups": on_documents(dedup.exact_groups),
        "stg05_near_pairs": on_documents(dedup.near_pairs),
        "stg05_greedy_dedup": on_documents(dedup.dedup_status),
        "str02_dedupe_stream": streamed(lambda e: stream.deduplicated(e).select("event_id", "user_id")),
        "str04_sliding_window_stream": streamed(stream.sliding_counts, "complete"),
        "str08_session_stream": streamed(stream.sessions, "complete"),
        "txt01_normalize": on("documents", lambda d: d.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))),
        "txt03_shingle_counts": on("documents", shingle_counts),
        "txt08_boilerplate": on("documents", boilerplate),
        "txt13_html_to_text": on("pages", html_lines),
        "txt14_extract_image": on("pages", first_image),
        "txt17_language_ratio": on("documents", language),
        "win02_snapshot_delta": on_events(N.snapshot_delta),
        "win04_trend_status": on_events(N.trend_status),
        "win05_rolling_baseline": on_events(rolling_baseline),
        "win06_first_narrative": on_events(R.first_topic),
        "win08_argmax_topic": on_events(R.argmax_topic),
        "win09_top3_districts": on_events(R.top_districts),
    }
