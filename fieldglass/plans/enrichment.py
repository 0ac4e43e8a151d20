"""Enrichment of mentions: by rules, or by a function behind a checked contract. QUERIES bind it to the testdata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import rules, scoring
from fieldglass.functions import text as T
from fieldglass.plans.findings import window_metrics
from fieldglass.plans.mentions import MENTIONS_SQL, event_mentions

TERMS = {"topics": ["and", "que", "und"], "districts": ["the", "der", "les"], "places": ["for", "con"], "negative": ["not", "pas", "nicht"], "demand": ["must", "soll"], "reassuring": ["with", "mit", "para"]}
BIOS = ["State Department", "Green Producer Company", "Village Sangham", "Daily Chronicle", "Agro Traders", "Field Vlogs", "Farmer", "Reporter", "Reader", "", "రైతు"]
OFFERS = ["", " open plots near the lake", " a debate on land reform", " one acre, for sale", " Regunta and its selling price", " real estate, selling price on request"]
TOPICS = ["seeds", "irrigation", "procurement", "crop-damage", "pest-outbreak", "roads"]


def enriched(docs: DataFrame, name: Column, bio: Column, official: Column, terms: dict[str, list[str]]) -> DataFrame:
    """Topics, district, author, sentiment, stance and confidence of each row of docs (doc_id, text), by term lists."""
    text = F.coalesce("text", F.lit(""))
    named = lambda kind: F.array_compact(F.array(*[F.when(T.matches_term(text, [t]), t) for t in terms[kind]]))
    some = lambda kind, where=text: T.matches_term(where, terms[kind])
    rest = F.regexp_replace(F.lower(text), "|".join(terms["reassuring"]), " ")  # reassurance isn't a complaint
    author = rules.author_class(name, bio, official)
    found = docs.select("doc_id", named("topics").alias("topics"), named("districts").alias("districts"), named("places").alias("places"), author.alias("author"), some("negative", rest).alias("negative"), some("demand").alias("demand"), some("reassuring").alias("reassuring"))
    district = F.get("districts", F.lit(0))
    return found.select(
        "doc_id",
        F.array_join("topics", ",").alias("topics"),
        district.alias("district"),
        rules.location_confidence(F.col("districts"), F.col("places")).alias("location_confidence"),
        F.col("author.author_type").alias("author_type"),
        rules.sentiment(F.col("negative"), F.col("reassuring")).alias("sentiment"),
        rules.stance(F.col("author.author_type"), F.col("negative"), F.col("demand"), F.col("reassuring")).alias("stance"),
        F.round(rules.enrichment_confidence(F.size("topics"), district, F.col("author.confidence")), 6).alias("confidence"),
    )


def enriched_by(docs: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(doc_id, label, confidence, failure) by a function from a batch to label and confidence, a row for each row.

    What breaks the contract (a label, a confidence in 0..1) is a failure row; so is each row of a batch that raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                made = model(batch)[["label", "confidence"]].reset_index(drop=True)
                if len(made) != len(batch):
                    raise ValueError("a row for each row")
                good = made["label"].notna() & made["confidence"].between(0, 1)
                failure = good.map({True: None, False: "contract"}).astype(object)
            except Exception as e:  # noqa: BLE001 - any fault of the model is a row's result
                made, failure = pd.DataFrame({"label": [None] * len(batch), "confidence": [None] * len(batch)}), type(e).__name__
                good = pd.Series(False, made.index)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "label": made["label"].where(good, None), "confidence": made["confidence"].where(good), "failure": failure})

    return docs.mapInPandas(run, "doc_id long, label string, confidence double, failure string")


def finding_texts(mentions: DataFrame) -> DataFrame:
    """A clause on the growth and one on the stance of each topic."""
    m = window_metrics(mentions)
    growth, shift = F.try_divide(F.col("mentions").cast("double"), F.col("weekly")), F.col("concern") - F.col("base_concern")
    kind = scoring.trajectory(F.col("mentions"), F.col("weekly"), F.col("lifetime"))
    usual = F.concat(F.lit("the usual "), rules.rate_text(F.col("weekly")), F.lit(" a week"))
    grown = F.when(kind == "new", "new this week").when(kind == "resurfacing", "back after four quiet weeks").when(kind == "rising", F.concat(rules.rate_text(growth), F.lit(" times "), usual)).when(kind == "falling", F.concat(F.lit("below "), usual)).otherwise(F.concat(F.lit("close to "), usual))
    was = rules.percent_text(F.col("base_concern"))
    change = F.when(shift >= 0.1, F.concat(F.lit(", more than "), was)).when(shift <= -0.1, F.concat(F.lit(", less than "), was)).when(shift.isNotNull(), F.concat(F.lit(", much like "), was)).otherwise("")
    positive = scoring.signal(F.col("carrying"), F.col("concern"), F.col("supportive"), F.col("base_concern")) == "positive"
    toned = F.when(F.col("carrying") == 0, "no stance").when(positive, F.concat(rules.percent_text(F.col("supportive")), F.lit(" in support"))).otherwise(F.concat(rules.percent_text(F.col("concern")), F.lit(" critical"), change))
    return m.select("data_origin", "topic", grown.alias("growth_text"), toned.alias("stance_text"))


def _picked(values: list[str], by: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.col(by) % len(values))


def _table(name: str, plan: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _authors(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", rules.author_class(F.col("source"), _picked(BIOS, "doc_id"), F.col("doc_id") % 50 == 0).alias("a")).select("doc_id", "a.author_type", "a.confidence")


def _context(orders: DataFrame) -> DataFrame:
    shown = F.transform(rules.near_windows(F.col("o_orderdate")), lambda w: F.concat_ws(":", w["label"], w["in_days"].cast("string")))
    return orders.select("o_orderdate").distinct().select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.array_join(shown, ",").alias("windows"))


def _urgency(orders: DataFrame) -> DataFrame:
    found = orders.select("o_orderkey", rules.calendar_urgency(F.array(_picked(TOPICS, "o_orderkey")), F.col("o_orderdate")).alias("u"))
    return found.select("o_orderkey", "u.multiplier", "u.label", "u.ahead")


def _transcripts(turns: DataFrame) -> DataFrame:
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    text = rules.transcript(F.transform("s", lambda x: x["text"]))
    return said.select("conv_id", F.sha2(text, 256).alias("text_hash"))


def _model(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"label": batch["lang"].str.upper(), "confidence": (batch["doc_id"] % 130) / 100})


QUERIES = {
    "dat03_season_context": _table("orders", _context),
    "dat04_calendar_urgency": _table("orders", _urgency),
    "scr05_enrichment": _table("documents", lambda d: enriched(d, F.col("source"), _picked(BIOS, "doc_id"), F.col("doc_id") % 50 == 0, TERMS)),
    "scr14_finding_texts": lambda spark, sf_dir: finding_texts(event_mentions(spark, sf_dir)),
    "src13_transcripts": _table("conversations", _transcripts),
    "txt19_property_listing": _table("documents", lambda d: d.select("doc_id", rules.is_property_listing(F.concat(F.coalesce("text", F.lit("")), _picked(OFFERS, "doc_id")), F.col("source")).alias("listing"))),
    "txt21_author_class": _table("documents", _authors),
    "udf01_enricher": _table("documents", lambda d: enriched_by(d.select("doc_id", "lang"), _model)),
}


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql(metrics_sql: str) -> dict[str, str]:
    """The statements; metrics_sql defines wm, the windowed metrics, over the mentions."""
    pick = lambda values, by: f"{_sql_list(values)}[{by} % {len(values)} + 1]"
    hay = f"lower(coalesce(source, '') || ' ' || {pick(BIOS, 'doc_id')})"
    case = "CASE WHEN doc_id % 50 = 0 THEN {0} " + " ".join(f"WHEN regexp_matches(hay, '{p}') THEN {{{i}}}" for i, (_, _, p) in enumerate(rules.AUTHOR_RULES, 1)) + " WHEN trim(hay) <> '' THEN {9} ELSE {10} END"
    kinds = [f"'{k}'" for k in ("government", *(k for k, _, _ in rules.AUTHOR_RULES), "citizen", "unknown")]
    sure = [f"{c}::DOUBLE" for c in (0.9, *(c for _, c, _ in rules.AUTHOR_RULES), 0.4)] + ["NULL"]
    authors = f"a AS (SELECT *, {case.format(*kinds)} AS author_type, {case.format(*sure)} AS author_confidence FROM (SELECT *, {hay} AS hay FROM documents))"
    values = ", ".join(f"({i}, '{label}', {s}, {e}, {_sql_list(t)})" for i, (label, s, e, t) in enumerate(rules.WINDOWS))
    opens = "date_diff('day', d, make_date(year(d) + {0}, s // 100, s % 100))"
    near = f"""WITH w(place, label, s, e, topics) AS (VALUES {values}), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
n AS (SELECT d, place, label, topics, CASE WHEN CASE WHEN s <= e THEN month(d) * 100 + day(d) BETWEEN s AND e ELSE month(d) * 100 + day(d) >= s OR month(d) * 100 + day(d) <= e END THEN 0
  WHEN {opens.format(0)} >= 0 THEN {opens.format(0)} ELSE {opens.format(1)} END AS in_days FROM days, w), near AS (SELECT * FROM n WHERE in_days <= {rules.HORIZON_DAYS})"""
    hit = lambda word, where="t": f"regexp_matches({where}, '(?i){T.term_pattern(word)[4:]}')"
    listed = lambda kind: "list_filter([" + ", ".join(f"CASE WHEN {hit([w])} THEN '{w}' END" for w in TERMS[kind]) + "], lambda x: x IS NOT NULL)"
    rest = f"regexp_replace(lower(t), '{'|'.join(TERMS['reassuring'])}', ' ', 'g')"
    said = "lower(coalesce(source, '') || chr(10) || coalesce(text, '') || " + pick(OFFERS, "doc_id") + ")"
    found = lambda terms: "regexp_matches(s, '" + rules.any_term(terms, r"\b", r"\b") + "')"
    tenths = "CAST(floor({0} * 10 + 0.5) AS BIGINT)"
    rate = f"CASE WHEN {{0}} >= 10 THEN CAST(CAST(floor({{0}} + 0.5) AS BIGINT) AS VARCHAR) ELSE ({tenths} // 10) || CASE WHEN {tenths} % 10 <> 0 THEN '.' || ({tenths} % 10) ELSE '' END END"
    percent = "(CAST(floor({0} * 100 + 0.5) AS BIGINT) || '%')"
    usual = f"'the usual ' || {rate.format('weekly')} || ' a week'"
    return {
        "dat03_season_context": near + " SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(string_agg(label || ':' || in_days, ',' ORDER BY in_days, place), '') AS windows FROM days LEFT JOIN near USING (d) GROUP BY d",
        "dat04_calendar_urgency": near
        + f", o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {pick(TOPICS, 'o_orderkey')} AS t FROM orders), b AS (SELECT o_orderkey, arg_min(label, in_days * 100 + place) AS label, min(in_days) AS i FROM o LEFT JOIN near ON o.d = near.d AND list_contains(topics, t) GROUP BY 1)"
        + " SELECT o_orderkey, CASE WHEN i IS NULL THEN 1.0 WHEN i > 0 THEN 1.9 ELSE 1.6 END::DOUBLE AS multiplier, label, coalesce(i > 0, false) AS ahead FROM b",
        "scr05_enrichment": f"WITH {authors}, e AS (SELECT doc_id, author_type AS au, author_confidence AS ac, {listed('topics')} AS ts, {listed('districts')} AS ds, {listed('places')} AS ps, {hit(TERMS['negative'], rest)} AS ng, {hit(TERMS['demand'])} AS dm, {hit(TERMS['reassuring'])} AS re FROM (SELECT *, coalesce(text, '') AS t FROM a))"
        + " SELECT doc_id, array_to_string(ts, ',') AS topics, ds[1] AS district, CASE WHEN len(ds) > 1 THEN 0.6 WHEN len(ds) = 1 THEN CASE WHEN len(ps) > 0 THEN 0.92 ELSE 0.85 END END::DOUBLE AS location_confidence, au AS author_type,"
        + " CASE WHEN ng AND re THEN 'mixed' WHEN ng THEN 'negative' WHEN re THEN 'positive' ELSE 'neutral' END AS sentiment,"
        + " CASE WHEN ng AND re AND au = 'media_organisation' THEN 'mixed' WHEN au = 'government' THEN CASE WHEN re THEN 'supportive' ELSE 'neutral' END WHEN ng OR dm THEN 'critical' WHEN re THEN 'supportive' ELSE 'neutral' END AS stance,"
        + " round(least(0.85::DOUBLE, 0.4::DOUBLE + 0.15::DOUBLE * least(2, len(ts)) + CASE WHEN len(ds) > 0 THEN 0.1 ELSE 0 END::DOUBLE + 0.1::DOUBLE * coalesce(ac, 0)), 6) AS confidence FROM e",
        "scr14_finding_texts": MENTIONS_SQL
        + metrics_sql
        + f" SELECT data_origin, topic, CASE WHEN weekly = 0 THEN CASE WHEN lifetime > mentions THEN 'back after four quiet weeks' ELSE 'new this week' END WHEN mentions / weekly >= 1.5 THEN {rate.format('(mentions / weekly)')} || ' times ' || {usual}"
        + f" WHEN mentions / weekly <= 1 / 1.5::DOUBLE THEN 'below ' || {usual} ELSE 'close to ' || {usual} END AS growth_text,"
        + f" CASE WHEN carrying = 0 THEN 'no stance' WHEN supportive >= 0.5 AND supportive > concern THEN {percent.format('supportive')} || ' in support' ELSE {percent.format('concern')} || ' critical' ||"
        + " ".join(f" CASE WHEN concern - base_concern >= 0.1 THEN ', more than ' || {p} WHEN concern - base_concern <= -0.1 THEN ', less than ' || {p} WHEN base_concern IS NOT NULL THEN ', much like ' || {p} ELSE '' END" for p in [percent.format("base_concern")])
        + " END AS stance_text FROM wm",
        "src13_transcripts": r"WITH j AS (SELECT conv_id, trim(regexp_replace(coalesce(string_agg(coalesce(text, ''), ' ' ORDER BY turn, text NULLS FIRST) FILTER (NOT regexp_matches(trim(coalesce(text, '')), '^\[.*\]$')), ''), '[ \t\r\n]+', ' ', 'g')) AS t FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN len(string_split(t, ' ')) >= 20 THEN sha256(t) END AS text_hash FROM j",
        "txt19_property_listing": f"SELECT doc_id, {found(rules.LISTING_PHRASES)} OR ({found(rules.SALE_OFFERS)} AND {found(rules.LAND_NOUNS + rules.LISTING_HINTS)}) AS listing FROM (SELECT doc_id, {said} AS s FROM documents)",
        "txt21_author_class": f"WITH {authors} SELECT doc_id, author_type, author_confidence AS confidence FROM a",
        "udf01_enricher": "SELECT doc_id, CASE WHEN ok THEN upper(lang) END AS label, CASE WHEN ok THEN c END AS confidence, CASE WHEN NOT ok THEN 'contract' END AS failure FROM (SELECT *, lang IS NOT NULL AND c <= 1 AS ok FROM (SELECT *, (doc_id % 130) / 100::DOUBLE AS c FROM documents))",
    }
