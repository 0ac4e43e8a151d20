"""The relevance gate: topical and regional scores from a term dictionary, acceptance, reasons, and its stage.

The dictionary is a table: family, term, place, variant, exclusion. Families MARKERS and DISTRICTS speak for the region,
all others for the topic. It is a parameter, so any subject and region can be gated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.rules import is_property_listing
from fieldglass.operators.terms import SUBSTRING_SCRIPT, found_terms, matched_terms

MARKERS, DISTRICTS = "markers", "districts"
#: Texts up to this length that have no title are titles themselves.
SHORT_FORM = 500
#: Least scores, in hundredths.
TOPICAL, REGIONAL = 50, 40
KIND = "channel-kind:"


def _parts(mentions: DataFrame) -> DataFrame:
    """A row for each text of a mention that terms are sought in: id, part (text, title or author), text."""
    title = F.coalesce("title", F.when(F.length("text") <= SHORT_FORM, F.col("text")))
    named = [("text", F.col("text")), ("title", title), ("author", F.col("author_context"))]
    parts = F.array(*[F.struct(F.lit(k).alias("part"), v.alias("text")) for k, v in named])
    return mentions.select("id", F.explode(parts).alias("p")).select("id", "p.part", "p.text")


def _several(*pairs: tuple[Column, Column]) -> Column:
    return F.concat_ws(", ", *[F.when(when, said) for when, said in pairs])


def assess(mentions: DataFrame, terms: DataFrame, outside: Sequence[str] = (), script: str = SUBSTRING_SCRIPT) -> DataFrame:
    """mentions (id, title, text, author_context, source_kind) with topical, regional (0 to 1), listing, accepted,
    districts (ids in the dictionary's order) and reason.

    Topic: 0.6 for a family in the title, 0.2 for a second one, 0.15 for each in the text up to 0.3, 0.15 for a source of the
    subject. Region: 0.6 for a marker, 0.5 for a district, 0.4 for an author of the region, 0.4 for a source of the region
    or subject; a place outside (any of `outside`, anywhere in the text) takes 0.15, or 0.4 where nothing of the text speaks
    for the region. Accepted: topic 0.5, region 0.4 and no property listing. A null text is empty. id: unique, not null.
    """
    mentions = mentions.withColumn("text", F.coalesce("text", F.lit("")))
    families = found_terms(_parts(mentions), terms, ["id", "part"], script).groupBy("id").agg(
        *[F.array_sort(F.collect_set(F.when((F.col("part") == p) & ~F.col("family").isin(MARKERS, DISTRICTS), F.col("family")))).alias(f"{p}_families") for p in ("text", "title")],
        F.bool_or((F.col("part") == "text") & (F.col("family") == MARKERS)).alias("marked"),
        F.bool_or((F.col("part") == "author") & F.col("family").isin(MARKERS, DISTRICTS)).alias("anchored"),
    )
    places = matched_terms(mentions.select("id", "text"), terms.where(F.col("family") == DISTRICTS), ["id"], script)
    out = mentions.join(families, "id", "left").join(places.withColumnRenamed("terms", "districts"), "id", "left")
    none = F.array().cast("array<string>")
    in_text, in_title, districts = (F.coalesce(c, none) for c in ("text_families", "title_families", "districts"))
    marked, anchored = (F.coalesce(c, F.lit(False)) for c in ("marked", "anchored"))
    of_subject, of_region = (F.coalesce(F.col("source_kind").isin(*kinds), F.lit(False)) for kinds in (["agriculture_programme"], ["agriculture_programme", "creator"]))
    low = F.lower("text")
    away = F.filter(F.array(*map(F.lit, outside)).cast("array<string>"), lambda place: F.contains(low, place))
    points = lambda when, n: F.when(when, n).otherwise(0)
    topical = points(F.size(in_title) > 0, 60) + points(F.size(in_title) > 1, 20) + F.least(F.lit(30), 15 * F.size(in_text)) + points(of_subject, 15)
    said = marked | (F.size(districts) > 0)
    regional = points(marked, 60) + points(F.size(districts) > 0, 50) + points(anchored, 40) + points(of_region, 40)
    less = F.when(F.size(away) == 0, 0).when(said, 15).otherwise(40)
    out = out.select(*mentions.columns, in_text.alias("text_families"), in_title.alias("title_families"), districts.alias("districts"), away.alias("away"), said.alias("said"), marked.alias("marked"), anchored.alias("anchored"), F.least(F.lit(100), topical).alias("topical"), F.least(F.lit(100), F.greatest(F.lit(0), regional - less)).alias("regional"), is_property_listing(F.col("text"), F.col("title")).alias("listing"))
    families = lambda c: F.array_join(c, ", ")
    enough = F.when(F.col("topical") >= TOPICAL, F.concat(F.lit("topic shown: "), _several((F.size("title_families") > 0, F.concat(F.lit("title ["), families("title_families"), F.lit("]"))), (F.size("text_families") > 0, F.concat(F.lit("text ["), families("text_families"), F.lit("]"))), (of_subject, F.lit("source of the subject")))))
    topic = enough.when(F.size("text_families") > 0, F.concat(F.lit("topic not shown: text alone ["), families("text_families"), F.lit("]"))).otherwise("topic not shown: no terms")
    grounds = _several((F.col("marked"), F.lit("named")), (F.size("districts") > 0, F.concat(F.lit("districts ["), families("districts"), F.lit("]"))), (F.col("anchored"), F.lit("author of the region")), (of_region & ~F.col("said"), F.lit("source of the region, to be confirmed")))
    region = F.when(grounds == "", "region not shown").otherwise(F.concat(F.lit("region shown: "), grounds))
    reason = F.concat_ws("; ", F.when(F.col("listing"), "a property listing"), topic, region, F.when(F.size("away") > 0, F.concat(F.lit("places outside ["), families("away"), F.lit("]"))))
    accepted = ~F.col("listing") & (F.col("topical") >= TOPICAL) & (F.col("regional") >= REGIONAL)
    return out.select(*mentions.columns, (F.col("topical") / 100.0).alias("topical"), (F.col("regional") / 100.0).alias("regional"), "listing", accepted.alias("accepted"), "districts", reason.alias("reason"))


def relevance_stage(mentions: DataFrame, authors: DataFrame, terms: DataFrame, outside: Sequence[str] = (), script: str = SUBSTRING_SCRIPT) -> DataFrame:
    """The rows of mentions after the stage: pending normalized ones are scored and accepted or rejected, others stay.

    mentions: id, title, content_text, original_text, author_id, status, relevance_status; authors: author_id, name, bio. The
    cleaned text is read where there is one, else title and text. A bio that begins with channel-kind: names the kind of source.
    Columns topical, regional and reason are null for rows that weren't pending. Run again, it changes nothing.
    """
    pending = (F.col("status") == "normalized") & (F.col("relevance_status") == "pending")
    known = authors.select("author_id", "name", "bio")
    due = mentions.where(pending).join(known, "author_id", "left")
    kind = F.when(F.startswith("bio", F.lit(KIND)), F.substr("bio", F.lit(len(KIND) + 1)))
    whole = F.coalesce("content_text", F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("original_text", F.lit(""))))
    context = F.when(F.col("name").isNotNull() | F.col("bio").isNotNull(), F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("bio", F.lit(""))))
    read = due.select("id", "title", whole.alias("text"), context.alias("author_context"), kind.alias("source_kind"))
    judged = assess(read, terms, outside, script).select("id", "topical", "regional", "accepted", "reason")
    out = mentions.join(judged, "id", "left")
    done = F.col("accepted").isNotNull()
    status = F.when(done & ~F.col("accepted"), "rejected").otherwise(F.col("status"))
    relevance = F.when(done, F.when(F.col("accepted"), "accepted").otherwise("rejected")).otherwise(F.col("relevance_status"))
    return out.withColumns({"status": status, "relevance_status": relevance}).drop("accepted")


def stage_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """The events that the stage appends: mention_id, kind, detail (JSON), for each row that it decided."""
    decided = before.where("status = 'normalized' AND relevance_status = 'pending'").select("id").join(after, "id").where("relevance_status <> 'pending'")
    kind = F.concat(F.lit("RELEVANCE_"), F.upper("relevance_status"))
    return decided.select(F.col("id").alias("mention_id"), kind.alias("kind"), F.to_json(F.struct("reason", "topical", "regional")).alias("detail"))


#: Accents stand for the script whose spellings occur within words.
ACCENTS = "À-ÖØ-öø-ÿ"


def corpus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary from the passages of `benchmark`: one term each, its first two words, its third, and accented parts of
    words; in every third the sixth word is an exclusion. Families by number."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = F.split("text", " ")
    number = F.col("item_id") % 8
    family = F.when(number == 6, MARKERS).when(number == 7, DISTRICTS).otherwise(F.concat(F.lit("f"), number))
    variant = lambda v, out: F.struct(v.alias("variant"), out.alias("exclusion"))
    accented = F.regexp_extract("text", f"[{ACCENTS}][{ACCENTS}a-z]{{2}}", 0)
    found = F.array(variant(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))), F.lit(False)), variant(F.get(words, F.lit(2)), F.lit(False)), variant(accented, F.lit(False)), variant(F.when(F.col("item_id") % 3 == 0, F.get(words, F.lit(5))), F.lit(True)))
    return items.select(family.alias("family"), F.concat(F.lit("t"), "item_id").alias("term"), F.col("item_id").alias("place"), F.explode(found).alias("v")).select("family", "term", "place", "v.variant", "v.exclusion")


def corpus_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mentions: the first line of those with several is the title, sources are authors of three kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.when(F.contains("text", F.lit("\n")), F.element_at(F.split("text", "\n"), 1))
    pending = F.col("doc_id") % 5 > 0
    return docs.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("content_text"), F.lit(None).cast("string").alias("original_text"), F.col("source").alias("author_id"), F.lit("normalized").alias("status"), F.when(pending, "pending").otherwise("accepted").alias("relevance_status"))


def corpus_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL").groupBy("source").agg(F.min("doc_id").alias("first"))
    kind = F.element_at(F.array(F.lit("channel-kind:agriculture_programme"), F.lit("channel-kind:creator"), F.lit("writes of thu erst eaea")), (F.col("first") % 3 + 1).cast("int"))
    return sources.select(F.col("source").alias("author_id"), F.concat(F.lit("desk "), "source").alias("name"), kind.alias("bio"))


OUTSIDE = ("estion", "zzyzx", "thouth", "eauque")


def terms_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = matched_terms(docs.select("doc_id", "text"), corpus_terms(spark, sf_dir), ["doc_id"], ACCENTS)
    return found.select("doc_id", F.array_join("terms", ",").alias("terms"))


def stage_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = relevance_stage(corpus_mentions(spark, sf_dir), corpus_authors(spark, sf_dir), corpus_terms(spark, sf_dir), OUTSIDE, ACCENTS)
    return after.select("id", "status", "relevance_status", "topical", "regional", "reason")


_VARIANTS = r"""variants AS (SELECT CASE item_id % 8 WHEN 6 THEN 'markers' WHEN 7 THEN 'districts' ELSE 'f' || item_id % 8 END AS family, 't' || item_id AS term, item_id AS place,
  unnest([{'v': w[1] || ' ' || w[2], 'x': false}, {'v': w[3], 'x': false}, {'v': regexp_extract(text, '[À-ÖØ-öø-ÿ][À-ÖØ-öø-ÿa-z]{2}'), 'x': false}, {'v': CASE WHEN item_id % 3 = 0 THEN w[6] END, 'x': true}], recursive := true)
  FROM (SELECT *, string_split(text, ' ') AS w FROM benchmark)),
v AS (SELECT DISTINCT family, term, v, x, regexp_matches(v, '[À-ÖØ-öø-ÿ]') AS anywhere, '(^|[^a-z])' || regexp_replace(lower(v), '([^a-z0-9 ])', '\\\1', 'g') || '([^a-z]|$)' AS pattern FROM variants WHERE v <> '')"""


def _found(texts: str, ids: str) -> str:
    """SQL of the terms found in a table of texts, by trying each spelling on each text."""
    return rf"""(SELECT {ids}, family, term FROM (SELECT {ids}, low, text, family, term, x, v, anywhere, pattern FROM {texts} JOIN v ON contains(CASE WHEN anywhere THEN text ELSE low END, CASE WHEN anywhere THEN v ELSE lower(v) END))
  WHERE anywhere OR regexp_matches(low, pattern) GROUP BY ALL HAVING NOT bool_or(x))""".replace("GROUP BY ALL", f"GROUP BY {ids}, family, term")


_OUTSIDE = ", ".join(f"'{x}'" for x in OUTSIDE)
SQL = {
    "txt16_term_table": rf"""
WITH {_VARIANTS}, d AS (SELECT doc_id, text, lower(text) AS low FROM documents)
SELECT doc_id, string_agg(term, ',' ORDER BY place) AS terms FROM {_found("d", "doc_id")} JOIN (SELECT DISTINCT term, place FROM variants) USING (term) GROUP BY doc_id""",
    "stg02_relevance_stage": rf"""
WITH {_VARIANTS},
authors AS (SELECT source, 'desk ' || source AS name, ['channel-kind:agriculture_programme', 'channel-kind:creator', 'writes of thu erst eaea'][min(doc_id) % 3 + 1] AS bio FROM documents WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT doc_id AS id, coalesce(text, '') AS text, CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10))[1] END AS title, name || ' ' || bio AS author, CASE WHEN bio LIKE 'channel-kind:%' THEN bio[14:] END AS kind FROM documents LEFT JOIN authors USING (source) WHERE doc_id % 5 > 0),
parts AS (SELECT id, part, text, lower(text) AS low FROM (SELECT id, 'text' AS part, text FROM m UNION ALL SELECT id, 'title', coalesce(title, CASE WHEN length(text) <= 500 THEN text END) FROM m UNION ALL SELECT id, 'author', author FROM m)),
found AS {_found("parts", "id, part")},
by_id AS (SELECT id, list_sort(list(DISTINCT family) FILTER (part = 'text' AND family NOT IN ('markers', 'districts'))) AS ft, list_sort(list(DISTINCT family) FILTER (part = 'title' AND family NOT IN ('markers', 'districts'))) AS fh,
  bool_or(part = 'text' AND family = 'markers') AS marked, bool_or(part = 'author' AND family IN ('markers', 'districts')) AS anchored,
  list(term ORDER BY term[2:]::INT) FILTER (part = 'text' AND family = 'districts') AS districts FROM found GROUP BY id),
s AS (SELECT id, coalesce(ft, []) AS ft, coalesce(fh, []) AS fh, coalesce(marked, false) AS marked, coalesce(anchored, false) AS anchored, coalesce(districts, []) AS districts, coalesce(kind = 'agriculture_programme', false) AS sub,
  coalesce(kind IN ('agriculture_programme', 'creator'), false) AS reg, [p FOR p IN [{_OUTSIDE}] IF contains(lower(text), p)] AS away FROM m LEFT JOIN by_id USING (id)),
p AS (SELECT *, marked OR len(districts) > 0 AS said, least(100, 60 * (len(fh) > 0)::INT + 20 * (len(fh) > 1)::INT + least(30, 15 * len(ft)) + 15 * sub::INT) AS topical,
  60 * marked::INT + 50 * (len(districts) > 0)::INT + 40 * anchored::INT + 40 * reg::INT AS raw FROM s),
q AS (SELECT *, least(100, greatest(0, raw - CASE WHEN len(away) = 0 THEN 0 WHEN said THEN 15 ELSE 40 END)) AS regional,
  concat_ws(', ', CASE WHEN marked THEN 'named' END, CASE WHEN len(districts) > 0 THEN 'districts [' || array_to_string(districts, ', ') || ']' END, CASE WHEN anchored THEN 'author of the region' END, CASE WHEN reg AND NOT said THEN 'source of the region, to be confirmed' END) AS grounds FROM p),
r AS (SELECT id, topical, regional, topical >= 50 AND regional >= 40 AS ok, concat_ws('; ',
  CASE WHEN topical >= 50 THEN 'topic shown: ' || concat_ws(', ', CASE WHEN len(fh) > 0 THEN 'title [' || array_to_string(fh, ', ') || ']' END, CASE WHEN len(ft) > 0 THEN 'text [' || array_to_string(ft, ', ') || ']' END, CASE WHEN sub THEN 'source of the subject' END)
    WHEN len(ft) > 0 THEN 'topic not shown: text alone [' || array_to_string(ft, ', ') || ']' ELSE 'topic not shown: no terms' END,
  CASE WHEN grounds = '' THEN 'region not shown' ELSE 'region shown: ' || grounds END, CASE WHEN len(away) > 0 THEN 'places outside [' || array_to_string(away, ', ') || ']' END) AS reason FROM q)
SELECT doc_id AS id, CASE WHEN ok = false THEN 'rejected' ELSE 'normalized' END AS status, CASE ok WHEN true THEN 'accepted' WHEN false THEN 'rejected' ELSE 'accepted' END AS relevance_status,
  topical / 100.0::DOUBLE AS topical, regional / 100.0::DOUBLE AS regional, reason FROM documents LEFT JOIN r ON id = doc_id""",
}

QUERIES = {"txt16_term_table": terms_of_documents, "stg02_relevance_stage": stage_of_documents}
