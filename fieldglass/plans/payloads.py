"""Payload families of the platforms, each projected onto the canonical mention; dispatch by platform.

A payload is JSON text, parsed once a row. What a family doesn't state is null. A platform without a projection makes a
failure row rather than stopping the batch. QUERIES are bound to the testdata's documents; SQL has the DuckDB statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import wording
from fieldglass.plans.rows import broadcast_state_of, evidence_time, joined_text, number_or_null

FIELDS = (
    "payloadKind string, title string, description string, channelTitle string, channelKind string, url string, publishedAt string, "
    "viewCount string, likeCount string, thumbnailUrl string, id string, "
    "snippet struct<title:string,description:string,channelTitle:string,channelDescription:string,publishedAt:string,liveBroadcastContent:string,"
    "thumbnails:struct<high:struct<url:string>,medium:struct<url:string>,`default`:struct<url:string>>>, "
    "statistics struct<viewCount:string,likeCount:string,commentCount:string>, liveStreamingDetails struct<actualStartTime:string,actualEndTime:string>, "
    "author struct<name:string,handle:string,bio:string>, metrics struct<views:string,likes:string,replies:string,reposts:string>, text string, "
    "headline string, body string, outlet string, section string, imageUrl string, organisation string, siteName string"
)
COLUMNS = ("url", "published_at", "author", "handle", "bio", "official", "title", "text", "views", "likes", "comments", "reposts", "image", "transcript", "broadcast")


def _some(name: str) -> Column:
    """A text that isn't empty."""
    return F.nullif(F.col(f"p.{name}"), F.lit(""))


def _row(**values: Column) -> Column:
    kinds = {"official": "boolean", "published_at": "timestamp"} | dict.fromkeys(("views", "likes", "comments", "reposts"), "double")
    return F.struct(*(values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def _when(name: str) -> Column:
    return evidence_time(F.col("published_at"), wording.tolerant_time(F.col(f"p.{name}")))


def feed_video() -> Column:
    kind = _some("channelKind")
    return _row(url=_some("url"), published_at=_when("publishedAt"), author=_some("channelTitle"), bio=F.when(_some("channelTitle").isNotNull(), F.concat(F.lit("channel-kind:"), kind)), official=F.coalesce(kind == "government", F.lit(False)), title=_some("title"), text=joined_text(_some("title"), _some("description")), views=number_or_null(_some("viewCount")), likes=number_or_null(_some("likeCount")), image=_some("thumbnailUrl"), transcript=F.lit("unavailable"))


def api_video() -> Column:
    image = F.coalesce(*(_some(f"snippet.thumbnails.{size}.url") for size in ("high", "medium", "default")))
    url = F.coalesce(_some("url"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("external_id")))
    counts = {k: number_or_null(_some(f"statistics.{v}")) for k, v in (("views", "viewCount"), ("likes", "likeCount"), ("comments", "commentCount"))}
    state = broadcast_state_of(_some("snippet.liveBroadcastContent"), _some("liveStreamingDetails.actualStartTime"), _some("liveStreamingDetails.actualEndTime"))
    return _row(url=url, published_at=_when("snippet.publishedAt"), author=_some("snippet.channelTitle"), bio=F.when(_some("snippet.channelTitle").isNotNull(), _some("snippet.channelDescription")), official=F.lit(False), title=_some("snippet.title"), text=joined_text(_some("snippet.title"), _some("snippet.description")), image=image, transcript=F.lit("unavailable"), broadcast=state, **counts)


def post(official_handles: tuple[str, ...]) -> Column:
    named = _some("author.name").isNotNull()
    official = F.coalesce(F.lower(F.regexp_replace(_some("author.handle"), "^@", "")).isin(*official_handles), F.lit(False))
    counts = {k: number_or_null(_some(f"metrics.{v}")) for k, v in (("views", "views"), ("likes", "likes"), ("comments", "replies"), ("reposts", "reposts"))}
    return _row(url=_some("url"), published_at=F.col("published_at"), author=_some("author.name"), handle=F.when(named, _some("author.handle")), bio=F.when(named, _some("author.bio")), official=official, text=F.coalesce(_some("text"), F.lit("")), **counts)


def news() -> Column:
    return _row(url=_some("url"), published_at=F.col("published_at"), author=_some("outlet"), bio=F.when(_some("outlet").isNotNull(), _some("section")), official=F.lit(False), title=_some("headline"), text=joined_text(_some("headline"), _some("body")), image=_some("imageUrl"), transcript=F.lit("not_applicable"))


def statement() -> Column:
    return _row(url=_some("url"), published_at=F.col("published_at"), author=_some("organisation"), official=_some("organisation").isNotNull(), title=_some("title"), text=joined_text(_some("title"), _some("body")))


def web_page() -> Column:
    return _row(url=_some("url"), published_at=F.col("published_at"), author=_some("siteName"), official=F.lit(False), title=_some("title"), text=joined_text(_some("title"), _some("body")))


def normalized(items: DataFrame, official_handles: tuple[str, ...] = ()) -> DataFrame:
    """items (platform, external_id, published_at, payload, ...) as platform, external_id, the COLUMNS, source_kind and error.

    error tells rows of a platform that nothing projects and of a payload that is null or no JSON object; their other
    columns are null.
    """
    parsed = items.withColumn("p", F.from_json("payload", FIELDS))
    feed = F.coalesce(F.col("p.payloadKind") == "youtube-rss-entry", F.lit(False))
    by_platform = {"youtube": F.when(feed, feed_video()).otherwise(api_video()), "x": post(official_handles), "news": news(), "official": statement(), "web": web_page()}
    row = F.lit(None)
    for name, projection in by_platform.items():
        row = F.when(F.col("platform") == name, projection).otherwise(row)
    broken = F.coalesce(~F.startswith(F.trim("payload"), F.lit("{")) | F.try_parse_json("payload").isNull(), F.lit(True))
    row = F.when(~broken, row)
    out = parsed.withColumn("row", row).withColumn("error", F.when(broken, "payload is no JSON object")).withColumn("error", F.coalesce("error", F.when(F.col("row").isNull(), F.concat(F.lit("no projection for platform "), F.coalesce("platform", F.lit("null"))))))
    return out.select("platform", "external_id", *(F.col(f"row.{c}").alias(c) for c in COLUMNS), source_kind(F.col("row.bio")).alias("source_kind"), "error")


def source_kind(bio: Column) -> Column:
    """The kind of channel that a bio states, null where it states none."""
    return F.nullif(F.regexp_extract(bio, "^channel-kind:(.*)$", 1), F.lit(""))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw items of six platforms, one of which nothing projects."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, title = F.col("doc_id"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("Title "), F.col("doc_id").cast("string")))
    kinds = F.element_at(F.array(*map(F.lit, ("youtube", "youtube", "x", "news", "official", "web", "radio"))), (n % 7 + 1).cast("int"))
    some = F.when(n % 3 > 0, F.col("source"))
    count = F.when(n % 4 == 0, F.lit("many")).when(n % 4 == 1, F.lit("")).otherwise(n.cast("string"))
    at = F.when(n % 2 == 0, F.lit("2024-03-05T06:07:08Z")).otherwise(F.lit("Tue, 5 Mar 2024 06:07:08 GMT"))
    flag = F.when(n % 5 == 0, F.lit("live")).when(n % 5 == 1, F.lit("upcoming")).otherwise(F.lit("none"))
    payloads = [
        F.to_json(F.struct(F.lit("youtube-rss-entry").alias("payloadKind"), F.concat(F.lit("T"), n.cast("string")).alias("title"), F.col("text").alias("description"), some.alias("channelTitle"), F.when(n % 2 == 0, F.lit("government")).otherwise(F.lit("creator")).alias("channelKind"), at.alias("publishedAt"), count.alias("viewCount"))),
        F.to_json(F.struct(F.struct(title.alias("title"), F.col("text").alias("description"), some.alias("channelTitle"), at.alias("publishedAt"), flag.alias("liveBroadcastContent"), F.struct(F.struct(F.lit("m.png").alias("url")).alias("medium"), F.struct(F.lit("d.png").alias("url")).alias("default")).alias("thumbnails")).alias("snippet"), F.struct(count.alias("viewCount"), count.alias("commentCount")).alias("statistics"), F.struct(F.when(n % 5 == 3, F.lit("2024")).alias("actualEndTime")).alias("liveStreamingDetails"))),
        F.to_json(F.struct(F.struct(some.alias("name"), F.concat(F.lit("@"), F.upper("source")).alias("handle")).alias("author"), F.struct(count.alias("replies"), count.alias("views")).alias("metrics"), F.col("text").alias("text"))),
        F.to_json(F.struct(title.alias("headline"), F.col("text").alias("body"), some.alias("outlet"), F.lit("farm").alias("section"), F.lit("").alias("imageUrl"))),
        F.to_json(F.struct(title.alias("title"), F.col("text").alias("body"), some.alias("organisation"))),
        F.to_json(F.struct(title.alias("title"), F.col("text").alias("body"), some.alias("siteName"))),
        F.lit("{}"),
    ]
    payload = F.lit(None)
    for k, made in enumerate(payloads):
        payload = F.when(n % 7 == k, made).otherwise(payload)
    return docs.select(kinds.alias("platform"), n.cast("string").alias("external_id"), F.lit(None).cast("timestamp").alias("published_at"), payload.alias("payload"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("platform", "external_id", "author", "bio", "official", "title", F.sha2("text", 256).alias("text_hash"), "views", "comments", "image", "broadcast", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "source_kind", "error")


QUERIES = {"prj07_dispatch": lambda spark, sf_dir: _told(normalized(document_items(spark, sf_dir), ("wiki", "web01", "src0")))}

SQL = {
    "prj07_dispatch": """
WITH d AS (SELECT doc_id AS n, text, CASE WHEN doc_id % 3 > 0 THEN nullif(source, '') END AS s, CASE WHEN doc_id % 7 > 0 THEN 'Title ' || doc_id END AS t, CASE WHEN doc_id % 4 > 1 THEN doc_id::DOUBLE END AS c, lower(source) IN ('wiki', 'web01', 'src0') AS known FROM documents),
r AS (SELECT *, n % 7 AS k, CASE WHEN n % 7 = 0 THEN 'T' || n ELSE t END AS head FROM d)
SELECT ['youtube', 'youtube', 'x', 'news', 'official', 'web', 'radio'][k + 1] AS platform, n::VARCHAR AS external_id, CASE WHEN k < 6 THEN s END AS author,
  CASE WHEN s IS NULL THEN NULL WHEN k = 0 THEN 'channel-kind:' || CASE WHEN n % 2 = 0 THEN 'government' ELSE 'creator' END WHEN k = 3 THEN 'farm' END AS bio,
  CASE k WHEN 0 THEN n % 2 = 0 WHEN 2 THEN coalesce(known, false) WHEN 4 THEN s IS NOT NULL WHEN 6 THEN NULL ELSE false END AS official,
  CASE WHEN k NOT IN (2, 6) THEN head END AS title,
  CASE k WHEN 6 THEN NULL WHEN 2 THEN sha256(coalesce(text, '')) ELSE sha256(concat_ws(chr(10) || chr(10), head, nullif(text, ''))) END AS text_hash,
  CASE WHEN k < 3 THEN c END AS views, CASE WHEN k IN (1, 2) THEN c END AS comments, CASE WHEN k = 1 THEN 'm.png' END AS image,
  CASE WHEN k = 1 THEN CASE n % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'upcoming' WHEN 3 THEN 'ended' END END AS broadcast,
  CASE WHEN k < 2 THEN '2024-03-05 06:07:08' END AS published,
  CASE WHEN k = 0 AND s IS NOT NULL THEN CASE WHEN n % 2 = 0 THEN 'government' ELSE 'creator' END END AS source_kind,
  CASE WHEN k = 6 THEN 'no projection for platform radio' END AS error FROM r"""
}
