"""Readers of feeds, pages and payload families into raw items, and the registry of connectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import text, wording

CONNECTORS: dict[str, Callable[..., DataFrame]] = {}


def connector(name: str):
    """Register a reader under a name."""

    def put(fn):
        CONNECTORS[name] = fn
        return fn

    return put


def text_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


_MEDIA = "enclosure array<struct<_url: string>>, `media:content` array<struct<_url: string>>, `media:thumbnail` array<struct<_url: string>>"
_RSS = f"title string, link string, description string, `content:encoded` string, pubDate string, `dc:date` string, guid string, category array<string>, {_MEDIA}"
_ATOM = f"title string, link array<struct<_href: string>>, id string, summary string, content string, published string, updated string, category array<struct<_term: string>>, {_MEDIA}"


def first_time(*texts: Column) -> Column:
    return F.coalesce(*map(wording.tolerant_time, texts))


def first_image(enclosure: Column, media: list[Column], bodies: list[Column]) -> Column:
    """A feed's picture: its enclosure, its media, or the first <img> of the first body that has one."""
    web = lambda urls: F.get(F.filter(urls["_url"], lambda u: u.rlike("^https?://")), F.lit(0))
    inner = F.get(F.filter(F.array(*bodies), lambda b: F.contains(b, F.lit("<img"))), F.lit(0))
    return F.coalesce(web(enclosure), *map(web, media), F.nullif(F.regexp_extract(inner, "(?i)<img[^>]+src=[\"']([^\"']+)[\"']", 1), F.lit("")))


def _items(rows: DataFrame, limit: int | None) -> DataFrame:
    """Rows with a title and a link; the newest `limit` of each feed, those without a time last."""
    kept = rows.where("title IS NOT NULL AND url IS NOT NULL").withColumn("external_id", F.coalesce(text_or_null(F.col("external_id")), F.col("url")))
    if limit is None:
        return kept
    order = Window.partitionBy("feed").orderBy(F.desc_nulls_last("published_at"), "external_id")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def _shown(markup: Column) -> Column:
    return text_or_null(text.html_text(markup))


@connector("rss")
def read_rss(spark: SparkSession, path: str, limit: int | None = 40) -> DataFrame:
    """Items of RSS 2.0 files: title and link are required, the body is the fullest there is, as text; newest `limit` a file."""
    items = spark.read.format("xml").option("rowTag", "item").schema(_RSS).load(path).withColumn("feed", F.input_file_name())
    body = F.coalesce(text_or_null(F.col("content:encoded")), text_or_null(F.col("description")))
    image = first_image(F.col("enclosure"), [F.col("media:content"), F.col("media:thumbnail")], [F.col("content:encoded"), F.col("description")])
    rows = items.select("feed", F.col("guid").alias("external_id"), _shown(F.col("title")).alias("title"), text_or_null(F.col("link")).alias("url"), _shown(body).alias("body"), first_time(F.col("pubDate"), F.col("dc:date")).alias("published_at"), text_or_null(F.get("category", F.lit(0))).alias("section"), image.alias("image"))
    return _items(rows, limit)


@connector("atom")
def read_atom(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Entries of Atom files as read_rss gives them; the link is the first that is a web address."""
    items = spark.read.format("xml").option("rowTag", "entry").schema(_ATOM).load(path).withColumn("feed", F.input_file_name())
    link = F.get(F.filter("link._href", lambda u: u.rlike("^https?://")), F.lit(0))
    image = first_image(F.col("enclosure"), [F.col("media:content"), F.col("media:thumbnail")], [F.col("content"), F.col("summary")])
    rows = items.select("feed", F.col("id").alias("external_id"), _shown(F.col("title")).alias("title"), link.alias("url"), _shown(F.coalesce(text_or_null(F.col("content")), F.col("summary"))).alias("body"), first_time(F.col("published"), F.col("updated")).alias("published_at"), text_or_null(F.get("category._term", F.lit(0))).alias("section"), image.alias("image"))
    return _items(rows, limit)


POST = (
    "id string, id_str string, conversationId string, text string, fullText string, full_text string, url string, twitterUrl string, lang string, createdAt string, created_at string, username string, "
    "author struct<userName: string, screen_name: string, name: string, description: string, followers: long, followersCount: long, isVerified: boolean, verified: boolean>, "
    "likeCount long, favorite_count long, retweetCount long, retweet_count long, replyCount long, reply_count long, viewCount long"
)


def _first(*names: str) -> Column:
    return F.coalesce(*[text_or_null(F.col(n)) for n in names])


@connector("posts")
def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Short posts as JSON lines, whichever of their field names are used; those without id or text go. A file set without
    any post is an error: an actor that has changed its form must not look like a quiet day."""
    rows = spark.read.schema(POST).json(path)
    handle, post_id = _first("author.userName", "author.screen_name", "username"), _first("id", "id_str", "conversationId")
    out = rows.select(
        post_id.alias("external_id"),
        _first("text", "fullText", "full_text").alias("text"),
        F.coalesce(_first("url", "twitterUrl"), F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), post_id)).alias("url"),
        F.lower(handle).alias("handle"),
        F.coalesce(_first("author.name"), handle).alias("author_name"),
        _first("author.description").alias("bio"),
        F.coalesce("author.followers", "author.followersCount").alias("followers"),
        F.coalesce("author.isVerified", "author.verified", F.lit(False)).alias("verified"),
        first_time(F.col("createdAt"), F.col("created_at")).alias("published_at"),
        _first("lang").alias("lang"),
        F.struct(F.col("viewCount").alias("views"), F.coalesce("likeCount", "favorite_count").alias("likes"), F.coalesce("replyCount", "reply_count").alias("comments"), F.coalesce("retweetCount", "retweet_count").alias("reposts")).alias("engagement"),
    ).where("external_id IS NOT NULL AND text IS NOT NULL")
    if out.isEmpty():
        raise ValueError(f"no posts in {path}")
    return out


PICTURE = "id string, shortCode string, caption string, ownerFullName string, ownerUsername string, url string, timestamp string, displayUrl string, likesCount long, commentsCount long"


@connector("pictures")
def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Picture posts found by hashtag, as JSON lines: the caption is the body, its first line (140 characters) the title."""
    rows = spark.read.schema(PICTURE).json(path)
    out = rows.select(_first("id", "shortCode").alias("external_id"), F.substring(F.element_at(F.split("caption", "\n"), 1), 1, 140).alias("title"), text_or_null(F.col("caption")).alias("body"), F.coalesce(_first("ownerFullName", "ownerUsername"), F.lit("Instagram")).alias("site"), _first("url").alias("url"), first_time(F.col("timestamp")).alias("published_at"), _first("displayUrl").alias("image"), F.struct(F.lit(None).cast("long").alias("views"), F.col("likesCount").alias("likes"), F.col("commentsCount").alias("comments"), F.lit(None).cast("long").alias("reposts")).alias("engagement"))
    out = out.where("external_id IS NOT NULL AND body IS NOT NULL")
    if out.isEmpty():
        raise ValueError(f"no posts in {path}")
    return out


@connector("parquet")
def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
