"""A search API as a Spark data source, `spark.read.format("search")`: search ids, look them up in batches, one row an item.

A partition holds some of the queries and runs by itself: a lost one is read again. Filters on published_at and query are
pushed into the reader, which then asks for nothing that they rule out. How answers are fetched is a method: here they are
recorded files in a folder that all workers see; a subclass of Search may ask a service.
"""

from __future__ import annotations

import datetime
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "query string, platform string, external_id string, published_at timestamp, payload string"
#: Ids of one look-up, items of a search unless limit is given, queries of a partition unless batch is given.
IDS, LIMIT, BATCH = 50, 25, 8


def parsed(value: str | None) -> datetime.datetime | None:
    """A time as the service writes it, in UTC; None if there is none or it can't be read."""
    try:
        at = datetime.datetime.fromisoformat(re.sub("Z$", "+00:00", value or ""))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=datetime.UTC)


@dataclass
class Queries(InputPartition):
    queries: tuple[str, ...]


class Search(DataSource):
    """Options: path (the recorded answers), queries (a JSON list), limit, since (a time), event (live or upcoming: searches
    for broadcasts), batch. A query without an answer, or with one that is no JSON, fails its partition."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = (options.get("path") or "").removeprefix("file://")
        self.queries = [q for q in dict.fromkeys(json.loads(options.get("queries", "[]"))) if q]
        self.limit, self.batch = int(options.get("limit", LIMIT)), int(options.get("batch", BATCH))
        self.event = options.get("event", "")
        self.since = parsed(options.get("since"))
        if not self.path:
            raise ValueError("search needs a path")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes in what bounds the time or names queries; Spark still applies times, as unreadable ones are null."""
        for f in filters:
            match f:
                case EqualTo(("query",), value):
                    self.queries = [q for q in self.queries if q == value]
                case In(("query",), values):
                    self.queries = [q for q in self.queries if q in values]
                case GreaterThan(("published_at",), value) | GreaterThanOrEqual(("published_at",), value):
                    at = value if value.tzinfo else value.replace(tzinfo=datetime.UTC)
                    self.since = max(self.since or at, at)
                    yield f
                case _:
                    yield f

    def partitions(self) -> list[Queries]:
        return [Queries(tuple(self.queries[i : i + self.batch])) for i in range(0, len(self.queries), self.batch)]

    def search(self, query: str) -> list[str]:
        """Ids that a search finds, newest first as the service orders them."""
        name = quote(query, safe="") + (f".{self.event}" if self.event else "")
        found = self._answer(f"search/{name}.json")
        ids = [(x.get("id") or {}).get("videoId") for x in found.get("items") or []]
        return [x for x in dict.fromkeys(ids) if x][: self.limit]

    def look_up(self, ids: list[str]) -> dict[str, dict]:
        """The items of up to IDS ids; ids that the service no longer knows are left out."""
        there = [x for x in ids if os.path.exists(f"{self.path}/items/{quote(x, safe='')}.json")]
        return {x: self._answer(f"items/{quote(x, safe='')}.json") for x in there}

    def _answer(self, name: str) -> dict:
        with open(f"{self.path}/{name}", encoding="utf-8") as f:
            return json.load(f)

    def read(self, partition: Queries) -> Iterator[tuple]:
        by_query = {q: self.search(q) for q in partition.queries}
        wanted, items = list(dict.fromkeys(x for ids in by_query.values() for x in ids)), {}
        for i in range(0, len(wanted), IDS):
            items |= self.look_up(wanted[i : i + IDS])
        for query, ids in by_query.items():
            for x in ids:
                if x not in items:
                    continue
                at = parsed((items[x].get("snippet") or {}).get("publishedAt"))
                if self.since and at and at < self.since:
                    continue
                yield query, "youtube", x, at, json.dumps(items[x] | {"searchQuery": query}, ensure_ascii=False)


def connector(path: str, event: str = "", **options: str):
    """A connector of the collection cycle over recorded answers: all due queries of a cycle in one read.

    The cycle's limit bounds the queries, whose names go to the reader as an option.
    """

    def collect(spark: SparkSession, queries: DataFrame) -> DataFrame:
        spark.dataSource.register(Search)
        names = json.dumps(sorted(r["query"] for r in queries.select("query").distinct().collect()))
        return spark.read.format("search").options(path=path, queries=names, event=event, **options).load().select("query", "platform", "external_id", "payload")

    return collect


def read_search(spark: SparkSession, path: str, queries: list[str], since: datetime.datetime | None = None, **options: str) -> DataFrame:
    """Items that the queries find, since a time if one is given (those without a readable time then go), filters pushed down."""
    spark.dataSource.register(Search)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("search").options(path=path, queries=json.dumps(queries), **options).load()
    return found.where(F.col("published_at") >= F.lit(since)) if since else found
