"""Copies of a whole store under new ids, and its export and import: plans over tables with declared keys and references."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldglass.sources.keyed import KeyedTable
from fieldglass.store import dropped, work_path, written

LIVE, COPY = "live", "verified_snapshot"


@dataclass(frozen=True)
class Ref:
    """A column that names a row of a table. A copied row's reference to a row that isn't copied becomes null, or stays where
    `keeps`. Rows of a table without data_origin belong where their `owner` belongs."""

    column: str
    table: str
    keeps: bool = False
    owner: bool = False


@dataclass(frozen=True)
class Table:
    """A table with a string key; with data_origin if `origin`, else with one reference to its owner."""

    name: str
    refs: tuple[Ref, ...] = ()
    origin: bool = True
    key: str = "id"


def in_order(tables: Sequence[Table]) -> list[Table]:
    """Parents before children. References to the own table don't count; a circle of several tables, or a reference to one
    that isn't declared, is an error."""
    left, out = {t.name: t for t in tables}, []
    if unknown := {r.table for t in tables for r in t.refs} - set(left):
        raise ValueError(f"references to tables that aren't declared: {sorted(unknown)}")
    while left:
        free = [t for t in left.values() if not any(r.table in left and r.table != t.name for r in t.refs)]
        if not free:
            raise ValueError(f"tables that refer to each other in a circle: {sorted(left)}")
        out += free
        for t in free:
            del left[t.name]
    return out


def dangling(store: Mapping[str, DataFrame], tables: Sequence[Table]) -> DataFrame:
    """(table, column, id, missing): references that name no row."""
    keys = {t.name: t.key for t in tables}
    found = [
        store[t.name].select(F.lit(t.name).alias("table"), F.lit(r.column).alias("column"), F.col(t.key).alias("id"), F.col(r.column).alias("missing")).where("missing IS NOT NULL").join(store[r.table].select(F.col(keys[r.table]).alias("missing")), "missing", "left_anti")
        for t in tables
        for r in t.refs
    ]
    return reduce(DataFrame.unionByName, found)


class Copied(dict[str, DataFrame]):
    """A store as snapshot() leaves it, that knows its copy and the rest apart: what asks for one of them joins nothing."""

    def __init__(self, tables: Sequence[Table], copy: str, own: dict[str, DataFrame], rest: dict[str, DataFrame]) -> None:
        super().__init__({t.name: rest[t.name].unionByName(own[t.name]) for t in tables})
        self.tables, self.copy_name, self.own, self.rest = tuple(tables), copy, own, rest
        self.made = dict(self)

    def knows(self, tables: Sequence[Table]) -> bool:
        """Whether its tables are these and still what they were made as."""
        return self.tables == tuple(tables) and all(self.get(k) is v for k, v in self.made.items())


def belonging(store: Mapping[str, DataFrame], tables: Sequence[Table], origin: str) -> dict[str, DataFrame]:
    """The rows of each table that belong to an origin, by data_origin or through their owners."""
    if isinstance(store, Copied) and store.knows(tables):
        return dict(store.own) if origin == store.copy_name else belonging(store.rest, tables, origin)
    out: dict[str, DataFrame] = {}
    keys = {t.name: t.key for t in tables}
    for t in in_order(tables):
        if t.origin:
            out[t.name] = store[t.name].where(F.col("data_origin") == origin)
        else:
            owner = next(r for r in t.refs if r.owner)
            owners = out[owner.table].select(F.col(keys[owner.table]).alias("__owner"))
            out[t.name] = store[t.name].join(owners, F.col(owner.column) == F.col("__owner"), "left_semi")
    return out


def snapshot(store: Mapping[str, DataFrame], tables: Sequence[Table], label: str, source: str = LIVE, copy: str = COPY) -> dict[str, DataFrame]:
    """The store with its `source` rows copied to origin `copy` under ids of their own; the copy that was there is gone.

    An id is made of the label, the table and the old id, so a run that is repeated makes the same copy. References are
    rewritten through the remap tables of what is copied, those to the own table too. A copy that an earlier call has made is
    left out as a whole, not looked up row by row.
    """
    if isinstance(store, Copied) and store.copy_name == copy and source != copy and store.knows(tables):
        rest = store.rest
    else:
        old, rest = belonging(store, tables, copy), {}
        for t in tables:
            other = store[t.name].where(~F.col("data_origin").eqNullSafe(F.lit(copy))) if t.origin else store[t.name].join(old[t.name].select(t.key), t.key, "left_anti")
            rest[t.name] = other.select(store[t.name].columns)
    mine = belonging(store, tables, source)
    new_id = lambda name, column: F.sha2(F.concat_ws(":", F.lit(label), F.lit(name), column), 256)
    keys = {t.name: t.key for t in tables}
    own = {}
    for t in tables:
        rows, values = mine[t.name], {keys[t.name]: new_id(t.name, F.col(t.key))}
        for k, r in enumerate(t.refs):
            if r.owner and not t.origin:  # rows are copied because their owner is
                values[r.column] = new_id(r.table, F.col(r.column))
                continue
            there = mine[r.table].select(F.col(keys[r.table]).alias(f"__is{k}"))
            rows = rows.join(there, F.col(r.column) == F.col(f"__is{k}"), "left")
            new = F.when(F.col(f"__is{k}").isNotNull(), new_id(r.table, F.col(r.column)))
            values[r.column] = F.coalesce(new, F.col(r.column)) if r.keeps else new
        if t.origin:
            values["data_origin"] = F.lit(copy)
        # Old ids go through the joins and long new ones are made behind them.
        own[t.name] = rows.select(*(values[c].alias(c) if c in values else F.col(c) for c in store[t.name].columns))
    return Copied(tables, copy, own, rest)


def manifest(store: Mapping[str, DataFrame], tables: Sequence[Table], label: str, previous: DataFrame | None = None, copy: str = COPY) -> DataFrame:
    """label, status, counts (JSON by table) of the copy in the store; the ones in `previous` count as replaced."""
    own = belonging(store, tables, copy)
    counts = {t.name: own[t.name].count() for t in tables}
    row = store[tables[0].name].sparkSession.createDataFrame([(label, "active", json.dumps(counts, sort_keys=True))], "label string, status string, counts string")
    return row if previous is None else previous.withColumn("status", F.lit("replaced")).unionByName(row)


def export(store: Mapping[str, DataFrame], tables: Sequence[Table], path: str) -> dict[str, int]:
    """Write each table as JSON lines with ISO times, and a table of contents (position, name, rows, schema); returns the rows."""
    spark, counts = store[tables[0].name].sparkSession, {}
    for t in in_order(tables):
        store[t.name].write.option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{path}/tables/{t.name}")
        counts[t.name] = spark.read.text(f"{path}/tables/{t.name}").count()
    rows = [(k, name, n, store[name].schema.json()) for k, (name, n) in enumerate(counts.items())]
    spark.createDataFrame(rows, "position int, name string, rows long, schema string").coalesce(1).write.json(f"{path}/contents")
    return counts


def _among(ids: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """ids that are among the keys (left_semi) or not (left_anti); tables of one column each.

    They are sorted by a hash, which is faster than by the texts; of equal hashes the texts are compared, and not as a key of the
    join, by which Spark would sort too.
    """
    near = F.xxhash64("id") == F.xxhash64("key")
    return ids.toDF("id").join(keys.toDF("key"), near & (F.col("id") <= F.col("key")) & (F.col("id") >= F.col("key")), how)


def imported(spark: SparkSession, path: str, tables: Sequence[Table], target: Mapping[str, KeyedTable]) -> dict[str, int]:
    """Load an export into keyed tables, parents first, with the types it was written with; returns the rows that were new.

    Keys that are there already keep their rows, so a second import, or one after a failure, adds what is missing. A file
    set that has lost rows, two rows of one key, or a reference that names no row is an error, and the table isn't touched.
    """
    contents = {r["name"]: r for r in spark.read.json(f"{path}/contents").collect()}
    keys, added = {t.name: t.key for t in tables}, {}
    for t in in_order(tables):
        if t.name not in contents:
            raise ValueError(f"{path} has no table {t.name}")
        # Parsed once.
        rows = written(spark.read.schema(StructType.fromJson(json.loads(contents[t.name]["schema"]))).json(f"{path}/tables/{t.name}"), "import")
        try:
            if (n := rows.count()) != contents[t.name]["rows"]:
                raise ValueError(f"{path}: {t.name} doesn't have the {contents[t.name]['rows']} rows that were written")
            own, one_key = rows.select(t.key), target[t.name].keys == [t.key]
            # As many keys of the table as there are rows: each row has a key of its own, and all are there.
            known = one_key and bool(target[t.name].versions()) and _among(target[t.name].read().select(t.key), own, "left_semi").count() == n
            if not known and not own.groupBy(t.key).count().where("count > 1").isEmpty():
                raise ValueError(f"{path}: {t.name} has several rows of one {t.key}")
            lost = []
            for k, r in enumerate(t.refs):
                there = own if r.table == t.name else target[r.table].read().select(keys[r.table])
                lost.append(_among(rows.select(r.column).where(F.col(r.column).isNotNull()), there, "left_anti").select(F.lit(k).alias("k")))
            if lost and (bad := reduce(DataFrame.union, lost).agg(F.min("k")).first()[0]) is not None:
                raise ValueError(f"{path}: {t.name}.{t.refs[bad].column} names rows that {t.refs[bad].table} doesn't have")
            # Where all keys are there, the columns are still compared.
            added[t.name] = target[t.name].insert_absent(rows.where("false") if known else rows, unique=one_key)
        finally:
            dropped(rows)
    return added


#: Customers, orders and lines as authors, mentions and links.
TABLES = (
    Table("links", (Ref("mention_id", "mentions", owner=True), Ref("author_id", "authors", keeps=True)), origin=False),
    Table("mentions", (Ref("author_id", "authors"), Ref("duplicate_of", "mentions"))),
    Table("authors"),
)


def order_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two origins; every fifth mention is a duplicate of its author's one before, some authors are of the other origin."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, text = read("orders"), lambda c: F.col(c).cast("string")
    origin = lambda key, n: F.when(key % n > 0, LIVE).otherwise("demo_seed").alias("data_origin")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    mentions = orders.select(text("o_orderkey").alias("id"), text("o_custkey").alias("author_id"), F.when(F.col("o_orderkey") % 5 == 0, before).cast("string").alias("duplicate_of"), origin(F.col("o_orderkey"), 4))
    lines = read("lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.select("l_orderkey", "l_linenumber", "o_custkey").distinct()  # the numbers, where the join has put them
    links = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), text("l_orderkey").alias("mention_id"), text("o_custkey").alias("author_id"))
    authors = read("customer").select(text("c_custkey").alias("id"), F.col("c_name").alias("name"), origin(F.col("c_custkey"), 6))
    return {"authors": authors, "mentions": mentions, "links": links}


def copied_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the second of two copies: it replaces the first."""
    store = order_store(spark, sf_dir)
    for label in ("first", "second"):
        store = snapshot(store, TABLES, label)
    own = belonging(store, TABLES, COPY)
    none = F.lit(None).cast("string")
    parts = [own["authors"].select(F.lit("authors").alias("table"), "id", none.alias("author"), none.alias("other")), own["mentions"].select(F.lit("mentions"), "id", "author_id", "duplicate_of"), own["links"].select(F.lit("links"), "id", "author_id", "mention_id")]
    return reduce(DataFrame.union, parts)


def moved_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after export and import, twice, into empty tables: rows and references of each table."""
    store, path = order_store(spark, sf_dir), work_path(spark, "moved")
    export(store, TABLES, f"{path}/export")
    target = {t.name: KeyedTable(spark, f"{path}/{t.name}", [t.key], 16) for t in TABLES}
    for _ in range(2):
        imported(spark, f"{path}/export", TABLES, target)
    parts = [target[t.name].read().select(F.lit(t.name).alias("table"), "id", F.to_json(F.struct(*[c for c in store[t.name].columns if c != "id"])).alias("row")) for t in TABLES]
    return reduce(DataFrame.union, parts).select("table", "id", F.sha2("row", 256).alias("row_hash"))


QUERIES = {"snk16_store_copy": copied_store, "snk18_export_import": moved_store}

_STORE = f"""authors AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 6 > 0 THEN '{LIVE}' ELSE 'demo_seed' END AS data_origin FROM customer),
mentions AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS author_id, CASE WHEN o_orderkey % 5 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END::VARCHAR AS duplicate_of, CASE WHEN o_orderkey % 4 > 0 THEN '{LIVE}' ELSE 'demo_seed' END AS data_origin FROM orders),
links AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS id, l_orderkey::VARCHAR AS mention_id, o_custkey::VARCHAR AS author_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_NEW = "sha256('second:{0}:' || {1})".format
SQL = {
    "snk16_store_copy": f"""WITH {_STORE}, a AS (SELECT * FROM authors WHERE data_origin = '{LIVE}'), m AS (SELECT * FROM mentions WHERE data_origin = '{LIVE}')
SELECT 'authors' AS "table", {_NEW("authors", "id")} AS id, NULL::VARCHAR AS author, NULL::VARCHAR AS other FROM a
UNION ALL SELECT 'mentions', {_NEW("mentions", "m.id")}, CASE WHEN a.id IS NOT NULL THEN {_NEW("authors", "a.id")} END, CASE WHEN d.id IS NOT NULL THEN {_NEW("mentions", "d.id")} END FROM m LEFT JOIN a ON a.id = m.author_id LEFT JOIN m d ON d.id = m.duplicate_of
UNION ALL SELECT 'links', {_NEW("links", "l.id")}, CASE WHEN a.id IS NOT NULL THEN {_NEW("authors", "a.id")} ELSE l.author_id END, {_NEW("mentions", "m.id")} FROM links l JOIN m ON m.id = l.mention_id LEFT JOIN a ON a.id = l.author_id""",
    "snk18_export_import": f"""WITH {_STORE}
SELECT 'authors' AS "table", id, sha256('{{"name":"' || name || '","data_origin":"' || data_origin || '"}}') AS row_hash FROM authors
UNION ALL SELECT 'mentions', id, sha256('{{"author_id":"' || author_id || '"' || coalesce(',"duplicate_of":"' || duplicate_of || '"', '') || ',"data_origin":"' || data_origin || '"}}') FROM mentions
UNION ALL SELECT 'links', id, sha256('{{"mention_id":"' || mention_id || '","author_id":"' || author_id || '"}}') FROM links""",
}
