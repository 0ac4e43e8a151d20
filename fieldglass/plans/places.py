"""The tree of places: levels from nested names, ancestors at any depth, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import text as T
from fieldglass.store import written

SQL_SEPARATOR = " > "


def place_nodes(districts: DataFrame) -> DataFrame:
    """level, id, name, parent of a tree from districts (region, district, mandals: array of names, may be null).

    A name under two parents is two places: ids hold the whole path. Repeated names count once.
    """
    region, district = T.slug(F.col("region")), F.concat_ws("/", T.slug(F.col("region")), T.slug(F.col("district")))
    none = F.lit(None).cast("string")
    tops = districts.select(F.lit("region").alias("level"), region.alias("id"), F.col("region").alias("name"), none.alias("parent"))
    middle = districts.select(F.lit("district"), district, "district", region)
    leaves = districts.select(district.alias("parent"), F.explode("mandals").alias("name")).where("name IS NOT NULL")
    low = leaves.select(F.lit("mandal"), F.concat_ws("/", "parent", T.slug(F.col("name"))), "name", "parent")
    return tops.union(middle).union(low).groupBy("level", "id", "parent").agg(F.min("name").alias("name")).select("level", "id", "name", "parent")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, steps) of nodes (id, parent), however deep: each round doubles the steps that are known, so a tree of
    depth n takes log n of them. A circle is an error; a parent that is no node is an ancestor all the same."""
    known = written(nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct(), "ancestors")
    count = known.count()
    while True:
        if not known.where("id = ancestor").isEmpty():
            raise ValueError(f"places that lie within themselves: {[r['id'] for r in known.where('id = ancestor').select('id').limit(5).collect()]}")
        further = known.join(known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("steps").alias("more")), "ancestor")
        known = written(known.union(further.select("id", "beyond", F.col("steps") + F.col("more"))).groupBy("id", "ancestor").agg(F.min("steps").alias("steps")), "ancestors")
        was, count = count, known.count()
        if count == was:
            return known


def paths(nodes: DataFrame) -> DataFrame:
    """id, level, depth and path (names from the top) of each node."""
    up = ancestors(nodes).join(nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("above")), "ancestor")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), F.col("above").alias("name"))))
    lines = up.groupBy("id").agg(F.transform(listed, lambda x: x["name"]).alias("names"))
    names = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array("name"))
    return nodes.join(lines, "id", "left").select("id", "level", (F.size(names) - 1).cast("long").alias("depth"), F.array_join(names, SQL_SEPARATOR).alias("path"))


def market_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, the nations in them, and under each nation the segments of its customers."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    segments = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias("mandals"))
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(segments, "n_nationkey", "left")
    return paths(place_nodes(nations.select(F.col("r_name").alias("region"), F.col("n_name").alias("district"), "mandals")))


_SLUG = r"regexp_replace(lower({0}), '\s+', '-', 'g')".format
QUERIES = {"snk05_location_paths": market_places}
SQL = {
    "snk05_location_paths": f"""
WITH RECURSIVE n AS (SELECT r_name, n_name, n_nationkey, {_SLUG("r_name")} AS r, {_SLUG("r_name")} || '/' || {_SLUG("n_name")} AS d FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (SELECT DISTINCT 'region' AS level, r AS id, r_name AS name, NULL::VARCHAR AS parent FROM n UNION SELECT 'district', d, n_name, r FROM n
  UNION SELECT DISTINCT 'mandal', d || '/' || {_SLUG("c_mktsegment")}, c_mktsegment, d FROM n JOIN customer ON c_nationkey = n_nationkey),
walk AS (SELECT id, level, 0::BIGINT AS depth, name AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT c.id, c.level, depth + 1, path || '{SQL_SEPARATOR}' || name FROM nodes c JOIN walk w ON c.parent = w.id)
SELECT * FROM walk"""
}
