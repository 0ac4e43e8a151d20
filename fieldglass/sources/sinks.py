"""Writes that can be repeated: insert-if-absent by key, last write wins, versioned replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not in old, one a key (the least by all columns)."""
    row = F.struct(*new.columns)
    return new.join(old.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min(row).alias("row")).select("row.*")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; ties by all columns."""
    row = F.struct(F.col(order).alias("__order"), *[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max(row).alias("row")).select(*(f"row.{c}" for c in rows.columns))


def superseded(versions: DataFrame, keys: list[str], generated: str = "generated_at") -> DataFrame:
    """versions with status: active for the newest generation of each key, else superseded."""
    newest = versions.groupBy(*keys).agg(F.max(generated).alias("newest"))
    return versions.join(newest, keys).withColumn("status", F.when(F.col(generated) == F.col("newest"), "active").otherwise("superseded")).drop("newest")
