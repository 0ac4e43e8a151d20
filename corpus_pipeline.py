"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm import decontaminate, mixing, near, quality, secrets
from fieldglass.llm.shared import stored

STAGES = [
    ("quality rules", quality.stage),
    ("near-dedup", near.stage),
    ("decontamination", decontaminate.stage),
    ("secret scans", secrets.stage),
    ("mixing", mixing.stage),
]

#: The components of near-duplicates and the dual's solution are beyond one SQL statement; tests compare the pipeline
#: with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
