"""The shared folder for intermediate tables of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; without it, in the warehouse, or in local mode in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="fieldglass-"))
        root = _local[0]
    root = root or spark.conf.get("spark.sql.warehouse.dir") + "/fieldglass-work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Words, as hashes too, are mostly of a few hundred thousand: they are written as numbers of a dictionary of that size.
DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, safe from the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.options(**DICTIONARY).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables made by written() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
