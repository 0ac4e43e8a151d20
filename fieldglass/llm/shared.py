"""What the operators of this subpackage have in common: the shared folder, tables in it, word splitting."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, StructType

cloudpickle.register_pickle_by_value(sys.modules["fieldglass"])  # executors need not have this package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one.

    A cluster without that setting gets a folder in the warehouse, which is shared too.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/fieldglass-work"
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="fieldglass-"))
    return _fallback[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/fieldglass/{name}-{uuid.uuid4().hex}"


#: Options of a writer whose rows have megabytes: row groups are closed by their bytes, looked at after each row instead of
#: after 100, as a reader holds a row group decoded.
LONG_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """df written to the shared folder and read back: the work isn't done twice, and survives the loss of executors.

    long_rows: rows may have megabytes each, and a task that reads them holds few at a time.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**LONG_ROWS if long_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the files of tables made by stored() that nothing reads any more."""
    for table in tables:
        for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as column `name`, computed once a row: the generator keeps Catalyst from writing the expression out
    wherever the column is used, in the worst case for each element within a lambda."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def row_packed(docs: DataFrame, *apart: str) -> DataFrame:
    """docs as the columns `apart` and `row`, a struct of all others, whose names so clash with none of a stage's own."""
    rest = [F.col(quoted(c)) for c in docs.columns if c not in apart]
    return docs.select(*apart, F.struct(*rest or [F.lit(0).alias("none")]).alias("row"))


def row_unpacked(rows: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The columns of the table that row_packed() was given with `apart`, in its order."""
    return rows.select(*(F.col(c) if c in apart else F.col("row").getField(c).alias(c) for c in columns))


def own_id(docs: DataFrame) -> Column:
    """doc_id, whole numbers as long, other types as string."""
    whole = isinstance(docs.schema["doc_id"].dataType, (IntegralType, NullType))
    return F.col("doc_id").cast("long" if whole else "string").alias("doc_id")


def long_id(docs: DataFrame) -> Column:
    """doc_id as long; TypeError where it isn't a whole number."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    return F.col("doc_id").cast("long").alias("doc_id")


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = 512) -> DataFrame:
    """mapInArrow by pieces of at most `rows` rows, so that what fn makes stays small beside long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
