"""What the vector operators have in common: integer components, a global numbering, matrices of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.shared import stored

_PART = 33  # monotonically_increasing_id has the partition above this bit


def takes_part(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite. A vector without components is."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component x, as array<long>."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256.0).cast("long"))


def upto(n: int) -> Column:
    """The array 0 to n - 1 of long; 0 alone if n is 0 (what is dealt by it then has no rows)."""
    return F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))


def numbered(df: DataFrame, *order: Column | str) -> tuple[DataFrame, int]:
    """df, written, with `place`: 0, 1, 2, … in the order given (rows equal in it in any), and the number of rows.

    Equal rows are told apart by a salt, so no value, however frequent, must fit into one task. The driver gets one count
    for each partition.
    """
    if order:
        df = df.withColumn("salt", F.monotonically_increasing_id())
        df = df.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    table = stored(df.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", _PART)
    starts, total = [], 0
    for p, n in sorted(table.groupBy(part.alias("part")).count().collect()):
        starts.append((p, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, "part long, start long")
    placed = table.join(F.broadcast(first), part == F.col("part")).withColumn("place", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << _PART) - 1)))
    return placed.drop("part", "start", "at"), total


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The lists of an Arrow column as rows of int64, filled up with zeros to the longest (or cut or filled up to width)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    most = int(lengths.max(initial=0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == most).all():
        out = flat.reshape(len(lists), most)
    else:
        out = np.zeros((len(lists), most), np.int64)
        out[np.arange(most) < lengths[:, None]] = flat
    if width is not None and width != most:
        out = np.pad(out[:, :width], ((0, 0), (0, max(0, width - most))))
    return out


def ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(is null, id or 0) of an id column: sorting by both puts nulls last."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)


def bound(a: np.ndarray, b: np.ndarray) -> float:
    """No inner product of a row of a with a row of b exceeds this in absolute value."""
    if not a.size or not b.size:
        return 0.0
    return float((np.abs(a.astype(np.float64)).max(axis=0) * np.abs(b.astype(np.float64)).max(axis=0)).sum())
