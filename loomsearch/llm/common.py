"""What the corpus operators share: staging in the cluster's folder, Arrow maps, numbering."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import file_system, ship
from ..storage import shared_dir as shared_dir


def _remove(spark: SparkSession, path: str) -> None:
    try:
        system, at = file_system(spark, path)
        system.delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended before us
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and lets several
    jobs use what was computed once. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomsearch/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be very long, so rows alone do not bound memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _give_back() -> None:
    """Returns what a finished task has freed to the system, for worker processes outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, step: Step, schema: T.StructType | str) -> DataFrame:
    """``df`` through ``step`` in Arrow batches of bounded size."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        _give_back()

    return df.mapInArrow(trimmed, schema)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the operator's own names; extra columns cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def least_count(counted: DataFrame, most: int) -> int:
    """The smallest count (column ``n``) that at most ``most`` rows reach, or a little more than it; more than any has if too many share the largest.

    Only a histogram with eight bins for each doubling comes to the driver, and
    no task sees more than its own rows, as one that sorts all tops would.
    """
    bins = counted.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    least, held = max((r["high"] for r in bins), default=0) + 1, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        held += r["rows"]
        if held > most:
            break
        least = r["low"]
    return least


def prefix_sums(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in its group. For small tables (a row per group and part)."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def numbered(df: DataFrame, group: list[str], part: str, order: str, out: str) -> DataFrame:
    """Numbers rows from 0, gapless, within each group, however large the group.

    ``part`` deals rows out evenly and ``order`` is unique within it (such as
    the partition and place that rows had when they were staged). Rows are
    numbered within their part and moved on by the counts of the parts before
    it, so a group that holds most of the table is spread over all parts.
    """
    counts = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"))
    starts = prefix_sums(counts, group, part, "__n", "__start").drop("__n")
    w = Window.partitionBy(*group, part).orderBy(order)
    ranked = df.withColumn("__row", F.row_number().over(w) - 1).join(starts, [*group, part])
    return ranked.withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).drop("__row", "__start")
