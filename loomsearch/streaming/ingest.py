"""Incremental ingest with Structured Streaming.

The file source remembers which files it has seen, so a query that is started
again goes on with new ones. A table is a set of buckets by the hash of its key.
A micro-batch rewrites only the buckets that it has keys of, each into a folder of
its own, and is committed by one pointer file that names the folders of all
buckets; the pointer comes into being by a rename, so it is there as a whole or
not at all. A batch that runs again, whether it stopped before or after its
commit, starts from the pointer before it and gives the same table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import file_system

#: Buckets of a new table (a table keeps its own number), and pointers that are kept: readers of older ones may still be at work.
BUCKETS, KEPT = 64, 3
_POINTER = "pointer-"


def _pointers(spark: SparkSession, table: str) -> list[int]:
    """The numbers of the committed batches, ascending."""
    fs, p = file_system(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(_POINTER)) for n in names if n.startswith(_POINTER))


def _pointer(spark: SparkSession, table: str, number: int) -> dict:
    text = "\n".join(r["value"] for r in spark.read.text(f"{table}/{_POINTER}{number}").collect())
    return json.loads(text)


def _commit(spark: SparkSession, table: str, number: int, pointer: dict) -> None:
    """Writes a pointer beside its place and renames it; one that a lost run has left for this batch is replaced."""
    fs, at = file_system(spark, f"{table}/{_POINTER}{number}")
    draft = file_system(spark, f"{table}/_draft-{uuid.uuid4().hex}")[1]
    out = fs.create(draft)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"the pointer of batch {number} of {table} could not be put in its place")


def _read(spark: SparkSession, table: str, folders: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{table}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The table after the last committed batch, or ``None`` before the first."""
    done = _pointers(spark, table)
    if not done:
        return None
    pointer = _pointer(spark, table, done[-1])
    return _read(spark, table, sorted(pointer["folders"].values()), T.StructType.fromJson(pointer["schema"]))


def merge_batch(table: str, key: list[str], order: str, buckets: int = BUCKETS, version: str | None = None, place: list[str] | None = None, gone: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows whose key is stored are left out; of several new ones the first by ``order`` stays.

    With ``version``, a column, the row of a key that has the largest stays,
    the new one in a tie. With ``gone``, a boolean column, rows that have it
    true are no rows: they take away what is stored, before this batch, under
    the same ``place``, columns of the key by which rows are dealt to buckets,
    so such a row touches one bucket. ``gone`` itself is not stored.
    """
    place = place or key

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [n for n in _pointers(spark, table) if n < number]
        stored = batch.drop(gone) if gone else batch
        pointer = _pointer(spark, table, done[-1]) if done else {"folders": {}, "buckets": buckets, "schema": json.loads(stored.schema.json())}
        schema = T.StructType.fromJson(pointer["schema"])
        run = f"run-{number:012d}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*place), F.lit(pointer["buckets"])).cast("int")
        # The batch is read once: what it brings lies beside the table until its buckets are written.
        flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
        came = batch.select(*schema.names, flag.alias("__gone"), bucket.alias("bucket"))
        came.repartition(pointer["buckets"], "bucket").write.partitionBy("bucket").parquet(f"{table}/{run}/new")
        touched = _buckets(spark, f"{table}/{run}/new")
        if touched:
            came = spark.read.schema(T.StructType([*schema.fields, T.StructField("__gone", T.BooleanType()), T.StructField("bucket", T.IntegerType())])).parquet(f"{table}/{run}/new")
            olds = [pointer["folders"][str(b)] for b in touched if str(b) in pointer["folders"]]
            old = _read(spark, table, olds, schema).withColumn("bucket", bucket)
            if gone:
                old = old.join(came.where("__gone").select(*place).distinct(), place, "left_anti")
            both = old.withColumn("__new", F.lit(0)).unionByName(came.where("not __gone").drop("__gone").withColumn("__new", F.lit(1)))
            first = [F.desc(version), F.desc("__new"), F.col(order)] if version else [F.col("__new"), F.col(order)]
            one = Window.partitionBy("bucket", *key).orderBy(*first)
            whole = both.repartition(len(touched), "bucket").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", "__new")
            whole.write.partitionBy("bucket").parquet(f"{table}/{run}/whole")
        left = set(_buckets(spark, f"{table}/{run}/whole")) if touched else set()
        folders = {b: f for b, f in pointer["folders"].items() if int(b) not in touched} | {str(b): f"{run}/whole/bucket={b}" for b in touched if b in left}
        _commit(spark, table, number, pointer | {"folders": folders})
        fs, at = file_system(spark, f"{table}/{run}/new")
        fs.delete(at, True)
        _forget(spark, table)

    return apply


def _buckets(spark: SparkSession, path: str) -> list[int]:
    fs, p = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def _forget(spark: SparkSession, table: str) -> None:
    """Removes all but the last ``KEPT`` pointers, and the folders that none of these names."""
    fs, p = file_system(spark, table)
    done = _pointers(spark, table)
    for n in done[:-KEPT]:
        fs.delete(file_system(spark, f"{table}/{_POINTER}{n}")[1], False)
    named = {f for n in done[-KEPT:] for f in _pointer(spark, table, n)["folders"].values()}
    last = f"run-{done[-1]:012d}"
    for run in (s.getPath().getName() for s in fs.listStatus(p)):
        if not run.startswith("run-") or run[:16] > last:
            continue
        if not any(f.startswith(run + "/") for f in named):
            fs.delete(file_system(spark, f"{table}/{run}")[1], True)
            continue
        for b in _buckets(spark, f"{table}/{run}/whole"):
            if f"{run}/whole/bucket={b}" not in named:
                fs.delete(file_system(spark, f"{table}/{run}/whole/bucket={b}")[1], True)


def ingest_available(spark: SparkSession, source: str, schema: T.StructType, table: str, checkpoint: str, key: list[str], order: str, files_per_batch: int = 32) -> DataFrame:
    """Reads all files that are there now, in micro-batches, and gives the table after them."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = rows.writeStream.foreachBatch(merge_batch(table, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = current(spark, table)
    return found if found is not None else spark.createDataFrame([], schema)


def ingest_every(spark: SparkSession, source: str, schema: T.StructType, table: str, checkpoint: str, key: list[str], order: str, every: str = "5 minutes", files_per_batch: int = 32):
    """The same as a query that goes on; returns it."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(merge_batch(table, key, order)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def sessionize(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """``key, started_at, ended_at, events``: runs of a key's events with less than ``gap`` between them; for tables and streams with a watermark."""
    window = F.session_window(time, gap)
    found = events.groupBy(key, window.alias("w")).agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count(F.lit(1)).alias("events"))
    return found.drop("w")
