"""What driver and executors share: a folder, and this package's code."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a session on one machine gets a temporary folder, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomsearch-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file beside its place and renames it there, so it is there as a whole or not at all; whether it could, for there may be one."""
    fs, at = file_system(spark, path)
    draft = file_system(spark, f"{at.getParent()}/_draft-{uuid.uuid4().hex}")[1]
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(at) and fs.rename(draft, at):
        return True
    fs.delete(draft, False)
    return False


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, in order; none if there is no such folder."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def ship(spark: SparkSession | None = None) -> None:
    """Gives executors this package, for they may not have it on their own path. Whatever builds a Python function for them calls this."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    context = spark.sparkContext
    if not getattr(context, "_loomsearch_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="loomsearch-")) / "loomsearch.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._loomsearch_shipped = True


#: Bytes of text that ``in_parts`` holds as Python strings at a time.
PART = 1 << 20


def in_parts(f: Callable[[str], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """A function of texts as one of Arrow arrays, of which it takes a part at a time; null stays null without a call."""

    def run(texts: pa.Array) -> pa.Array:
        rows = max(1, len(texts) * PART // max(1, texts.nbytes))
        parts = [pa.array([None if (t := x.as_py()) is None else f(t) for x in texts.slice(k, rows)], kind) for k in range(0, len(texts), rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def arrow_function(f: Callable[[pa.Array], pa.Array], kind: str):
    """``F.arrow_udf`` of one column, whose executors have this package."""
    ship()

    def run(column: pa.Array) -> pa.Array:
        return f(column)

    return F.arrow_udf(run, kind)


def pandas_function(f, kind: str):
    """``F.pandas_udf`` whose executors have this package."""
    ship()
    return F.pandas_udf(f, kind)
