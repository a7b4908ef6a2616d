"""Transcripts as a stream: new lines as they end, in micro-batches, and files that are written anew in place of what they gave.

The stream keeps a table of parsed lines, dealt to buckets by their file: a
micro-batch writes the buckets of the files that it has lines of, and a file that
begins anew takes its earlier lines away in the same commit. Messages are read
from that table. ``number_messages`` numbers messages in the stream itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import merge
from ..sources import files
from ..sources.ranges import ANEW, RANGE, stream_lines
from ..storage import ship
from .ingest import current, merge_batch

KEY = ["source_path", "source_offset", "sub", "said"]


def follow(spark: SparkSession, agent: str, folder: str, table: str, checkpoint: str, buckets: int = 64, suffix: str = ".jsonl", range_bytes: int = RANGE) -> None:
    """Reads all that an agent's files below ``folder`` have now and had not at the last time, and merges it into ``table``."""
    merged = merge_batch(table, KEY, "content", buckets, place=["source_path"], gone="gone")
    parser = files.SOURCES[agent][3]

    def apply(batch: DataFrame, number: int) -> None:
        lines = batch.where(F.col("source_offset") != ANEW).withColumn("begin", F.lit(0).cast("long"))
        parsed = files.parse_lines(lines, parser).where("role is not null or sub = 0").withColumn("said", F.col("role").isNotNull())
        anew = batch.where(F.col("source_offset") == ANEW).select("source_path", F.lit(True).alias("gone"))
        merged(parsed.withColumn("gone", F.lit(False)).unionByName(anew, allowMissingColumns=True), number)

    rows = stream_lines(spark, folder, suffix, range_bytes)
    rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def messages(spark: SparkSession, agent: str, table: str) -> DataFrame:
    """The messages of a table that ``follow`` keeps: ``files.PARSED`` with ``session_id`` and ``ordinal``."""
    lines = current(spark, table)
    if lines is None:
        lines = spark.createDataFrame([], files.LINES)
    none = F.lit(None).cast("long")
    listed = lines.select("source_path", none.alias("mtime_ns"), none.alias("size")).distinct()
    parsed = files.assembled(lines, agent, listed).withColumn("session_id", merge.session_key())
    return merge.assign_ordinals(parsed)


def number_messages(rows: DataFrame, expiry: str | None = None) -> DataFrame:
    """A stream of parsed messages (``session_id, source_path, source_offset, sub, role, ts, content``) with ``ordinal``: their place in their session.

    The state of a session is its next ordinal and, by file, the last place
    that was numbered, so what comes again after that place is left out. Within
    a micro-batch a session's messages are numbered by file and place. A
    session that nothing has come of for ``expiry`` (such as ``"30 days"``) is
    forgotten, and would be numbered from 0 again; without it, none is. A
    session's messages of one micro-batch are sorted by one task, so what a
    trigger reads bounds its memory.
    """
    ship(rows.sparkSession)
    names = ["session_id", "source_path", "source_offset", "sub", "role", "ts", "content"]
    out = "session_id long, source_path string, source_offset long, sub int, role string, ts long, content string, ordinal int"
    milliseconds = None if expiry is None else int(rows.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {expiry})").first()[0])

    def number(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        begin, seen = (state.get[0], dict(zip(*state.get[1:], strict=True))) if state.exists else (0, {})
        found = pd.concat(list(parts)).sort_values(["source_path", "source_offset", "sub"], kind="stable").drop_duplicates(["source_path", "source_offset", "sub"])
        last = found["source_path"].map(lambda p: seen.get(p, -1))
        # A line has few messages, so a place is one number: its offset and, in the lowest digits, which of them it is.
        place = found["source_offset"] * 1024 + found["sub"]
        found, place = found[place > last], place[place > last]
        if len(found):
            seen |= {p: int(x) for p, x in place.groupby(found["source_path"]).max().items()}
            state.update((begin + len(found), list(seen), list(seen.values())))
            yield found.assign(ordinal=range(begin, begin + len(found)))
        if milliseconds is not None:
            state.setTimeoutDuration(milliseconds)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if milliseconds is not None else GroupStateTimeout.NoTimeout
    return rows.select(*names).groupBy("session_id").applyInPandasWithState(number, out, "next int, paths array<string>, places array<long>", "append", timeout)
