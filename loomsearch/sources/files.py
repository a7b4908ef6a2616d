"""Transcript sources as tables of parsed messages.

Files of lines are read by byte ranges, stores of key-value pairs each by one
task, and parsed where they are read. Every reader gives the same columns (``PARSED``),
which ``ingest`` turns into sessions and messages.
"""

from __future__ import annotations

import re
import shutil
import sqlite3
import tempfile
import time
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_path
from ..model import flat_schema
from ..storage import file_system, pandas_function, ship
from . import parse, ranges
from .ranges import RANGE, by_ranges, read_lines

PARSED = flat_schema("agent string, session_uid string, workspace string, role string, ts long, content string, source_path string, source_offset long, sub int, started_at long, source_mtime_ns long, source_size long")
# Where the agents keep their transcripts, below a home folder.
ROOTS = {"claude_code": ".claude/projects", "codex": ".codex", "cursor": ".config/Cursor/User"}
RETRIES, RETRY_S = 5, 0.1


def listing(spark: SparkSession, pattern: str, recursive: bool = False, name: str | None = None) -> DataFrame:
    """``source_path, mtime_ns, size`` of the files of a pattern, without reading them.

    Folders are listed, not one path after the other, and by few tasks: a task
    for each file would take far longer than what it says of it.
    """
    found = _binary(spark, pattern, recursive, name) if recursive or name else _in_folders(spark, pattern)
    return found.coalesce(spark.sparkContext.defaultParallelism).select(F.col("path").alias("source_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def _in_folders(spark: SparkSession, pattern: str) -> DataFrame:
    """The files of a pattern, by the folders that its beginning matches."""
    folder, name = pattern.rsplit("/", 1)
    fs, at = file_system(spark, folder)
    above = [s.getPath().toString() for s in fs.globStatus(fs.makeQualified(at)) or [] if s.isDirectory()]
    if not above:
        raise FileNotFoundError(f"no folder is at {folder}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load([_plain(p) for p in above])
    own = spark.createDataFrame([(a,) for a in above], "above string")
    # Folders below these are listed too, but are not what the pattern means.
    return found.join(F.broadcast(own), F.regexp_replace("path", "/[^/]*$", "") == F.col("above"), "left_semi")


def _plain(path: str) -> str:
    """A path as a pattern that only it matches."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _binary(spark: SparkSession, pattern: str, recursive: bool, name: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.load(pattern)


def _named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of these paths, whatever characters their names have."""
    plain = [_plain(p) for p in paths]
    return spark.read.format("binaryFile").load(plain) if plain else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


#: Parsed lines before it is known what their file says of itself: rows with a role are messages, rows without tell of the file and of lines that are no records (``sub`` of them).
LINES = flat_schema("source_path string, source_offset long, session_uid string, role string, ts long, content string, sub int, head_uid string, head_workspace string, head_started long")
HEAD = "uid string, workspace string, started long"


def parse_lines(lines: DataFrame, parser: str) -> DataFrame:
    """Lines (``source_path, source_offset, line, begin``) as ``LINES``; messages of lines before ``begin`` are left out, but not what such lines say of their file."""
    ship(lines.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = getattr(parse, parser)
        bad: dict[str, int] = {}
        heads: dict[str, list] = {}
        for batch in batches:
            rows = []
            for path, at, raw, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = parse.record_of(raw)
                if record is None:
                    if at >= begin and (raw is None or raw.strip()):
                        bad[path] = bad.get(path, 0) + 1
                    continue
                said, found = read(record)
                told = {"source_path": path, "source_offset": at}
                if at >= begin:
                    rows += [told | r for r in found]
                known = heads.setdefault(path, list(parse.NOTHING))
                if any(s and not k for s, k in zip(said, known, strict=True)):  # the first of this task; whether it is the first of the file shows later
                    heads[path] = [k or s for k, s in zip(known, said, strict=True)]
                    rows.append(told | {"sub": 0, "head_uid": said[0] or None, "head_workspace": said[1] or None, "head_started": said[2] or None})
            if rows:
                yield _rows(rows)
        if bad:
            yield _rows([{"source_path": path, "source_offset": 0, "sub": n} for path, n in bad.items()])

    return lines.select("source_path", "source_offset", "line", "begin").mapInArrow(step, LINES)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f: r.get(f) for f in LINES.names} for r in rows], schema=_ARROW)


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_ARROW = pa.schema([pa.field(f.name, _KINDS[f.dataType.simpleString()]) for f in LINES.fields])


def _lines(spark: SparkSession, due: DataFrame, range_bytes: int) -> DataFrame:
    """Lines of files (``source_path, size, offset, head``) by byte ranges, from ``offset`` where it is known what the lines before it say of their file.

    Files in stores that only Spark reads are read whole. Names come to the driver, which lists all files anyway.
    """
    rows = due.select("source_path", "size", "offset", F.coalesce("head", F.lit("")).alias("head")).collect()
    here = [(r["source_path"], r["offset"] if r["head"] else 0, r["size"]) for r in rows if by_ranges(r["source_path"])]
    found = read_lines(spark, here, range_bytes)
    others = [r["source_path"] for r in rows if not by_ranges(r["source_path"])]
    if others:
        whole = _named(spark, others).select(F.col("path").alias("source_path"), "content")
        found = found.unionByName(whole.mapInArrow(_split, "source_path string, source_offset long, line binary"))
    if not any(r["offset"] for r in rows):
        return found.withColumn("begin", F.lit(0).cast("long"))
    return found.join(due.where("offset > 0").select("source_path", F.col("offset").alias("begin")), "source_path", "left").withColumn("begin", F.coalesce("begin", F.lit(0)))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for part in ranges.lines_of(path, data):
                yield part


def read_source(spark: SparkSession, agent: str, root: str, due: DataFrame | None = None, range_bytes: int = RANGE) -> DataFrame:
    """``LINES`` of an agent's files: of all, or of those that are ``due`` (``source_path, size, offset, head``)."""
    pattern, recursive, name, parser = SOURCES[agent]
    if due is None:
        due = listing(spark, pattern.format(root), recursive, name).select("source_path", "size", F.lit(0).cast("long").alias("offset"), F.lit("").alias("head"))
    return parse_lines(_lines(spark, due, range_bytes), parser)


def heads(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``source_path, uid, workspace, started``: the first that any line of a file names; what is ``known`` already (``source_path, head``, as JSON) comes from lines before."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_offset")))
    named = lines.where("role is null").groupBy("source_path").agg(*(first(f"head_{c}").alias(c) for c in ("uid", "workspace", "started")))
    if known is None:
        return named
    before = known.where("head != ''").select("source_path", F.from_json("head", HEAD).alias("k"))
    return named.join(before, "source_path", "full_outer").select("source_path", *(F.coalesce(F.col(f"k.{c}"), F.col(c)).alias(c) for c in ("uid", "workspace", "started")))


def assembled(lines: DataFrame, agent: str, listed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``PARSED`` messages of ``LINES``, with what their files say; ``listed`` has the files' times and sizes. Format B's files without a session give none."""
    stem = F.regexp_extract("source_path", r"([^/]*?)(\.jsonl)?$", 1)
    uid = F.coalesce(F.col("session_uid"), F.col("uid"), *([stem] if agent == "claude_code" else []))
    whole = lines.where("role is not null").join(heads(lines, known), "source_path", "left").join(listed.select("source_path", "mtime_ns", "size"), "source_path", "left")
    return whole.select(
        F.lit(agent).alias("agent"), uid.alias("session_uid"), F.coalesce("workspace", F.lit("")).alias("workspace"), "role", "ts", "content", "source_path", "source_offset", "sub",
        F.col("started").alias("started_at"), F.col("mtime_ns").alias("source_mtime_ns"), F.col("size").alias("source_size"),
    ).where("session_uid is not null")


#: By agent: the pattern below its root, whether folders are searched, the files' names, and what reads a line.
SOURCES = {"claude_code": ("{}/*/*.jsonl", False, None, "session_line"), "codex": ("{}/sessions", True, "rollout-*.jsonl", "rollout_line"), "history": ("{}", False, "history.jsonl", "history_line")}


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """Format A: ``<root>/*/*.jsonl``, a session each."""
    return _all(spark, "claude_code", root)


def rollout_files(spark: SparkSession, root: str) -> DataFrame:
    """Format B: ``rollout-*.jsonl`` anywhere below ``<root>/sessions``."""
    return _all(spark, "codex", root)


def history_files(spark: SparkSession, root: str) -> DataFrame:
    """Format B's shared history, a message of an otherwise unknown session each."""
    return _all(spark, "history", root).withColumn("agent", F.lit("codex"))


def _all(spark: SparkSession, agent: str, root: str) -> DataFrame:
    pattern, recursive, name, _ = SOURCES[agent]
    return assembled(read_source(spark, agent, root), agent, listing(spark, pattern.format(root), recursive, name))


def key_values(files: DataFrame, table: str, like: str = "%") -> DataFrame:
    """``source_path, key, value`` of SQLite files' key-value tables, read without changing them, a file by one task.

    Their paths come to the driver; a task copies its file to its own disk, part
    by part, so no process holds a file. Those in stores that only Spark opens
    are held whole, one at a time.
    """
    spark = files.sparkSession
    ship(spark)
    paths = [r["path"] for r in files.select("path").collect()]
    here, others = [p for p in paths if by_ranges(p)], [p for p in paths if not by_ranges(p)]
    out = "source_path string, key string, value string"

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            with tempfile.TemporaryDirectory() as d:
                copy = Path(d, "store.db")
                store, at = ranges.store_of(path)
                with store.open_input_stream(at) as f, copy.open("wb") as to:
                    shutil.copyfileobj(f, to, ranges.CHUNK)
                yield from _rows_of(copy, path, table, like)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with tempfile.TemporaryDirectory() as d:
                    copy = Path(d, "store.db")
                    copy.write_bytes(data.as_buffer())
                    del data
                    yield from _rows_of(copy, path, table, like)

    # A slice for each file, which no later step of the plan joins to another.
    named = spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in here], max(1, len(here))), "source_path string")
    found = named.mapInArrow(copied, out)
    if others:
        found = found.unionByName(_named(spark, others).select(F.col("path").alias("source_path"), "content").mapInArrow(held, out))
    return found


def _rows_of(copy: Path, path: str, table: str, like: str) -> Iterator[pa.RecordBatch]:
    """The rows of a store, in batches of some megabytes."""
    with closing(_opened(copy)) as db:
        keys, texts, size = [], [], 0
        for key, v in db.execute(f"SELECT key, value FROM {table} WHERE key LIKE ?", (like,)):
            keys.append(key)
            texts.append(v if isinstance(v, str) else (v or b"").decode("utf-8", "replace"))
            size += len(texts[-1])
            if size > ranges.CHUNK or len(keys) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(keys)), pa.array(keys), pa.array(texts)], ["source_path", "key", "value"])
                keys, texts, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(keys)), pa.array(keys), pa.array(texts)], ["source_path", "key", "value"])


def _opened(path: Path) -> sqlite3.Connection:
    """A read-only connection; a busy file is tried again a few times."""
    for attempt in range(RETRIES):
        try:
            db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
            db.execute("SELECT 1 FROM sqlite_master LIMIT 1").fetchall()
            return db
        except sqlite3.OperationalError:
            if attempt == RETRIES - 1:
                raise
            time.sleep(RETRY_S)
    raise AssertionError


def composer_workspaces(spark: SparkSession, root: str) -> DataFrame:
    """Format C: ``composer, workspace``, the first workspace that lists a composer."""
    stores = key_values(_binary(spark, f"{root}/workspaceStorage/*/state.vscdb", False, None), "ItemTable", "composer.composerData").where("key = 'composer.composerData'")
    folder = F.regexp_replace("source_path", "/[^/]*$", "")
    told = spark.read.option("wholetext", "true").text(f"{root}/workspaceStorage/*/workspace.json").select(
        F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("at"), F.coalesce(F.get_json_object("value", "$.folder"), F.get_json_object("value", "$.configuration")).alias("uri")
    )
    ids = F.from_json(F.get_json_object("value", "$.allComposers"), "array<struct<composerId:string>>")
    listed = stores.select(folder.alias("at"), F.explode(F.transform(ids, lambda x: x["composerId"])).alias("composer"))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    both = listed.join(told, plain(listed["at"]) == plain(told["at"]), "left").select("composer", file_path(F.col("uri")).alias("workspace"), plain(listed["at"]).alias("at"))
    return both.groupBy("composer").agg(F.min_by("workspace", "at").alias("workspace"))


_COMPOSER = "struct<fullConversationHeadersOnly:array<struct<bubbleId:string,type:int>>,createdAt:double,lastUpdatedAt:double,name:string,latestConversationSummary:struct<summary:struct<summary:string>>>"


def composers(spark: SparkSession, root: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Format C: (sessions, parsed messages) of all composers that have bubbles.

    Sessions: ``session_uid, title, summary, started_at, ended_at, n, prior,
    action`` with ``n`` bubbles listed; ``counts`` (``session_uid, n``) are those of the
    last time: with as many a composer is skipped, with fewer it restarts, and
    with more only the later bubbles are read. Bubbles are joined, not looked up.
    """
    stores = _binary(spark, f"{root}/globalStorage/state.vscdb", False, None)
    digest = pandas_function(lambda s: s.map(lambda t: parse.summary_digest(t) if t else ""), "string")
    c = F.from_json("value", _COMPOSER)
    heads = key_values(stores, "cursorDiskKV", "composerData:%").where(F.startswith("key", F.lit("composerData:"))).select(F.substring_index("key", ":", -1).alias("session_uid"), c.alias("c"))
    heads = heads.select("session_uid", F.col("c.fullConversationHeadersOnly").alias("heads"), F.coalesce("c.name", F.lit("")).alias("title"), F.col("c.latestConversationSummary.summary.summary").alias("raw"), F.floor(F.col("c.createdAt") / 1000).alias("started_at"), F.floor(F.col("c.lastUpdatedAt") / 1000).alias("ended_at"))
    heads = heads.where(F.size("heads") > 0).withColumn("summary", digest("raw")).withColumn("n", F.size("heads")).drop("raw")
    prior = counts.select("session_uid", F.col("n").alias("prior")) if counts is not None else spark.createDataFrame([], "session_uid string, prior int")
    heads = heads.join(prior, "session_uid", "left").withColumn("prior", F.coalesce("prior", F.lit(0)))
    action = F.when((F.col("prior") > 0) & (F.col("n") == F.col("prior")), "skip").when(F.col("n") < F.col("prior"), "restart").otherwise("resume")
    heads = heads.withColumn("action", action)
    due = heads.where("action != 'skip'")
    begin = F.when(F.col("action") == "resume", F.col("prior")).otherwise(0)
    wanted = due.select("session_uid", begin.alias("begin"), F.posexplode("heads").alias("pos", "h")).where(F.col("pos") >= F.col("begin"))
    bubbles = key_values(stores, "cursorDiskKV", "bubbleId:%").where(F.startswith("key", F.lit("bubbleId:"))).select(F.split_part("key", F.lit(":"), F.lit(2)).alias("session_uid"), F.split_part("key", F.lit(":"), F.lit(3)).alias("bubble"), "value")
    text = pandas_function(lambda s: s.map(_bubble), "string")
    rows = wanted.join(bubbles, (wanted["session_uid"] == bubbles["session_uid"]) & (wanted["h.bubbleId"] == bubbles["bubble"])).select(wanted["session_uid"], "pos", F.col("h.type").alias("type"), text("value").alias("content"))
    rows = rows.where(F.trim("content") != "").join(composer_workspaces(spark, root).withColumnRenamed("composer", "session_uid"), "session_uid", "left")
    none = F.lit(None).cast("long")
    parsed = rows.select(
        F.lit("cursor").alias("agent"), "session_uid", F.coalesce("workspace", F.lit("")).alias("workspace"), F.when(F.col("type") == 1, "user").otherwise("assistant").alias("role"), none.alias("ts"), "content",
        F.concat(F.lit("cursor:composer:"), "session_uid").alias("source_path"), F.col("pos").cast("long").alias("source_offset"), F.lit(0).alias("sub"), none.alias("started_at"), none.alias("source_mtime_ns"), none.alias("source_size"),
    )
    return heads.drop("heads"), parsed


def _bubble(value: str) -> str:
    import json

    try:
        found = json.loads(value)
    except (TypeError, ValueError):
        return ""
    return parse.bubble_text(found) if isinstance(found, dict) else ""
