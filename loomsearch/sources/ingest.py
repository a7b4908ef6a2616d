"""Ingest: from parsed messages to the next version of all tables.

Everything of a session is derived from all of its messages, so reading it in
parts gives what reading it at once gives.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import INDEX_STATE, MESSAGES, SESSIONS, Corpus
from ..operators import merge, summaries
from ..operators.redact import Redactor
from ..operators.redact_rules import Rule
from ..storage import names, shared_dir
from . import files

if TYPE_CHECKING:
    from ..operators.index import SearchIndex

STORED = "session_id long, ordinal int, role string, ts long, content string, source_path string, source_offset long, sub int, mid long"


class Tables:
    """``sessions``, ``messages`` (with where they come from), ``state``, and ``summaries`` of sessions, which are made of the messages where there are none yet."""

    def __init__(self, sessions: DataFrame, messages: DataFrame, state: DataFrame, kept: DataFrame | None = None):
        self.sessions, self.messages, self.state = sessions, messages, state
        self.summaries = kept if kept is not None else summaries.summarise(messages)

    @classmethod
    def empty(cls, spark: SparkSession) -> Tables:
        return cls(spark.createDataFrame([], SESSIONS), spark.createDataFrame([], STORED), spark.createDataFrame([], INDEX_STATE))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Tables:
        """Tables that an earlier version has written may have no summaries."""
        tables = ["sessions", "messages", "state"] + (["summaries"] if "summaries" in names(spark, path) else [])
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in tables))

    def corpus(self) -> Corpus:
        """What is searched and listed; lists and counts come from the summaries."""
        return Corpus(self.sessions, self.messages, self.summaries)

    def write(self, path: str) -> Tables:
        """Writes all tables to a new place (sessions and messages by session, which later joins and slices use) and reads them back."""
        self.sessions.write.mode("overwrite").parquet(f"{path}/sessions")
        self.messages.repartition("session_id").sortWithinPartitions("session_id", "ordinal").write.mode("overwrite").parquet(f"{path}/messages")
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        self.summaries.write.mode("overwrite").parquet(f"{path}/summaries")
        return Tables.read(self.sessions.sparkSession, path)


def register(tables: Tables, database: str, location: str | None = None) -> DataFrame:
    """Saves all tables in a database of the catalogue (below ``location``, if it is new) and has their columns' statistics computed, which later joins are planned by.

    Gives ``table, rows, bytes`` as the catalogue now knows them.
    """
    spark = tables.sessions.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`" + (f" LOCATION '{location}'" if location else ""))
    known = []
    for name, rows in (("sessions", tables.sessions), ("messages", tables.messages), ("index_state", tables.state)):
        rows.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
        spark.sql(f"ANALYZE TABLE `{database}`.`{name}` COMPUTE STATISTICS FOR ALL COLUMNS")
        told = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED `{database}`.`{name}`").collect() if r["col_name"] == "Statistics")
        size, count = (int(x.split()[0]) for x in told.split(","))
        known.append((name, count, size))
    return spark.createDataFrame(known, "table string, rows long, bytes long")


def merge_parsed(tables: Tables, parsed: DataFrame, extra: DataFrame | None = None, rules: Iterable[Rule] | None = None, redact: bool = True, work: str | None = None) -> Tables:
    """Adds parsed messages (``files.PARSED``), redacted, and rolls their sessions up again.

    With ``work``, what several steps read is written there once.

    ``extra`` gives titles, summaries and times of sessions by ``session_uid``
    that their messages do not tell.
    """
    if redact:
        redactor = Redactor(rules)
        parsed = parsed.withColumn("content", redactor.column(F.col("content")))
        if extra is not None:
            extra = extra.withColumns({c: redactor.column(F.col(c)) for c in ("title", "summary")})
    parsed = _kept(parsed.withColumn("session_id", merge.session_key()), work, "parsed")
    new = merge.assign_ordinals(parsed, tables.messages).withColumn("mid", merge.message_key())
    added = _kept(merge.free_messages(tables.messages, new.select(*tables.messages.columns)), work, "added")
    messages = tables.messages.unionByName(added)
    touched = parsed.groupBy("session_id", "agent", "session_uid").agg(
        F.max(F.struct(F.col("workspace") != "", "source_path", "workspace")).alias("w"), F.min("started_at").alias("told"), F.max(F.struct("source_path", "source_mtime_ns", "source_size")).alias("src")
    )
    told = messages.join(touched.select("session_id", "agent"), "session_id")
    a = merge.roll_up(told.where("agent != 'codex'"), True, True)
    b = merge.roll_up(told.where("agent = 'codex'"), False, False)
    rolled = touched.join(a.unionByName(b), "session_id")
    empty = F.lit("")
    rolled = rolled.select(
        "session_id", "agent", "session_uid", F.col("w.workspace").alias("workspace"), "title", empty.alias("summary"), F.coalesce("told", "started_at").alias("started_at"), "ended_at",
        F.col("src.source_path").alias("source_path"), F.col("src.source_mtime_ns").alias("source_mtime_ns"), F.col("src.source_size").alias("source_size"),
    )
    if extra is not None:
        e = extra.select("session_uid", *(F.col(c).alias(f"e_{c}") for c in ("title", "summary", "started_at", "ended_at")))
        rolled = rolled.join(e, "session_uid", "left")
        best = lambda c: F.coalesce(F.when(F.col(f"e_{c}") != "", F.col(f"e_{c}")), F.col(c))
        rolled = rolled.select("session_id", "agent", "session_uid", "workspace", best("title").alias("title"), best("summary").alias("summary"), F.coalesce("e_started_at", "started_at").alias("started_at"), F.coalesce("e_ended_at", "ended_at").alias("ended_at"), "source_path", "source_mtime_ns", "source_size")
    return Tables(merge.upsert_sessions(tables.sessions, rolled), messages, tables.state, summaries.with_added(tables.summaries, added))


def _kept(df: DataFrame, work: str | None, name: str) -> DataFrame:
    if work is None:
        return df
    path = f"{work}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _work(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"


def ingest(spark: SparkSession, roots: dict[str, str], tables: Tables | None = None, full: bool = False, rules: Iterable[Rule] | None = None, redact: bool = True, work: str | None = None, report: list[dict] | None = None, index: SearchIndex | None = None) -> Tables:
    """The next version of all tables after reading the sources in ``roots`` (by agent).

    The tables are written to ``work`` after each source, so that a later one
    does not plan and compute the earlier ones again.

    Unchanged files are skipped, shortened ones replace what they gave before,
    and longer ones are read from where the last whole line ended. ``full``
    starts from nothing. Histories come last, for sessions not known otherwise.
    ``report`` gets a row for each source: ``sessions`` touched, messages
    ``offered`` (known ones included), ``errors`` (lines that are no records)
    and ``seconds``. An ``index`` follows: the messages of sessions that any
    source has touched are compared with what they were, and what differs is
    added and removed in one commit.
    """
    begin = tables if tables is not None else Tables.empty(spark)
    touched: list[DataFrame] = []
    now = tables if tables is not None and not full else Tables.empty(spark)
    work = work or _work(spark)

    def note(source: str):
        began = time.monotonic()

        def told(parsed: DataFrame) -> None:
            if report is not None:
                said = F.col("role").isNotNull()
                row = parsed.agg(F.count_distinct(F.when(said, F.col("session_uid"))).alias("sessions"), F.count(F.when(said, 1)).alias("offered"), F.coalesce(F.sum(F.when(~said, F.col("sub"))), F.lit(0)).alias("errors")).first()
                report.append({"source": source, **row.asDict(), "seconds": round(time.monotonic() - began, 3)})

        return told

    for agent in ("claude_code", "codex"):
        if agent in roots:
            now = _read_source(spark, now, agent, roots[agent], rules, redact, work, note(agent), touched).write(f"{work}/{agent}")
    if "cursor" in roots:
        now = _read_composers(spark, now, roots["cursor"], rules, redact, work, note("cursor"), touched).write(f"{work}/cursor")
    if "codex" in roots:
        history = merge.unknown_only(files.history_files(spark, roots["codex"]).where("role is not null"), now.sessions)
        history = _kept(history.select(*files.PARSED.names), work, "history")
        note("history")(history)
        touched.append(history.select(merge.session_key().alias("session_id")))
        now = merge_parsed(now, history, None, rules, redact, work).write(f"{work}/history")
    if index is not None:
        _follow(index, begin, now, touched if index.manifest()["number"] and not full else None)
    return now


def _follow(index: SearchIndex, before: Tables, after: Tables, touched: list[DataFrame] | None) -> None:
    """Brings an index from one version of the messages to the next; ``touched`` has the sessions that may differ, and is nothing for all."""
    old, new = before.messages, after.messages
    if touched is not None:
        if not touched:
            return
        ids = functools.reduce(DataFrame.unionAll, touched).distinct()
        old, new = old.join(ids, "session_id", "left_semi"), new.join(ids, "session_id", "left_semi")
    index.apply(old.select("mid", "content"), new.select("mid", "content"))


def _without(now: Tables, gone: DataFrame) -> Tables:
    """All tables without what the sources of ``gone`` have given."""
    lost = now.sessions.join(gone, "source_path", "left_semi").select("session_id")
    return Tables(*merge.delete_source(now.sessions, now.messages, now.state, gone), summaries.without_sessions(now.summaries, lost))


def _read_source(spark: SparkSession, now: Tables, agent: str, root: str, rules, redact: bool, work: str, note, touched: list[DataFrame]) -> Tables:
    pattern, recursive, name, _ = files.SOURCES[agent]
    listed = files.listing(spark, pattern.format(root), recursive, name)
    decided = merge.decide(listed, now.state).join(now.state.select("source_path", F.col("fingerprint").alias("told")), "source_path", "left")
    # What lines before the offset say of their file is kept with its state; without it, a file is read from its start.
    decided = _kept(decided.withColumn("head", F.when(F.col("action") != "restart", F.coalesce("told", F.lit(""))).otherwise("")).drop("told"), work, "decided")
    gone = decided.where("truncate").select("source_path")
    touched.append(now.sessions.join(gone, "source_path", "left_semi").select("session_id"))
    now = _without(now, gone)
    lines = _kept(files.read_source(spark, agent, root, decided.where("action != 'skip'")), work, "read")
    parsed = _kept(files.assembled(lines, agent, decided, decided), work, "assembled")
    touched.append(parsed.select(merge.session_key().alias("session_id")))
    note(parsed.unionByName(lines.where("role is null and sub > 0").select("source_path", "sub"), allowMissingColumns=True))
    heads = files.heads(lines, decided).select("source_path", F.to_json(F.struct("uid", "workspace", "started")).alias("fingerprint"))
    ends = parsed.groupBy("source_path").agg(F.max("source_offset").alias("end"))
    state = decided.join(heads, "source_path", "left").join(ends, "source_path", "left")
    offset = F.greatest(F.when(F.col("action") == "skip", F.col("offset_before")).otherwise(F.lit(0)), F.coalesce("end", F.lit(0)))
    state = state.join(now.state.select("source_path", F.col("last_offset").alias("offset_before")), "source_path", "left")
    state = state.select("source_path", "mtime_ns", "size", F.coalesce(offset, F.lit(0)).cast("long").alias("last_offset"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    merged = merge_parsed(now, parsed, None, rules, redact, work)
    return Tables(merged.sessions, merged.messages, merge.save_state(now.state, state), merged.summaries)


def _read_composers(spark: SparkSession, now: Tables, root: str, rules, redact: bool, work: str, note, touched: list[DataFrame]) -> Tables:
    prefix = "cursor:composer:"
    counts = now.state.where(F.startswith("source_path", F.lit(prefix))).select(F.substring("source_path", len(prefix) + 1, 1 << 20).alias("session_uid"), F.regexp_extract("fingerprint", r"count=(\d+)", 1).try_cast("int").alias("n"))
    sessions, parsed = files.composers(spark, root, counts)
    sessions, parsed = _kept(sessions, work, "composers"), _kept(parsed, work, "read")
    note(parsed)
    path = F.concat(F.lit(prefix), "session_uid")
    gone = sessions.where("action = 'restart'").select(path.alias("source_path"))
    touched += [now.sessions.join(gone, "source_path", "left_semi").select("session_id"), parsed.select(merge.session_key().alias("session_id"))]
    now = _without(now, gone)
    state = sessions.select(path.alias("source_path"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("last_offset"), F.concat(F.lit("count="), F.col("n").cast("string")).alias("fingerprint"))
    merged = merge_parsed(now, parsed, sessions, rules, redact, work)
    return Tables(merged.sessions, merged.messages, merge.save_state(now.state, state), merged.summaries)


def ingest_stats(before: Tables, after: Tables) -> DataFrame:
    """``sessions`` and ``messages`` that an ingest has added."""
    n = F.count(F.lit(1))
    old = before.sessions.agg(n.alias("s0")).crossJoin(before.messages.agg(n.alias("m0")))
    new = after.sessions.agg(n.alias("s1")).crossJoin(after.messages.agg(n.alias("m1")))
    return old.crossJoin(new).select((F.col("s1") - F.col("s0")).alias("sessions"), (F.col("m1") - F.col("m0")).alias("messages"))
