"""Ordinals, roll-up and merging of ingested sessions and messages.

Tables are values here: each step gives the next version of a table, to be
written beside the old one. Keys are (agent, session_uid) and (session,
ordinal); identifiers are hashes of them, so no sequence has to be shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import truncate_runes

TITLE = 200


def session_key(agent: str = "agent", uid: str = "session_uid") -> Column:
    return F.xxhash64(agent, uid)


def message_key(session: str = "session_id", ordinal: str = "ordinal") -> Column:
    return F.xxhash64(session, F.col(ordinal).cast("int"))


def assign_ordinals(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``ordinal`` of parsed rows (``session_id, source_path, source_offset, sub``): their place in their session, after what is stored.

    Rows whose (source_path, source_offset, sub) is stored already are left
    out, so reading a file again adds nothing.
    """
    place = Window.partitionBy("session_id").orderBy("source_path", "source_offset", "sub")
    if known is None:
        return rows.withColumn("ordinal", (F.row_number().over(place) - 1).cast("int"))
    new = rows.join(known.select("session_id", "source_path", "source_offset", "sub"), ["session_id", "source_path", "source_offset", "sub"], "left_anti")
    base = next_ordinals(known)
    return new.join(base, "session_id", "left").withColumn("ordinal", (F.row_number().over(place) - 1 + F.coalesce("next_ordinal", F.lit(0))).cast("int")).drop("next_ordinal")


def next_ordinals(messages: DataFrame) -> DataFrame:
    """``session_id, next_ordinal``: one after the largest that is stored. Sessions without messages begin at 0 and are not listed."""
    return messages.groupBy("session_id").agg((F.max("ordinal") + 1).alias("next_ordinal"))


def roll_up(messages: DataFrame, first_line_only: bool = True, by_position: bool = True) -> DataFrame:
    """``session_id, title, started_at, ended_at`` from messages: the first user text, and the times of the first and last message.

    ``by_position`` takes the last message's time even if an earlier one is
    later; otherwise the end is the latest time.
    """
    user = F.when(F.col("role") == "user", F.col("content"))
    title = F.min_by(user, F.when(user.isNotNull(), F.col("ordinal")))
    if first_line_only:
        title = truncate_runes(F.split_part(title, F.lit("\n"), F.lit(1)), TITLE)
    else:
        title = F.substring(title, 1, TITLE)
    end = F.max_by("ts", "ordinal") if by_position else F.max("ts")
    return messages.groupBy("session_id").agg(F.coalesce(title, F.lit("")).alias("title"), F.min_by("ts", "ordinal").alias("started_at"), end.alias("ended_at"))


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new sessions by (agent, session_uid).

    New texts win unless they are empty, the first known start stays, the
    latest end wins (null for none at all), and sources are the new ones.
    ``new`` may have several rows for a session; the last by ``source_path`` wins.
    """
    key = ["agent", "session_uid"]
    one = Window.partitionBy(*key).orderBy(F.desc("source_path"), F.desc("ended_at"))
    new = new.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")

    def text(c: str) -> Column:
        return F.coalesce(F.when(F.col(f"n.{c}") != "", F.col(f"n.{c}")), F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)

    out = {k: F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key} | {c: text(c) for c in ("workspace", "title", "summary")}
    out["started_at"] = F.coalesce("o.started_at", "n.started_at").alias("started_at")
    out["ended_at"] = F.nullif(F.greatest("o.ended_at", "n.ended_at"), F.lit(0)).alias("ended_at")
    for c in ("source_path", "source_mtime_ns", "source_size"):
        out[c] = F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return joined.select(*(out[c] if c in out else F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in old.columns))


def free_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Those of the new messages whose (session_id, ordinal) is free; of several the first by source."""
    key = ["session_id", "ordinal"]
    order = [c for c in ("source_path", "source_offset", "sub", "mid", "content") if c in new.columns]
    one = Window.partitionBy(*key).orderBy(*order)
    return new.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n").join(old.select(*key), key, "left_anti")


def insert_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old messages and the free ones of the new."""
    return old.unionByName(free_messages(old, new), allowMissingColumns=True)


def delete_source(sessions: DataFrame, messages: DataFrame, state: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All tables without the sessions of ``paths`` (column ``source_path``), their messages and the paths' state."""
    left = sessions.join(paths, "source_path", "left_anti")
    gone = sessions.join(paths, "source_path", "left_semi").select("session_id")
    return left, messages.join(gone, "session_id", "left_anti"), state.join(paths, "source_path", "left_anti")


def save_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State by ``source_path``; new rows replace old ones."""
    return old.join(new, "source_path", "left_anti").unionByName(new)


def unknown_only(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """History rows of uids that no agent's session has, the first row of each."""
    new = history.join(sessions.select("session_uid").distinct(), "session_uid", "left_anti")
    one = Window.partitionBy("session_uid").orderBy("source_offset")
    return new.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")


def decide(listing: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """What to do with each listed file (``source_path, mtime_ns, size``): ``skip``, ``resume`` at ``offset`` or ``restart``."""
    s = state.select("source_path", F.col("mtime_ns").alias("old_mtime"), F.col("size").alias("old_size"), "last_offset")
    both = listing.join(s, "source_path", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime"))
    action = F.when(F.lit(full) | F.col("old_size").isNull() | (F.col("size") < F.col("old_size")), "restart").when(same, "skip").otherwise("resume")
    offset = F.when(action == "resume", F.coalesce("last_offset", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return both.select("source_path", "mtime_ns", "size", action.alias("action"), offset.alias("offset"), (F.col("old_size").isNotNull() & (action == "restart")).alias("truncate"))
