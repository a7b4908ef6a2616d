"""Summaries of sessions, kept by what a merge adds and takes away, so that listing and counting read no messages.

A summary is a session's number of messages, its last message's ordinal and role,
and its first and last known time. Added messages are summed up on their own and
met with what is there; sessions that are taken away take their summary along.
Taking single messages away cannot be undone from a sum, so only the sessions
that have lost any are summed up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARIES = "session_id long, messages long, last_ordinal int, last_role string, first_ts long, last_ts long"


def summarise(messages: DataFrame) -> DataFrame:
    """``SUMMARIES`` of messages (``session_id, ordinal, role, ts``), a row for each session that has any."""
    last = F.max(F.struct("ordinal", "role"))
    found = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), last.alias("last"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select("session_id", "messages", F.col("last.ordinal").alias("last_ordinal"), F.col("last.role").alias("last_role"), "first_ts", "last_ts")


def with_added(summaries: DataFrame, added: DataFrame) -> DataFrame:
    """Summaries after messages have been added that were not there."""
    return _met(summaries.unionByName(summarise(added)))


def without_sessions(summaries: DataFrame, gone: DataFrame) -> DataFrame:
    """Summaries after the sessions of ``gone`` (``session_id``) have been taken away."""
    return summaries.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def without_messages(summaries: DataFrame, gone: DataFrame, left: DataFrame) -> DataFrame:
    """Summaries after some messages have been taken away: the sessions of ``gone`` are summed up again from the messages that are ``left``."""
    touched = gone.select("session_id").distinct()
    again = summarise(left.join(touched, "session_id", "left_semi"))
    return without_sessions(summaries, touched).unionByName(again)


def _met(parts: DataFrame) -> DataFrame:
    last = F.max(F.struct("last_ordinal", "last_role"))
    found = parts.groupBy("session_id").agg(F.sum("messages").alias("messages"), last.alias("last"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return found.select("session_id", "messages", F.col("last.last_ordinal").alias("last_ordinal"), F.col("last.last_role").alias("last_role"), "first_ts", "last_ts")


def ended_mid_task(summaries: DataFrame) -> DataFrame:
    """``session_id`` of the sessions whose last message is by the user or a tool."""
    return summaries.where(F.col("last_role").isin("user", "tool")).select("session_id")
