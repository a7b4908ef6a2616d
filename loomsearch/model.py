"""Schemas, parameters and references of sessions and messages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}


def flat_schema(text: str) -> T.StructType:
    """A schema from ``name type`` pairs; unlike DDL it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


SESSIONS = flat_schema(
    "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long, source_path string, source_mtime_ns long, source_size long"
)
MESSAGES = flat_schema("mid long, session_id long, ordinal int, role string, ts long, content string, source_offset long")
INDEX_STATE = flat_schema("source_path string, mtime_ns long, size long, last_offset long, fingerprint string")

# The agents' names, their short codes, and what else they and roles are called.
AGENT_CODES = {"claude_code": "cc", "codex": "cdx", "cursor": "cur"}
AGENT_ALIASES = {"all": "", "cc": "claude_code", "claude": "claude_code", "cdx": "codex", "cur": "cursor", "claude_code": "claude_code", "codex": "codex", "cursor": "cursor"}
ROLE_ALIASES = {"all": "", "user": "user", "u": "user", "human": "user", "assistant": "assistant", "a": "assistant", "ai": "assistant", "asst": "assistant", "thinking": "thinking", "t": "thinking", "thnk": "thinking", "think": "thinking", "tool": "tool"}
CITE = re.compile(r"^(cc|cdx|cur)/[0-9a-f]{8}:\d+$")

# Results when no limit is asked for, by surface, and the largest limits that are accepted where there is one.
DEFAULT_LIMITS = {"search": 20, "sessions": 50, "related": 10, "ask": 6, "web_search": 50, "web_sessions": 100, "tui": 100}
LARGEST_LIMITS = {"search": 200, "sessions": 500, "related": 200, "web_search": 500, "web_sessions": 500}


def capped(limit: int | None, surface: str) -> int:
    """The limit that a surface works with: its own where none above 0 is asked for, and never more than its largest."""
    asked = limit if limit is not None and limit > 0 else DEFAULT_LIMITS[surface]
    return min(asked, LARGEST_LIMITS.get(surface, asked))


@dataclass(frozen=True)
class Corpus:
    """``sessions`` (see ``SESSIONS``) and ``messages`` (see ``MESSAGES``); a query needs only the columns it uses. With ``summaries``, lists and counts read no messages."""

    sessions: DataFrame
    messages: DataFrame
    summaries: DataFrame | None = None


@dataclass(frozen=True)
class Query:
    """A search. Times are unix seconds, 0 for none."""

    text: str = ""
    agent: str = ""
    workspace: str = ""
    role: str = ""
    since: int = 0
    until: int = 0
    limit: int = 20
    offset: int = 0


@dataclass(frozen=True)
class SessionFilter:
    agent: str = ""
    workspace: str = ""
    since: int = 0
    until: int = 0
    limit: int = 50
    offset: int = 0
    order: str = "desc"
    ended_mid_task: bool = False


@dataclass(frozen=True)
class SessionRef:
    uid: str
    ordinal: int | None = field(default=None)


def normalize_agent(name: str | None) -> str:
    """The agent a name stands for; "" for all agents, and unknown names as they are."""
    name = (name or "").strip()
    return AGENT_ALIASES.get(name.lower(), name)


def normalize_role(name: str | None) -> str:
    name = (name or "").strip()
    return ROLE_ALIASES.get(name.lower(), name)


def parse_ref(ref: str) -> SessionRef:
    """A session reference: an agent code and slash, and an ordinal after a colon, are both optional."""
    rest = ref.strip().split("/", 1)[-1]
    uid, colon, last = rest.rpartition(":")
    if colon and re.fullmatch(r"[+-]?\d+", last):
        return SessionRef(uid, int(last) if int(last) >= 0 else None)
    return SessionRef(rest)


_AGO = re.compile(r"(\d+)([mhdw])")
_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_since(text: str | None, now: int) -> int:
    """Unix seconds of ``7d``-like ages before ``now``, of a date (midnight UTC) or of an RFC 3339 time; 0 for none."""
    text = (text or "").strip()
    if not text:
        return 0
    if m := _AGO.fullmatch(text):
        if int(m[1]) == 0:
            raise ValueError(f"an age must be more than nothing: {text!r}")
        return now - int(m[1]) * _SECONDS[m[2]]
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"neither an age such as 7d, nor a date, nor a time: {text!r}") from None
    if found.tzinfo is None:
        if len(text) != 10:
            raise ValueError(f"a time needs a zone: {text!r}")
        found = found.replace(tzinfo=UTC)
    return int(found.timestamp())


def agent_code(agent: Column) -> Column:
    """The short code of an agent; others are their own code."""
    out = agent
    for name, code in AGENT_CODES.items():
        out = F.when(agent == name, code).otherwise(out)
    return out


def cite(agent: Column, uid: Column, ordinal: Column | None = None) -> Column:
    """``code/uid8:ordinal``, or ``code/uid8`` for a whole session."""
    head = F.concat(agent_code(agent), F.lit("/"), F.substring(uid, 1, 8))
    return head if ordinal is None else F.concat(head, F.lit(":"), ordinal.cast("string"))


def ref_columns(ref: Column) -> tuple[Column, Column]:
    """``parse_ref`` on a column: the uid, and the ordinal or null."""
    rest = F.regexp_replace(F.trim(ref), r"^[^/]*/", "")
    ordinal = F.regexp_extract(rest, r":([+-]?\d+)$", 1)
    uid = F.when(ordinal != "", F.regexp_replace(rest, r":[+-]?\d+$", "")).otherwise(rest)
    number = ordinal.try_cast("int")
    return uid, F.when(number >= 0, number)
