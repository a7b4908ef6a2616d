"""What a tool server or a program calls: five functions with the limits of their surface, and a description of them."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from .model import Corpus, Query, SessionFilter, capped
from .operators import search as _search
from .operators import sessions as _sessions
from .operators.index import SearchIndex


def search(corpus: Corpus, text: str, agent: str = "", workspace: str = "", role: str = "", since: int = 0, until: int = 0, limit: int | None = None, offset: int = 0, index: SearchIndex | None = None) -> DataFrame:
    """Messages that match, one row for each excerpt of the best sessions."""
    query = Query(text, agent, workspace, role, since, until, capped(limit, "search"), offset)
    return _search.flat_hits(_search.search(corpus, query, index=index), offset)


def get_session(corpus: Corpus, ref: str, around: int | None = None, span: int = _sessions.SPAN, first: int | None = None, last: int | None = None, role: str = "", max_chars: int = 0) -> DataFrame:
    """The messages of a session, or a slice of them."""
    return _sessions.get_session(corpus, ref, around, span, first, last, role, max_chars)


def related(corpus: Corpus, ref: str, limit: int | None = None, index: SearchIndex | None = None) -> DataFrame:
    """Sessions that are about the same as one."""
    return _search.flat_hits(_sessions.related(corpus, ref, capped(limit, "related"), index=index))


def list_sessions(corpus: Corpus, agent: str = "", workspace: str = "", since: int = 0, until: int = 0, ended_mid_task: bool = False, order: str = "desc", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sessions by their last time, with their position."""
    f = SessionFilter(agent, workspace, since, until, capped(limit, "sessions"), offset, order, ended_mid_task)
    return _sessions.session_rows(_sessions.list_sessions(corpus, f), offset, order)


def stats(corpus: Corpus) -> DataFrame:
    """Sessions and messages by agent, and in all."""
    return _sessions.stats(corpus, total=True)


TOOLS: tuple[Callable[..., DataFrame], ...] = (search, get_session, related, list_sessions, stats)


def describe() -> list[dict]:
    """The functions for machines: name, what it gives, and its parameters with their defaults."""
    out = []
    for tool in TOOLS:
        given = [p for p in inspect.signature(tool).parameters.values() if p.name not in ("corpus", "index")]
        parameters = [{"name": p.name, "type": str(p.annotation), "required": p.default is p.empty} | ({} if p.default is p.empty else {"default": p.default}) for p in given]
        out.append({"name": tool.__name__, "description": inspect.getdoc(tool), "parameters": parameters})
    return out
