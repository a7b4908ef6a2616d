"""Rows as text: JSON lines within a budget of bytes, and Markdown."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_text, cut_bytes


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as JSON without its null fields (column ``line``), in order."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("line"))


def within_budget(lines: Iterable[str], most: int, what: str = "hits") -> Iterator[str]:
    """Lines that fit in ``most`` bytes with their line ends; longer ones are skipped and shorter ones after them still come.

    A last line says how many were skipped; it is not charged. 0 is no limit.
    """
    used = skipped = 0
    for line in lines:
        size = len(line.encode()) + 1
        if most > 0 and used + size > most:
            skipped += 1
            continue
        used += size
        yield line
    if skipped:
        yield json.dumps({"truncated": True, f"skipped_{what}": skipped}, separators=(",", ":"))


def budgeted(rows: DataFrame, most: int, what: str = "hits") -> DataFrame:
    """``within_budget`` of result rows, which a query's limit keeps few: which are kept depends on all before."""
    found = [(k, line) for k, line in enumerate(within_budget((r["line"] for r in json_lines(rows).toLocalIterator()), most, what))]
    return rows.sparkSession.createDataFrame(found, "position int, line string")


def cut_text(text: str, most: int) -> str:
    """Text within ``most`` bytes, cut after its last whole line and marked."""
    if most <= 0 or len(text.encode()) <= most:
        return text
    head = cut_bytes(text, most)
    return (head[: head.rfind("\n") + 1] or head) + "…[truncated]"


def highlighted(snippet: Column, begin: str = "<mark>", end: str = "</mark>") -> Column:
    return F.replace(F.replace(snippet, F.lit("«"), F.lit(begin)), F.lit("»"), F.lit(end))


def markdown(rows: Iterable) -> str:
    """Messages (``role, content``) under a heading for each."""
    return "\n\n".join(f"### {r['role']}\n\n{r['content']}" for r in rows)


def hit_lines(hits: Iterable, begin: str = "", end: str = "") -> str:
    """Flat hits as text: a session's title and cite once, then its excerpts, matches between ``begin`` and ``end``."""
    out, rank = [], None
    for r in hits:
        if r["rank"] != rank:
            rank = r["rank"]
            out.append(f"{rank:>3}. {r['title'] or r['uid']} [{r['agent']}]")
        snippet = (r["snippet"] or "").replace("«", begin).replace("»", end).replace("\n", " ")
        out.append(f"     {r['cite']} {r['role']}: {snippet}")
    return "\n".join(out)


def session_lines(rows: Iterable, now: int) -> str:
    """Session rows as text: position, cite, age, messages and title."""
    out = []
    for r in rows:
        last = r["ended_at"] or r["started_at"] or 0
        out.append(f"{r['rank']:>3}. {r['cite']} {age_text(now - last) if last else '-':>4} {r['message_count']:>5}  {r['title'] or ''}".rstrip())
    return "\n".join(out)
