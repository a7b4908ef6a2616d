"""Browsing: listing, counting and summing sessions, slices of one, what surrounds hits, and related sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cut_bytes
from ..model import Corpus, Query, SessionFilter, cite, normalize_agent, normalize_role, parse_ref
from . import summaries
from .index import SearchIndex
from .search import search, small

SPAN, SEED_LEAST, SEED_MOST = 3, 20, 300
CUT_MARK = "…[truncated]"


def last_time() -> Column:
    """When a session was last known to go on: its end, or else its start."""
    return F.coalesce("ended_at", "started_at", F.lit(0).cast("long"))


def ended_mid_task(messages: DataFrame) -> DataFrame:
    """``session_id`` of the sessions whose last message is by the user or a tool. One aggregate instead of a correlated lookup."""
    last = messages.groupBy("session_id").agg(F.max_by("role", "ordinal").alias("last_role"))
    return last.where(F.col("last_role").isin("user", "tool")).select("session_id")


def select_sessions(corpus: Corpus, f: SessionFilter) -> DataFrame:
    """The sessions that a filter lets through, whatever its limit, offset and order."""
    out = corpus.sessions
    for column, value in (("agent", normalize_agent(f.agent)), ("workspace", f.workspace)):
        if value:
            out = out.where(F.col(column) == value)
    if f.since > 0:
        out = out.where(last_time() >= f.since)
    if f.until > 0:
        out = out.where(last_time() <= f.until)
    if f.ended_mid_task:
        ended = ended_mid_task(corpus.messages) if corpus.summaries is None else summaries.ended_mid_task(corpus.summaries)
        out = out.join(ended, "session_id", "left_semi")
    return out


def count_sessions(corpus: Corpus, f: SessionFilter) -> DataFrame:
    return select_sessions(corpus, f).agg(F.count(F.lit(1)).alias("total"))


def list_sessions(corpus: Corpus, f: SessionFilter) -> DataFrame:
    """Sessions by their last time, with how many messages each has; the limit comes before messages are counted."""
    way = F.asc if f.order == "asc" else F.desc
    by = last_time()
    page = select_sessions(corpus, f).withColumn("__at", by).orderBy(way("__at"), way("session_id")).offset(max(0, f.offset)).limit(f.limit if f.limit > 0 else 50)
    if corpus.summaries is None:
        counts = corpus.messages.join(small(page.select("session_id"), f.limit), "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    else:
        counts = corpus.summaries.join(small(page.select("session_id"), f.limit), "session_id", "left_semi").select("session_id", F.col("messages").alias("message_count"))
    out = page.join(counts, "session_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0).cast("long")))
    return out.orderBy(way("__at"), way("session_id")).drop("__at")


def latest_session(corpus: Corpus, agent: str = "") -> DataFrame:
    rows = select_sessions(corpus, SessionFilter(agent=agent))
    return rows.orderBy(F.coalesce("ended_at", "started_at").desc_nulls_last(), F.desc("session_id")).limit(1)


def stats(corpus: Corpus, total: bool = False) -> DataFrame:
    """``agent, sessions, messages, latest`` by agent, and in all (agent ``total``).

    Messages are counted by session before they meet sessions, so no distinct
    count and no row for each pair is needed; summaries have these counts.
    """
    counts = corpus.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")) if corpus.summaries is None else corpus.summaries.select("session_id", F.col("messages").alias("n"))
    rows = corpus.sessions.select("session_id", "agent", "started_at", "ended_at").join(counts, "session_id", "left")
    sums = [F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("messages"), F.max("ended_at").alias("e"), F.max("started_at").alias("s")]
    found = (rows.rollup("agent") if total else rows.groupBy("agent")).agg(*sums, *([F.grouping("agent").alias("g")] if total else [F.lit(0).alias("g")]))
    agent = F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("agent"))
    latest = F.coalesce("e", "s", F.lit(0)).cast("long")
    return found.orderBy("g", "agent").select(agent.alias("agent"), "sessions", "messages", latest.alias("latest"))


def exact_session(sessions: DataFrame, agent: str, uid: str) -> DataFrame:
    return sessions.where((F.col("agent") == agent) & (F.col("session_uid") == uid))


def find_session(sessions: DataFrame, ref: str) -> DataFrame:
    """At most one session: the one with the uid, or else the first uid that begins with it. Nothing for an empty reference."""
    uid = parse_ref(ref).uid
    found = sessions.where(F.startswith("session_uid", F.lit(uid)) & F.lit(uid != ""))
    return found.orderBy((F.col("session_uid") == uid).desc(), "session_uid", "session_id").limit(1)


def cut_content(content: Column, most: int) -> Column:
    """At most ``most`` characters, and a mark if there were more; 0 for all."""
    if most <= 0:
        return content
    return F.when(F.char_length(content) > most, F.concat(F.substring(content, 1, most), F.lit(CUT_MARK))).otherwise(content)


def slice_bounds(ref: str, around: int | None = None, span: int = SPAN, first: int | None = None, last: int | None = None) -> tuple[int, int] | None:
    """The ordinals that are asked for: around one, or from one to another, or around the reference's own; ``None`` for all."""
    if around is None and first is None and last is None:
        around = parse_ref(ref).ordinal
    if around is not None:
        return around - span, around + span
    if first is not None or last is not None:
        return first or 0, last if last is not None else 1 << 30
    return None


def get_session(corpus: Corpus, ref: str, around: int | None = None, span: int = SPAN, first: int | None = None, last: int | None = None, role: str = "", max_chars: int = 0) -> DataFrame:
    """Messages of the session that ``ref`` names, in order: ``cite, agent, uid, ordinal, role, ts, content``."""
    one = find_session(corpus.sessions, ref).select("session_id", "agent", "session_uid")
    rows = corpus.messages.join(F.broadcast(one), "session_id")
    if bounds := slice_bounds(ref, around, span, first, last):
        rows = rows.where(F.col("ordinal").between(*bounds))
    if role := normalize_role(role):
        rows = rows.where(F.col("role") == role)
    return rows.select(
        cite(F.col("agent"), F.col("session_uid"), F.col("ordinal")).alias("cite"), "agent", F.col("session_uid").alias("uid"), "ordinal", "role", "ts", cut_content(F.col("content"), max_chars).alias("content")
    ).orderBy("ordinal")


def expand(anchors: DataFrame, messages: DataFrame, span: int = 2) -> DataFrame:
    """Messages within ``span`` of each anchor (``session_id, anchor``): an equi join on the session with a range on ordinals."""
    near = (messages["ordinal"] >= anchors["anchor"] - span) & (messages["ordinal"] <= anchors["anchor"] + span)
    rows = messages.join(anchors, (messages["session_id"] == anchors["session_id"]) & near)
    return rows.select(messages["session_id"], anchors["anchor"], messages["ordinal"], messages["role"], messages["ts"], messages["content"])


def rag_context(corpus: Corpus, query: Query, span: int = 2, stems: bool = True, index: SearchIndex | None = None) -> DataFrame:
    """What a grounded answer is made of: for the best sessions, the messages around their best excerpt.

    Columns ``rank, cite, agent, session_uid, title, ordinal, role, ts, content``, in reading order.
    """
    found = search(corpus, query, stems=stems, snippets=False, index=index)
    place = Window.orderBy("score", "session_id")
    top = found.withColumn("rank", F.row_number().over(place)).select("rank", "session_id", "agent", "session_uid", "title", F.col("excerpts")[0]["ordinal"].alias("anchor"))
    rows = expand(small(top.select("session_id", "anchor"), query.limit), corpus.messages, span)
    out = rows.join(small(top.drop("anchor"), query.limit), "session_id")
    return out.select("rank", cite(F.col("agent"), F.col("session_uid"), F.col("ordinal")).alias("cite"), "agent", "session_uid", "title", "ordinal", "role", "ts", "content").orderBy("rank", "ordinal")


def rag_prompt(context: DataFrame, question: str) -> str:
    """A prompt from the rows of ``rag_context``, which a query's limit and span keep small. Nothing found is an error."""
    rows = context.collect()
    if not rows:
        raise LookupError("no session matches the question")
    out = ["Answer from the excerpts below only, and name the cite of each fact that you use.", f"Question: {question}"]
    rank = 0
    for r in rows:
        if r["rank"] != rank:
            rank = r["rank"]
            out.append(f"\n## {r['title'] or r['session_uid']}")
        out.append(f"[{r['cite']}] {r['role']}: {r['content']}")
    return "\n".join(out)


def seed_text(corpus: Corpus, ref: str) -> str:
    """What a session is about: its title, or its summary, or its first user message of some length."""
    row = find_session(corpus.sessions, ref).select("session_id", "title", "summary").head()
    if row is None:
        raise LookupError(f"no session is named {ref!r}")
    for text in (row["title"], row["summary"]):
        if (text or "").strip():
            return text.strip()
    trimmed = F.trim("content")
    first = corpus.messages.where((F.col("session_id") == row["session_id"]) & (F.col("role") == "user") & (F.octet_length(trimmed) >= SEED_LEAST))
    found = first.agg(F.min_by(trimmed, "ordinal").alias("t")).head()["t"]
    return cut_bytes(found or "", SEED_MOST)


def related(corpus: Corpus, ref: str, limit: int = 10, **options) -> DataFrame:
    """Sessions that match what ``ref`` is about, itself left out before the limit is applied."""
    uid = find_session(corpus.sessions, ref).select("session_uid").head()
    text = seed_text(corpus, ref)
    return search(corpus, Query(text, limit=limit), exclude_uid=uid["session_uid"], **options)


def session_rows(listed: DataFrame, offset: int = 0, order: str = "desc") -> DataFrame:
    """``list_sessions`` rows as they are shown: with a cite token and their position in the list (of the same ``order``), without empty fields."""
    way = F.asc if order == "asc" else F.desc
    place = Window.orderBy(way(last_time()), way("session_id"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return listed.select(
        cite(F.col("agent"), F.col("session_uid")).alias("cite"), "agent", F.col("session_uid").alias("uid"), blank("title"), blank("summary"), blank("workspace"),
        "started_at", "ended_at", "message_count", (F.row_number().over(place) + max(0, offset)).cast("int").alias("rank"),
    )


#: Seconds after which what an agent last said counts as old.
STALE_S = 1800


def doctor(sessions: DataFrame, messages: DataFrame, now: int) -> DataFrame:
    """``agent, sessions, messages, latest, age, stale``: what is there of each agent, and how fresh it is at ``now`` (unix seconds)."""
    rows = stats(Corpus(sessions, messages))
    age = F.lit(now) - F.col("latest")
    return rows.select("agent", "sessions", "messages", "latest", age.cast("long").alias("age"), (age > STALE_S).alias("stale"))
