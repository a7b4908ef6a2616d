"""Ranked full-text search over messages: words and substrings, rolled up to sessions with their best excerpts.

A message must have all items of the query. Its score is BM25 over the whole
corpus (filters never change the statistics; lower is better); substring
matches count ``SUBSTRING_WEIGHT`` of their score. A message found both ways
keeps its better score, a session has its best message's score.
"""

from __future__ import annotations

import functools
import operator
import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.porter import stem
from ..functions.snippet import substring_snippet, word_snippet
from ..model import Corpus, Query, agent_code, normalize_agent, normalize_role
from ..plans.grammar import Item, substring_items, word_items
from ..storage import pandas_function

if TYPE_CHECKING:
    from .index import SearchIndex

SUBSTRING_WEIGHT, EXCERPTS, LARGEST_BROADCAST = 0.7, 3, 10_000
#: Constants of the ranking function: term saturation, length normalisation, and what idf is at least.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RESULT = "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long, score double, match_count long, excerpts array<struct<ordinal:int,role:string,ts:long,snippet:string,score:double>>"


def phrase_tokens(item: Item, stems: bool) -> list[str]:
    """The tokens that an item's text has, folded, and stemmed before any prefix match."""
    found = [t for _, _, t in X.word_spans(item.text)]
    return [stem(t) for t in found] if stems else found


def word_frequency(line: Column, tokens: list[str], prefix: bool) -> Column:
    """How often the tokens stand in a row in a ``token_line``; the last one may be a prefix. A look-ahead lets matches share their edges."""
    pattern = " " + " ".join(_quoted(t) for t in tokens) + ("" if prefix else " ")
    return F.when(F.contains(line, F.lit(" " + tokens[0])), F.regexp_count(line, F.lit(f"(?={pattern})"))).otherwise(0)


def token_line(text: Column, stems: bool) -> Column:
    """A text's tokens, folded (and stemmed), each between spaces: one string, so that scans need no arrays."""
    plain = F.trim(F.regexp_replace(X.fold(text), r"[^\p{L}\p{N}\p{Co}]+", " "))
    if stems:
        plain = F.array_join(X.stemmed(F.split(plain, " ")), " ")
    return F.concat(F.lit(" "), plain, F.lit(" "))


def _quoted(part: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", part)


def substring_frequency(text: Column, part: str) -> Column:
    """How often a (lower-case) part stands in ``text``, overlaps included."""
    found = F.regexp_count(text, F.lit(f"(?={_quoted(part)})"))
    return F.when(F.contains(text, F.lit(part)), found).otherwise(0)


def bm25(scanned: DataFrame, n_items: int) -> DataFrame:
    """Messages that have all items (columns ``f0``, ``f1``, …; ``size``) and their ``score``.

    The statistics are one row, joined by broadcast; both sides come from one
    scanned plan.
    """
    fs = [F.col(f"f{k}") for k in range(n_items)]
    stats = scanned.agg(F.count(F.lit(1)).alias("rows"), F.avg("size").alias("mean_size"), *(F.count(F.when(f > 0, 1)).alias(f"n{k}") for k, f in enumerate(fs)))
    hits = scanned.where(functools.reduce(operator.and_, (f > 0 for f in fs))).crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("size") / F.col("mean_size"))
    score = F.lit(0.0)
    for k, f in enumerate(fs):
        idf = F.ln((F.col("rows") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        score -= F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + norm)
    return hits.select("mid", score.alias("score"))


def word_hits(messages: DataFrame, query: str, stems: bool = True) -> DataFrame | None:
    """``mid, score`` of the messages with all words and phrases; ``None`` if the query has none with a token."""
    phrases = [(phrase_tokens(i, stems), i.prefix) for i in word_items(query)]
    phrases = [p for p in phrases if p[0]]
    if not phrases:
        return None
    line = messages.select("mid", token_line(F.col("content"), stems).alias("line"))
    size = F.when(F.char_length("line") > 2, F.regexp_count("line", F.lit(" ")) - 1).otherwise(0)
    scanned = line.select("mid", size.alias("size"), *(word_frequency(F.col("line"), t, p).alias(f"f{k}") for k, (t, p) in enumerate(phrases)))
    return bm25(scanned, len(phrases))


def substring_hits(messages: DataFrame, query: str) -> DataFrame | None:
    """``mid, score`` of the messages with all substrings of three characters or more; case does not matter, diacritics do."""
    parts = [i.text.lower() for i in substring_items(query)]
    if not parts:
        return None
    low = messages.select("mid", F.lower("content").alias("low"))
    scanned = low.select("mid", F.greatest(F.char_length("low") - 2, F.lit(0)).alias("size"), *(substring_frequency(F.col("low"), p).alias(f"f{k}") for k, p in enumerate(parts)))
    return bm25(scanned, len(parts)).withColumn("score", F.col("score") * SUBSTRING_WEIGHT)


def hits(messages: DataFrame, query: str, stems: bool = True, words: bool = True, substrings: bool = True, index: SearchIndex | None = None) -> DataFrame | None:
    """Hits of both searches, one row for each message: ``mid, score, by_words``; ties go to the word search. With an index of the messages, only its postings are read."""
    found = []
    if words and (by_words := index.word_hits(query) if index else word_hits(messages, query, stems)) is not None:
        found.append(by_words.withColumn("by_words", F.lit(True)))
    if substrings and (by_parts := index.substring_hits(query, messages) if index else substring_hits(messages, query)) is not None:
        found.append(by_parts.withColumn("by_words", F.lit(False)))
    if not found:
        return None
    if len(found) == 1:
        return found[0]
    best = F.min(F.struct("score", (~F.col("by_words")).alias("by_parts")))
    return found[0].unionByName(found[1]).groupBy("mid").agg(best.alias("best")).select("mid", F.col("best.score").alias("score"), (~F.col("best.by_parts")).alias("by_words"))


def small(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of which a limit leaves few, to be broadcast; with a large limit they are joined as the planner sees fit."""
    return F.broadcast(rows) if limit <= LARGEST_BROADCAST else rows


def filters(query: Query) -> list[Column]:
    """Conditions on a hit's message and session; times are the message's, or else when its session began."""
    when = F.coalesce("ts", "started_at", F.lit(0))
    out = []
    for column, value in (("agent", normalize_agent(query.agent)), ("workspace", query.workspace), ("role", normalize_role(query.role))):
        if value:
            out.append(F.col(column) == value)
    if query.since > 0:
        out.append(when >= query.since)
    if query.until > 0:
        out.append(when <= query.until)
    return out


def ranked(found: DataFrame, corpus: Corpus, query: Query, exclude_uid: str | None = None) -> DataFrame:
    """The best excerpts of the best sessions: one row for each, with the session's score, count and position.

    Sessions are cut to the limit before any of their excerpts are decorated.
    """
    conditions = filters(query)
    at = found.join(corpus.messages.select("mid", "session_id", "ordinal", "role", "ts"), "mid")
    if exclude_uid is not None:
        conditions.append(F.coalesce(F.col("session_uid") != exclude_uid, F.lit(True)))
    if conditions:
        at = at.join(corpus.sessions.select("session_id", "agent", "session_uid", "workspace", "started_at"), "session_id")
        at = at.where(functools.reduce(operator.and_, conditions)).drop("agent", "session_uid", "workspace", "started_at")
    top = at.groupBy("session_id").agg(F.min("score").alias("session_score"), F.count(F.lit(1)).alias("match_count"))
    top = top.orderBy("session_score", "session_id").offset(max(0, query.offset)).limit(query.limit if query.limit > 0 else 20)
    best = Window.partitionBy("session_id").orderBy("score", "ordinal")
    kept = at.join(small(top, query.limit), "session_id").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= EXCERPTS)
    return kept


def search(corpus: Corpus, query: Query, stems: bool = True, words: bool = True, substrings: bool = True, snippets: bool = True, exclude_uid: str | None = None, index: SearchIndex | None = None) -> DataFrame:
    """The sessions that match, best first, each with up to three excerpts (columns: ``RESULT``). An empty query finds nothing."""
    stems = index.stems if index else stems
    found = hits(corpus.messages, query.text, stems, words, substrings, index)
    if found is None:
        return corpus.messages.sparkSession.createDataFrame([], RESULT)
    kept = ranked(found, corpus, query, exclude_uid)
    shown = kept.join(corpus.messages.select("mid", "content"), "mid") if snippets else kept.withColumn("content", F.lit(None).cast("string"))
    snippet = _snippets(query.text, stems)(F.col("content"), F.col("by_words")) if snippets else F.lit(None).cast("string")
    shown = shown.withColumn("snippet", snippet)
    folded = shown.groupBy("session_id", "session_score", "match_count").agg(F.array_sort(F.collect_list(F.struct("rn", "ordinal", "role", "ts", "snippet", "score"))).alias("all"))
    none = F.lit(0).cast("long")
    meta = corpus.sessions.select("session_id", "agent", "session_uid", *(F.coalesce(c, F.lit("")).alias(c) for c in ("workspace", "title", "summary")), *(F.coalesce(c, none).alias(c) for c in ("started_at", "ended_at")))
    excerpts = F.transform("all", lambda e: F.struct(*(e[c].alias(c) for c in ("ordinal", "role")), F.coalesce(e["ts"], none).alias("ts"), *(e[c].alias(c) for c in ("snippet", "score"))))
    out = meta.join(small(folded, query.limit), "session_id").select(
        *meta.columns, F.col("session_score").alias("score"), "match_count", excerpts.alias("excerpts")
    )
    return out.orderBy("score", "session_id")


def _snippets(query: str, stems: bool):
    phrases = [p for p in ((phrase_tokens(i, stems), i.prefix) for i in word_items(query)) if p[0]]
    parts = [i.text.lower() for i in substring_items(query)]

    def cut(contents, by_words):
        import pandas as pd

        return pd.Series([word_snippet(c, phrases, stems) if w else substring_snippet(c, parts) for c, w in zip(contents, by_words, strict=True)], dtype="object")

    return pandas_function(cut, "string")


def flat_hits(results: DataFrame, offset: int = 0) -> DataFrame:
    """One row for each excerpt: its cite token, its session's position (from 1, after ``offset``) and what is known of both."""
    place = Window.orderBy("session_score", "session_id")
    one = results.withColumnsRenamed({"score": "session_score"}).withColumn("rank", (F.row_number().over(place) + F.lit(max(0, offset))).cast("int"))
    rows = one.select("*", F.posexplode("excerpts").alias("nth", "e"))
    blank = lambda c: F.when(c != "", c)
    zero = lambda c: F.when(c != 0, c)
    token = F.concat(agent_code(F.col("agent")), F.lit("/"), F.substring("session_uid", 1, 8), F.lit(":"), F.col("e.ordinal").cast("string"))
    return rows.select(
        token.alias("cite"), "agent", F.col("session_uid").alias("uid"), F.col("e.ordinal").alias("ordinal"), F.col("e.role").alias("role"), zero(F.col("e.ts")).alias("ts"),
        F.col("e.score").alias("score"), "session_score", "match_count", "rank", blank(F.col("title")).alias("title"), blank(F.col("workspace")).alias("workspace"),
        zero(F.col("started_at")).alias("started_at"), F.col("e.snippet").alias("snippet"),
    )
