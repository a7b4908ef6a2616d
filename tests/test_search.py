"""Search against the standard library's SQLite FTS5, and filters, results and pages on a small corpus."""

import random
import sqlite3

import pytest

from loomsearch.functions.porter import stem
from loomsearch.functions.snippet import substring_snippet, word_snippet
from loomsearch.model import Corpus, Query
from loomsearch.operators.search import flat_hits, phrase_tokens, search, substring_hits, word_hits
from loomsearch.plans.grammar import substring_items, substring_match, word_items, word_match

WORDS = "authentication authorize author running runner café naïve snake_case retry webhook the a of configure: end. Stop! data database relational hopping generalization x".split()


def corpus_rows(n=150, seed=4):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))) for k in range(n)]


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE w USING fts5(content, tokenize='porter unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='trigram')")
    for k, text in corpus_rows():
        for name in "wt":
            db.execute(f"INSERT INTO {name}(rowid, content) VALUES (?, ?)", (k, text))
    return db


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(corpus_rows(), "mid long, content string").cache()


@pytest.mark.parametrize("query", ["authentication", "running", "cafe", "snake_case", '"data database"', "retry webhook", '"author runner"', "hop gener", "ending", "a"])
def test_words_score_as_fts5(fts, messages, query):
    want = dict(fts.execute("SELECT rowid, bm25(w) FROM w WHERE w MATCH ?", (word_match(query),)))
    got = {r["mid"]: r["score"] for r in word_hits(messages, query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("query", ["hentic", "café", "retry webhook", "TABASE", "cas", "aut run"])
def test_substrings_score_as_fts5(fts, messages, query):
    want = dict(fts.execute("SELECT rowid, bm25(t) * 0.7 FROM t WHERE t MATCH ?", (substring_match(query),)))
    got = {r["mid"]: r["score"] for r in substring_hits(messages, query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("query", ["authentication", "retry webhook", '"data database"', "running the", "a"])
def test_snippets_are_those_of_fts5(fts, query):
    phrases = [p for p in ((phrase_tokens(i, True), i.prefix) for i in word_items(query)) if p[0]]
    texts = dict(corpus_rows())
    for k, want in fts.execute("SELECT rowid, snippet(w, 0, '«', '»', '…', 12) FROM w WHERE w MATCH ?", (word_match(query),)):
        assert word_snippet(texts[k], phrases) == want
    parts = [i.text.lower() for i in substring_items(query)]
    if parts:
        for k, want in fts.execute("SELECT rowid, snippet(t, 0, '«', '»', '…', 12) FROM t WHERE t MATCH ?", (substring_match(query),)):
            assert substring_snippet(texts[k], parts) == want


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "generalization", "sky", "is")] == ["caress", "poni", "relat", "hop", "gener", "sky", "is"]


def store(spark, sessions, messages):
    s = spark.createDataFrame(sessions, "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long")
    m = spark.createDataFrame(messages, "mid long, session_id long, ordinal int, role string, ts long, content string")
    return Corpus(s, m)


SESSIONS = [
    (11, "cursor", "hay-1", "/farm", "Barn", "", 5_000, 5_300),
    (12, "claude_code", "hay-2", "/mill", None, None, None, None),
    (13, "codex", "hay-3", "/farm", "", "wheat", 9_000, 9_050),
]
SPOKEN = [
    (11, 0, "user", 5_000, "Where do the sparrows nest this year?"), (11, 1, "assistant", None, "Sparrows nest under the SparrowHouse roof."), (11, 2, "tool", 5_200, "roofCheck(ok)"),
    (12, 0, "user", None, "Count the sparrow eggs, please"), (12, 1, "thinking", 7_100, "eggs only"), (13, 4, "assistant", 9_040, "A sparrowhawk is no sparrow."), (13, 5, "user", 9_050, "Thanks"),
]


@pytest.fixture(scope="module")
def farm(spark):
    return store(spark, SESSIONS, [(100 + n, *row) for n, row in enumerate(SPOKEN)])


def matches(session, said_by, ts, want):
    """A filter read off the rows: times are the message's, or else its session's start."""
    own = next(s for s in SESSIONS if s[0] == session)
    when = ts if ts is not None else own[6] or 0
    return all((want.get("agent") in (None, own[1]), want.get("workspace") in (None, own[3]), want.get("role") in (None, said_by), when >= want.get("since", 0), when <= want.get("until", 1 << 40)))


@pytest.mark.parametrize("want", [{}, {"agent": "cursor"}, {"agent": "codex", "role": "user"}, {"workspace": "/farm"}, {"role": "assistant"}, {"since": 5_001}, {"until": 8_999}, {"since": 5_001, "until": 9_000}, {"workspace": "/sea"}])
def test_filters_are_those_of_the_rows(farm, want):
    expected = {}
    for session, ordinal, role, ts, text in SPOKEN:
        if "sparrow" in text.lower() and matches(session, role, ts, want):
            expected.setdefault(session, set()).add(ordinal)
    got = {r["session_id"]: {e["ordinal"] for e in r["excerpts"]} for r in search(farm, Query("sparrow", **want)).collect()}
    assert got == expected


def test_results_have_no_nulls_and_flatten(farm):
    found = search(farm, Query("sparrow"))
    rows = found.collect()
    for r in rows:
        assert None not in (r["workspace"], r["title"], r["summary"], r["started_at"], r["ended_at"])
        assert all("«" in e["snippet"] for e in r["excerpts"]) and r["match_count"] == len(r["excerpts"])
    assert [r["score"] for r in rows] == sorted(r["score"] for r in rows)
    flat = flat_hits(found, 20).collect()
    assert {r["rank"] for r in flat} == {21, 22, 23} and {r["cite"] for r in flat} == {"cur/hay-1:0", "cur/hay-1:1", "cc/hay-2:0", "cdx/hay-3:4"}


@pytest.mark.parametrize(
    ("query", "want"),
    [("sparrowhouse", {11}), ("rowHo", {11}), ("nests", {11}), ("egg count", {12}), ('"sparrow eggs"', {12}), ('"eggs sparrow"', set()), ("roofcheck thanks", set()), ("NOT sparrow", set()), ("", set()), (' "?" - ', set())],
)
def test_words_parts_and_phrases(farm, query, want):
    assert {r["session_id"] for r in search(farm, Query(query)).collect()} == want


def test_pages_follow_each_other(spark):
    rng = random.Random(8)
    texts = ["turnip " * rng.randint(1, 4) + "field " * rng.randint(0, 9) for _ in range(11)]
    c = store(spark, [(k, "cursor", f"bed{k}", "", "", "", k, k) for k in range(11)], [(k, k, 0, "user", k, t) for k, t in enumerate(texts)])
    whole = [r["session_id"] for r in search(c, Query("turnip", limit=50)).collect()]
    pages = [[r["session_id"] for r in search(c, Query("turnip", limit=4, offset=o)).collect()] for o in (0, 4, 8, 12)]
    assert sorted(whole) == list(range(11)) and sum(pages, []) == whole and [len(p) for p in pages] == [4, 4, 3, 0]
