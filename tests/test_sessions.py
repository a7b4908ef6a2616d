import pytest

from loomsearch.model import Corpus, Query, SessionFilter
from loomsearch.operators import merge, render, sessions


@pytest.fixture(scope="module")
def corpus(spark):
    s = spark.createDataFrame(
        [(1, "claude_code", "aaaa1111-x", "/w", "", "", 100, 200), (2, "codex", "aaaa2222-y", "/w", "alpha beta title words", "", 300, None), (3, "codex", "bbbb3333-z", "/v", None, None, None, None)],
        "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long",
    )
    rows = [(1, k, ("user", "assistant", "tool")[k % 3], 100 + k, f"message {k} alpha beta gamma delta epsilon") for k in range(9)] + [(2, 0, "user", None, "alpha beta title words again"), (2, 1, "thinking", None, "hm")]
    m = spark.createDataFrame([(1000 * a + b, a, b, c, d, e) for a, b, c, d, e in rows], "mid long, session_id long, ordinal int, role string, ts long, content string")
    return Corpus(s, m)


def ids(df):
    return [r["session_id"] for r in df.collect()]


def test_lists(corpus):
    assert ids(sessions.list_sessions(corpus, SessionFilter())) == [2, 1, 3]
    assert ids(sessions.list_sessions(corpus, SessionFilter(order="asc", offset=-4))) == [3, 1, 2]
    assert ids(sessions.list_sessions(corpus, SessionFilter(agent="cdx", since=1))) == [2]
    assert ids(sessions.list_sessions(corpus, SessionFilter(until=250))) == [1, 3]
    assert {r["session_id"]: r["message_count"] for r in sessions.list_sessions(corpus, SessionFilter()).collect()} == {1: 9, 2: 2, 3: 0}
    assert sessions.count_sessions(corpus, SessionFilter(workspace="/w", limit=1)).head()["total"] == 2
    assert ids(sessions.list_sessions(corpus, SessionFilter(ended_mid_task=True))) == [1]
    assert ids(sessions.latest_session(corpus)) == [2]
    assert [r["rank"] for r in sessions.session_rows(sessions.list_sessions(corpus, SessionFilter()), 4).collect()] == [5, 6, 7]


def test_stats(corpus):
    rows = [tuple(r) for r in sessions.stats(corpus, total=True).collect()]
    assert rows == [("claude_code", 1, 9, 200), ("codex", 2, 2, 300), ("total", 3, 11, 200)]
    assert [tuple(r) for r in sessions.stats(corpus).collect()] == rows[:2]


def test_slices(corpus):
    def ordinals(ref, **options):
        return [r["ordinal"] for r in sessions.get_session(corpus, ref, **options).collect()]

    assert ordinals("cc/aaaa1111") == list(range(9)) == ordinals("aaaa")
    assert ordinals("cc/aaaa1111:4") == [1, 2, 3, 4, 5, 6, 7] and ordinals("aaaa1111:0", span=1) == [0, 1]
    assert ordinals("aaaa1111", first=7) == [7, 8] and ordinals("aaaa1111", last=1) == [0, 1] and ordinals("aaaa1111", around=0, span=0) == [0]
    assert ordinals("aaaa1111", role="human") == [0, 3, 6] and ordinals("") == [] and ordinals("zzz") == []
    assert sessions.get_session(corpus, "aaaa1111:0", span=0, max_chars=7).head()["content"] == "message…[truncated]"


def test_context_and_related(corpus):
    context = sessions.rag_context(corpus, Query("epsilon"), 1)
    assert [r["ordinal"] for r in context.collect()] == [0, 1]
    assert "cc/aaaa1111:0" in sessions.rag_prompt(context, "what?")
    with pytest.raises(LookupError):
        sessions.rag_prompt(sessions.rag_context(corpus, Query("nothing")), "what?")
    assert sessions.seed_text(corpus, "aaaa2222") == "alpha beta title words"
    assert sessions.seed_text(corpus, "aaaa1111").startswith("message 0")
    assert ids(sessions.related(corpus, "aaaa2222", snippets=False)) == []
    with pytest.raises(LookupError):
        sessions.related(corpus, "nowhere")


def test_budget():
    lines = ["a" * 50, "b" * 10, "c" * 10]
    assert list(render.within_budget(lines, 30)) == ["b" * 10, "c" * 10, '{"truncated":true,"skipped_hits":1}']
    assert list(render.within_budget(lines, 0)) == lines
    assert render.cut_text("one\ntwo\nthree", 9) == "one\ntwo\n…[truncated]"


def test_merge(spark):
    cols = "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long, source_path string, source_mtime_ns long, source_size long"
    old = spark.createDataFrame([(1, "codex", "a", "/w", "T", "", 100, None, "p", 1, 1), (2, "codex", "b", "", "", "", None, 50, "q", 1, 1)], cols)
    new = spark.createDataFrame([(1, "codex", "a", "", "", "S", 90, None, "r", 2, 2), (2, "codex", "b", "/x", "N", "", 70, 40, "q", 2, 2), (3, "codex", "c", "", "", "", 1, 2, "s", 1, 1)], cols)
    got = {r["session_uid"]: r for r in merge.upsert_sessions(old, new).collect()}
    assert (got["a"]["title"], got["a"]["summary"], got["a"]["workspace"], got["a"]["started_at"], got["a"]["ended_at"], got["a"]["source_path"]) == ("T", "S", "/w", 100, None, "r")
    assert (got["b"]["title"], got["b"]["workspace"], got["b"]["started_at"], got["b"]["ended_at"]) == ("N", "/x", 70, 50)
    assert set(got) == {"a", "b", "c"}
    listing = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 1, 5), ("d", 1, 1)], "source_path string, mtime_ns long, size long")
    state = spark.createDataFrame([("a", 1, 10, 10, ""), ("b", 1, 10, 9, ""), ("c", 1, 9, 9, "")], "source_path string, mtime_ns long, size long, last_offset long, fingerprint string")
    got = {r["source_path"]: (r["action"], r["offset"], r["truncate"]) for r in merge.decide(listing, state).collect()}
    assert got == {"a": ("skip", 0, False), "b": ("resume", 9, False), "c": ("restart", 0, True), "d": ("restart", 0, False)}
