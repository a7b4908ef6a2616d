import pytest

from loomsearch import surface
from loomsearch.model import DEFAULT_LIMITS, LARGEST_LIMITS, Corpus, capped
from loomsearch.operators import render
from loomsearch.operators.redact import write_redacted
from loomsearch.operators.sessions import doctor


@pytest.mark.parametrize("surface_", sorted(DEFAULT_LIMITS))
def test_limits(surface_):
    most = LARGEST_LIMITS.get(surface_, 10**9)
    assert capped(None, surface_) == capped(0, surface_) == capped(-5, surface_) == DEFAULT_LIMITS[surface_] <= most
    assert capped(3, surface_) == 3 and capped(10**9, surface_) == min(most, 10**9)


@pytest.fixture(scope="module")
def corpus(spark):
    s = spark.createDataFrame([(k, "codex", f"c0ffee{k:02d}", "/w", f"Title {k}", "", 100 + k, 200 + k) for k in range(30)], "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long")
    m = spark.createDataFrame([(2 * k + j, k, j, "user", 150 + k, f"lantern number {k} of {j}") for k in range(30) for j in range(2)], "mid long, session_id long, ordinal int, role string, ts long, content string")
    return Corpus(s, m)


def test_tools(corpus):
    assert surface.search(corpus, "lantern").select("rank").distinct().count() == 20
    assert surface.search(corpus, "lantern", limit=10**6).select("rank").distinct().count() == 30
    listed = surface.list_sessions(corpus, order="asc", limit=4, offset=2).orderBy("rank").collect()
    assert [(r["rank"], r["uid"]) for r in listed] == [(3, "c0ffee02"), (4, "c0ffee03"), (5, "c0ffee04"), (6, "c0ffee05")]
    assert [r["rank"] for r in surface.list_sessions(corpus, limit=2).orderBy("ended_at").collect()] == [2, 1]
    assert surface.related(corpus, "c0ffee00", limit=3).count() == 0 and surface.get_session(corpus, "cdx/c0ffee01").count() == 2
    assert [r["messages"] for r in surface.stats(corpus).collect()] == [60, 60]


def test_description():
    found = {t["name"]: t for t in surface.describe()}
    assert set(found) == {"search", "get_session", "related", "list_sessions", "stats"} and all(t["description"] for t in found.values())
    assert [p["name"] for p in found["search"]["parameters"] if p["required"]] == ["text"] and found["stats"]["parameters"] == []


def test_renderers(corpus):
    text = render.hit_lines(surface.search(corpus, "lantern", limit=2).orderBy("rank", "cite").collect(), "<b>", "</b>")
    assert text.count("<b>lantern</b>") == 4 and text.splitlines()[0].startswith("  1. Title")
    rows = surface.list_sessions(corpus, limit=1).collect()
    assert render.session_lines(rows, 229 + 7200) == "  1. cdx/c0ffee29   2h     2  Title 29"
    assert render.markdown([{"role": "user", "content": "x"}]) == "### user\n\nx"


def test_doctor(corpus):
    (row,) = doctor(corpus.sessions, corpus.messages, 229 + 1801).collect()
    assert tuple(row) == ("codex", 30, 60, 229, 1801, True)
    assert not doctor(corpus.sessions, corpus.messages, 229 + 1800).first()["stale"]


def test_a_redacted_copy_leaves_its_sources(spark, tmp_path):
    secret = "ghp_" + "k9" * 18
    for name, lines in (("a.jsonl", [f'{{"t": "{secret}"}}', "plain", secret]), ("b.jsonl", ["only"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = write_redacted(spark, f"{tmp_path}/*.jsonl", f"{tmp_path}/copy").orderBy("source_path", "line").collect()
    assert [(r["source_path"][-7:], r["line"], r["value"]) for r in rows] == [("a.jsonl", 0, '{"t": "[REDACTED:github-pat]"}'), ("a.jsonl", 1, "plain"), ("a.jsonl", 2, "[REDACTED:github-pat]"), ("b.jsonl", 0, "only")]
    assert secret in (tmp_path / "a.jsonl").read_text()
