"""Summaries kept by deltas against summing everything up."""

import random

import pytest

from loomsearch.model import Corpus, SessionFilter
from loomsearch.operators import sessions, summaries

MESSAGE = "session_id long, ordinal int, role string, ts long"


def content(df):
    return sorted(tuple(r[c] for c in ("session_id", "messages", "last_ordinal", "last_role", "first_ts", "last_ts")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(s, k, rng.choice(["user", "assistant", "tool"]), rng.choice([None, 100 * s + k])) for s in range(12) for k in range(rng.randint(1, 9))]


def test_inserts_and_deletes_give_what_summing_up_gives(spark, rows):
    def table(keep):
        return spark.createDataFrame([r for r in rows if keep(r)], MESSAGE)

    kept = summaries.summarise(table(lambda r: r[1] < 2))
    kept = summaries.with_added(kept, table(lambda r: r[1] >= 2 and r[0] != 3))
    assert content(kept) == content(summaries.summarise(table(lambda r: r[0] != 3 or r[1] < 2)))
    kept = summaries.without_sessions(kept, table(lambda r: r[0] in (4, 5)))
    left = table(lambda r: r[0] not in (4, 5) and (r[0] != 3 or r[1] < 2))
    assert content(kept) == content(summaries.summarise(left))
    lost = left.where("session_id in (7, 8) and (ordinal > 0 or session_id = 8)")
    left = left.join(lost, ["session_id", "ordinal"], "left_anti")
    assert content(summaries.without_messages(kept, lost, left)) == content(summaries.summarise(left))


def test_lists_and_counts_read_no_messages(spark, rows):
    m = spark.createDataFrame(rows, MESSAGE)
    own = spark.createDataFrame([(s, "codex", f"u{s}", "", "", "", s, 2 * s) for s in range(13)], "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long")
    plain, kept = Corpus(own, m), Corpus(own, m.where("1 = 0"), summaries.summarise(m))
    for f in (SessionFilter(), SessionFilter(ended_mid_task=True, limit=4)):
        assert [tuple(r) for r in sessions.list_sessions(kept, f).select(sorted(own.columns)).collect()] == [tuple(r) for r in sessions.list_sessions(plain, f).select(sorted(own.columns)).collect()]
        assert [r["message_count"] for r in sessions.list_sessions(kept, f).collect()] == [r["message_count"] for r in sessions.list_sessions(plain, f).collect()]
        assert sessions.count_sessions(kept, f).collect() == sessions.count_sessions(plain, f).collect()
    assert sessions.stats(kept, True).collect() == sessions.stats(plain, True).collect()


def test_the_ingest_keeps_them_and_old_tables_get_them(spark, tmp_path):
    import shutil

    from loomsearch.sources.ingest import Tables, ingest

    def line(text, role="user"):
        return f'{{"type":"{role}","sessionId":"s","timestamp":"2024-01-01T00:00:0{len(text)}Z","message":{{"role":"{role}","content":"{text}"}}}}\n'

    (tmp_path / "a/p").mkdir(parents=True)
    f = tmp_path / "a/p/s.jsonl"
    f.write_text(line("a") + line("bb"))
    first = ingest(spark, {"claude_code": str(tmp_path / "a")}).write(str(tmp_path / "t1"))
    f.write_text(line("a") + line("bb") + line("ccc"))
    grown = ingest(spark, {"claude_code": str(tmp_path / "a")}, first).write(str(tmp_path / "t2"))
    f.write_text(line("new"))
    anew = ingest(spark, {"claude_code": str(tmp_path / "a")}, grown).write(str(tmp_path / "t3"))
    for tables, n in ((first, 2), (grown, 3), (anew, 1)):
        assert content(tables.summaries) == content(summaries.summarise(tables.messages)) and [r["messages"] for r in tables.summaries.collect()] == [n]
        assert [r["messages"] for r in sessions.stats(tables.corpus()).collect()] == [n]
    shutil.rmtree(tmp_path / "t2/summaries")
    assert content(Tables.read(spark, str(tmp_path / "t2")).summaries) == content(grown.messages.transform(summaries.summarise))
