import json
import os
import sqlite3

from loomsearch.functions import text as X
from loomsearch.functions.text import compact_json, cut_bytes
from loomsearch.sources import parse
from loomsearch.sources.ingest import Tables, ingest


def lines(*records):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)


def said(kind, content, at, **more):
    return {"type": kind, "sessionId": "u-1", "cwd": "/w", "timestamp": at, "message": {"role": kind, "content": content}, **more}


A = [
    {"type": "summary", "sessionId": "u-1"},
    said("user", "first line\nsecond", "2024-01-01T00:00:10.5Z"),
    "",
    "{broken",
    said("assistant", [{"type": "text", "text": " hello "}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "run", "input": {"b": "<x>", "a": 1.0}}], "2024-01-01T00:00:20Z"),
    said("assistant", "plain strings say nothing", "2024-01-01T00:00:21Z"),
    said("user", [{"type": "tool_result", "tool_use_id": "0123456789abcdef", "is_error": True, "content": "x" * 5000}, {"type": "text", "text": "and more"}], "2024-01-01T00:00:30Z"),
    {"type": "other", "message": {"content": "no"}},
]


def test_session_files():
    data = lines(*A).encode()
    rows = list(parse.session_file("f/u.jsonl", data))
    assert [(r["role"], r["sub"]) for r in rows] == [("user", 0), ("assistant", 0), ("thinking", 1), ("user", 0)]
    assert rows[1]["content"] == 'hello\n[tool_use name=run] {"a":1,"b":"\\u003cx\\u003e"}'
    assert rows[3]["content"] == "[tool_result error id=0123456789ab] " + "x" * 4096 + "…\nand more"
    assert rows[0]["ts"] == 1704067210 and rows[0]["workspace"] == "/w"
    assert list(parse.session_file("f", data, rows[3]["source_offset"])) == rows[3:]
    assert list(parse.session_file("f", data[:-40]))[-1]["role"] == "user"
    assert parse.consumed(b"a\nb") == 2


def test_rollout_files():
    records = [
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "r-1", "cwd": "/v"}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:05Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "title\nrest"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "<turn_aborted> x"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "system", "content": [{"text": "x"}]}},
        {"type": "response_item", "payload": {"type": "reasoning", "summary": [], "encrypted_content": "x"}},
        {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "s"}], "content": [{"text": "c"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "f", "arguments": "é" * 600}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "done"}},
        {"type": "event", "payload": {"type": "message", "role": "user", "content": [{"text": "x"}]}},
    ]
    rows = list(parse.rollout_file("f", lines(*records).encode()))
    assert [(r["role"], r["content"]) for r in rows] == [("user", "title\nrest"), ("thinking", "s\nc"), ("tool", "[tool_call name=f] " + "é" * 512), ("tool", "[tool_result] done")]
    assert {r["started_at"] for r in rows} == {1704067200}
    history = [{"session_id": "h", "ts": 5, "text": "hi"}, {"session_id": "h", "ts": 6, "text": "<permissions instructions> x"}, {"session_id": "", "text": "x"}, {"session_id": "i", "text": " "}]
    assert [(r["session_uid"], r["ts"]) for r in parse.history_file("f", lines(*history).encode())] == [("h", 5)]


def test_bubbles_and_summaries():
    assert parse.bubble_text({"text": " ", "content": " c "}) == "c"
    assert parse.bubble_text({"toolFormerData": {"tool": "t", "rawArgs": "r", "args": {"a": 1}}}) == "[tool name=t args=r]"
    assert parse.bubble_text({"toolFormerData": {"name": "t"}}) == "[tool name=t]"
    assert parse.bubble_text({"tool_calls": [{"function": {"name": "g", "arguments": {"k": [1, 2]}}}]}) == '[tool name=g args={"k":[1,2]}]'
    assert parse.bubble_text({"name": "n", "arguments": None, "richText": "x"}) == "[tool name=n]"
    assert parse.bubble_text({"richText": "x"}) == ""
    raw = "pre <previous_assistant_message>A <omitted /></previous_assistant_message><attached_files>z</attached_files><previous_user_message><user_query>U</user_query></previous_user_message><previous_assistant_message>B"
    assert parse.summary_digest(raw) == "User: U\n\nAssistant: B"
    assert parse.summary_digest(raw[4:].replace("<previous_user_message>", "<x>")) == "Assistant: A …\n\nAssistant: B"


def test_text_functions(spark):
    assert compact_json({"b": [1.5, 2.0, None, True], "a": "é&"}) == '{"a":"é\\u0026","b":[1.5,2,null,true]}'
    assert cut_bytes("aé", 2) == "a"
    df = spark.createDataFrame([("file:///a%20b/c+d",), ("vscode-remote://x/y",), ("aéb",)], "t string")
    rows = df.select(X.file_path(df["t"]).alias("p"), X.truncate_bytes(df["t"], 2).alias("b"), X.truncate_runes(df["t"], 2).alias("r"), X.unix_seconds(df["t"]).alias("s")).collect()
    assert [r["p"] for r in rows] == ["/a b/c+d", "vscode-remote://x/y", "aéb"]
    assert rows[2]["b"] == "a" and rows[2]["r"] == "aé…" and rows[2]["s"] == 0


def messages(tables):
    return sorted((r["session_id"], r["ordinal"], r["role"], r["content"]) for r in tables.messages.collect())


def sessions(tables):
    return {(r["agent"], r["session_uid"]): (r["title"], r["workspace"], r["started_at"], r["ended_at"]) for r in tables.sessions.collect()}


def test_ingest_in_parts_is_ingest_at_once(spark, tmp_path):
    a, b, c = tmp_path / "a/p", tmp_path / "b", tmp_path / "c"
    a.mkdir(parents=True)
    (b / "sessions/2024").mkdir(parents=True)
    (c / "globalStorage").mkdir(parents=True)
    (c / "workspaceStorage/w1").mkdir(parents=True)
    part = lines(*A[:5])
    (a / "u.jsonl").write_text(part + '{"type": "us')
    roll = lines({"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "r-1", "cwd": "/v"}}, {"type": "response_item", "timestamp": "2024-01-01T00:00:05Z", "payload": {"type": "message", "role": "user", "content": [{"text": "t ghp_" + "A" * 36}]}})
    (b / "sessions/2024/rollout-1.jsonl").write_text(roll)
    (b / "history.jsonl").write_text(lines({"session_id": "r-1", "ts": 1, "text": "known"}, {"session_id": "h-1", "ts": 2, "text": "new"}, {"session_id": "h-1", "ts": 3, "text": "later"}))
    db = sqlite3.connect(c / "globalStorage/state.vscdb")
    db.execute("CREATE TABLE cursorDiskKV (key TEXT, value BLOB)")
    heads = [{"bubbleId": "b1", "type": 1}, {"bubbleId": "missing", "type": 2}]

    def composer():
        db.execute("DELETE FROM cursorDiskKV WHERE key LIKE 'composerData%'")
        db.execute("INSERT INTO cursorDiskKV VALUES ('composerData:k1', ?)", (json.dumps({"fullConversationHeadersOnly": heads, "createdAt": 5500, "lastUpdatedAt": 9900, "name": "N"}),))
        db.execute("INSERT INTO cursorDiskKV VALUES ('composerData:k2', '{\"fullConversationHeadersOnly\": []}')")
        db.commit()

    db.execute("INSERT INTO cursorDiskKV VALUES ('bubbleId:k1:b1', '{\"text\": \"q\"}')")
    db.execute("INSERT INTO cursorDiskKV VALUES ('bubbleId:k1:b2', '{\"message\": \"answer\"}')")
    composer()
    w = sqlite3.connect(c / "workspaceStorage/w1/state.vscdb")
    w.execute("CREATE TABLE ItemTable (key TEXT, value BLOB)")
    w.execute("INSERT INTO ItemTable VALUES ('composer.composerData', '{\"allComposers\": [{\"composerId\": \"k1\"}]}')")
    w.commit()
    (c / "workspaceStorage/w1/workspace.json").write_text('{"folder": "file:///home/x%20y"}')
    roots = {"claude_code": str(tmp_path / "a"), "codex": str(b), "cursor": str(c)}
    first = ingest(spark, roots).write(str(tmp_path / "t1"))
    assert sessions(first)["codex", "r-1"] == ("t [REDACTED:github-pat]", "/v", 1704067200, 1704067205)
    assert sessions(first)["cursor", "k1"] == ("N", "/home/x y", 5, 9)
    assert sessions(first)["codex", "h-1"] == ("new", "", 2, 2)
    (a / "u.jsonl").write_text(lines(*A))
    os.utime(a / "u.jsonl", (2e9, 2e9))
    heads.append({"bubbleId": "b2", "type": 2})
    composer()
    grown = ingest(spark, roots, first).write(str(tmp_path / "t3"))
    whole = ingest(spark, roots, first, full=True).write(str(tmp_path / "t4"))
    assert messages(grown) == messages(whole) and sessions(grown) == sessions(whole)
    assert sessions(whole)["claude_code", "u-1"] == ("first line", "/w", 1704067210, 1704067230)
    assert len(messages(whole)) == len(messages(first)) + 2
    (a / "u.jsonl").write_text(lines(*A[:2]))
    shorter = ingest(spark, {"claude_code": roots["claude_code"]}, grown).write(str(tmp_path / "t5"))
    assert len([m for m in shorter.messages.join(shorter.sessions, "session_id").where("agent = 'claude_code'").collect()]) == 1
    assert Tables.read(spark, str(tmp_path / "t5")).state.count() == shorter.state.count()


def test_registered_tables_have_statistics(spark, tmp_path):
    from loomsearch.sources.ingest import register

    (tmp_path / "a/p").mkdir(parents=True)
    (tmp_path / "a/p/u.jsonl").write_text(lines(*A))
    report = []
    tables = ingest(spark, {"claude_code": str(tmp_path / "a")}, report=report)
    assert [(r["source"], r["sessions"], r["offered"], r["errors"]) for r in report] == [("claude_code", 1, 4, 1)] and report[0]["seconds"] >= 0
    try:
        rows = {r["table"]: r["rows"] for r in register(tables, "kept_transcripts", str(tmp_path / "db")).collect()}
        assert rows == {"sessions": 1, "messages": 4, "index_state": 1}
        assert spark.table("kept_transcripts.messages").count() == 4
    finally:
        spark.sql("DROP DATABASE kept_transcripts CASCADE")


def test_streamed_ingest_adds_each_row_once(spark, tmp_path):
    from loomsearch.streaming.ingest import current, ingest_available

    df = spark.createDataFrame([(k, k % 3, float(k)) for k in range(30)], "id long, g long, v double")
    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    assert current(spark, table) is None
    df.where("id < 20").repartition(3).write.parquet(src)
    assert ingest_available(spark, src, df.schema, table, mark, ["id"], "v", 1).count() == 20
    df.where("id >= 10").write.mode("append").parquet(src)
    assert ingest_available(spark, src, df.schema, table, mark, ["id"], "v").count() == 30
    assert ingest_available(spark, src, df.schema, table, mark, ["id"], "v").count() == 30


def test_the_index_follows_the_ingest(spark, tmp_path):
    from loomsearch.operators.index import SearchIndex
    from loomsearch.operators.search import word_hits

    a = tmp_path / "a/p"
    a.mkdir(parents=True)
    (a / "u.jsonl").write_text(lines(*A))
    (a / "v.jsonl").write_text(lines({**A[1], "sessionId": "u-2"}))
    index, roots = SearchIndex(spark, str(tmp_path / "i"), stems=False), {"claude_code": str(tmp_path / "a")}

    def same(tables):
        m = tables.messages.select("mid", "content")
        for query in ("first", "more", "hello"):
            want = sorted((r["mid"], round(r["score"], 9)) for r in word_hits(m, query, stems=False).collect())
            assert sorted((r["mid"], round(r["score"], 9)) for r in index.word_hits(query).collect()) == want
        return index.manifest()

    first = ingest(spark, roots, index=index).write(str(tmp_path / "t1"))
    assert same(first)["rows"] == 5
    with (a / "v.jsonl").open("a") as f:
        f.write(lines({**said("user", "more of it", "2024-01-01T00:00:40Z"), "sessionId": "u-2"}))
    grown = ingest(spark, roots, first, index=index).write(str(tmp_path / "t2"))
    assert [s["rows"] for s in same(grown)["segments"]] == [5, 1]  # what was there is not indexed again
    (a / "u.jsonl").write_text(lines(*A[:2]))
    shorter = ingest(spark, roots, grown, index=index).write(str(tmp_path / "t3"))
    assert same(shorter)["rows"] == 3 and not index.needs_rebuild(shorter.messages)
