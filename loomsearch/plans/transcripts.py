"""Queries of the three transcript sources: the conversations are written as an agent would have kept them, and ingested from there."""

from __future__ import annotations

import json
import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, sessions
from ..operators.index import SearchIndex
from ..sources import files
from ..sources.ingest import Tables, ingest
from ..sources.ranges import by_ranges, put, store_of
from ..storage import file_system, shared_dir, ship
from ..streaming import transcripts as streamed

START = 1704067200
#: Turns that one composer store is given.
STORE_ROWS = 50_000


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def _at(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'.25Z'")


def _files(lines: DataFrame, root: str, suffix: str = ".jsonl") -> str:
    """Writes lines (``folder, name, at, value``) in order into ``root/folder/name.jsonl``, each file in the task that has its lines."""
    spark = lines.sparkSession
    ordered = lines.repartition("folder", "name").sortWithinPartitions("folder", "name", "at").select("folder", "name", "value")
    if not by_ranges(root):
        return _moved(ordered, root, suffix)
    ship(spark)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made: set[str] = set()
        for (folder, name), own in groupby(rows, lambda r: r[:2]):
            if folder not in made:
                store.create_dir(f"{top}/{folder}", recursive=True)
                made.add(folder)
            put(store, f"{top}/{folder}/{name}{suffix}", ((value or "").encode() + b"\n" for _, _, value in own))
            yield pa.RecordBatch.from_pydict({"files": [1]})

    ordered.mapInArrow(step, "files long").agg(F.sum("files")).collect()
    return root


def _moved(ordered: DataFrame, root: str, suffix: str) -> str:
    """The same in a store that only Spark opens: it writes a folder for each file, of which the driver moves the file to its place."""
    spark = ordered.sparkSession
    draft = f"{root}/draft-{uuid.uuid4().hex}"
    ordered.write.partitionBy("folder", "name").text(draft)
    fs, top = file_system(spark, draft)
    for folder in (s.getPath() for s in fs.listStatus(top) if s.isDirectory()):
        target = file_system(spark, f"{root}/{folder.getName().split('=', 1)[1].replace('%2F', '/')}")[1]
        fs.mkdirs(target)
        for name in (s.getPath() for s in fs.listStatus(folder)):
            part = next(s.getPath() for s in fs.listStatus(name) if s.getPath().getName().startswith("part-"))
            to = file_system(spark, f"{target}/{name.getName().split('=', 1)[1]}{suffix}")[1]
            fs.delete(to, False)
            fs.rename(part, to)
    fs.delete(top, True)
    return root


def session_lines(talk: DataFrame, most_turns: int = 1 << 30) -> DataFrame:
    """Format A: summaries, blank and broken lines; user texts and tool results; what assistants say, think and call."""
    uid, cwd = F.concat(F.lit("a-"), F.col("conv_id").cast("string")), F.concat(F.lit("/p/"), F.pmod("conv_id", F.lit(3)).cast("string"))
    ts = _at(F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    head = [uid.alias("sessionId"), cwd.alias("cwd"), ts.alias("timestamp")]
    text = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    plain = F.to_json(F.struct(F.lit("user").alias("type"), *head, F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.lit("toolu_0123456789").alias("tool_use_id"), F.col("text").alias("content")))
    parts = F.concat(F.lit("["), result, F.lit(","), F.to_json(text("text", F.lit("  next "))), F.lit("]"))
    call = F.concat(F.lit('{"type":"tool_use","name":"run","input":{"b":'), F.col("turn").cast("string"), F.lit('.0,"a":"<k>"}}'))
    thought = F.to_json(F.struct(F.lit("thinking").alias("type"), F.concat(F.lit("why "), F.col("turn").cast("string")).alias("thinking")))
    said = F.concat(F.lit("["), thought, F.lit(","), F.to_json(text("text", F.col("text"))), F.lit(","), call, F.lit("]"))

    def record(kind: str, content: Column) -> Column:
        rest = F.substring(F.to_json(F.struct(*head)), 2, 1 << 20)
        return F.concat(F.lit(f'{{"type":"{kind}","message":{{"role":"{kind}","content":'), content, F.lit("},"), rest)

    other = F.to_json(F.struct(F.col("role").alias("type"), *head, F.struct(F.col("text").alias("content")).alias("message")))
    value = F.when(F.col("role") == "user", F.when(F.pmod("turn", F.lit(3)) == 0, plain).otherwise(record("user", parts))).when(F.col("role") == "assistant", record("assistant", said)).otherwise(other)
    place = [F.concat(F.lit("p"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("folder"), uid.alias("name")]
    lines = talk.where(F.col("turn") < most_turns).select(*place, (F.col("turn") + 10).alias("at"), value.alias("value"))
    first = talk.select("conv_id").distinct()
    for at, v in ((1, F.concat(F.lit('{"type":"summary","sessionId":"'), uid, F.lit('","cwd":"'), cwd, F.lit('"}'))), (2, F.lit("")), (3, F.lit('{"type": "user", "message'))):
        lines = lines.unionByName(first.select(*place, F.lit(at).cast("long").alias("at"), v.alias("value")))
    return lines


def rollout_lines(talk: DataFrame) -> DataFrame:
    """Format B: a rollout of messages, reasoning and calls for each conversation."""
    uid = F.concat(F.lit("b-"), F.col("conv_id").cast("string"))
    ts = _at(F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    place = [F.lit("sessions/2024").alias("folder"), F.concat(F.lit("rollout-"), uid).alias("name")]

    def item(payload: Column) -> Column:
        return F.concat(F.lit('{"type":"response_item","timestamp":"'), ts, F.lit('","payload":'), payload, F.lit("}"))

    message = F.to_json(F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), F.array(F.struct(F.col("text").alias("text"))).alias("content")))
    reason = F.lit('{"type":"reasoning","summary":[{"text":"s"}],"content":[{"text":"c"}]}')
    call = F.to_json(F.struct(F.lit("function_call").alias("type"), F.lit("f").alias("name"), F.concat(F.col("turn").cast("string"), F.repeat(F.lit("ab"), 700)).alias("arguments")))
    output = F.to_json(F.struct(F.lit("function_call_output").alias("type"), F.concat(F.lit("out "), F.col("turn").cast("string")).alias("output")))
    first = talk.select("conv_id").distinct()
    meta = F.concat(F.lit('{"type":"session_meta","timestamp":"2024-02-01T00:00:00Z","payload":{"id":"'), uid, F.lit('","cwd":"/v"}}'))
    out = first.select(*place, F.lit(0).cast("long").alias("at"), meta.alias("value"))
    assistant = F.col("role") == "assistant"
    for k, (payload, where) in enumerate(((message, F.lit(True)), (reason, assistant), (call, assistant), (output, assistant))):
        out = out.unionByName(talk.where(where).select(*place, (F.col("turn") * 4 + 1 + k).alias("at"), item(payload).alias("value")))
    return out


def history_lines(talk: DataFrame) -> DataFrame:
    """Format B's history: known sessions, unknown ones twice, and texts that nobody said."""
    k = F.col("conv_id").cast("string")
    line = lambda uid, ts, text: F.to_json(F.struct(uid.alias("session_id"), ts.alias("ts"), text.alias("text")))
    first = talk.select("conv_id").distinct()
    out = None
    for n, (uid, text) in enumerate((("b-", "known "), ("h-", "hist "), ("h-", "later "), ("n-", "<permissions instructions> "))):
        rows = first.select(F.lit(".").alias("folder"), F.lit("history").alias("name"), (F.col("conv_id") * 4 + n).alias("at"), line(F.concat(F.lit(uid), k), F.lit(START) + F.col("conv_id") + n, F.concat(F.lit(text), k)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def composer_stores(talk: DataFrame, root: str, rows: int = STORE_ROWS) -> str:
    """Format C: SQLite stores of composers and bubbles, one in each of as many homes as there are ``rows`` turns, and three workspaces in each that list them.

    A store is one file, so one task writes it, from rows in order; many tasks write many. Gives a pattern of all homes.
    """
    spark = talk.sparkSession
    homes = 1 + talk.count() // rows
    own = talk.withColumn("home", F.pmod(F.xxhash64("conv_id"), F.lit(homes)).cast("int"))
    # One partition for each home and not one more: hashes of homes would put several into a task.
    ordered = own.repartitionByRange(homes, "home").sortWithinPartitions("home", "conv_id", "turn").select("home", "conv_id", "turn", "role", "text")
    ship(spark)
    direct = by_ranges(root)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for home, of_home in groupby(turns, lambda r: r[0]):
            with tempfile.TemporaryDirectory() as d:
                for name, path in _home(Path(d), of_home).items():
                    data = None
                    if direct:
                        store, top = store_of(root)
                        to = f"{top}/home-{home}/{name}"
                        store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                        with path.open("rb") as f:
                            put(store, to, iter(lambda f=f: f.read(1 << 20), b""))
                    else:
                        data = path.read_bytes()
                    yield pa.RecordBatch.from_pydict({"path": [f"{root}/home-{home}/{name}"], "content": pa.array([data], pa.binary())})

    made = ordered.mapInArrow(step, "path string, content binary")
    if direct:
        made.agg(F.count("path")).collect()
    else:  # only Spark opens the store, so the driver puts one file after the other there
        for r in made.toLocalIterator():
            fs, to = file_system(spark, r["path"])
            out = fs.create(to)
            out.write(r["content"])
            out.close()
    return f"{root}/home-*"


def _home(local: Path, turns: Iterator[tuple]) -> dict[str, Path]:
    """The files of a home, by their names in it, of turns (home, conversation, turn, role, text) in order."""
    known: list[int] = []
    with sqlite3.connect(local / "global.db") as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT, value BLOB)")
        for k, of_talk in groupby(turns, lambda r: r[1]):
            heads = []
            for _, _, t, role, text in of_talk:
                heads.append({"bubbleId": f"b{t}", "type": 1 if role == "user" else 2})
                bubble = ({"text": text}, {"text": " ", "content": text}, {"toolFormerData": {"tool": "grep", "args": {"q": t}}})[t % 3]
                db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", (f"bubbleId:c-{k}:b{t}", json.dumps(bubble)))
            data = {"fullConversationHeadersOnly": heads, "createdAt": (START + k) * 1000 + 500, "lastUpdatedAt": (START + 2 * k) * 1000, "name": f"N{k}" if k % 2 else ""}
            if k % 5 == 0:
                data["latestConversationSummary"] = {"summary": {"summary": f"pre <previous_user_message>hello {k}</previous_user_message><attached_files>x</attached_files>"}}
            db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", (f"composerData:c-{k}", json.dumps(data)))
            known.append(k)
    made = {"globalStorage/state.vscdb": local / "global.db"}
    for w in range(3):
        with sqlite3.connect(local / f"w{w}.db") as db:
            db.execute("CREATE TABLE ItemTable (key TEXT, value BLOB)")
            db.execute("INSERT INTO ItemTable VALUES ('composer.composerData', ?)", (json.dumps({"allComposers": [{"composerId": f"c-{k}"} for k in known if k % 3 == w]}),))
        (local / f"w{w}.json").write_text(json.dumps({"folder": f"file:///home/my%20{w}"} if w else {"configuration": "vscode-remote://x"}))
        made |= {f"workspaceStorage/w{w}/state.vscdb": local / f"w{w}.db", f"workspaceStorage/w{w}/workspace.json": local / f"w{w}.json"}
    return made


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/transcripts-{uuid.uuid4().hex}"


def _roots(spark: SparkSession, sf_dir: str, *agents: str) -> dict[str, str]:
    talk, place = _talk(spark, sf_dir), _place(spark)
    made: dict[str, Callable[[], str]] = {
        "claude_code": lambda: _files(session_lines(talk), f"{place}/a"),
        "codex": lambda: _files(rollout_lines(talk).unionByName(history_lines(talk)), f"{place}/b"),
        "cursor": lambda: composer_stores(talk, f"{place}/c"),
    }
    return {a: made[a]() for a in agents}


def _messages(tables: Tables) -> DataFrame:
    return tables.messages.join(tables.sessions.select("session_id", "agent", "session_uid"), "session_id").select("agent", "session_uid", "ordinal", "role", "ts", "content")


def source_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(ingest(spark, _roots(spark, sf_dir, "claude_code")))


def source_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(ingest(spark, _roots(spark, sf_dir, "codex")))


def source_composers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(ingest(spark, _roots(spark, sf_dir, "cursor")))


def source_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest(spark, _roots(spark, sf_dir, "claude_code", "codex", "cursor")).sessions
    return found.select("agent", "session_uid", "workspace", "title", "summary", "started_at", "ended_at")


def source_grown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of format A as they were after two turns, and again when they are whole."""
    talk, root = _talk(spark, sf_dir), f"{_place(spark)}/a"
    first = ingest(spark, {"claude_code": _files(session_lines(talk, 2), root)})
    return _messages(ingest(spark, {"claude_code": _files(session_lines(talk), root)}, first))


def source_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream of lines: as they were after two turns, when they are whole, and one in seven written anew with one turn and then whole."""
    talk, place = _talk(spark, sf_dir), _place(spark)
    root, work = f"{place}/a", f"{place}/stream"
    for lines in (session_lines(talk, 2), session_lines(talk), session_lines(talk.where("conv_id % 7 = 0"), 1), session_lines(talk.where("conv_id % 7 = 0"))):
        streamed.follow(spark, "claude_code", _files(lines, root), f"{work}/table", f"{work}/mark", range_bytes=1 << 20)
    return streamed.messages(spark, "claude_code", f"{work}/table").select("agent", "session_uid", "ordinal", "role", "ts", "content")


def source_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by an index that the ingest keeps: of the files after two turns, and of what they have become."""
    talk, place = _talk(spark, sf_dir), _place(spark)
    root, index = f"{place}/a", SearchIndex(spark, f"{place}/index", stems=False)
    first = ingest(spark, {"claude_code": _files(session_lines(talk, 2), root)}, index=index)
    whole = ingest(spark, {"claude_code": _files(session_lines(talk), root)}, first, index=index)
    hits = index.word_hits('"the"').join(whole.messages.select("mid", "session_id", "ordinal"), "mid").join(whole.sessions.select("session_id", "session_uid"), "session_id")
    return hits.select("session_uid", "ordinal", F.round("score", 6).alias("score"))


def source_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next ingest would do with each file after a third of them has grown."""
    talk, root = _talk(spark, sf_dir), f"{_place(spark)}/a"
    first = ingest(spark, {"claude_code": _files(session_lines(talk, 1), root)}, redact=False)
    _files(session_lines(talk.where("conv_id % 3 = 0")), root)
    decided = merge.decide(files.listing(spark, f"{root}/*/*.jsonl"), first.state)
    grown = F.when(F.col("offset") > 0, "resumed").otherwise("from the start")
    return decided.select(F.regexp_extract("source_path", r"/(a-\d+)\.jsonl$", 1).alias("session_uid"), "action", F.when(F.col("action") == "resume", grown).alias("begin"))


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest of all sources says of itself, but for how long it took."""
    report: list[dict] = []
    ingest(spark, _roots(spark, sf_dir, "claude_code", "codex", "cursor"), redact=False, report=report)
    return spark.createDataFrame(report, "source string, sessions long, offered long, errors long, seconds double").drop("seconds")


def source_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ingest(spark, _roots(spark, sf_dir, "claude_code", "codex"), redact=False)
    return sessions.doctor(tables.sessions, tables.messages, now=START + 10_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (source_session_files, source_rollouts, source_composers, source_sessions, source_grown_files, source_streamed, source_indexed, source_decisions, source_report, source_doctor)}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(13)"
_WHEN = f"{START} + conv_id * 3600 + turn * 60"
_A = f"""a_all AS (
SELECT conv_id, turn, 0 AS sub, 'user' AS role, CASE WHEN turn % 3 = 0 THEN text ELSE '[tool_result id=toolu_012345] ' || text || chr(10) || 'next' END AS content FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn, 0, 'assistant', trim(text, {_BLANK}) || chr(10) || '[tool_use name=run] {{"a":"\\u003ck\\u003e","b":' || turn || '}}' FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 1, 'thinking', 'why ' || turn FROM conversations WHERE role = 'assistant'),
a AS (SELECT 'claude_code' AS agent, 'a-' || conv_id AS session_uid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1 AS INTEGER) AS ordinal, role, {_WHEN} AS ts, content, conv_id FROM a_all)"""
_B = f"""b_all AS (
SELECT conv_id, turn, 0 AS sub, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')
UNION ALL SELECT conv_id, turn, 1, 'thinking', 's' || chr(10) || 'c' FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 2, 'tool', '[tool_call name=f] ' || substr(turn || repeat('ab', 700), 1, 1024) FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 3, 'tool', '[tool_result] out ' || turn FROM conversations WHERE role = 'assistant'),
b AS (SELECT 'codex' AS agent, 'b-' || conv_id AS session_uid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1 AS INTEGER) AS ordinal, role, {_WHEN} AS ts, content, conv_id FROM b_all
UNION ALL SELECT 'codex', 'h-' || conv_id, 0, 'user', {START} + conv_id + 1, 'hist ' || conv_id, NULL FROM (SELECT DISTINCT conv_id FROM conversations))"""
_C = f"""c AS (SELECT 'cursor' AS agent, 'c-' || conv_id AS session_uid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, CAST(NULL AS BIGINT) AS ts,
  CASE WHEN turn % 3 = 2 THEN '[tool name=grep args={{"q":' || turn || '}}]' ELSE trim(text, {_BLANK}) END AS content, conv_id FROM conversations)"""
_OUT = "agent, session_uid, ordinal, role, ts, content"
_FIRST_LINE = "CASE WHEN length(split_part(t, chr(10), 1)) > 200 THEN substr(split_part(t, chr(10), 1), 1, 200) || '…' ELSE split_part(t, chr(10), 1) END"

ORACLE_SQL: dict[str, str] = {
    "source_session_files": f"WITH {_A} SELECT {_OUT} FROM a",
    "source_grown_files": f"WITH {_A} SELECT {_OUT} FROM a",
    "source_streamed": f"WITH {_A} SELECT {_OUT} FROM a",
    "source_indexed": f"""WITH {_A}, w AS (SELECT session_uid, ordinal, list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM a),
s AS (SELECT session_uid, ordinal, len(w) AS size, len(list_filter(w, lambda x: x = 'the')) AS f FROM w), t AS (SELECT count(*) AS r, avg(size) AS m, count(*) FILTER (WHERE f > 0) AS n FROM s)
SELECT session_uid, ordinal, round(-greatest(ln((r - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / m)), 6) AS score FROM s, t WHERE f > 0""",
    "source_rollouts": f"WITH {_B} SELECT {_OUT} FROM b",
    "source_composers": f"WITH {_C} SELECT {_OUT} FROM c",
    "source_sessions": f"""WITH {_A}, {_B}, {_C}, m AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
s AS (SELECT agent, session_uid, max(conv_id) AS k, arg_min(content, ordinal) FILTER (WHERE role = 'user') AS t, arg_min(ts, ordinal) AS first_ts, arg_max(ts, ordinal) AS last_ts FROM m GROUP BY 1, 2)
SELECT agent, session_uid, CASE WHEN agent = 'claude_code' THEN '/p/' || (k % 3) WHEN session_uid LIKE 'b-%' THEN '/v' WHEN agent = 'codex' THEN '' WHEN k % 3 = 0 THEN 'vscode-remote://x' ELSE '/home/my ' || (k % 3) END AS workspace,
CASE WHEN agent = 'cursor' AND k % 2 = 1 THEN 'N' || k WHEN agent = 'codex' THEN coalesce(substr(t, 1, 200), '') ELSE coalesce({_FIRST_LINE}, '') END AS title,
CASE WHEN agent = 'cursor' AND k % 5 = 0 THEN 'User: hello ' || k ELSE '' END AS summary,
CASE WHEN agent = 'cursor' THEN {START} + k WHEN session_uid LIKE 'b-%' THEN 1706745600 ELSE first_ts END AS started_at, CASE WHEN agent = 'cursor' THEN {START} + 2 * k ELSE last_ts END AS ended_at FROM s""",
    # A file whose first turn was by the system has given no message yet, so it is read from its start.
    "source_decisions": "SELECT 'a-' || conv_id AS session_uid, CASE WHEN conv_id % 3 = 0 THEN 'resume' ELSE 'skip' END AS action, CASE WHEN conv_id % 3 <> 0 THEN NULL WHEN arg_min(role, turn) = 'system' THEN 'from the start' ELSE 'resumed' END AS \"begin\" FROM conversations GROUP BY conv_id",
    "source_report": f"""WITH {_A}, {_B}, {_C}, n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations)
SELECT 'claude_code' AS source, count(DISTINCT session_uid) AS sessions, count(*) AS offered, (SELECT n FROM n) AS errors FROM a
UNION ALL SELECT 'codex', count(DISTINCT session_uid), count(*), 0 FROM b WHERE session_uid LIKE 'b-%' UNION ALL SELECT 'cursor', count(DISTINCT session_uid), count(*), 0 FROM c UNION ALL SELECT 'history', count(DISTINCT session_uid), count(*), 0 FROM b WHERE session_uid LIKE 'h-%'""",
    "source_doctor": f"""WITH {_A}, {_B}, m AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT agent, count(DISTINCT session_uid) AS sessions, count(*) AS messages, max(ts) AS latest, {START} + 10000000 - max(ts) AS age, {START} + 10000000 - max(ts) > 1800 AS stale FROM m GROUP BY 1""",
}
