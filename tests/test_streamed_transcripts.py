"""Transcripts as a stream against the batch ingest: files that grow, and files that are written anew; ordinals by state."""

import json
import random

from loomsearch.operators import merge
from loomsearch.sources.ingest import ingest
from loomsearch.streaming import transcripts
from loomsearch.streaming.ingest import current, merge_batch


def line(uid, text, role="user"):
    content = text if role == "user" else [{"type": "text", "text": text}, {"type": "thinking", "thinking": f"why {text}"}]
    return json.dumps({"type": role, "sessionId": uid, "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": content}}) + "\n"


def by_ingest(spark, root):
    t = ingest(spark, {"claude_code": str(root)}, redact=False)
    rows = t.messages.join(t.sessions.select("session_id", "session_uid", "workspace"), "session_id")
    return sorted((r["session_uid"], r["ordinal"], r["role"], r["content"], r["workspace"]) for r in rows.collect())


def by_stream(spark, root, work):
    transcripts.follow(spark, "claude_code", str(root), str(work / "table"), str(work / "mark"), buckets=4, range_bytes=300)
    rows = transcripts.messages(spark, "claude_code", str(work / "table"))
    return sorted((r["session_uid"], r["ordinal"], r["role"], r["content"], r["workspace"]) for r in rows.collect())


def test_a_stream_of_files_gives_what_the_ingest_gives(spark, tmp_path):
    root = tmp_path / "in"
    (root / "p").mkdir(parents=True)
    for k in range(6):
        (root / f"p/f{k}.jsonl").write_text("{broken\n" + "".join(line(f"s{k}", f"text {k} {n}", ("user", "assistant")[n % 2]) for n in range(k + 1)))
    assert by_stream(spark, root, tmp_path) == by_ingest(spark, root)
    with (root / "p/f3.jsonl").open("a") as f:
        f.write(line("s3", "and more") + line("s3", "no end")[:-1])
    (root / "p/f9.jsonl").write_text(line("s9", "new"))
    grown = by_stream(spark, root, tmp_path)
    assert grown == by_ingest(spark, root) and ("s3", 6, "user", "and more", "/w") in grown
    (root / "p/f5.jsonl").write_text(line("s5", "written anew"))
    (root / "p/f4.jsonl").write_text("")
    shrunk = by_stream(spark, root, tmp_path)
    assert shrunk == by_ingest(spark, root) and [r for r in shrunk if r[0] == "s5"] == [("s5", 0, "user", "written anew", "/w")]
    assert by_stream(spark, root, tmp_path) == shrunk


SCHEMA = "path string, at long, version long, value string, gone boolean"


def content(spark, table):
    return sorted((r["path"], r["at"], r["value"]) for r in current(spark, table).collect())


def test_newer_versions_and_deletes_in_a_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    merged = merge_batch(table, ["path", "at"], "value", 4, version="version", place=["path"], gone="gone")
    batches = [
        [("a", 0, 1, "a0", False), ("a", 1, 1, "a1", None), ("b", 0, 1, "b0", False)],
        [("a", 0, 2, "a0'", False), ("b", 0, 0, "older", False), ("c", 0, 1, "c0", False)],
        [("a", None, None, None, True), ("a", 5, 1, "a5", False), ("x", None, None, None, True)],
        [("c", None, None, None, True)],
    ]
    want = [
        [("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0")],
        [("a", 0, "a0'"), ("a", 1, "a1"), ("b", 0, "b0"), ("c", 0, "c0")],
        [("a", 5, "a5"), ("b", 0, "b0"), ("c", 0, "c0")],
        [("a", 5, "a5"), ("b", 0, "b0")],
    ]
    for number, (rows, expected) in enumerate(zip(batches, want, strict=True)):
        for _ in range(2):  # and once more, as after a run that was lost
            merged(spark.createDataFrame(rows, SCHEMA), number)
            assert content(spark, table) == expected
    merged(spark.createDataFrame(batches[2], SCHEMA), 2)
    assert "gone" not in current(spark, table).columns


MESSAGE = "session_id long, source_path string, source_offset long, sub int, role string, ts long, content string"


def test_ordinals_by_state_are_those_of_the_batch(spark, tmp_path, expiry="30 days"):
    rng = random.Random(3)
    rows = [(k % 3, f"f{k % 3}", k // 3 * 10, s, "user", k, f"m{k}") for k in range(36) for s in range(1 + k % 2)]
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))

    def run():
        stream = transcripts.number_messages(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 2).parquet(src), expiry)
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("session_id", "ordinal", "content").collect())

    first, later = [r for r in rows if r[2] < 60], [r for r in rows if r[2] >= 40]  # what was there before comes again
    for part in (first, later):
        files = [[r for r in part if r[0] == s] for s in rng.sample(range(3), 3)]
        for f in files:
            spark.createDataFrame(rng.sample(f, len(f)), MESSAGE).coalesce(1).write.mode("append").parquet(src)
        found = run()
    whole = merge.assign_ordinals(spark.createDataFrame(rows, MESSAGE))
    assert found == sorted(tuple(r) for r in whole.select("session_id", "ordinal", "content").collect())
    assert run() == found and len({f[:2] for f in found}) == len(rows)
