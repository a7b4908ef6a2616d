"""Transcript files and stores are written and listed by tasks, however many there are."""

import pytest

from loomsearch.plans import transcripts
from loomsearch.sources import files
from loomsearch.sources.ingest import ingest


def talk(spark, n):
    rows = [(k, t, ("user", "assistant")[t % 2], f"text {k} {t}") for k in range(n) for t in range(4)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def tasks_of(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        found = run()
    finally:
        sc._jsc.clearJobGroup()
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return found, sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_files_are_written_by_tasks_and_listed_by_few(spark, tmp_path, monkeypatch):
    rows = talk(spark, 60)
    with monkeypatch.context() as m:
        m.setattr(transcripts, "file_system", lambda *_: pytest.fail("the driver moves a file"))
        root = transcripts._files(transcripts.session_lines(rows), str(tmp_path / "a"))
    made = sorted(p.relative_to(root).as_posix() for p in (tmp_path / "a").rglob("*") if p.is_file())
    assert [p for p in made if not p.rsplit("/", 1)[-1].startswith(".")] == sorted(f"p{k % 3}/a-{k}.jsonl" for k in range(60))
    said = (tmp_path / "a/p1/a-1.jsonl").read_text().split("\n")
    assert len(said) == 8 and said[1] == "" and "text 1 3" in said[6] and said[7] == ""
    found, tasks = tasks_of(spark, "listed", lambda: files.listing(spark, f"{root}/*/*.jsonl").collect())
    assert len(found) == 60 and tasks < 30  # a task for each file before
    assert sorted(r["source_path"].split("/a/")[1] for r in found) == sorted(f"p{k % 3}/a-{k}.jsonl" for k in range(60))
    transcripts._files(transcripts.session_lines(rows.where("conv_id = 1"), 1), root)
    assert len((tmp_path / "a/p1/a-1.jsonl").read_text().split("\n")) == 5 and len(made) == sum(p.is_file() for p in (tmp_path / "a").rglob("*"))


def test_a_pattern_has_the_files_of_its_own_depth(spark, tmp_path):
    for name in ("top.jsonl", "p/x.jsonl", "p/_y.jsonl", "p/x.txt", "p/deep/no.jsonl", "p{q}/w x.jsonl", "k=1/v.jsonl", "_h/a.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    found = files.listing(spark, f"{tmp_path}/*/*.jsonl").collect()
    assert sorted(r["source_path"].split(f"{tmp_path}/")[1] for r in found) == ["_h/a.jsonl", "k=1/v.jsonl", "p/x.jsonl", "p{q}/w x.jsonl"]
    assert {r["size"] for r in found} == {3}


def test_composers_are_in_as_many_stores_as_they_need_and_no_store_is_held(spark, tmp_path, monkeypatch):
    rows = talk(spark, 40)
    roots = transcripts.composer_stores(rows, str(tmp_path / "c"), 50)
    stores = list((tmp_path / "c").glob("home-*/globalStorage/state.vscdb"))
    assert 2 <= len(stores) <= 4
    plan = files.key_values(files._binary(spark, f"{roots}/globalStorage/state.vscdb", False, None), "cursorDiskKV")._jdf.queryExecution().toString()
    assert "content" not in plan
    t = ingest(spark, {"cursor": roots}, redact=False)
    found = sorted((r["session_uid"], r["workspace"], r["ordinal"], r["content"]) for r in t.messages.join(t.sessions, "session_id").select("session_uid", "workspace", "ordinal", "content").collect())
    place = ("vscode-remote://x", "/home/my 1", "/home/my 2")
    want = sorted((f"c-{k}", place[k % 3], i, f"[tool name=grep args={{\"q\":{i}}}]" if i % 3 == 2 else f"text {k} {i}") for k in range(40) for i in range(4))
    assert found == want
    with monkeypatch.context() as m:  # and so in stores that only Spark opens
        m.setattr(transcripts, "by_ranges", lambda _: False)
        m.setattr(files, "by_ranges", lambda _: False)
        again = transcripts.composer_stores(rows, f"file:{tmp_path}/d", 50)
        t = ingest(spark, {"cursor": again}, redact=False)
        assert t.messages.count() == len(want) and t.sessions.count() == 40
