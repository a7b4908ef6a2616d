"""Executors get this package's code from the driver, whatever folder they were started in."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from loomsearch.functions.text import compact_json_text
from loomsearch.model import Corpus, Query
from loomsearch.operators.index import SearchIndex
from loomsearch.operators.redact import Redactor
from loomsearch.operators.search import search
from loomsearch.sources.ingest import ingest

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
messages = spark.createDataFrame([(1, 1, 0, "user", 5, "harvested barns")], "mid long, session_id long, ordinal int, role string, ts long, content string")
sessions = spark.createDataFrame([(1, "codex", "u1", "", "", "", 5, 5)], "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long")
print(search(Corpus(sessions, messages), Query("harvesting")).count(), SearchIndex(spark, "index").add(messages).word_hits("barn").count())
print(messages.select(Redactor().column("content").alias("c"), compact_json_text("content")).first()["c"])
print(ingest(spark, {{"claude_code": "transcripts"}}).messages.count())
"""


def test_the_driver_alone_has_the_package_on_its_path(tmp_path):
    (tmp_path / "transcripts/p").mkdir(parents=True)
    (tmp_path / "transcripts/p/u.jsonl").write_text('{"type":"user","sessionId":"s","message":{"role":"user","content":"hello"}}\n')
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split("\n")[-4:-1] == ["1 1", "harvested barns", "1"]
