"""What a worker holds of an Arrow batch as Python objects does not grow with the batch."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from loomsearch.functions.porter import stem
from loomsearch.functions.text import stem_lists, stemmed
from loomsearch.operators.redact import Redactor
from loomsearch.operators.redact_rules import GENERIC_TOKEN
from loomsearch.storage import in_parts


def peak(run):
    tracemalloc.start()
    try:
        found = run()
        return found, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_stems_are_made_of_distinct_words(spark):
    words = ["running", "ponies", "é", "nation", "x"]
    lists = pa.array([[*words], None, [], words[:2] * 3], pa.list_(pa.string()))
    want = [None if r is None else [stem(w) for w in r] for r in lists.to_pylist()]
    assert stem_lists(lists).to_pylist() == want and stem_lists(lists.slice(1, 3)).to_pylist() == want[1:] and stem_lists(lists.slice(0, 0)).to_pylist() == []
    found, mb = peak(lambda n=pa.array([[f"{w}{k % 7}" for w in words * 60] for k in range(3000)], pa.list_(pa.string())): stem_lists(n))
    assert len(found.flatten()) == 900_000 and mb < 5  # about 100 as Python lists
    df = spark.createDataFrame([(r,) for r in lists.to_pylist()], "w array<string>")
    assert [r["s"] for r in df.select(stemmed(F.col("w")).alias("s")).collect()] == want


def test_texts_are_redacted_part_by_part(spark):
    secret = f'token = "{"0a" * 20}"'
    redactor = Redactor([GENERIC_TOKEN])
    texts = pa.array([f"{k} {secret} " + "é" * 5000 if k % 3 else None for k in range(3000)], pa.string())
    found, mb = peak(lambda: in_parts(redactor.redact, pa.string())(texts))
    assert found.to_pylist() == [None if t is None else redactor.redact(t) for t in texts.to_pylist()] and mb < 6  # about 30 as Python strings
    rows = [(None,), ("",), (secret,), ("plain",)]
    out = spark.createDataFrame(rows, "t string").select(redactor.column(F.col("t")).alias("r"), redactor.flag(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in out] == [False, False, True, False] and [r["r"] for r in out] == [None, "", 'token = "[REDACTED:generic-token]"', "plain"]
