"""Lines by byte ranges: every line once, whatever the cuts; files that grow, and streams of them."""

import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.sources import ranges


def whole_lines(data, begin=0):
    out, at = [], begin
    while (end := data.find(b"\n", at)) >= 0:
        out.append((at, data[at:end]))
        at = end + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=9).map(lambda b: b.replace(b"\n", b"")), max_size=12), st.booleans(), st.integers(1, 30), st.integers(0, 12))
def test_every_line_is_in_one_range(parts, ended, most, skipped):
    data = b"\n".join(parts) + (b"\n" if ended and parts else b"")
    begin = ([0] + [a + len(x) + 1 for a, x in whole_lines(data)])[: skipped + 1][-1]
    found = []
    for part in ranges.cut([("f", begin, len(data))], most):
        for _, first, start, end in part.parts:
            found += ranges.lines_in(io.BytesIO(data), first, start, end)
    assert found == whole_lines(data, begin)


@pytest.mark.parametrize("most", [7, 40, 1000])
def test_lines_that_are_too_long_are_null(monkeypatch, most):
    monkeypatch.setattr(ranges, "LONGEST_LINE", 20)
    monkeypatch.setattr(ranges, "CHUNK", 8)
    data = b"ab\n" + b"x" * 20 + b"\n" + b"y" * 21 + b"\n" + b"z" * 300 + b"\nlast\nunfinished"
    found = [line for r in ranges.cut([("f", 0, len(data))], most) for _, first, a, b in r.parts for _, line in ranges.lines_in(io.BytesIO(data), first, a, b)]
    assert found == [b"ab", b"x" * 20, None, None, b"last"]


def test_small_files_share_a_range_and_large_ones_are_cut():
    cut = ranges.cut([("a", 0, 10), ("b", 5, 10), ("c", 0, 95), ("d", 3, 3)], 40)
    assert [[p[0] for p in r.parts] for r in cut] == [["a", "b"], ["c"], ["c"], ["c"]]
    assert sum(b - a for r in cut for _, _, a, b in r.parts) == 110


def test_a_large_file_is_read_by_many_tasks_and_a_grown_one_from_its_offset(spark, tmp_path):
    path = tmp_path / "odd name é.jsonl"
    data = b"".join(b"%d %s\n" % (k, b"t" * (k % 50)) for k in range(3000))
    path.write_bytes(data + b"no end")
    df = ranges.read_lines(spark, [(str(path), 0, path.stat().st_size)], 10_000)
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // 10_000)
    assert sorted((r["source_offset"], bytes(r["line"])) for r in df.collect()) == whole_lines(data)
    path.write_bytes(data + b"no end, now one\nmore\n")
    grown = ranges.read_lines(spark, [(f"file:{path}", len(data), path.stat().st_size)]).collect()
    assert [(r["source_path"], r["source_offset"], bytes(r["line"])) for r in grown] == [(f"file:{path}", len(data), b"no end, now one"), (f"file:{path}", len(data) + 16, b"more")]


def streamed(spark, folder, mark, out):
    query = ranges.stream_lines(spark, str(folder), range_bytes=64).writeStream.format("parquet").option("checkpointLocation", str(mark)).trigger(availableNow=True).start(str(out))
    query.awaitTermination()
    return sorted((r["source_path"].rsplit("/", 1)[-1], r["source_offset"], bytes(r["line"] or b"")) for r in spark.read.schema(ranges.SCHEMA).parquet(str(out)).collect())


def test_a_stream_gives_each_line_when_its_end_is_there(spark, tmp_path):
    folder, mark, out = tmp_path / "in", tmp_path / "mark", tmp_path / "out"
    (folder / "p").mkdir(parents=True)
    a, b = folder / "p/a.jsonl", folder / "b.jsonl"
    a.write_bytes(b"one\ntwo\nthr")
    (folder / "other.txt").write_bytes(b"no\n")
    first = [("a.jsonl", 0, b"one"), ("a.jsonl", 4, b"two")]
    assert streamed(spark, folder, mark, out) == first
    with a.open("ab") as f:
        f.write(b"ee\n")
    b.write_bytes(b"".join(b"line %d\n" % k for k in range(40)))
    second = sorted([*first, ("a.jsonl", 8, b"three"), *(("b.jsonl", at, x) for at, x in whole_lines(b.read_bytes()))])
    assert streamed(spark, folder, mark, out) == second
    assert streamed(spark, folder, mark, out) == second
    a.write_bytes(b"new\n")
    assert streamed(spark, folder, mark, out) == sorted([*second, ("a.jsonl", ranges.ANEW, b""), ("a.jsonl", 0, b"new")])
