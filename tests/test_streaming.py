"""Streamed ingest: replays, runs that stop half-way, and which buckets are rewritten."""

import json

import pytest

from loomsearch.storage import shared_dir
from loomsearch.streaming import ingest
from loomsearch.streaming.ingest import current, ingest_available, ingest_every, merge_batch

SCHEMA = "id long, g long, v double"


def rows(spark, ids, g=0):
    return spark.createDataFrame([(k, g, float(k)) for k in ids], SCHEMA)


def content(spark, table):
    return sorted(tuple(r) for r in current(spark, table).collect())


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    merge = merge_batch(table, ["id"], "v", 4)
    assert current(spark, table) is None
    for number, batch in enumerate((rows(spark, range(8)), rows(spark, range(5, 12), 1), rows(spark, range(3), 2))):
        merge(batch, number)
        once = content(spark, table)
        merge(batch, number)
        assert content(spark, table) == once
    assert [(k, g) for k, g, _ in content(spark, table)] == [(k, int(k >= 8)) for k in range(12)]


def test_an_earlier_batch_that_runs_again_starts_from_what_was_before_it(spark, tmp_path):
    table = str(tmp_path / "t")
    merge = merge_batch(table, ["id"], "v", 4)
    merge(rows(spark, range(4)), 0)
    merge(rows(spark, range(4, 8)), 1)
    merge(rows(spark, range(4)), 0)
    merge(rows(spark, range(4, 8)), 1)
    assert [k for k, _, _ in content(spark, table)] == list(range(8))


@pytest.mark.parametrize("stop", ["_buckets", "_commit", "_forget"])
def test_a_run_that_stops_half_way_is_made_good_by_the_next(spark, tmp_path, monkeypatch, stop):
    """Stopped after its rows were written, before its commit, and after it."""
    table = str(tmp_path / "t")
    merge = merge_batch(table, ["id"], "v", 4)
    merge(rows(spark, range(6)), 0)
    before = content(spark, table)

    def lost(*args):
        raise ConnectionError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, stop, lost)
        with pytest.raises(ConnectionError):
            merge(rows(spark, range(4, 9), 1), 1)
    if stop != "_forget":
        assert content(spark, table) == before
    merge(rows(spark, range(4, 9), 1), 1)
    assert [(k, g) for k, g, _ in content(spark, table)] == [(k, int(k > 5)) for k in range(9)]


def test_only_touched_buckets_are_rewritten_and_old_folders_go(spark, tmp_path):
    table = tmp_path / "t"
    merge = merge_batch(str(table), ["id"], "v", 16)
    merge(rows(spark, range(200)), 0)
    first = json.loads((table / "pointer-0").read_text())["folders"]
    for number in range(1, 6):
        merge(rows(spark, [1000 + number]), number)
    last = json.loads((table / "pointer-5").read_text())["folders"]
    assert len(first) == 16 and sum(first[b] != last[b] for b in first) <= 5
    assert not (table / "pointer-0").exists() and len(list(table.glob("pointer-*"))) == ingest.KEPT
    assert len(content(spark, str(table))) == 205
    merge(rows(spark, []), 6)
    assert len(content(spark, str(table))) == 205


def test_available_files_and_a_query_that_goes_on(spark, tmp_path):
    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    df = rows(spark, range(40))
    df.where("id < 25").repartition(3).write.parquet(src)
    assert ingest_available(spark, src, df.schema, table, mark, ["id"], "v", 1).count() == 25
    df.where("id >= 20").write.mode("append").parquet(src)
    query = ingest_every(spark, src, df.schema, table, mark, ["id"], "v", "1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        query.awaitTermination()
    assert [k for k, _, _ in content(spark, table)] == list(range(40))


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://head:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)
    assert shared_dir(spark) == shared_dir(spark)
