"""The queries opN_ over the driver's smallest tables: their contracts, by brute force or by their SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomsearch.llm import neardup, queries
from loomsearch.llm.decontamination import words_of

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (Tokenizer.from_file(str(public_tokenizers.path(f"{n}.json"))) for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def run(spark):
    def rows(name):
        return queries.queries()[next(n for n in queries.queries() if n.startswith(name + "_"))](spark, SF)

    return rows


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def ids_of(library, text):
    return np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")


def test_op1(run, texts):
    rows = run("op1").collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op2(run, texts):
    by_doc, places = {}, {}
    for r in run("op2").collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for k, pieces in by_doc.items():
        ids, at = ids_of(BYTES, texts[k]), 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // 1024)
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    tokens = sum(len(ids_of(BYTES, t)) for t in texts.values())
    assert len(places) <= 1.02 * tokens / 1024 + 1


@pytest.mark.parametrize("name", ["op3", "op8"])
def test_those_that_sql_can_say(run, name):
    found = run(name)
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        said = db.execute(next(sql for n, sql in queries.oracle_sql().items() if n.startswith(name)))
        columns = [d[0] for d in said.description]
        want = sorted(said.fetchall(), key=repr)
    assert sorted(found.columns) == sorted(columns) and sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == want
    if name == "op3":
        row = next(r for r in want if r[0] == -1)
        assert row[columns.index("n_turns")] == 2 and row[columns.index("loss_chars")] == len("</s>[INST] ok [/INST]")


def test_op4(run, texts):
    rows = run("op4").collect()
    sizes, slots, shards = [0] * 8, {}, {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) for t in texts.values())


def test_op5(run, texts):
    table, keys = neardup.Words(), sorted(texts)
    runs = {k: table.kmers(words_of(texts[k])) for k in keys}
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and (texts[a] == texts[b] or len(runs[a]) and len(runs[b]) and neardup.aligned(runs[a], runs[b])):
                parent[root(a)] = root(b)
    found, kept = {}, {}
    for r in run("op5").collect():
        found.setdefault(r["class_id"], set()).add(r["doc_id"])
        kept[r["class_id"]] = kept.get(r["class_id"], 0) + r["kept"]
    want = {}
    for k in keys:
        want.setdefault(root(k), set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and set(kept.values()) == {1}


def test_op6(run, texts):
    for r in run("op6").collect():
        n = len(BYTES.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_op7(run, texts):
    rows = {r["doc_id"]: r for r in run("op7").collect()}
    assert {k: r["n_words"] for k, r in rows.items()} == {k: len(words_of(t)) for k, t in texts.items()}
    assert all(r["log_prob"] <= 0 for r in rows.values()) and all(np.isclose(r["mean_log_prob"] * r["n_words"], r["log_prob"]) for r in rows.values() if r["n_words"])


def test_op9(run, texts):
    at = 0
    for r in sorted(run("op9").collect(), key=lambda r: r["doc_id"]):
        ids = ids_of(WORDS, texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op10(run, spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found, hit = {}, 0
    for r in run("op10").orderBy("query_id", "rank").collect():
        assert np.isclose(r["score"], np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum()), rtol=1e-12)
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == {k for k in x if k % 100 == 0}
    for q, near in found.items():
        assert [n for n, _, _ in near] == list(range(1, 11)) and [n[1:] for n in near] == sorted(n[1:] for n in near)
        want = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), k) for k, v in x.items() if k != q)[:10]
        hit += len({k for _, k in want} & {k for _, _, k in near})
    assert hit >= 0.9 * 10 * len(found)


def test_op11(run, texts):
    rows = {r["doc_id"]: r for r in run("op11").collect()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        ids = BYTES.encode(texts[k], add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(BYTES.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_op13(run, spark):
    rows = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)).astype(np.int64) + 1_000_000 for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    once = np.unique(np.array(list(rows.values())), axis=0)
    n, s = len(once), once.sum(axis=0)
    values, directions = np.linalg.eigh(np.cov((once - s / n).T, bias=True))
    values, directions = values[::-1], directions[:, ::-1]
    found = run("op13").toPandas()
    assert len(found) == 16 * len(rows) and set(found.n) == {n} and found.identity_error.max() < 1e-9 and found.identity_error.nunique() == 1
    for k, own in found.groupby("component"):
        x = np.array([rows[v] for v in own.vec_id])
        assert own.deviation.tolist() == ((n * x - s) ** 2).sum(axis=1).tolist()
        assert np.allclose(own.explained, values[k - 1] / values.sum(), rtol=1e-10)
        want = (x - s / n) @ directions[:, k - 1] / np.sqrt(values[k - 1])
        assert np.abs(own.whitened * np.sign(own.whitened.iloc[0] * want[0]) - want).max() < 1e-7


def test_op12(run, texts):
    from test_alignment import brute_force

    keys = sorted(texts)
    want = {k: (*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for k, r in zip(keys, brute_force([texts[k] for k in keys]), strict=True)}
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in run("op12").collect()} == want
