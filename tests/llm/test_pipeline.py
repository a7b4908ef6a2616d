"""The stages of the corpus pipeline, each against a plain reading of its input, and the whole of it."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomsearch.llm import neardup
from loomsearch.llm.decontamination import words_of

LIBRARY = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, odd_docs, prose):
    """A folder of tables: labelled texts, near and exact copies, benchmark passages, and odd rows with further columns."""
    rng = random.Random(4)
    place = tmp_path_factory.mktemp("tables")
    item = prose(40)
    toxic = [(1000 + k, f"{prose(20)} vilewordone vilewordtwo {prose(20)}") for k in range(60)]
    clean = [(2000 + k, prose(45)) for k in range(160)]
    base = prose(120).split()
    copies = [(3000 + k, " ".join(base[:60] + [f"edit{k}"] + base[61:])) for k in range(4)] + [(3010, " ".join(base))] * 2
    leaks = [(4000, f"{prose(60)} {item} {prose(60)}"), (4001, f"One. {item}"), (4002, " ".join(item.split()[5:12]) + " " + prose(20))]
    rows = [(k, t, "en", "s", len(t)) for k, t in [*toxic, *clean, *copies, *leaks]]
    rng.shuffle(rows)
    own = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as nth", "3 as length", "'x' as key", "0.5 as score", "4 as part", "5 as kept_lang")
    own.unionByName(odd_docs).write.parquet(f"{place}/documents.parquet")
    labels = [(k, int(k < 2000)) for k, _ in toxic + clean] + [(None, 1), (2000, None), (99999, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([("b1", item), (None, None), ("b2", "")], "item_id string, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


@pytest.fixture(scope="module")
def kept(spark, tables, tmp_path_factory):
    """What each stage has returned, written and read again."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], tables).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_all_but_the_last_stage_return_the_columns_of_documents(kept):
    assert all(d.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")] for d in kept[1:-1])


def test_toxic_texts_go_and_all_others_stay(kept):
    want = [r for r in rows(kept[0]) if not (r[0] is not None and 1000 <= r[0] < 2000)]
    assert rows(kept[1]) == want


def test_one_text_of_each_group_of_near_copies_stays(kept):
    table, before, after = neardup.Words(), rows(kept[1]), rows(kept[2])
    runs = [table.kmers(words_of(t)) for _, t in before]
    parent = list(range(len(before)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(before)):
        for b in range(a):
            ta, tb = before[a][1], before[b][1]
            same = ta is not None and ta == tb or (len(runs[a]) and len(runs[b]) and neardup.aligned(runs[a], runs[b]))
            if same:
                parent[root(a)] = root(b)
    groups = {}
    for k, row in enumerate(before):
        groups.setdefault(root(k), []).append(row)
    assert len(after) == len(groups) and all(sum(after.count(x) for x in set(g)) == 1 for g in groups.values())


def test_passages_go_and_what_is_mostly_passage(kept):
    before, after = dict(rows(kept[2])), dict(rows(kept[3]))
    assert set(before) - set(after) == {4001}
    assert all(after[k] == before[k] for k in after if k != 4000)
    words = before[4000].split()
    assert after[4000].split() == words[:60] + words[100:]
    lengths = {r["doc_id"]: r["n_chars"] for r in kept[3].collect()}
    assert lengths[4000] == len(after[4000])


def test_everything_left_is_packed_once(kept):
    want = {}
    for k, t in rows(kept[3]):
        want.setdefault(k, []).append(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1)
    got = {}
    places = {}
    for r in kept[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {k: sum(v) for k, v in want.items()}
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist() and sum(n for _, n in spans) <= 1024


def test_run_gives_the_last_stage(spark, tables, kept):
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    pick = lambda df: sorted((tuple(r[f] for f in fields) for r in df.collect()), key=repr)
    got, want = pick(corpus_pipeline.run(spark, tables)), pick(kept[4])
    # Which of several copies stays may differ; how many pieces there are does not.
    assert len(got) == len(want) and {x for x in got if x[0] is not None and x[0] < 3000} == {x for x in want if x[0] is not None and x[0] < 3000}


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
