"""The index against the scan, and its upkeep."""

import random
import re

import pytest

from loomsearch.model import Corpus, Query
from loomsearch.operators.index import Conflict, SearchIndex
from loomsearch.operators.search import search, substring_hits, word_hits

WORDS = "harvest harvesting harvester barn barns Café naïve cafe ox_cart the of plough: ploughed end. mill miller milling x 7 日本 über".split()
QUERIES = ["harvest", "the", "cafe", "ox_cart", '"barn mill"', '"the of"', "harvest mill", '"mill x" barn', "m", "日", "ploughing", '"of the of"']


def rows(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + k, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for k in range(n)] + [(first + n, None)]


def messages(spark, found):
    return spark.createDataFrame(found, "mid long, content string")


def scores(df):
    return {r["mid"]: round(r["score"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    m = messages(spark, rows(1, 120)).cache()
    return m, SearchIndex(spark, str(tmp_path_factory.mktemp("index") / "i")).add(m)


@pytest.mark.parametrize("query", QUERIES)
def test_word_hits_are_those_of_a_scan(indexed, query):
    m, index = indexed
    assert scores(index.word_hits(query)) == scores(word_hits(m.na.fill(""), query))


@pytest.mark.parametrize("query", ["arv", "RVEST mil", "café", "of the", '"h: p"', "ooo", "本 harvest"])
def test_substring_hits_are_those_of_a_scan(indexed, query):
    m, index = indexed
    assert scores(index.substring_hits(query, m)) == scores(substring_hits(m.na.fill(""), query))


def test_nothing_to_look_for(indexed):
    m, index = indexed
    assert index.word_hits('" "') is None and index.substring_hits("ab", m) is None


def test_a_query_reads_the_folders_of_its_terms_only(indexed):
    plan = indexed[1].word_hits("harvest")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*lead#\d+ = h\)", plan) and "StringStartsWith(term,harvest)" in plan


def test_changed_new_and_removed_messages(spark, tmp_path):
    old, changed, new = rows(2, 40), rows(3, 10, 5), rows(4, 10, 100)
    index = SearchIndex(spark, str(tmp_path / "i"), stems=False).add(messages(spark, old))
    index.add(messages(spark, changed)).add(messages(spark, new)).remove(messages(spark, [(3, ""), (100, "")]))
    now = {**dict(old), **dict(changed), **dict(new)}
    del now[3], now[100]
    m = messages(spark, sorted((k, v or "") for k, v in now.items()))
    for query in ("harvest", "the", '"barn mill"', "mill the"):
        want = scores(word_hits(m, query, stems=False))
        assert scores(index.word_hits(query)) == want
        assert scores(index.substring_hits(query, m)) == scores(substring_hits(m, query))
    assert index.manifest()["dead"] and not index.compact().manifest()["dead"]
    assert scores(index.word_hits("mill the")) == scores(word_hits(m, "mill the", stems=False))
    assert not index.needs_rebuild(m) and index.needs_rebuild(m.unionByName(messages(spark, [(999, "lost")])))
    assert scores(index.rebuild(m).word_hits("harvest")) == scores(word_hits(m, "harvest", stems=False))
    assert not index.needs_rebuild(m)


def test_sessions_are_found_alike(spark, indexed):
    m, index = indexed
    own = m.na.fill("").selectExpr("mid", "mid % 9 as session_id", "cast(mid as int) as ordinal", "'user' as role", "mid as ts", "content")
    s = spark.createDataFrame([(k, "codex", f"u{k}", "", "", "", k, k) for k in range(9)], "session_id long, agent string, session_uid string, workspace string, title string, summary string, started_at long, ended_at long")
    corpus = Corpus(s, own)
    for q in (Query("harvest mill"), Query("rves", limit=3), Query("the", role="user", offset=2)):
        with_index = [(r["session_uid"], round(r["score"], 9), r["match_count"], [e["snippet"] for e in r["excerpts"]]) for r in search(corpus, q, index=index).collect()]
        assert with_index == [(r["session_uid"], round(r["score"], 9), r["match_count"], [e["snippet"] for e in r["excerpts"]]) for r in search(corpus, q).collect()]


@pytest.mark.parametrize("table", ["sizes", "words", "grams", "blocks", "gram_counts", "dead", "manifest"])
def test_a_run_that_is_lost_at_any_write_leaves_results_as_they_were(spark, tmp_path, monkeypatch, table):
    old, more = messages(spark, rows(5, 12)), messages(spark, rows(6, 6, 8))
    index = SearchIndex(spark, str(tmp_path / "i"), stems=False).add(old)
    before, queries = index.manifest(), ("harvest", "mill the")
    want = [scores(index.word_hits(q)) for q in queries]
    put = SearchIndex._put

    def lost(self, rows, name, run, order=()):
        put(self, rows, name, run, order)
        if name == table:
            raise ConnectionError("lost")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/run={run}")

    with monkeypatch.context() as m:
        m.setattr(SearchIndex, "_put", lost)
        if table == "manifest":
            m.setattr("loomsearch.operators.index.write_new", lambda *a: (_ for _ in ()).throw(ConnectionError("lost")))
        with pytest.raises(ConnectionError):
            index.add(more)
    assert index.manifest() == before and [scores(index.word_hits(q)) for q in queries] == want
    index.add(more)
    now = messages(spark, sorted({**dict(rows(5, 12)), **dict(rows(6, 6, 8))}.items())).na.fill("")
    assert [scores(index.word_hits(q)) for q in queries] == [scores(word_hits(now, q, stems=False)) for q in queries]
    assert index.sweep() == 1 and index.sweep() == 0
    assert scores(index.word_hits("harvest")) == scores(word_hits(now, "harvest", stems=False))


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, str(tmp_path / "i"), stems=False).add(messages(spark, rows(1, 5)))
    seen = index.manifest()
    index.add(messages(spark, rows(2, 5, 50)))
    late = SearchIndex(spark, index.path, stems=False)
    monkeypatch.setattr(late, "manifest", lambda: seen)
    with pytest.raises(Conflict):
        late.add(messages(spark, rows(3, 5, 90)))
    assert index.manifest()["rows"] == 12


def test_segments_of_one_size_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomsearch.operators.index.FANOUT", 2)
    index, all_rows = SearchIndex(spark, str(tmp_path / "i"), stems=False), {}
    for k in range(5):
        new = rows(k, 7, 5 * k)
        all_rows |= dict(new)
        index.add(messages(spark, new))
    m = messages(spark, sorted(all_rows.items())).na.fill("")
    assert len(index.manifest()["segments"]) <= 3 and index.manifest()["rows"] == len(all_rows)
    for query in ("harvest", '"of the"'):
        assert scores(index.word_hits(query)) == scores(word_hits(m, query, stems=False))


def test_a_table_s_next_version_is_followed(spark, tmp_path):
    first = dict(rows(7, 15))
    after = {k: v for k, v in first.items() if k not in (2, 3)} | {4: "harvest the", 99: "new barn"}
    a, b = (messages(spark, sorted(x.items())) for x in (first, after))
    index = SearchIndex(spark, str(tmp_path / "i"), stems=False).add(a).apply(a, b)
    assert index.manifest()["rows"] == len(after) and index.manifest()["segments"][-1]["rows"] == 2
    for query in ("harvest", "the"):
        assert scores(index.word_hits(query)) == scores(word_hits(b.na.fill(""), query, stems=False))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    rng = random.Random(11)
    common = [f"w{k}" for k in range(40)]
    found = [(k, " ".join(rng.choices(common, weights=[40 // (j + 1) + 1 for j in range(40)], k=rng.randint(1, 60)))) for k in range(1500)]
    found += [(5000 + k, "rare " * (k + 1) + "w1") for k in range(5)]
    m = messages(spark, found).cache()
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr("loomsearch.operators.index.PAGE_ROWS", 50)  # as if there were many more rows
        return m, SearchIndex(spark, str(tmp_path_factory.mktemp("large") / "i"), stems=False).add(m.where("mid < 900")).add(m.where("mid >= 900"))


def read_rows(df):
    """Rows that a query's scans of the words gave, by their metrics."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and plan.nodeName() == "AdaptiveSparkPlan" else plan
    stack = [plan]
    while stack:
        p = stack.pop()
        kids = p.children()
        stack += [kids.apply(k) for k in range(kids.size())]
        if p.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
            stack.append(p.plan())
        if p.nodeName().startswith("Scan"):
            n += p.metrics().apply("numOutputRows").value()
    return n


@pytest.mark.parametrize(("query", "k"), [("w0", 20), ("w0 w1", 20), ("w39", 1), ("w3 w3 w7", 5000), ("rare", 2), ("rare w1", 20), ("w0 w2 w5", 7), ("w1 nowhere", 20)])
def test_the_best_messages_are_those_of_full_scoring(large, query, k):
    """Rows whose scores are alike but for rounding may stand for each other."""
    _, index = large
    quoted = " ".join(f'"{w}"' for w in query.split())
    full = {r["mid"]: r["score"] for r in index.word_hits(quoted).collect()}
    got = [(r["score"], r["mid"]) for r in index.top_word_hits(quoted, k).collect()]
    assert got == sorted(got) and len({mid for _, mid in got}) == len(got) == min(k, len(full))
    assert [s for s, _ in got] == pytest.approx(sorted(full.values())[:k], rel=1e-12)
    assert [s for s, _ in got] == pytest.approx([full[mid] for _, mid in got], rel=1e-12)


def test_few_postings_are_read_for_the_best_messages(large):
    _, index = large
    assert read_rows(index.top_word_hits('"w0"', 5)) * 4 < read_rows(index.word_hits('"w0"'))


def test_phrases_prefixes_and_dead_messages_are_scored_in_full(spark, indexed, tmp_path):
    m, index = indexed
    for query in ('"of the"', "harvest"):
        want = sorted((s, mid) for mid, s in scores(index.word_hits(query)).items())[:3]
        assert [(round(r["score"], 9), r["mid"]) for r in index.top_word_hits(query, 3).collect()] == want
    own = SearchIndex(spark, str(tmp_path / "i")).add(m).remove(m.where("mid < 5"))
    want = sorted((s, mid) for mid, s in scores(own.word_hits('"the"')).items())[:4]
    assert [(round(r["score"], 9), r["mid"]) for r in own.top_word_hits('"the"', 4).collect()] == want
    assert own.top_word_hits('" "', 3) is None


def test_the_rarest_grams_are_met(large):
    _, index = large
    now = index.manifest()
    assert index.rarest(now, {"rar", "are", "w1 "})[0] in ("rar", "are") and "w1 " not in index.rarest(now, {"rar", "are", "w1 "})
