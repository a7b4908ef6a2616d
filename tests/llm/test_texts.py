import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.llm import chat, decontamination, lm, neardup, sharding, toxicity
from loomsearch.llm.decontamination import words_of


# -- toxicity --


def test_a_machine_learns_what_two_terms_say_together():
    rng = random.Random(2)
    rows = []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(([k for k, on in ((0, a), (1, b), (2, rng.random() < 0.5)) if on], int(a and b)))
    machine = toxicity.fit_machine(rows, np.arange(3))
    odds = machine.log_odds(np.array([0, 1, 0, 1]), np.array([1, 2, 4, 4]))
    assert odds[2] > 1 > 0 > odds[0] and odds[1] < 0 and odds[3] < 0


def test_toxicity_on_held_out_and_odd_rows(spark, odd_docs, no_docs, prose):
    rng = random.Random(3)
    rows = [(k, prose(60) + (" foulword nastything " if k % 4 == 0 else " ") + prose(rng.randint(0, 60))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    assert np.mean([(scores[k] >= 0.5) == (k % 4 == 0) for k in range(400, 600)]) > 0.98
    odd = toxicity.score(odd_docs, machine).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(no_docs, machine).count() == 0
    blank = toxicity.train(no_docs, labels)
    assert [r["score"] for r in toxicity.score(docs.limit(1), blank).collect()] == [0.5]


# -- near duplicates --


def brute(texts, least=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(words_of, texts)]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if texts[i] == texts[j] and texts[i] is not None or a and len(a & sets[j]) >= least * len(a | sets[j]) > 0:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def classes(keys):
    out = {}
    for k, x in enumerate(keys):
        out.setdefault(x, set()).add(k)
    return sorted(map(sorted, out.values()))


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_are_those_of_brute_force(spark, prose):
    rng = random.Random(1)
    texts = [prose(rng.randint(40, 300)) for _ in range(40)]
    passage = prose(30)
    for k in range(10):
        texts += [edited(texts[k], e, rng) for e in (0, 1, 2, 5)]
        texts.append(prose(20) + " " + passage + " " + prose(20))
    base = prose(140)
    texts += [edited(base, rng.randint(0, 3), rng) for _ in range(120)]  # a large group, its members not all near each other
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["label"] for r in neardup.near_duplicates(docs).collect()}
    assert classes([got[k] for k in range(len(texts))]) == classes(brute(texts))


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs, keep=("lang", "nth")).collect()
    assert len(rows) == odd_docs.count() and sum(r["nth"] == r["label"] for r in rows) == odd_docs.count() - 2
    nulls = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, ""), (5, "!!!"), (6, "!!!"), (7, "one two"), (8, "One, two!")], "doc_id long, text string")
    got = {r["id"]: r["label"] for r in neardup.near_duplicates(nulls).collect()}
    assert classes([got[k] for k in range(1, 9)]) == [[0], [1], [2, 3], [4, 5], [6, 7]]
    assert neardup.near_duplicates(no_docs).count() == 0


def test_alignment_respects_order_and_bound():
    kmers = neardup.Words().kmers(words_of(" ".join(f"w{k}" for k in range(200))))
    assert neardup.aligned(kmers, kmers) == 1.0
    assert neardup.aligned(np.concatenate((kmers[100:], kmers[:100])), kmers) == 0.0
    assert neardup.aligned(kmers, kmers[:150]) == 0.0 and abs(neardup.aligned(kmers, kmers[:180]) - 180 / 196) < 1e-9
    repeated = neardup.Words().kmers(words_of("a b c d e " * 50))
    assert len(set(repeated.tolist())) == len(repeated)


# -- decontamination --

_WORDS = "alpha beta gamma delta eps".split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_WORDS), max_size=9), max_size=5), st.lists(st.sampled_from([*_WORDS, "other"]), max_size=40), st.integers(1, 5))
def test_automaton_finds_all_windows(items, words, window):
    named = [(f"i{k}", " ".join(x)) for k, x in enumerate(items)]
    spans, found = decontamination.Matcher(named, window).match([w.encode() for w in words])
    hit, names = set(), set()
    for name, item in zip((n for n, _ in named), items, strict=True):
        n = min(window, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == item[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(name)
    assert {i for a, b in spans for i in range(a, b)} == hit and set(found) == names


def test_leaks_in_odd_rows(spark, odd_docs, no_docs, prose):
    item, short = prose(30), "only four words here"
    bench = spark.createDataFrame([("b1", item), ("b2", short), ("b3", None), (None, "x"), ("b4", "..."), ("b1", item)], "item_id string, text string")
    w = item.split()
    docs = spark.createDataFrame([(1, "Before, " + " ".join(w[3:18]).upper() + "! after."), (2, prose(50)), (3, "x y z u v w " + short + " y"), (4, item), (5, " ".join(w[:9]))], "doc_id long, text string")
    for most in (10**6, 3):  # one block, and a block for each item
        got = {r["id"]: r for r in decontamination.find_leaks(docs, bench, most_words=most).collect()}
        assert got[1]["spans"] == [[1, 16]] and got[1]["items"] == ["b1"] and got[3]["items"] == ["b2"] and not got[2]["items"] and not got[5]["items"]
        assert [0, 1] in got[3]["spans"]  # an item without a name is found, and not listed
    left = {r["id"]: r["text"] for r in decontamination.remove_leaks(decontamination.find_leaks(docs, bench)).collect()}
    assert set(left) == {2, 3, 5} and left[3] == "x y z u v w " + short + " y"
    kept = {r["id"]: r["text"] for r in decontamination.remove_leaks(decontamination.find_leaks(docs, bench), most_coverage=0.95).collect()}
    assert kept[1] == "Before, ! after." or kept[1].startswith("Before,") and w[5].upper() not in kept[1]
    assert decontamination.find_leaks(odd_docs, bench, keep=("lang",)).count() == odd_docs.count()
    assert decontamination.find_leaks(no_docs, bench).count() == 0
    assert all(not r["spans"] for r in decontamination.find_leaks(odd_docs, bench.limit(0)).collect())


# -- sharding --


def test_shards_are_even_and_groups_whole(spark, odd_docs, no_docs, prose):
    rng = random.Random(4)
    texts = [prose(rng.randint(1, 200)) for _ in range(2000)] + [prose(80)] * 900
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shards_by_bytes(docs, 8).collect()
    size, place, of = {}, {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        place.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault(texts[r["id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values()) and all(sorted(p) == list(range(len(p))) for p in place.values())
    big = of[texts[-1]].pop()
    rest = [n for s, n in size.items() if s != big]
    assert len(rest) == 7 and max(rest) - min(rest) < 0.03 * min(rest)
    odd = sharding.shards_by_bytes(odd_docs, 3).collect()
    assert len(odd) == odd_docs.count() and {r["size"] for r in odd if r["id"] == 2} == {1}
    assert sharding.shards_by_bytes(no_docs, 8).count() == 0


def test_shards_are_cells_of_a_k_d_tree(spark, prose):
    """Read off the result: at every node, the left shards' texts come before the right ones' along the widest dimension, and weigh what they should."""
    rng = random.Random(11)
    texts = [prose(rng.randint(1, 150)) + "\n" * rng.randint(0, 40) + "é" * rng.randint(0, 60) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shard = {r["id"]: r["shard"] for r in sharding.shards_by_bytes(docs, 8).collect()}
    key = {r["doc_id"]: r["k"] for r in docs.selectExpr("doc_id", "xxhash64(text) as k").collect()}
    point = {k: dict(zip(sharding.DIMENSIONS, (len(t.encode()), len(t), t.count("\n") + 1), strict=True)) for k, t in enumerate(texts)}
    weight = {k: p["bytes"] + 1 for k, p in point.items()}
    total, heaviest = sum(weight.values()), max(weight.values())

    def check(rows, first, shards, siblings):
        assert {shard[k] for k in rows} == set(range(first, first + shards))
        if shards == 1:
            return
        every = [k for group in siblings for k in group]  # all nodes of a storey are measured on one scale
        spread = {d: max(1.0, max(point[k][d] for k in every) - min(point[k][d] for k in every)) for d in sharding.DIMENSIONS}
        widest = max(sharding.DIMENSIONS, key=lambda d: (max(point[k][d] for k in rows) - min(point[k][d] for k in rows)) / spread[d])
        half = shards // 2
        left, right = [k for k in rows if shard[k] < first + half], [k for k in rows if shard[k] >= first + half]
        place = lambda k: (point[k][widest], key[k])
        assert max(map(place, left)) < min(map(place, right))
        aim = sum(weight[k] for k in rows) * half / shards
        assert abs(sum(weight[k] for k in left) - aim) <= heaviest + sharding.NEARNESS * total / 8

    storey = [(list(range(1500)), 0, 8)]
    while storey:
        for node in storey:
            check(*node, [rows for rows, _, _ in storey])
        halves = [(f, s // 2) for _, f, s in storey if s > 1] + [(f + s // 2, s - s // 2) for _, f, s in storey if s > 1]
        storey = [([k for k in shard if f <= shard[k] < f + s], f, s) for f, s in sorted(halves)]


# -- chat --


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\abcde<s>/[INST] \n", max_size=30), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "a", "[/INST", "</", "s>", "]"]), max_size=6).map("".join))
def test_turns_round_trip(role, text):
    turn = chat.render(role, text)
    two = turn + chat.render(text, role)
    assert [(t.role, t.text) for t in chat.parse(two)] == [(role, text), (text, role)]


def test_the_grammar_rejects_what_it_did_not_write():
    for bad in ("x", "<s>a[INST]b</s>", "<s>a[INST]b\\q[/INST]</s>", "<s>a[INST]b[/INST]</s>x", "<s>a[INST]<s>[/INST]</s>"):
        with pytest.raises(chat.NotATurn):
            list(chat.parse(bad))


def test_chats_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a [INST]"), (2, None, None, None), (None, 0, "user", "q"), (3, 0, "assistant", "é</s>"), (3, 0, "assistant", "é</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as nth", "'x' as formatted")
    got = {r["conv"]: r for r in chat.read_chats(chat.write(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na [INST]\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b") and got[1]["loss_chars"] == 1
    assert got[2]["turns_sha256"] == sha("\n\n") and got[None]["n_turns"] == 1 and got[3]["loss_chars"] == 10 and got[3]["loss_sha256"] == sha("é</s>" * 2)
    assert chat.read_chats(chat.write(df.limit(0))).count() == 0


# -- language model --


def test_pseudo_likelihood_prefers_text_in_order(spark, odd_docs, no_docs):
    rng = random.Random(6)
    nouns, verbs = [f"noun{chr(97 + k)}" for k in range(12)], [f"verb{chr(97 + k)}" for k in range(12)]

    def text():
        return " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)}" for _ in range(20))

    texts = [text() for _ in range(150)]
    network = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    fresh = [text() for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), 100)) for t in fresh]
    rows = spark.createDataFrame(list(enumerate(fresh + mixed)), "doc_id long, text string")
    got = {r["id"]: r for r in lm.score(rows, network).collect()}
    assert all(got[k]["mean_log_prob"] > got[k + 20]["mean_log_prob"] + 0.5 for k in range(20))
    table = network.table()
    assert np.allclose(np.exp(table[:3, :3]).sum(axis=2), 1, atol=1e-4)
    c = lm.Classes(network.words).of(words_of(fresh[0]))
    assert abs(sum(table[a, b, t] for a, t, b in zip(c, c[1:], c[2:], strict=False)) - got[0]["log_prob"]) < 1e-3
    odd = {r["id"]: r for r in lm.score(odd_docs, network).collect()}
    assert odd[2]["log_prob"] == 0 == odd[3]["n_words"] and odd[3]["mean_log_prob"] is None
    assert lm.score(no_docs, lm.train(no_docs)).count() == 0
