import math
import random

import numpy as np

from loomsearch.llm import neardup
from loomsearch.llm.neardup import Words, aligned, near_duplicates, sketches


def test_a_copy_that_says_a_sentence_twice_is_near():
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    once, twice = (Words().kmers([w.encode() for w in x]) for x in (words, words + words[50:62]))
    assert len(set(twice.tolist())) == len(twice) and set(once.tolist()) < set(twice.tolist())
    assert aligned(once, twice) > 0.9 and (sketches(once) == sketches(twice)).any()


def test_a_copy_that_says_a_sentence_twice_is_linked(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = spark.createDataFrame([("a", " ".join(words)), ("b", " ".join(words + words[50:62])), ("c", "another text altogether")], "doc_id string, text string")
    label = {r["id"]: r["label"] for r in near_duplicates(docs).collect()}
    assert label["a"] == label["b"] != label["c"]


def test_short_texts_at_the_least_similarity_meet(spark):
    rng, n = random.Random(5), 0
    rows = []
    for length in range(8, 21):
        for _ in range(40):
            words = [f"v{rng.randrange(100_000)}" for _ in range(length)]
            rows += [(n, " ".join(words)), (n + 1, " ".join([*words, f"last{n}"]))]
            n += 2
    label = {r["id"]: r["label"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(0, n, 2) if label[k] != label[k + 1]] == [] and len(set(label.values())) == n // 2


def test_sketches_lose_less_than_promised_at_every_length():
    def chance(same, all_, k):
        return math.comb(same, k) / math.comb(all_, k) if k <= all_ else 0.0

    worst = 0.0
    for union in range(5, 500):
        same = -(-4 * union // 5)
        for larger in {union, *(m + over for m, _, _ in neardup.TIERS if m for over in (0, 1) if same <= union + same - m - over <= m + over <= union)}:
            lost = [(1 - chance(same, union, k)) ** count for most, count, k in neardup.TIERS if most is None or larger <= most]
            worst = max(worst, math.prod(lost))
    assert worst < 1e-4


def test_texts_are_cut_into_the_tiers_of_their_length():
    kmers = np.arange(1, 200, dtype=np.uint64)
    assert [len(sketches(kmers[:n])) for n in (1, 5, 30, 31, 100, 101)] == [46, 46, 46, 36, 36, 32]


def test_blocks_compare_short_texts(spark, monkeypatch):
    """Many short texts that share a bucket of two k-mers, of which some pairs are near, are compared block by block."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    rng = random.Random(6)
    rows, n = [], 0
    shared = "one very common opening line of words"
    for _ in range(60):
        words = shared.split() + [f"u{rng.randrange(100_000)}" for _ in range(12)]
        rows += [(n, " ".join(words)), (n + 1, " ".join([*words, f"last{n}"]))]
        n += 2
    label = {r["id"]: r["label"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label[k] == label[k + 1] for k in range(0, n, 2)) and len(set(label.values())) == n // 2
