import random

import numpy as np

from loomsearch.llm import toxicity


def test_train_learns_what_two_terms_say_together(spark):
    """Each of two terms says a little, both together all; the corpus has many rows with one of them."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(1200):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append((k, " ".join([*(f"w{rng.randrange(300)}" for _ in range(20)), *["alphaword"] * a, *["betaword"] * b])))
        labels.append((k, int(a and b)))
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    lines = spark.createDataFrame([(0, "alphaword"), (1, "betaword"), (2, "alphaword betaword")], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.score(lines, machine).collect()}
    assert got[0] < 0.5 > got[1] and got[2] > 0.5


def test_train_learns_what_only_pairs_tell(spark):
    """Exactly one of two terms: neither tells anything alone, so no additive model does better than chance."""
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((k, " ".join([*(f"w{rng.randrange(400)}" for _ in range(30)), *["zorb"] * a, *["quix"] * b])))
        labels.append((k, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels[:2000], "doc_id long, toxic int"))
    score = {r["id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    assert sum((score[k] >= 0.5) == bool(y) for k, y in labels[2000:]) >= 900
    places = {int(b): i for i, b in enumerate(machine.active)}
    x = np.zeros((3000, len(places)))
    for k, (_, text) in enumerate(rows):
        x[k, [places[t] for t in toxicity.terms_of(text) if t in places]] = 1
    additive = np.linalg.lstsq(x[:2000], np.array([y for _, y in labels[:2000]]) - 0.5, rcond=None)[0]
    assert sum((x[k] @ additive > 0) == bool(y) for k, y in labels[2000:]) < 650


def test_log_odds_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(0.3, np.arange(12), rng.normal(size=12), rng.normal(size=(12, 3)))
    rows = [[], [4], [0, 3, 7, 11], list(range(12))]
    want = [0.3 + sum(machine.weights[i] for i in r) + sum(machine.vectors[i] @ machine.vectors[j] for i in r for j in r if i < j) for r in rows]
    got = machine.log_odds(np.array([i for r in rows for i in r], np.int64), np.cumsum([len(r) for r in rows]))
    assert np.allclose(got, want)


def test_train_keeps_terms_between_four_and_five_standard_errors(spark):
    """A term in 11 of 200 toxic and 40 of 2,800 other rows."""
    rows = [(k, f"common{k % 7} " + ("seldomword" if k < 11 or 200 <= k < 240 else "")) for k in range(3000)]
    labels = [(k, int(k < 200)) for k in range(3000)]
    n, share = 51, 51 / 3000
    z = abs(11 / 200 - 40 / 2800) / np.sqrt(share * (1 - share) * (1 / 200 + 1 / 2800))
    assert 4 < z < 5 and n >= toxicity.LEAST_ROWS
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(toxicity.buckets_of("seldomword")) <= set(machine.active.tolist())
