import random

import numpy as np
import pytest

from loomsearch.llm import lm


@pytest.fixture
def texts():
    """More words than have classes of their own: 191 frequent ones, then 'common' often, 'seldom' rarely, and one of them once."""
    rng = random.Random(8)
    frequent = [f"f{k:03}" for k in range(191)]
    out = [" ".join(rng.sample(frequent, 60)) for _ in range(150)]
    return [t + " planted" * (k < 25) + " cobbled" * (k < 3) + " slanted" * (k < 1) for k, t in enumerate(out)]


@pytest.mark.parametrize("held", [50_000, 1, 0])
def test_words_of_a_shared_class_have_their_own_probability(spark, texts, held, monkeypatch):
    monkeypatch.setattr(lm, "MOST_HELD", held)
    network = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len({lm.shape_of(w) for w in (b"planted", b"cobbled", b"slanted", b"qqaqqqq")}) == 1 and b"planted" not in network.words
    lines = [f"f001 {w} f002" for w in ("planted", "cobbled", "slanted", "qqaqqqq")] + ["f001 planted f002 cobbled"]
    rows = spark.createDataFrame([*enumerate(lines), (9, lines[0])], "doc_id long, text string")
    got = {r["id"]: r["log_prob"] for r in lm.score(rows, network, leave_out=False).collect()}
    share = {k: n + lm.UNSEEN for k, n in enumerate((25, 3, 1, 0))}
    assert all(np.isclose(got[0] - got[k], np.log(share[0] / share[k])) for k in share) and got[0] == got[9]
    shape = lm.shape_of(b"planted")
    assert (network.totals[shape], network.kinds[shape]) == (29, 3)
    # The words of the class and all that never occur share it out among them, and the classes of a context all there is.
    assert np.isclose(sum(share.values()), np.exp(network.rest(np.zeros(lm.SHAPES + 1))[shape]))
    assert np.allclose(np.exp(network.table()).sum(axis=2), 1, atol=1e-4)


def test_a_text_does_not_vouch_for_itself(spark, texts):
    """Of texts that have a word of their own each, those that occur twice score apart from those that occur once."""
    rng = random.Random(2)
    own = [" ".join(t.split()[:20] + ["".join(rng.choices("bdfgklmnprstv", k=5)) + "a" for _ in range(6)]) for t in texts[:40]]
    rows = own + own[:8] + texts
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r["mean_log_prob"] for r in lm.score(docs, lm.train(docs)).collect()}
    twice, once = [got[k] for k in range(8)], [got[k] for k in range(8, 40)]
    assert np.mean([a > b for a in twice for b in once]) > 0.95 and all(np.isclose(got[k], got[40 + k]) for k in range(8))


def test_gradients_are_those_of_the_loss():
    """A step of learning against differences of the loss."""
    rng = np.random.default_rng(0)
    shapes = ((lm.CLASSES, lm.HIDDEN), (lm.CLASSES, lm.HIDDEN), (lm.HIDDEN,), (lm.HIDDEN, lm.CLASSES), (lm.CLASSES,))
    network = lm.Network([], *(rng.normal(0, 0.3, s) for s in shapes))
    context, counts = np.array([5 << 8 | 7, 9 << 8 | 7]), np.zeros((2, lm.CLASSES))
    counts[0, [3, 4]], counts[1, 200] = (2, 1), 5

    def loss(net):
        return -(net.log_probabilities(context >> 8, context & 255)[1] * counts).sum() / counts.sum()

    learned = lm.Network([], *lm._learn(network, context, counts, 1))
    assert loss(learned) < 0.2 * loss(network)


def test_odd_rows(spark, odd_docs, no_docs):
    network = lm.train(odd_docs)
    rows = {(r["id"], r["n_words"]): r for r in lm.score(odd_docs, network).collect()}
    assert rows[2, 0]["log_prob"] == 0 == rows[3, 0]["log_prob"] and rows[4, 0]["mean_log_prob"] is None
    assert sum(1 for r in lm.score(odd_docs, network).collect() if r["id"] == 1) == 3
    assert lm.score(no_docs, lm.train(no_docs)).count() == 0
