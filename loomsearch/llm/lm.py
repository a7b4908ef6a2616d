"""Masked pseudo-likelihood: a small network predicts every token's class from both neighbours, counts of all words the word in it.

Words fall into ``CLASSES`` classes: the most frequent words have one each,
all others share classes by length and make-up. The network sees the classes
left and right of a hidden token. In a shared class, a word has the share that
it has of the class in all other texts, smoothed by ``UNSEEN`` occurrences of
every word and of all that never occur together, so every word has a probability of its own and
a text does not vouch for itself. The counts of words grow with the corpus and
are met in a join, except for the ``MOST_HELD`` most frequent ones, which every
task holds. A text's score is the sum of the log-probabilities of its tokens.

Classes are learned from counts of (left, token, right), over all tokens of
all texts; their table has at most ``CLASSES ** 3`` rows however large the
corpus is, and a context's tokens are learned in one step, so training costs
the same at every size while the counting is spread over all of the input.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_count, map_arrow, only, staged
from .decontamination import words_of
from .tokens import in_slices

CLASSES, SHAPES, HIDDEN = 256, 64, 24
#: Words of shared classes whose counts each task holds; those of all others come by a join, so this bounds memory and not the vocabulary.
MOST_HELD = 50_000
#: Logarithms of counts are summed as whole numbers of this size, so that the order of rows does not matter.
FINE = 1_000_000_000
UNSEEN = 0.1
#: Rounds of training, passes over the counts in each, and parts that learn side by side and are then averaged.
ROUNDS, PASSES, PARTS = 3, 6, 8
#: Contexts in a step, and steps that a round has at least, however few contexts there are.
BATCH, LEAST_STEPS = 64, 150
EDGE = 0
_DIGIT, _VOWEL = re.compile(rb"[0-9]"), re.compile(rb"[aeiouy]")


def shape_of(word: bytes) -> int:
    """The shared class of a word that has none of its own: eight lengths, with or without digits, vowels, letters beyond ASCII."""
    length = min(7, (len(word) - 1) // 2)
    return 1 + length * 8 + 4 * bool(_DIGIT.search(word)) + 2 * (not _VOWEL.search(word)) + (not word.isascii())


@dataclass
class Network:
    """Weights, and which words have a class of their own. ``token`` names it in worker processes.

    ``totals`` and ``kinds``: tokens of the corpus in each shared class and different words among them; ``held``: the most frequent words' counts there;
    ``counts``: ``word, n`` of all others (a table, which does not travel to workers).
    """

    words: list[bytes]
    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    token: str = field(default_factory=lambda: uuid.uuid4().hex)
    totals: np.ndarray = field(default_factory=lambda: np.zeros(SHAPES + 1))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(SHAPES + 1))
    held: dict[bytes, int] = field(default_factory=dict)
    counts: DataFrame | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.left, self.right, self.bias, self.out, self.out_bias]

    def log_probabilities(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(self.left[left] + self.right[right] + self.bias)
        scores = hidden @ self.out + self.out_bias
        scores -= scores.max(axis=1, keepdims=True)
        return hidden, scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def rest(self, own: np.ndarray) -> np.ndarray:
        """The logarithm of what is shared out in each shared class, to a text that has ``own`` tokens of each."""
        return np.log(np.maximum(self.totals - own, 0) + UNSEEN * (self.kinds + 1))

    def table(self) -> np.ndarray:
        """Log-probabilities of every class in every context, ``[left, right, class]``."""
        out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
        right = np.arange(CLASSES)
        for k in range(CLASSES):
            out[k] = self.log_probabilities(np.full(CLASSES, k), right)[1]
        return out


class Classes:
    """Classes of words, kept for the words met lately."""

    def __init__(self, words: list[bytes]):
        self.own = {w: 1 + SHAPES + k for k, w in enumerate(words)}
        self.known = dict(self.own)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The classes of a text's words, with an edge before and after."""
        if len(self.known) > 200_000:
            self.known = dict(self.own)
        known = self.known
        for w in set(words).difference(known):
            known[w] = shape_of(w)
        return np.array([EDGE, *[known[w] for w in words], EDGE], np.uint8)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return only(docs, text=text_col).where(F.col("text").isNotNull())


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, shape`` and ``n`` of every word of the whole corpus; counted in the map before they are shuffled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.binary()), pa.array([shape_of(w) for w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            out = pa.RecordBatch.from_arrays(columns, ["word", "shape", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in in_slices(batch, 0):
                for text in part.column(0).to_pylist():
                    counts.update(words_of(text))
                if len(counts) > 400_000:
                    yield rows()
        yield rows()

    return map_arrow(_texts(docs, text_col), step, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, most: int) -> list[tuple[bytes, int]]:
    rows = counted.orderBy(F.desc("n"), "word").limit(most).select("word", "n").collect()
    return [(bytes(r["word"]), r["n"]) for r in rows]


def count_windows(docs: DataFrame, words: list[bytes], text_col: str = "text") -> DataFrame:
    """``context`` (left and right class), ``token`` and ``n``, over every token of every text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(words)
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        new: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            got, n = np.unique(np.concatenate([*new, np.zeros(0, np.uint32)]), return_counts=True)
            all_, inverse = np.unique(np.concatenate((keys, got)), return_inverse=True)
            return all_, np.bincount(inverse, np.concatenate((counts, n)), len(all_)).astype(np.int64)

        for batch in batches:
            for part in in_slices(batch, 0):
                for text in part.column(0).to_pylist():
                    c = classes.of(words_of(text)).astype(np.uint32)
                    new.append(c[:-2] << 16 | c[2:] << 8 | c[1:-1])
                    size += len(c)
                if size > 2_000_000:
                    keys, counts = merged()
                    new, size = [], 0
        keys, counts = merged()
        for k in range(0, len(keys), 100_000):
            part = slice(k, k + 100_000)
            columns = [pa.array((keys[part] >> 8).astype(np.int32)), pa.array((keys[part] & 255).astype(np.int32)), pa.array(counts[part])]
            yield pa.RecordBatch.from_arrays(columns, ["context", "token", "n"])

    found = map_arrow(_texts(docs, text_col), step, "context int, token int, n long")
    return found.groupBy("context", "token").agg(F.sum("n").alias("n"))


def _learn(network: Network, context: np.ndarray, counts: np.ndarray, seed: int, rate: float = 0.01) -> list[np.ndarray]:
    """Adam over contexts in batches; each context brings the counts of all its tokens at once."""
    own = [p.astype(np.float64).copy() for p in network.parameters()]
    net = Network(network.words, *own)
    first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
    rng, t = np.random.default_rng(seed), 0
    passes = max(PASSES, -(-LEAST_STEPS * BATCH // len(context)))
    for _ in range(passes):
        order = rng.permutation(len(context))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            left, right, n = context[at] >> 8, context[at] & 255, counts[at]
            hidden, logs = net.log_probabilities(left, right)
            by_score = (np.exp(logs) * n.sum(axis=1, keepdims=True) - n) / n.sum()
            by_hidden = (by_score @ net.out.T) * (1 - hidden**2)
            grads = [np.zeros_like(net.left), np.zeros_like(net.right), by_hidden.sum(axis=0), hidden.T @ by_score, by_score.sum(axis=0)]
            np.add.at(grads[0], left, by_hidden)
            np.add.at(grads[1], right, by_hidden)
            t += 1
            for p, g, m, v in zip(own, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return own


def train(docs: DataFrame, text_col: str = "text", seed: int = 5) -> Network:
    """A network for the corpus. Parts of the (bounded) count table learn side by side; after each round the driver averages their weights."""
    own = CLASSES - SHAPES - 1
    counted = staged(word_counts(docs, text_col), "words")
    first = most_frequent(counted, own)
    words = [w for w, _ in first]
    least = least_count(counted, own + MOST_HELD)
    frequent = counted.where(F.col("n") >= least).select("word", "n").toArrow()
    held = dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), strict=True))
    for w in words:
        held.pop(w, None)
    totals, kinds = np.zeros(SHAPES + 1), np.zeros(SHAPES + 1)
    for row in counted.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        totals[row["shape"]], kinds[row["shape"]] = row["n"], row["kinds"]
    for w, n in first:
        totals[shape_of(w)] -= n
        kinds[shape_of(w)] -= 1
    others = counted.where(F.col("n") < least).select("word", "n")
    rng = np.random.default_rng(seed)
    shapes = ((CLASSES, HIDDEN), (CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
    network = Network(words, *(rng.normal(0, 0.1, s) for s in shapes))
    windows = staged(count_windows(docs, words, text_col), "windows").repartition(PARTS, "context")
    for number in range(ROUNDS):

        def step(batches: Iterator[pa.RecordBatch], network=network, number=number) -> Iterator[pa.RecordBatch]:
            table = np.zeros((CLASSES * CLASSES, 0))
            rows = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
            if rows:
                context, token, n = (np.concatenate(x) for x in zip(*rows, strict=True))
                known, at = np.unique(context, return_inverse=True)
                table = np.zeros((len(known), CLASSES))
                table[at, token] = n
                learned = np.concatenate([p.ravel() for p in _learn(network, known, table, number)])
                yield pa.RecordBatch.from_arrays([pa.array([float(table.sum())]), pa.array([learned.tobytes()], pa.binary())], ["weight", "weights"])

        parts = sorted((bytes(r["weights"]), r["weight"]) for r in map_arrow(windows, step, "weight double, weights binary").collect())
        if parts:
            mean = sum(np.frombuffer(p) * w for p, w in parts) / sum(w for _, w in parts)
            cut = np.split(mean, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
            network = Network(words, *(c.reshape(s) for c, s in zip(cut, shapes, strict=True)))
    return replace(network, totals=totals, kinds=kinds, held=held, counts=others)


_TABLES: dict[str, tuple[Classes, np.ndarray]] = {}


def _ready(network: Network) -> tuple[Classes, np.ndarray]:
    """This process's classes and table for a network; only the last network's are kept."""
    if network.token not in _TABLES:
        _TABLES.clear()
        _TABLES[network.token] = Classes(network.words), network.table()
    return _TABLES[network.token]


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", leave_out: bool = True) -> DataFrame:
    """``id, n_words, log_prob`` (sum) of every row and ``mean_log_prob``.

    In a shared class of ``t`` tokens and ``k`` different words in all other
    texts, a word that occurs ``n`` times there has (n + u) / (t + u (k + 1)),
    and all that never occur together u / (t + u (k + 1)), u being ``UNSEEN``.
    Without ``leave_out``, for texts that the network was not trained on, the
    corpus takes the place of all other texts. One scan; only words that no
    task holds are shuffled to their counts, once for each text that has them.

    Null, empty and wordless texts have no tokens, a sum of 0 and no mean;
    repeated rows are scored alike; an empty table gives an empty result.
    """
    own = only(docs, id=id_col, text=text_col).withColumn("nth", F.monotonically_increasing_id())
    schema = T.StructType([own.schema["id"], *T.StructType.fromDDL("nth long, n_words long, log_prob double, word array<binary>, times array<int>").fields])
    counts = network.counts
    sent = docs.sparkSession.sparkContext.broadcast(replace(network, counts=None))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table = _ready(sent.value)
        network, held, never = sent.value, sent.value.held, float(np.log(UNSEEN))
        for whole in batches:
            for batch in in_slices(whole, 1):
                sizes, sums, others, times = [], [], [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    c = classes.of(words)
                    sizes.append(len(c) - 2)
                    inner = c[1:-1]
                    shared = Counter([words[k] for k in np.flatnonzero(inner <= SHAPES).tolist()])
                    met = [(n, held[w]) for w, n in shared.items() if w in held]
                    far = [w for w in shared if w not in held]
                    others.append(far)
                    times.append([shared[w] for w in far])
                    own = np.bincount(inner[inner <= SHAPES], minlength=SHAPES + 1)
                    words_sum = never * sum(times[-1])
                    if met:
                        n, of = np.array(met, float).T
                        words_sum += float((n * np.log(np.maximum(of - leave_out * n, 0) + UNSEEN)).sum())
                    sums.append(float(table[c[:-2], c[2:], inner].sum(dtype=np.float64)) - float(own @ network.rest(leave_out * own)) + words_sum)
                columns = [pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(others, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], schema.names)

    scored = map_arrow(own, step, schema)
    if counts is not None:
        scored = staged(scored, "scored")
        asked = scored.select("nth", F.explode(F.arrays_zip("word", "times")).alias("w")).select("nth", F.col("w.word").alias("word"), F.col("w.times").alias("times"))
        # What a word has beyond UNSEEN; a word of this text alone is not in the other texts.
        others = F.col("n") - (F.col("times") if leave_out else F.lit(0))
        gain = F.round(F.log(others / UNSEEN + 1) * FINE).cast("long")
        more = asked.join(counts, "word").where(others > 0).groupBy("nth").agg(F.sum(F.col("times") * gain).alias("more"))
        scored = scored.join(more, "nth", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce(F.col("more") / FINE, F.lit(0.0)))
    scored = scored.select("id", "n_words", "log_prob")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
