"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and word beginnings, hashed to buckets. The
machine gives every bucket a weight and a vector; a text's log-odds are the
weights of its buckets and the inner products of all pairs of their vectors,
so that two terms together can say what neither says alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, only, staged
from .tokens import in_slices

BUCKETS, FACTORS, BEGINNING = 1 << 18, 8, 5
#: The fit sees at most so many labelled rows: those whose id has the lowest hash.
MOST_LABELLED = 20_000
#: The most frequent buckets take part whatever the labels say, for what they tell may lie in pairs alone; so do rarer ones (of ``LEAST_ROWS`` rows
#: and more, as one row tells nothing) whose share among the classes differs by ``LEAST_Z`` standard errors, the strongest first, up to ``MOST_ACTIVE``.
MOST_FREQUENT, LEAST_ROWS, LEAST_Z, MOST_ACTIVE = 4_000, 5, 4.0, 24_000
#: How strongly parameters are drawn to nothing; which of these is a matter of at most ``TRIED`` rows.
ROUNDS, DECAYS, TRIED = 120, (1e-3, 30.0), 2_500
_WORD = re.compile(r"\w+")


def buckets_of(word: str) -> tuple[int, int]:
    """The buckets of a (lower-cased) word and of its beginning."""
    return zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(b"^" + word[:BEGINNING].encode()) % BUCKETS


def terms_of(text: str | None) -> list[int]:
    """The distinct buckets of a whole text, ascending."""
    return sorted({b for w in set(_WORD.findall((text or "").lower())) for b in buckets_of(w)})


@dataclass
class Machine:
    """``active``: the buckets that take part, ascending; ``weights`` and ``vectors`` in their order."""

    bias: float
    active: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def log_odds(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For texts whose places in ``active`` are ``flat``, cut at ``ends``."""
        if not len(ends):
            return np.zeros(0)
        z = np.concatenate((np.zeros((1, self.vectors.shape[1])), np.cumsum(self.vectors[flat], axis=0)))
        q = np.concatenate(([0.0], np.cumsum((self.vectors[flat] ** 2).sum(axis=1))))
        w = np.concatenate(([0.0], np.cumsum(self.weights[flat])))
        begins = np.concatenate(([0], ends[:-1]))
        return self.bias + w[ends] - w[begins] + 0.5 * (((z[ends] - z[begins]) ** 2).sum(axis=1) - (q[ends] - q[begins]))


def fit_machine(rows: list[tuple[list[int], int]], active: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Machine:
    """Fits by Adam on the mean logistic loss; ``rows`` are (places in ``active``, label). Without both classes: their share."""
    sizes = np.array([len(x) for x, _ in rows], np.int64)
    flat = np.fromiter((i for x, _ in rows for i in x), np.int32, int(sizes.sum()))
    return fit_places(flat, np.cumsum(sizes), np.array([label for _, label in rows], float), active, factors, rounds, rate, decay, seed)


def _sums(values: np.ndarray, at: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """The sums of ``values[at]`` for each stretch of ``at`` cut at ``ends``; ``most`` places are held at once, or one stretch."""
    out = np.zeros((len(ends), values.shape[1]), values.dtype)
    begins = np.concatenate(([0], ends[:-1]))
    k = 0
    while k < len(ends):
        to = max(k + 1, int(np.searchsorted(ends, begins[k] + most, "right")))
        some = np.flatnonzero(ends[k:to] > begins[k:to])
        if len(some):
            out[k + some] = np.add.reduceat(values[at[begins[k] : ends[to - 1]]], begins[k + some] - begins[k], axis=0)
        k = to
    return out


def fit_places(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, active: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Machine:
    """Fits rows whose places in ``active`` are ``flat``, cut at ``ends``. Sums go by row and by place, so no array has factors for every entry."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    # The pairs of a row of many terms say little at first, as those of a row of few do.
    spread = min(0.05, (0.05 / max(1.0, len(flat) / max(1, len(y)))) ** 0.5)
    machine = Machine(float(np.log(share / (1 - share))), active, np.zeros(len(active)), np.random.default_rng(seed).normal(0, spread, (len(active), factors)))
    if not len(active) or not len(y):
        return machine
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(np.concatenate(([0], ends))))
    owner = owner[np.argsort(flat, kind="stable")]
    place_ends = np.cumsum(np.bincount(flat, minlength=len(active)))
    state = [np.zeros_like(x) for x in (np.zeros(1), machine.weights, machine.vectors) for _ in range(2)]
    for t in range(1, rounds + 1):
        v = machine.vectors
        by_row = _sums(np.column_stack((v, (v**2).sum(axis=1), machine.weights)).astype(np.float32), flat, ends)
        z = by_row[:, :factors]
        odds = machine.bias + by_row[:, -1] + 0.5 * ((z**2).sum(axis=1) - by_row[:, factors])
        error = 1 / (1 + np.exp(-np.clip(odds, -40, 40))) - y
        by_place = _sums(np.column_stack((error[:, None] * z, error)).astype(np.float32), owner, place_ends)
        grads = [np.array([error.sum()]), by_place[:, -1].copy(), by_place[:, :factors] - by_place[:, -1:] * v]
        grads = [g / len(y) for g in grads]
        grads[1] += decay * machine.weights / len(active)
        grads[2] += decay * machine.vectors / len(active)
        steps = []
        for g, first, second in zip(grads, state[::2], state[1::2], strict=True):
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            steps.append(rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8))
        machine.bias -= float(steps[0][0])
        machine.weights -= steps[1]
        machine.vectors -= steps[2]
    return machine


def rows_of(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and ends of some rows."""
    begins = np.concatenate(([0], ends[:-1]))[rows]
    sizes = ends[rows] - begins
    out = np.cumsum(sizes)
    return flat[np.repeat(begins - (out - sizes), sizes) + np.arange(int(out[-1]) if len(out) else 0)], out


def fit_best(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, active: np.ndarray, telling: np.ndarray, seed: int = 7) -> Machine:
    """The machine that serves best a tenth of the rows, which its fit has not seen: one of all terms, or one of those that are ``telling`` (a mask).

    The latter is best where there are few rows for many terms, and is then
    fitted to all rows. The decay for all terms is chosen before, in the same
    way, on ``TRIED`` of the other rows.
    """
    order = np.random.default_rng(seed).permutation(len(y))
    checked, fitted = order[: len(y) // 10], order[len(y) // 10 :]

    def loss(machine: Machine, places: np.ndarray, cuts: np.ndarray, rows: np.ndarray) -> float:
        odds = np.clip(machine.log_odds(*rows_of(places, cuts, rows)), -40, 40)
        return float((np.logaddexp(0, odds) - y[rows] * odds).sum())

    def fit(places: np.ndarray, cuts: np.ndarray, rows: np.ndarray, terms: np.ndarray, decay: float) -> Machine:
        return fit_places(*rows_of(places, cuts, rows), y[rows], terms, decay=decay, seed=seed)

    unseen, seen = fitted[: min(len(fitted), TRIED) // 5], fitted[min(len(fitted), TRIED) // 5 : TRIED]
    decay = min(DECAYS, key=lambda d: loss(fit(flat, ends, seen, active, d), flat, ends, unseen))
    # What is telling to rows that are checked later must not be told by them.
    known = telling & (_standard_errors(*rows_of(flat, ends, fitted), y[fitted], len(active)) >= LEAST_Z)
    few, few_ends = _places_of(flat, ends, known)
    whole, part = fit(flat, ends, fitted, active, decay), fit(few, few_ends, fitted, active[known], DECAYS[0])
    if loss(whole, flat, ends, checked) <= loss(part, few, few_ends, checked):
        return whole
    return fit_places(*_places_of(flat, ends, telling), y, active[telling], decay=DECAYS[0], seed=seed)


def _places_of(flat: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the terms of a mask only, which are numbered anew."""
    if not len(flat):
        return flat, ends
    kept = np.where(mask, np.cumsum(mask) - 1, -1)[flat]
    return kept[kept >= 0].astype(np.int32), np.concatenate(([0], np.cumsum(kept >= 0)))[ends]


def _standard_errors(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """By how many standard errors each term's share differs between the classes of these rows."""
    n1, rows = y.sum(), max(1, len(y))
    n0 = rows - n1
    if not n1 or not n0:
        return np.zeros(terms)
    n = np.bincount(flat, minlength=terms)
    a = np.bincount(flat, np.repeat(y, np.diff(np.concatenate(([0], ends)))), terms)
    share = n / rows
    return np.abs(a / n1 - (n - a) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> Machine:
    """Fits a machine on at most ``most_labelled`` labelled rows.

    Only the ids and labels of that sample are broadcast, and only the
    buckets that take part and the sample's places in them reach the driver.
    Frequent buckets take part whatever the labels say, so a pair of terms can
    tell what neither tells alone, and the labels add rare ones; only where
    unseen rows are served better by it, the frequent ones stay out.
    Ids or labels that are null, and labels other than 0 and 1, do not count;
    an id labelled more than once is toxic if any label says so.
    """
    picked = only(labels, id=id_col, y=label_col).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    picked = staged(picked, "labelled")
    sample = only(docs, id=id_col, text=text_col).join(F.broadcast(picked), "id").select("y", "text", F.xxhash64("text").alias("h"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 1):
                found = pa.array([terms_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], ["y", "h", "terms"])

    rows = staged(map_arrow(sample, terms, "y int, h long, terms array<int>"), "labelled-terms")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    active = telling = np.zeros(0, np.int64)
    if n1 and n0:
        counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
        share = F.col("n") / (n1 + n0)
        z = F.abs(F.col("a") / n1 - (F.col("n") - F.col("a")) / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        enough = counts.where(F.col("n") >= LEAST_ROWS)
        frequent = enough.orderBy(F.desc("n"), "term").limit(MOST_FREQUENT).select("term")
        telling = enough.select("term", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MOST_ACTIVE - MOST_FREQUENT).select("term")
        telling = np.array([r["term"] for r in telling.collect()], np.int64)
        active = np.union1d(telling, np.array([r["term"] for r in frequent.collect()], np.int64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(BUCKETS, -1, np.int32)
        at[active] = np.arange(len(active))
        for batch in batches:
            found = [at[np.asarray(x, np.int64)] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[x >= 0] for x in found], pa.list_(pa.int32()))], ["y", "h", "places"])

    # Equal texts are alike in any order; the sample is bounded, so the driver sorts it.
    told = map_arrow(rows, places, "y int, h long, places array<int>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    flat = pc.list_flatten(told.column("places")).to_numpy()
    ends = np.cumsum(pc.list_value_length(told.column("places")).to_numpy())
    y = told.column("y").to_numpy().astype(float)
    del told
    return fit_best(flat, ends, y, active, np.isin(active, telling))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``score`` (0 to 1) and the columns in ``keep`` of every row; one scan, no shuffle.

    Null and empty texts have no terms and get the score of that. Repeated
    rows are scored alike; an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))
    rest = [f for f in own.schema.fields if f.name != "text" or keep]
    schema = T.StructType([*rest, T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        place = {int(b): i for i, b in enumerate(machine.active)}
        known: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for batch in in_slices(whole, 1, 1 << 20):
                if len(known) > 150_000:
                    known.clear()
                flat: list[int] = []
                ends: list[int] = []
                for text in batch.column(1).to_pylist():
                    words = set(_WORD.findall((text or "").lower()))
                    for w in words.difference(known):
                        known[w] = tuple(place[b] for b in buckets_of(w) if b in place)
                    flat.extend({i for w in words for i in known[w]})
                    ends.append(len(flat))
                odds = machine.log_odds(np.array(flat, np.int64), np.array(ends, np.int64))
                scores = pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40))), pa.float64())
                columns = [batch.column(f.name) for f in rest]
                yield pa.RecordBatch.from_arrays([*columns, scores], schema.names)

    return map_arrow(own, step, schema)
