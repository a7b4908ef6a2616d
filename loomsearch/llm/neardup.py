"""Near duplicates by order MinHash, verified by banded alignment.

A text is its run of occurrence-labelled k-mers of words. A sketch picks the
``PICKED`` k-mers with the smallest hashes and keeps them in text order, so two
texts agree in it if they share these k-mers *and* their order; short texts
have more sketches, of fewer k-mers. Texts that
agree in any sketch are candidates; a banded alignment of their k-mers decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, staged
from .decontamination import words_of
from .tokens import in_slices

WORDS, SIMILARITY = 5, 0.8
#: Sketches of a text and k-mers in each. Long texts at 0.8 agree in one with 0.8**6 = 0.26, in none of 32 with less than 0.0001.
SKETCHES, PICKED = 32, 6
#: (up to so many k-mers in a text, sketches, k-mers in each). The fewer k-mers two texts have at 0.8, the fewer are the runs of six that
#: they share; with the further sketches of short texts the loss stays below 0.0001 at every length (4 of 5 k-mers: 0.4**10).
TIERS = ((None, SKETCHES, PICKED), (100, 4, 4), (30, 10, 2))
_ALL = sum(count for _, count, _ in TIERS)
_RNG = np.random.default_rng(11)
_FACTORS = (_RNG.integers(0, 1 << 63, _ALL, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, _ALL, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Hashes of words, kept for the words met lately."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)

    def kmers(self, words: list[bytes], k: int = WORDS) -> np.ndarray:
        """Hashes of all runs of ``k`` words (all words, if there are fewer), labelled by their occurrence: no two are alike."""
        h = self.hashes(words)
        if not len(h):
            return h
        k = min(k, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : len(h) - k + 1 + j]
        out = _mixed(out)
        order = np.argsort(out, kind="stable")
        same = out[order][1:] == out[order][:-1]
        if same.any():
            begins = np.concatenate(([0], np.flatnonzero(~same) + 1))
            rank = np.arange(len(out)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(out)]))))
            again = rank > 0
            out[order[again]] = _mixed(out[order[again]] + rank[again].astype(np.uint64) * _MIX)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One number for each sketch of every tier that the text is short enough for: the picked k-mers in the order in which the text has them."""
    out, begin = [], 0
    for most, count, picked in TIERS:
        if most is None or len(kmers) <= most:
            out.append(_tier(kmers, begin, count, min(picked, len(kmers))))
        begin += count
    return np.concatenate(out).view(np.int64)


def _tier(kmers: np.ndarray, begin: int, count: int, picked: int) -> np.ndarray:
    values = kmers[None, :] * _FACTORS[begin : begin + count, None] + _SHIFTS[begin : begin + count, None]
    values ^= values >> np.uint64(32)
    if picked < len(kmers):
        at = np.sort(np.argpartition(values, picked - 1, axis=1)[:, :picked], axis=1)
    else:
        at = np.broadcast_to(np.arange(picked), (count, picked))
    out = np.arange(begin + 1, begin + count + 1, dtype=np.uint64) * _MIX
    for j in range(picked):
        out = _mixed(out * _MIX + kmers[at[:, j]])
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two runs of labelled k-mers: those on a best banded alignment over all, or 0 if below ``least``.

    As no two k-mers of a text are alike, each matches at one place at most,
    and the longest alignment is the longest increasing run of places. An
    alignment that reaches ``least`` leaves at most ``band`` k-mers of either
    text out, so matches further apart than that are not on it.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), m - 1)
    found = order[at]
    here = np.flatnonzero(b[found] == a)
    band = int((n + m) * (1 - 2 * least / (1 + least))) + 1
    there = found[here]
    there = there[np.abs(there - here) <= band]
    c = len(there)
    if c < least * (n + m - c):
        return 0.0
    if (np.diff(there) < 0).any():
        tails: list[int] = []
        for x in there.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        c = len(tails)
    similarity = c / (n + m - c)
    return similarity if similarity >= least - 1e-12 else 0.0


def sketched(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Every row with a number of its own (``nth``), its class key, k-mer count and sketches; staged with its text."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("nth"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))
    schema = T.StructType([*own.schema.fields, *T.StructType.fromDDL("key binary, n int, keys array<long>").fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for whole in batches:
            for batch in in_slices(whole, 1):
                keys: list[bytes | None] = []
                sizes: list[int] = []
                found: list[list[int] | np.ndarray] = []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    kmers = table.kmers(words)
                    sizes.append(len(kmers))
                    found.append(sketches(kmers) if len(kmers) else [])
                    keys.append(None if text is None else xxhash.xxh3_128_digest(b" ".join(words)) if words else b"=" + xxhash.xxh3_128_digest(text.encode()))
                new = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return staged(map_arrow(own, step, schema), "sketched")


def verified(pairs: DataFrame, texts: DataFrame, deals: int, least: float) -> DataFrame:
    """The ``pairs`` (``nth, leader``) whose texts align to ``least`` or more.

    The texts that are needed travel once to their leaders, whose members are
    dealt into ``deals`` parts, so a leader of very many members is in many
    tasks. In a task rows are sorted, the leader first, and only the leader's
    k-mers are held.
    """
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("nth"), F.lit(deals)))
    members = dealt.select("leader", "deal", "nth", F.lit(1).alias("member"))
    leaders = dealt.select("leader", "deal").distinct().select("leader", "deal", F.col("leader").alias("nth"), F.lit(0).alias("member"))
    rows = members.unionByName(leaders).join(texts.select("nth", "text"), "nth")
    rows = rows.repartition("leader", "deal").sortWithinPartitions("leader", "deal", "member").select("leader", "deal", "member", "nth", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kmers = Words(), np.zeros(0, np.uint64)
        for whole in batches:
            for batch in in_slices(whole, 4):
                out: tuple[list[int], list[int]] = ([], [])
                for leader, _, member, nth, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = table.kmers(words_of(text))
                    if not member:
                        kmers = own
                    elif aligned(kmers, own, least):
                        out[0].append(nth)
                        out[1].append(leader)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["nth", "leader"])

    return map_arrow(rows, step, "nth long, leader long")


def components(edges: DataFrame) -> DataFrame:
    """``nth`` and ``label`` (the smallest number of its component) of everything that ``edges`` (``nth, leader``) link.

    First, what has several links keeps the one to the smallest, and the others
    become links between what they lead to, of which there are far fewer kinds.
    Labels take the smallest of their neighbours' and then jump to the label of
    their label, until none changes; every step is written to the shared
    folder, and only the number of changes comes to the driver.
    """
    low = edges.groupBy("nth").agg(F.min("leader").alias("low"))
    across = edges.join(low, "nth").where("leader <> low").select(F.col("leader").alias("nth"), F.col("low").alias("leader")).distinct()
    edges = low.select("nth", F.col("low").alias("leader")).unionByName(across)
    both = staged(edges.select("nth", "leader").unionByName(edges.select(F.col("leader").alias("nth"), F.col("nth").alias("leader"))).distinct(), "links")
    labels = staged(both.groupBy("nth").agg(F.least(F.col("nth"), F.min("leader")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("nth").alias("leader"), F.col("label").alias("other")), "leader").groupBy("nth").agg(F.min("other").alias("other"))
        moved = labels.join(near, "nth").select("nth", "label", F.least("label", "other").alias("to"))
        jump = labels.select(F.col("nth").alias("to"), F.col("label").alias("further"))
        after = staged(moved.join(jump, "to").select("nth", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("label")).alias("changed")), "labels")
        labels = after.drop("changed")
        if not after.where("changed").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, nth, label, text`` and the columns in ``keep``: rows with one ``label`` are copies or linked by near copies.

    ``label`` is the ``nth`` of one of them, so ``nth = label`` picks one row
    of each class. Texts with the same words are one class from the start, and
    only one of them is sketched further. In a bucket of texts that agree in a
    sketch, all are first compared with two of them: the one that meets most
    others (over all its buckets), and one by a hash. Where that leaves more
    than one component, those that are not in the first one's are compared
    with all others of the bucket (see ``_rest``), so that in the end every two
    texts of a bucket are linked or have been compared, while a large group of
    copies costs two comparisons each.

    Null texts are near nothing; texts without words only their exact copies;
    shorter texts than a k-mer are one k-mer; repeated rows are copies; an
    empty table gives an empty result.
    """
    rows = sketched(docs, id_col, text_col, keep)
    exact = staged(rows.where("key is not null").groupBy("key").agg(F.min("nth").alias("rep")), "classes")
    reps = rows.where("n > 0").select("nth", "n", "keys").join(exact.select(F.col("rep").alias("nth")), "nth", "left_semi")
    spread = staged(reps.select("nth", "n", F.posexplode("keys").alias("sketch", "bucket")), "buckets")
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = staged(spread.join(shared, "bucket"), "members")
    popular = staged(members.groupBy("nth").agg(F.sum("size").alias("met")), "met")
    texts = staged(rows.select("nth", "text", "keys").join(popular.hint("merge"), "nth", "left_semi"), "member-texts")
    chance = F.xxhash64("bucket", "nth")
    picked = members.join(popular, "nth").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("nth")).alias("low"))).alias("best"), F.min(F.struct(chance.alias("h"), "nth")).alias("other"))
    leaders = staged(picked.select("bucket", (-F.col("best.low")).alias("first"), F.col("other.nth").alias("second")), "leaders")
    seen = members.join(leaders, "bucket").select("nth", F.explode(F.array("first", "second")).alias("leader")).where("nth <> leader")
    pairs = staged(seen.select(F.greatest("nth", "leader").alias("nth"), F.least("nth", "leader").alias("leader")).distinct(), "pairs")
    links = staged(verified(pairs, texts, _deals(pairs), least), "found")
    labels = components(links)
    more = _rest(members, leaders, labels, texts, least)
    if more is not None:
        labels = components(links.unionByName(more))
    classes = exact.withColumnRenamed("rep", "nth").join(labels, "nth", "left").select("key", F.coalesce("label", "nth").alias("label"))
    kept = [F.col(f"kept_{c}") for c in keep]
    return rows.join(classes, "key", "left").select("id", "nth", F.coalesce("label", "nth").alias("label"), "text", *kept)


def _deals(pairs: DataFrame) -> int:
    return 64 * (1 + pairs.count() // 5_000_000)


#: Buckets up to this size give pairs; larger ones are compared block by block, so that no row stands for a pair.
#: Blocks of all texts, which stream by, are at most ``MOST_COLUMNS`` a bucket, for each of them gets the new texts once more.
SMALL, BLOCK_NEW, BLOCK_ALL, MOST_COLUMNS = 24, 256, 256, 64


def _rest(members: DataFrame, leaders: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame | None:
    """Links between components that share a bucket: texts outside of the first leader's component against all others."""
    known = members.join(labels, "nth", "left").withColumn("label", F.coalesce("label", "nth"))
    first = leaders.join(labels.withColumnRenamed("nth", "first"), "first", "left").select("bucket", "first", "second", F.coalesce("label", "first").alias("main"))
    known = known.join(first, "bucket").withColumn("new", (F.col("label") != F.col("main")).cast("int"))
    counts = known.groupBy("bucket").agg(F.sum("new").alias("n_new")).where("n_new > 0")
    open_ = staged(known.join(counts, "bucket"), "open")
    small = open_.where(F.col("size") <= SMALL)
    a, b = (small.where("nth <> first and nth <> second").select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("nth", "n", "label"))) for x in "ab")
    fits = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
    pairs = a.join(b, "bucket").where("nth_a > nth_b and label_a <> label_b").where(fits).select(F.col("nth_a").alias("nth"), F.col("nth_b").alias("leader")).distinct()
    pairs = staged(pairs, "pairs")
    found = []
    if pairs.limit(1).count():
        found.append(staged(verified(pairs, texts, _deals(pairs), least), "found"))
    large = open_.where(F.col("size") > SMALL)
    if large.limit(1).count():
        found.append(staged(_blocks(large, texts, least), "found"))
    return None if not found else found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _blocks(large: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``nth, leader`` of the links that large buckets add.

    The texts outside of the main component are dealt into blocks of about
    ``BLOCK_NEW``, all texts into blocks of ``BLOCK_ALL`` or more, and a task
    holds one block of the former while the latter stream by. A pair is
    compared in the first of the buckets that it shares; pairs of components
    that are linked by then are passed over.
    """
    row, column = F.ceil(F.col("n_new") / BLOCK_NEW), F.least(F.ceil(F.col("size") / BLOCK_ALL), F.lit(MOST_COLUMNS))
    hashed = F.xxhash64("nth")
    own = ["bucket", "sketch", "nth", "label"]
    new = large.where("new = 1").select(*own, F.lit(0).alias("side"), F.pmod(hashed, row).alias("r"), F.explode(F.sequence(F.lit(0), column - 1)).alias("c"))
    every = large.select(*own, (1 + F.col("new")).alias("side"), F.explode(F.sequence(F.lit(0), row - 1)).alias("r"), F.pmod(hashed, column).alias("c"))
    rows = new.unionByName(every).join(texts, "nth").repartition("bucket", "r", "c").sortWithinPartitions("bucket", "r", "c", "side", "nth")
    rows = rows.select("bucket", "r", "c", "side", "sketch", "nth", "label", "keys", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = Words(), None
        held: list[tuple[int, int, np.ndarray]] = []
        keys = np.zeros((0, _ALL), np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for whole in batches:
            for batch in in_slices(whole, 8):
                out: tuple[list[int], list[int]] = ([], [])
                for bucket, r, c, side, sketch, nth, label, own_keys, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if at != (bucket, r, c):
                        at, held, parent = (bucket, r, c), [], {}
                    kmers = table.kmers(words_of(text))
                    own = np.zeros(_ALL, np.int64)  # What a text has no sketch for comes last, after any that two texts of a bucket share.
                    own[: len(own_keys)] = own_keys
                    if side == 0:
                        held.append((nth, label, kmers))
                        keys = own[None] if len(held) == 1 else np.vstack((keys, own))
                        continue
                    first_shared = (keys == own).argmax(axis=1) if len(held) else ()
                    for k in np.flatnonzero(first_shared == sketch).tolist():
                        other, other_label, other_kmers = held[k]
                        if other == nth or side == 2 and other > nth or root(label) == root(other_label):
                            continue
                        if aligned(other_kmers, kmers, least):
                            parent[root(label)] = root(other_label)
                            out[0].append(nth)
                            out[1].append(other)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["nth", "leader"])

    return map_arrow(rows, step, "nth long, leader long")
