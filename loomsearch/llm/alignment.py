"""Alignment of two tokenizers through a dictionary of groups.

Byte offsets at which tokens of both tokenizers end cut a text into *groups*: a
run of A ids and a run of B ids for the same bytes. Groups repeat endlessly, so
each distinct one is interned, its links (all pairs of an A and a B id in it)
are expanded once for the whole corpus, and what they add up to is joined back
to the texts by the group's key.

How many documents hold a pair linked is the sum, over the distinct groups that
have it, of the documents that hold the group, less what documents that hold
several such groups have counted too often; each task finds these overlaps in
its own documents, and only for pairs that it has met in more than one group.

Neither tokenizer joins what stands on both sides of a space between two words,
so groups never go over such a place either, and each process aligns each
distinct stretch between two of them once. Short stretches are merged by rank
arrays, many at a time (see :mod:`.bpe`); the libraries have all others.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import least_count, map_arrow, only, staged
from .tokens import _LETTERS, _RUN, _SPACED, in_slices

#: Stretches, and characters in them, that a worker remembers before it starts afresh.
MOST_KEPT, MOST_CHARS = 300_000, 8_000_000
#: Groups whose sums each task holds, the most frequent ones; all others come by a join, so this bounds memory and not what is counted.
MOST_HELD = 300_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = {chr(c): b for b, c in _LETTERS.items()}
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _stretches(text: str) -> list[str]:
    """A text, a space before it, in parts that begin with a space between two words; without these spaces."""
    if not text[0].isspace() and not _RUN.search(text):
        return text.split(" ")
    text = " " + text
    starts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[a + 1 : b] for a, b in zip(starts, starts[1:])]


def groups_of(raw: bytes, a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[tuple[list[int], list[int]]] | None:
    """The groups of bytes with the ids of both tokenizers; nothing if either's bytes are not the given ones."""
    if b"".join([a_bytes[k] for k in a]) != raw or b"".join([b_bytes[k] for k in b]) != raw:
        return None
    out, i, j, left, right = [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        first, second = i, j
        while True:
            if left <= right and i < len(a):
                left += len(a_bytes[a[i]])
                i += 1
            else:
                right += len(b_bytes[b[j]])
                j += 1
            if left == right:
                break
        out.append((a[first:i], b[second:j]))
    return out


class Aligner:
    """What a process knows: stretches with their groups, groups with their distinct pairs, all by number.

    Numbers index arrays that only grow; ``starts``-like arrays have one entry
    more than there are things, so the groups of stretch k are
    ``held[first[k]:first[k + 1]]``.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = (self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size()))
        self.a_bytes = [bytes(map(_BYTE.__getitem__, t)) if _BYTE.keys() >= set(t) else t.encode() for t in letters]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.own = bpe.ByteBPE.of(a_path)
        self.b_chars, self.b_table, self.b_merged = self._pairs()
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.clear()

    def _pairs(self) -> tuple[np.ndarray, bpe.RankTable, np.ndarray]:
        """The second vocabulary as rank arrays take it: ids of characters, or -1, and the rank of each pair that makes a piece, which is that of the piece."""
        b = self.b
        plain = [k for k in range(b.get_piece_size()) if not (b.is_byte(k) or b.is_control(k) or b.is_unknown(k) or b.is_unused(k))]
        number = {b.id_to_piece(k): k for k in plain}
        # Runs of spaces share a score; texts that have any are left to the library.
        order = sorted((k for k in plain if len(b.id_to_piece(k)) > 1 and b.id_to_piece(k).strip("▁")), key=lambda k: -b.get_score(k))
        if len({b.get_score(k) for k in order}) < len(order):
            raise ValueError("pieces share a score")
        made = [(number[p[:i]], number[p[i:]], rank) for rank, p in enumerate(map(b.id_to_piece, order)) for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        chars = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                chars[ord(p)] = k
        left, right, ranks = np.array(made, np.int64).T
        return chars, bpe.RankTable(left, right, ranks), np.array(order, np.int32)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        """This process's aligner: worker processes outlive tasks, and so does what they remember."""
        if (a_path, b_path) not in _ALIGNERS:
            _ALIGNERS[a_path, b_path] = cls(a_path, b_path)
        return _ALIGNERS[a_path, b_path]

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of stretches
        self.chars = 0
        self.sizes = array("q")  # valid, A ids, B ids, groups of each stretch
        self.first, self.held = array("q", [0]), array("q")
        self.groups: dict[bytes, int] = {}
        self.keys: list[str] = []
        self.links, self.flagged = array("q"), bytearray()
        self.first_pair, self.pair = array("q", [0]), array("q")
        self.pairs: dict[int, int] = {}
        self.holder, self.shared = array("q"), bytearray()  # the first group of a pair, and whether there are more

    @property
    def full(self) -> bool:
        return len(self.number) > MOST_KEPT or self.chars > MOST_CHARS

    def _group(self, raw: bytes) -> int:
        """The number of a group: its ids in 32 bits each, A's before B's, and how many are A's."""
        found = self.groups.get(raw)
        if found is not None:
            return found
        found = self.groups[raw] = len(self.keys)
        *ids, n = np.frombuffer(raw, np.int32).tolist()
        a, b = ids[:n], ids[n:]
        self.keys.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        self.links.append(len(a) * len(b))
        self.flagged.append(0)
        for x in set(a):
            for y in set(b):
                p = self.pairs.setdefault(x << 32 | y, len(self.pairs))
                if p == len(self.holder):
                    self.holder.append(found)
                    self.shared.append(0)
                else:
                    self.shared[p] = self.flagged[found] = self.flagged[self.holder[p]] = 1
                self.pair.append(p)
        self.first_pair.append(len(self.pair))
        return found

    def _interned(self, a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> np.ndarray:
        """The numbers of groups whose ids stand in a row. Like ones are found by a hash, and compared."""
        parts = []
        for ids, stops, salt in ((a, a_stops, 1), (b, b_stops, 2)):
            starts = stops - np.diff(stops, prepend=0)
            place = np.arange(len(ids)) - np.repeat(starts, stops - starts)
            mixed = (ids.astype(np.uint64) + np.uint64(7 * salt)) * np.uint64(0x9E3779B97F4A7C15) * (2 * place.astype(np.uint64) + np.uint64(salt))
            mixed ^= mixed >> np.uint64(29)
            parts.append((ids, starts, stops - starts, place, np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)))
        _, first, like = np.unique(parts[0][4] + (parts[1][4] << np.uint64(1)), return_index=True, return_inverse=True)
        same = np.ones(len(like), bool)
        for _, _, sizes, _, _ in parts:
            same &= sizes == sizes[first[like]]
        for ids, starts, sizes, place, _ in parts:
            at = np.minimum(np.repeat(starts[first[like]], sizes) + place, len(ids) - 1)
            same &= np.logical_and.reduceat(ids[at] == ids, starts)
        raw_a, raw_b = a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()

        def number(k: int) -> int:
            (_, x, n, _, _), (_, y, m, _, _) = parts
            return self._group(raw_a[4 * x[k] : 4 * (x[k] + n[k])] + raw_b[4 * y[k] : 4 * (y[k] + m[k])] + n[k].astype(np.int32).tobytes())

        found = np.array([number(k) for k in first], np.int64)[like]
        for k in np.flatnonzero(~same):
            found[k] = number(k)
        return found

    def _keep(self, some: list[str], sizes: np.ndarray, held: np.ndarray) -> None:
        """Adds stretches: rows of valid, A ids, B ids and groups, and the groups of all in a row."""
        self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
        self.chars += sum(map(len, some))
        self.sizes.frombytes(np.ascontiguousarray(sizes, np.int64).tobytes())
        self.first.frombytes((len(self.held) + np.cumsum(sizes[:, 3])).astype(np.int64).tobytes())
        self.held.frombytes(np.ascontiguousarray(held, np.int64).tobytes())

    def _learn(self, new: list[str]) -> None:
        slow = []
        for k in range(0, len(new), 20_000):
            slow += self._learn_short(new[k : k + 20_000])
        for k in range(0, len(slow), 2000):
            some, rows, held = slow[k : k + 2000], [], []
            coded = self.a.encode_batch([" " + s for s in some], add_special_tokens=False)
            for s, x, b in zip(some, coded, self.b.encode(some, num_threads=1), strict=True):
                found = groups_of((" " + s).encode(), x.ids, b, self.a_bytes, self.b_bytes)
                rows.append((found is not None, len(x.ids), len(b), len(found or ())))
                held += [self._group(np.array([*first, *second, len(first)], np.int32).tobytes()) for first, second in found or ()]
            self._keep(some, np.array(rows, np.int64), np.array(held, np.int64))

    def _learn_short(self, new: list[str]) -> list[str]:
        """Learns the short stretches of Latin-1 characters that the second vocabulary has, and gives back the others."""
        if not new:
            return []
        text = " " + " ".join(new)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, new), np.int64, len(new)) + 1
        starts = np.cumsum(lengths) - lengths
        chars = self.b_chars[np.where(codes == 32, 0x2581, codes)]
        odd = (chars < 0) | (codes > 255) | (codes == 32)
        odd[starts] = False  # the space before each
        fine = (lengths <= bpe.WIDTHS[-1] // 2) & (lengths > 1) & ~np.logical_or.reduceat(odd, starts)
        some = [new[k] for k in np.flatnonzero(fine)]
        if not some:
            return new
        inside = np.repeat(fine, lengths)
        b, b_sizes = bpe.merge_rows(chars[inside], lengths[fine], self.b_table, self.b_merged)
        pieces = _SPACED.findall(" " + " ".join(some))
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        wide = np.cumsum(1 + (codes[inside] > 127))
        a, piece_sizes = bpe.merge_rows(self.own.letters[np.frombuffer((" " + " ".join(some)).encode(), np.uint8)], np.diff(wide[stops - 1], prepend=0), self.own.table, self.own.merged)
        last = np.searchsorted(stops, np.cumsum(lengths[fine]))
        a_sizes = np.diff(np.cumsum(piece_sizes)[last], prepend=0)
        # Ends of tokens, in bytes of all stretches in a row: where both have one, a group ends.
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_stops, b_stops = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
        per = np.diff(np.searchsorted(a_stops, np.cumsum(a_sizes)) + 1, prepend=0)
        self._keep(some, np.column_stack([np.ones(len(some), np.int64), a_sizes, b_sizes, per]), self._interned(a, b, a_stops, b_stops))
        return [new[k] for k in np.flatnonzero(~fine)]

    def read(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's stretches; none for null and empty texts."""
        cut = [_stretches(t) if t else [] for t in texts]
        new: set[str] = set()
        for stretches in cut:
            new.update(stretches)
        self._learn(list(new.difference(self.number)))
        return [list(map(self.number.__getitem__, stretches)) for stretches in cut]


def _ranges(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``first[k] .. first[k + 1]`` of all k in ``of``, in a row, and how many each has."""
    sizes = first[of + 1] - first[of]
    ends = np.cumsum(sizes)
    return np.repeat(first[of] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


class _Tables:
    """An aligner's arrays as numpy has them, for one slice of texts."""

    def __init__(self, known: Aligner):
        self.known = known
        self.sizes, self.links = np.array(known.sizes).reshape(-1, 4), np.array(known.links, np.int64)
        self.first, self.held = np.array(known.first), np.array(known.held, np.int64)
        self.first_pair, self.pair = np.array(known.first_pair), np.array(known.pair, np.int64)
        self.flagged, self.shared = (np.frombuffer(bytes(x), np.uint8) == 1 for x in (known.flagged, known.shared))
        self.pair_ids = np.fromiter(known.pairs, np.int64, len(known.pairs))

    def groups(self, stretches: list[int]) -> np.ndarray:
        """The groups of a text, in order; none if its tokens do not give it back."""
        at = np.array(stretches, np.int64)
        if not len(at) or not self.sizes[at, 0].all():
            return np.zeros(0, np.int64)
        return self.held[_ranges(self.first, at)[0]]

    def overlaps(self, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that several distinct groups of a text have, and how often that is too often."""
        linked = self.pair[_ranges(self.first_pair, once[self.flagged[once]])[0]]
        found, times = np.unique(linked[self.shared[linked]], return_counts=True)
        return self.pair_ids[found[times > 1]], times[times > 1] - 1


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values]).astype(kind)))


def read_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``id, nth, n_a, n_b, n_groups, n_links``, the groups (``groups``, or ``groups_sha256`` with ``digest``), and for the counts: each
    text's distinct groups (``key``, ``times``) and the pairs that several of them have (``pair``, ``over``). One pass over the texts."""
    last = "groups_sha256" if digest else "groups"
    own = only(docs, id=id_col, text=text_col).select("id", F.monotonically_increasing_id().alias("nth"), "text")
    schema = f"id {own.schema['id'].dataType.simpleString()}, nth long, n_a long, n_b long, n_groups long, n_links long, {last} string, key array<string>, times array<int>, pair array<bigint>, over array<int>"
    names = ["id", "nth", "n_a", "n_b", "n_groups", "n_links", last, "key", "times", "pair", "over"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner.of(a_path, b_path)
        for batch in batches:
            for part in in_slices(batch, 2):
                read = known.read(part.column(2).to_pylist())
                tables = _Tables(known)
                sizes, written, keys, times, pairs, over = np.zeros((4, len(read)), np.int64), [], [], [], [], []
                for k, stretches in enumerate(read):
                    found = tables.groups(stretches)
                    if len(found):
                        sizes[:, k] = *tables.sizes[stretches, 1:3].sum(axis=0), len(found), tables.links[found].sum()
                    text = ";".join(map(known.keys.__getitem__, found.tolist()))
                    written.append(sha256(text.encode()).hexdigest() if digest and text else text)
                    once, often = np.unique(found, return_counts=True)
                    both, more = tables.overlaps(once)
                    for out, x in ((keys, once), (times, often), (pairs, both), (over, more)):
                        out.append(x)
                groups = _lists(keys, np.int64)
                groups = pa.ListArray.from_arrays(groups.offsets, pa.array(known.keys, pa.string()).take(groups.values))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, sizes), pa.array(written, pa.string()), groups, _lists(times, np.int32), _lists(pairs, np.int64), _lists(over, np.int32)], names)
                if known.full:
                    known.clear()

    return map_arrow(own, step, schema)


def _expanded(groups: DataFrame) -> DataFrame:
    """``key, n, a, b, times``: each distinct pair of each group, and how many links of the group it is."""
    halves = groups.withColumn("half", F.split("key", r"\|")).select("key", "n", *(F.split(F.col("half")[k], ",").cast("array<int>").alias(c) for k, c in enumerate(("as", "bs"))))
    own = halves.select("key", "n", "as", "bs", F.explode(F.array_distinct("as")).alias("a")).select("*", F.explode(F.array_distinct("bs")).alias("b"))
    times = F.size(F.filter("as", lambda x: x == F.col("a"))).cast("long") * F.size(F.filter("bs", lambda x: x == F.col("b")))
    return own.select("key", "n", "a", "b", times.alias("times"))


def dictionary(read: DataFrame) -> DataFrame:
    """``key, n``, written to the shared folder: every distinct group and how many documents hold it; of :func:`read_groups`."""
    return staged(read.select(F.explode("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "groups")


def link_counts(read: DataFrame, interned: DataFrame) -> DataFrame:
    """``a, b, n, best``: how many documents hold each pair linked, and whether no pair of the same A id has more.

    An A id has at most as many rows as the other vocabulary has ids.
    """
    overlaps = read.select(F.explode(F.arrays_zip("pair", "over")).alias("o")).groupBy("o.pair").agg(F.sum("o.over").alias("n"))
    pair = F.col("pair")
    overlaps = overlaps.select(F.shiftright(pair, 32).cast("int").alias("a"), F.expr("pair & 4294967295").cast("int").alias("b"), (-F.col("n")).alias("n"))
    pairs = staged(_expanded(interned).select("a", "b", "n").unionAll(overlaps).groupBy("a", "b").agg(F.sum("n").alias("n")), "links")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``groups`` is ``a1,a2|b1;a3|b2``; with ``digest`` there is its SHA-256
    instead, as ``groups_sha256``. Texts that are null, empty, or not what the
    tokens of both give back have zeros and an empty string, for the digest
    too. Very long texts are aligned whole; ties for the best link all count;
    each of repeated rows is a document; null ids and further columns of any
    name are fine, and an empty table gives an empty result.

    The ``MOST_HELD`` most frequent groups' sums are broadcast (so no key is
    hot after that), and only pairs of a document and a rarer group are
    shuffled. Each text is read once; what is read is written to the shared
    folder.
    """
    read = staged(read_groups(docs, a_path, b_path, id_col, text_col, digest), "aligned")
    interned = dictionary(read)
    linked = _expanded(interned).withColumnRenamed("n", "docs").join(link_counts(read, interned), ["a", "b"])
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    sums = staged(linked.groupBy("key").agg(F.max("docs").alias("n"), best.alias("best"), F.sum(F.col("times") * F.col("n")).alias("counts")), "group-sums")
    least = least_count(sums, MOST_HELD)
    asked = read.select("nth", F.explode(F.arrays_zip("key", "times")).alias("g")).select("nth", F.col("g.key").alias("key"), F.col("g.times").cast("long").alias("times"))
    n_best, count_sum = F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("counts")).alias("count_sum")
    added = asked.join(F.broadcast(sums.where(F.col("n") >= least).select("key", "best", "counts")), "key").groupBy("nth").agg(n_best, count_sum)
    if least > 1:
        rarer = sums.where(F.col("n") < least).select("key", "best", "counts")
        asked = asked.join(F.broadcast(sums.where(F.col("n") >= least).select("key")), "key", "left_anti")
        added = added.unionAll(asked.join(rarer, "key").groupBy("nth").agg(n_best, count_sum)).groupBy("nth").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    whole = read.drop("key", "times", "pair", "over").join(added, "nth", "left")
    return whole.select("id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), read.columns[6])
