"""Byte-pair encoding and decoding of whole texts with a rank array.

A pre-token is cut into its bytes. Two arrays describe it: its *parts*, side by
side, and for each part the *rank* of the merge with the part after it. Until no
rank is left, the ranks are scanned for the smallest one, the boundary in the
middle of that pair is deleted, so all behind it moves up, and the ranks on both
sides are refreshed. For short words, as nearly all are, a scan of a few numbers
beats any queue; long ones use a queue, to the same effect. Words of about the
same length are rows of one matrix and go through these steps together. What
each process has encoded is remembered, by pre-token and by stretch from space
to space.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, only
from .tokens import _LETTERS, _RUN, _SPACED, in_slices

#: Stretches and pre-tokens that a worker remembers before it starts afresh.
MOST_KEPT = 250_000
#: Bytes up to which words are scanned, by the matrix they are in; longer ones use a queue.
WIDTHS = (4, 8, 12, 16, 24, 40)
#: Characters of a text that are encoded at a time, or a few more, for it is only cut where no pre-token goes on.
BLOCK = 1 << 16

_NONE = np.int32(2**31 - 1)
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, ByteBPE] = {}


def _stretches(block: str) -> list[str]:
    """A block by its spaces; where one is next to other white space, only by those between two words."""
    if not _RUN.search(block):
        return block.split(" ")
    starts = [0, *(m.start() + 1 for m in _CUT.finditer(block)), len(block) + 1]
    return [block[a : b - 1] for a, b in zip(starts, starts[1:])]


class RankTable:
    """Ranks of pairs of ids, in an open hash table that whole arrays look up at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray | None = None):
        """Pairs are ranked by their order, or as ``ranks`` says, where several may share one."""
        self.mask = (1 << max(4, int(len(left)).bit_length() + 2)) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int32)
        ranks = np.arange(len(left)) if ranks is None else ranks
        keys = left.astype(np.int64) << 32 | right
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[todo[put]], ranks[todo[put]]
            left_over = np.delete(np.arange(len(todo)), put)
            todo, at = todo[left_over], at[left_over] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(-7046029254386353131) >> 33) & self.mask

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``_NONE``."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], _NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            held = self.keys[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.ranks[at[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out


def scan_merge(parts: np.ndarray, table: RankTable, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of short words and how many each has.

    ``parts`` has a word's byte ids in each row, filled up with -1, ``merged``
    the id that each rank makes. Ties go to the leftmost pair. As every row that
    goes on loses a boundary in a step, so does the matrix.
    """
    n, width = parts.shape
    out, sizes = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
    rows = np.arange(n)
    near = table.of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
    while True:
        width = parts.shape[1]
        k = near.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
        least = near[np.arange(len(rows)), k] if width > 1 else np.full(len(rows), _NONE)
        ended = least == _NONE
        out[rows[ended], :width], sizes[rows[ended]] = parts[ended], (parts[ended] >= 0).sum(axis=1)
        go = np.flatnonzero(~ended)
        if not len(go):
            return out, sizes
        rows, k, least = rows[go], k[go], least[go]
        own, each = np.arange(width - 1), np.arange(len(rows))
        parts = parts[go[:, None], own + (own > k[:, None])]
        parts[each, k] = merged[least]
        near = near[go[:, None], own[:-1] + (own[:-1] >= k[:, None])]
        here = np.flatnonzero(k < width - 2)
        near[here, k[here]] = table.of(parts[here, k[here]], parts[here, k[here] + 1])
        here = np.flatnonzero(k > 0)
        near[here, k[here] - 1] = table.of(parts[here, k[here] - 1], parts[here, k[here]])


def merge_rows(parts: np.ndarray, lengths: np.ndarray, table: RankTable, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merged parts of words, one after the other, and how many each has; ``parts`` are those of all words in a row, of which each has ``lengths``, at most the widest row."""
    starts = np.cumsum(lengths) - lengths
    sizes, found, order = np.zeros(len(lengths), np.int64), [], []
    for least, width in zip((0, *WIDTHS), WIDTHS):
        here = np.flatnonzero((lengths > least) & (lengths <= width))
        if len(here):
            inside = np.arange(width) < lengths[here, None]
            rows = np.where(inside, parts[np.minimum(starts[here, None] + np.arange(width), len(parts) - 1)], -1).astype(np.int32)
            rows, sizes[here] = scan_merge(rows, table, merged)
            inside = np.arange(width) < sizes[here, None]
            found.append(rows[inside])
            order.append(np.repeat(here, sizes[here]))
    if not found:
        return np.zeros(0, np.int32), sizes
    return np.concatenate(found)[np.argsort(np.concatenate(order), kind="stable")], sizes


def queue_merge(parts: list[int], ranks: dict[tuple[int, int], int], merged: np.ndarray) -> list[int]:
    """The same for one word of any length: ranks wait in a queue, parts are linked in both directions."""
    n = len(parts)
    parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))  # a part of -1 is gone
    queue = [(ranks[p], k, p) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(queue)
    while queue:
        rank, k, pair = heapq.heappop(queue)
        b = after[k]
        if b >= n or (parts[k], parts[b]) != pair:
            continue  # one of its two parts has changed since
        parts[k], parts[b], after[k] = int(merged[rank]), -1, after[b]
        if after[k] < n:
            before[after[k]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right < n and (parts[left], parts[right]) in ranks:
                pair = parts[left], parts[right]
                heapq.heappush(queue, (ranks[pair], left, pair))
    return [p for p in parts if p >= 0]


class ByteBPE:
    """A byte-level vocabulary file of the tokenizers library: its merges as ranks, its tokens as bytes.

    Of the library itself, only its splitter is used, and that only for blocks
    with characters beyond Latin-1, where Unicode tables of different versions
    differ. A special token's string in a text is that token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        odd = [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if model["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or odd:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocabulary[p[0] + p[1]] for p in pairs], np.int32)
        self.table = RankTable(left, right)
        self.ranks = {pair: k for k, pair in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.letters = np.array([vocabulary[chr(_LETTERS[b])] for b in range(256)], np.int32)
        self.pieces: dict[str, bytes] = {}  # ids of pre-tokens
        self.later: dict[str, bytes] = {}  # ids of stretches with a space before them
        self.first: dict[str, bytes] = {}  # ids of stretches at the start of a text
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        byte = {chr(c): b for b, c in _LETTERS.items()}
        tokens = {k: t for t, k in model["vocab"].items()} | {t["id"]: t["content"] for t in added}
        self.tokens = {k: bytes(map(byte.__getitem__, t)) if byte.keys() >= set(t) else t.encode() for k, t in tokens.items()}

    @classmethod
    def of(cls, path: str) -> ByteBPE:
        """This process's encoder: worker processes outlive tasks, and so does what they remember."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word's bytes."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(lengths <= WIDTHS[-1])
        raw = np.frombuffer(b"".join([words[k] for k in short]), np.uint8)
        ids, sizes = merge_rows(self.letters[raw], lengths[short], self.table, self.merged)
        flat, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        for k, a, b in zip(short.tolist(), [0, *ends], ends):
            out[k] = flat[a:b]
        for k in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            out[k] = array("I", queue_merge(self.letters[np.frombuffer(words[k], np.uint8)].tolist(), self.ranks, self.merged)).tobytes()
        return out

    def _cut(self, block: str) -> list[str]:
        """The pre-tokens of a block."""
        try:
            block.encode("latin-1")
            return _SPACED.findall(block)
        except UnicodeEncodeError:
            return [block[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(block)]

    def _learn(self, table: dict[str, bytes], new: list[str], lead: str) -> None:
        cut = [self._cut(lead + s) for s in new]
        unknown = list({p for pieces in cut for p in pieces}.difference(self.pieces))
        self.pieces.update(zip(unknown, self.merge([p.encode() for p in unknown]), strict=True))
        table.update((s, b"".join([self.pieces[p] for p in pieces])) for s, pieces in zip(new, cut, strict=True))

    def _blocks(self, texts: list[str]) -> Iterator[tuple[int, bool, list[str] | bytes]]:
        """The number of a text, whether no space is before what follows, and the stretches of a block of it, or the id of a special string."""
        for k, text in enumerate(texts):
            special = any(x in text for x in self.special)
            for nth, whole in enumerate(self.specials.split(text) if special else [text]):
                if nth % 2:
                    yield k, False, self.special[whole]
                    continue
                at = 0
                while at < len(whole):
                    cut = _CUT.search(whole, at + BLOCK) if len(whole) - at > BLOCK else None
                    stop = cut.start() if cut else len(whole)
                    yield k, at == 0, _stretches(whole[at:stop] if at == 0 else whole[at + 1 : stop])
                    at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        blocks = self._blocks(texts)
        while some := list(islice(blocks, 64)):
            if max(len(self.later), len(self.first), len(self.pieces)) > MOST_KEPT:
                for table in (self.later, self.first, self.pieces):
                    table.clear()
            words = [(starts, parts) for _, starts, parts in some if isinstance(parts, list)]
            self._learn(self.first, list({parts[0] for starts, parts in words if starts}.difference(self.first)), "")
            new: set[str] = set()
            for starts, parts in words:
                new.update(parts[1:] if starts else parts)
            self._learn(self.later, list(new.difference(self.later)), " ")
            for k, starts, parts in some:
                if isinstance(parts, bytes):
                    out[k].append(parts)
                else:
                    if starts:
                        out[k].append(self.first[parts[0]])
                    out[k] += map(self.later.__getitem__, parts[1:] if starts else parts)
        return [b"".join(x) for x in out]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; those that no token has give nothing, and bytes that are no UTF-8 give replacement characters."""
        get = self.tokens.get
        try:
            return b"".join(map(self.tokens.__getitem__, ids)).decode(errors="replace")
        except KeyError:
            return b"".join(get(k, b"") for k in ids).decode(errors="replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (an array of integers) of every row, in one pass without a shuffle.

    Null and empty texts have no ids. Very long texts are encoded whole, block
    by block; long words go through a queue. Repeated rows and null ids give a
    row each, ties between merges go to the leftmost, further columns may have
    any name and are left behind, and an empty table gives an empty result.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBPE.of(path)
        for batch in batches:
            for part in in_slices(batch, 1):
                found = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int64).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    own = only(docs, id=id_col, text=text_col)
    return map_arrow(own, step, f"id {own.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id``, ``ids`` and the ``text`` that they stand for; null ids give a null text, and null entries give nothing."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBPE.of(path)
        for batch in batches:
            for part in in_slices(batch, 1):
                ids = part.column(1)
                values, ends = (ids.values, ids.offsets.to_pylist())
                values = values.to_numpy() if not values.null_count else np.array([-1 if v is None else v for v in values.to_pylist()])
                texts = [encoder.decode(values[a:b].tolist()) if there else None for a, b, there in zip(ends, ends[1:], ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["id", "ids", "text"])

    own = only(encoded, id=id_col, ids=ids_col)
    return map_arrow(own, step, f"id {own.schema['id'].dataType.simpleString()}, ids array<int>, text string")
