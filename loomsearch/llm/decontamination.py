"""Benchmark decontamination with a generalised suffix automaton of the test items.

Training words stream through the automaton, which knows at each word the
longest stretch of words ending there that some item contains. Words under a
stretch of ``window`` item words, or under a whole shorter item, are hit.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, only, staged
from .tokens import in_slices

WINDOW = 10
#: Item words in one automaton. Benchmarks with more are worked off in several, so what is broadcast stays bounded.
MOST_WORDS = 1_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, letters and characters beyond ASCII, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over items given as lists of word numbers.

    ``items_at[state]``: the items that contain the state's stretches; for the
    states of stretches of ``window`` words only. ``ends_at[state]``: short
    items that are the state's own longest or a shorter stretch of it.
    """

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = array("q", [-1])
        self.length = array("q", [0])
        owners: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w, owners)
                owners[last].add(k)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for v in order:  # an item that contains a stretch contains its suffixes
            if self.length[self.link[v]] >= window:
                owners[self.link[v]] |= owners[v]
        self.items_at = {v: sorted(s) for v, s in enumerate(owners) if v and self.length[v] >= window}
        self.ends_at: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                v = 0
                for w in words:
                    v = self.next[v][w]
                self.ends_at.setdefault(v, []).append((len(words), k))
        for v in reversed(order):  # shorter ones first: what ends at a suffix ends here too
            if more := self.ends_at.get(self.link[v]):
                self.ends_at[v] = self.ends_at.get(v, []) + more
        short = [len(words) for _, words in items if 0 < len(words) < window]
        self.least = min([window, *short])

    def _extend(self, last: int, w: int, owners: list[set[int]]) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q, owners)
        new = self._state(self.length[last] + 1, {}, owners)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q, owners)
        return new

    def _state(self, length: int, edges: dict[int, int], owners: list[set[int]]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        owners.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int, owners: list[set[int]]) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), owners)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def stream(self, words: list[int], begin: int, spans: list[list[int]], items: set[int]) -> None:
        """Adds to ``spans`` the places (from ``begin``) that are hit, and to ``items`` whose stretches they are."""
        state, n = 0, 0
        edges, link, length, window = self.next, self.link, self.length, self.window
        for i, w in enumerate(words, begin):
            to = edges[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = edges[state].get(w)
            if to is None:
                continue
            state, n = to, n + 1
            first = i + 1
            if n >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items.update(self.items_at[at])
                first = i + 1 - window
            for size, k in self.ends_at.get(state, ()):
                if size <= n:
                    items.add(k)
                    first = min(first, i + 1 - size)
            if first <= i:
                if spans and first <= spans[-1][1]:
                    while spans and first <= spans[-1][1]:
                        first = min(first, spans.pop()[0])
                spans.append([first, i + 1])


class Matcher:
    """One automaton with its vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        numbered = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]) for name, text in items]
        self.automaton = Automaton(numbered, window)

    def match(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Hit spans (word from, word to) in order and names of the items found.

        Only runs of item words that are long enough for the shortest window
        are streamed; no match can cross a word that no item has.
        """
        at = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (at >= 0).view(np.int8), [0]))))
        spans: list[list[int]] = []
        items: set[int] = set()
        for begin, end in edge.reshape(-1, 2)[np.diff(edge)[::2] >= self.automaton.least] if len(edge) else ():
            self.automaton.stream(at[begin:end].tolist(), int(begin), spans, items)
        return spans, [name for k in items if (name := self.automaton.names[k]) is not None]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most_words: int) -> Iterator[list[Row]]:
    """The items in blocks of bounded size. They arrive one partition at a time, and only a block is held."""
    block: list[Row] = []
    size = 0
    for row in only(benchmark, item=item_col, text=text_col).where("text is not null").select(F.col("item").cast("string"), "text").toLocalIterator():
        n = len(row["text"]) // 4 + 1
        if block and size + n > most_words:
            yield block
            block, size = [], 0
        block.append(row)
        size += n
    yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), most_words: int = MOST_WORDS
) -> DataFrame:
    """``id, n_words, spans (of words, from and to), items`` of every document, and the columns in ``keep``.

    One scan for every block of items (nearly always one), no shuffle; between
    blocks the result is written, and the block before is let go. Null and
    empty texts have no words; items without text or words never occur; items
    without a name are looked for like others and not listed; items with one
    name count once; repeated rows are rows of their own.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))
    out = out.select("*", F.lit(0).cast("long").alias("n_words"), F.lit([]).cast("array<array<int>>").alias("spans"), F.lit([]).cast("array<string>").alias("items"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    blocks = item_blocks(benchmark, item_col, item_text_col, most_words)
    block = next(blocks)
    while block is not None:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], r["text"]) for r in block]))

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent, window)
            for whole in batches:
                for batch in in_slices(whole, 1):
                    n_words, spans, items = [], [], []
                    before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                    for text, (old_spans, old_items) in zip(batch.column(1).to_pylist(), before, strict=True):
                        words = words_of(text)
                        new_spans, new_items = matcher.match(words)
                        n_words.append(len(words))
                        spans.append(_merged(old_spans + new_spans) if old_spans else new_spans)
                        items.append(sorted({*old_items, *new_items}))
                    new = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "items": pa.array(items, pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

        out = map_arrow(out, step, schema)
        block = next(blocks, None)
        if block is not None:
            out = staged(out, "leaks")
            sent.destroy()
    return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(sent, window: int) -> Matcher:
    """This process's matcher for a broadcast; only the last is kept."""
    key, items = sent.value
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, window)
    return _MATCHERS[key]


def remove_leaks(found: DataFrame, least_words: int = WINDOW, most_coverage: float = 0.5) -> DataFrame:
    """Cuts the hit spans of at least ``least_words`` words out of the texts of ``find_leaks()``, and drops texts hit over ``most_coverage``.

    A span goes with the characters between its words; what stands before and
    after it stays and is joined by a space. ``text`` of texts without such
    spans is as it was.
    """
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0])
    kept = found.where(F.coalesce(hit <= most_coverage * F.col("n_words"), F.lit(True)))
    long = F.filter("spans", lambda s: s[1] - s[0] >= least_words)
    kept = kept.withColumn("spans", long)
    schema = kept.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            if any(spans):
                texts = [without(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
                columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch

    return map_arrow(kept, step, schema)


def without(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words from and to each span."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]].rstrip())
        at = places[b - 1][1]
    out.append(raw[at:])
    return b" ".join(x for x in out if x).decode()
