"""Token counts and ids of whole texts, from their pre-tokens.

A *pre-token* here is a stretch of text from one space to the next, with the
space before it. The tokenizers used never merge across the start of such a
stretch, so a text's ids are the ids of its stretches in a row. ``count_tokens``
counts the pieces of every distinct stretch of the corpus once and joins them to
the stretches of each document. ``PieceTable`` gives ids: each worker process
keeps what it has encoded in a bounded table and only ever asks the library
about stretches that are new to it. Stretches are cut, numbered and put together
again in Arrow arrays, so Python sees each of them once for some MB of text.
Where pieces have neither spaces nor capitals, Latin-1 texts are cut into pieces
at once, so that a word is the same entry in all its stretches.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_count, map_arrow, only, staged

#: Stretches that a worker keeps before those go that came only once, pieces before they start afresh, and the longest stretch that is kept.
MOST_KEPT, MOST_PIECES, LONGEST_KEPT = 500_000, 100_000, 48
#: Stands for no entry, where None is one.
_ABSENT = object()


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


# The two splitting patterns that the vocabularies' files name.
_SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The first for printable Latin-1, of which only a leading space is white: there the library's classes are these.
_SPACED_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[{0}]+| ?[{1}]+| ?[^ {0}{1}]+| +".format("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"))
_BARE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The second for Latin-1 in UTF-8: what its characters are, by the first byte or, behind 0xC2 and 0xC3, by the code, and their small letters.
_WHITE, _LETTER, _NUMBER, _SIGN = range(4)
_KINDS = bytes(_WHITE if regex.match(r"\s", c) else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _SIGN for c in map(chr, range(256)))
_SMALL = bytes(ord(chr(c).lower()) for c in range(128)) + bytes(range(128, 256))
_LATIN_KINDS = np.frombuffer(_KINDS, np.uint8)[128:]
_LATIN_SMALL = np.array([c.lower().encode()[1] for c in map(chr, range(128, 256))], np.uint8)

#: Signs that end a word and are a piece of their own there.
_ENDS = frozenset(",.;:!?")
_LETTERS = _byte_letters()
_TABLES: dict[tuple[str, bool], PieceTable] = {}


class PieceTable:
    """Looks up the ids (little-endian unsigned 32-bit, as bytes) or the number of ids of texts.

    A stretch is cut into the library's own pieces (words, punctuation) once,
    and each distinct piece is given to the library's model once. A stretch
    whose first character is white space (several spaces in a row, say) is
    joined to the one before it, because white space runs are cut by their
    end. A text that contains the string of a special token goes to the
    library whole, and a very long stretch is encoded without being kept.
    """

    def __init__(self, path: str, counts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.counts = counts
        spec = json.loads(self.library.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        #: Whether plain words can be cut here, without the library's splitter, and whether a piece has the space before it.
        self.spaced = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]
        self.plain = self.spaced or kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in spec["pre_tokenizer"].get("pretokenizers", [])] == ["Split", "ByteLevel"]
        self.later: dict[str, bytes | int | None] = {}  # stretches after a space
        self.first: dict[str, bytes | int | None] = {}  # stretches that begin a text
        self.again: set[str] = set()  # of the stretches after a space, those that a later call met
        self.pieces: dict[str, bytes | int] = {}
        self.bare: dict[str, bytes | int] = {}  # pieces of vocabularies whose pieces have no space, and of these, those that a later call met
        self.bare_again: set[str] = set()

    @classmethod
    def of(cls, path: str, counts: bool = False) -> PieceTable:
        """This process's table: worker processes outlive tasks, and so do their tables."""
        if (path, counts) not in _TABLES:
            _TABLES[path, counts] = cls(path, counts)
        return _TABLES[path, counts]

    def _value(self, ids: list[int]):
        return len(ids) if self.counts else array("I", ids).tobytes()

    def _whole(self, text: str):
        return self._value(self.library.encode(text, add_special_tokens=False).ids)

    def _cut(self, text: str) -> list[str]:
        """The library's pieces of a stretch with the space before it; by its own pattern where all characters are Latin-1 ones, or else by its splitter."""
        if self.plain and (text.isascii() or max(text) < "\u0100"):
            if self.spaced:
                if text.isprintable() and text.rfind(" ") <= 0:
                    found = _SPACED_LATIN.findall(text)
                    if text.isascii():
                        if found and found[0][0] == " ":
                            found[0] = "\u0120" + found[0][1:]
                        return found
                    return [p.encode().decode("latin-1").translate(_LETTERS) for p in found]
                return [p.encode().decode("latin-1").translate(_LETTERS) for p in _SPACED.findall(text)]
            text = "".join(c.lower() for c in text)
            return [p.encode().decode("latin-1").translate(_LETTERS) for p in _BARE.findall(text)]
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _piece(self, p: str):
        found = self.pieces.get(p)
        if found is None:
            found = self.pieces[p] = self._value([t.id for t in self.tokenize(p)])
        return found

    def _word(self, s: str, mark: str, table: dict):
        """The value of a Latin-1 word, or of one with a sign behind it, by the word's own entry in ``table``; None for all else."""
        if s.isalpha():
            end = ""
        elif s[-1:] in _ENDS and s[:-1].isalpha():
            s, end = s[:-1], s[-1]
        else:
            return None
        found = table.get(s)
        if found is None:
            p = s if self.spaced else s.lower()
            p = mark + p if p.isascii() else mark + p.encode().decode("latin-1").translate(_LETTERS)
            found = table[s] = self._value([t.id for t in self.tokenize(p)])
        return found + self._piece(end) if end else found

    def _learn(self, table: dict, new: Iterable[str], lead: str) -> None:
        plain, spaced, word = self.plain, self.spaced, self._word
        mark = "\u0120" if lead and spaced else ""
        nothing = 0 if self.counts else b""
        for s in new:
            if plain and len(s) <= LONGEST_KEPT and (s.isascii() or max(s) < "\u0100"):
                found = word(s, mark, table)
                if found is None and "\n" in s:  # a line's end between two words is a piece of its own, or none
                    before, after = s.split("\n", 1)
                    before, after = word(before, mark, table), word(after, "", self.first)
                    if before is not None and after is not None:
                        found = before + (self._piece("\u010a") if spaced else nothing) + after
                if found is not None:
                    table[s] = found
                    continue
            if len(s) > LONGEST_KEPT or lead and (not s or s[0].isspace()) or "<" in s and any(x in s for x in self.specials):
                table[s] = None
            else:
                whole = nothing
                for p in self._cut(lead + s):
                    whole += self._piece(p)
                table[s] = whole

    def _carefully(self, parts: list[str], text: str):
        if any(s in text for s in self.specials):
            return self._whole(text)
        joined, start = [], 0
        for i in range(1, len(parts) + 1):
            if i == len(parts) or parts[i] and not parts[i][0].isspace():
                joined.append((" " if start else "") + " ".join(parts[start:i]))
                start = i
        found = [self.later.get(s[1:]) if k else self.first.get(s) for k, s in enumerate(joined)]
        found = [self._whole(joined[k]) if v is None else v for k, v in enumerate(found)]
        return sum(found) if self.counts else b"".join(found)

    def _make_room(self) -> None:
        if len(self.later) + len(self.first) > MOST_KEPT:
            later, self.first = self.later, {}
            self.later = {s: later[s] for s in self.again if s in later}
            if 4 * len(self.later) > 3 * MOST_KEPT:
                self.later = {}
            self.again = set()
        if len(self.pieces) > MOST_PIECES:
            self.pieces = {}
        if len(self.bare) > MOST_KEPT:
            self.bare = {s: self.bare[s] for s in self.bare_again}
            if 4 * len(self.bare) > 3 * MOST_KEPT:
                self.bare = {}
            self.bare_again = set()

    def look_up(self, texts: list[str | None] | pa.Array) -> list:
        """For each text its ids as bytes, or how many there are. Null counts as empty."""
        self._make_room()
        if not len(texts):
            return []
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        return self._by_pieces(column) if self.plain and not self.spaced else self._by_stretches(column)

    def _by_pieces(self, column: pa.Array) -> list:
        """The texts of Latin-1 by their pieces, so that a word is one entry whatever stands around it and whichever letters are capitals; others by stretches."""
        data, offsets = _bytes_of(column)
        odd = np.zeros(len(column), bool)
        odd[np.searchsorted(offsets, np.flatnonzero(np.frombuffer(data, np.uint8) >= 0xC4), side="right") - 1] = True
        for s in (s for s in self.specials if s.encode() in data):
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        del data  # a dozen MB, as are the marks below
        rest = column.filter(pa.array(odd))
        if len(rest):
            column = pc.if_else(pa.array(odd), pa.scalar("", column.type), column)
        pieces, starts = _bare_pieces(column)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [self.bare.get(s) for s in distinct]
        self.bare_again.update(s for s, v in zip(distinct, found, strict=True) if v is not None)
        for k, v in enumerate(found):
            if v is None:
                s = distinct[k]
                p = s if s.isascii() and s.isprintable() else s.encode().decode("latin-1").translate(_LETTERS)
                found[k] = self._value([t.id for t in self.tokenize(p)])
                if len(s) <= LONGEST_KEPT:
                    self.bare[s] = found[k]
        out, _ = self._joined(found, coded.indices, starts)
        if len(rest):
            for k, ids in zip(np.flatnonzero(odd).tolist(), self._by_stretches(rest), strict=True):
                out[k] = ids
        return out

    def _joined(self, found: list, at: pa.Array, starts: np.ndarray) -> tuple[list, pa.Array]:
        """What ``found`` has at ``at``, joined from each of ``starts`` to the next, and not joined."""
        each = pa.array(found, pa.int64() if self.counts else pa.binary()).take(at)
        if self.counts:
            ends = np.append(0, np.cumsum(each.fill_null(0).to_numpy()))[starts].tolist()
            return [b - a for a, b in zip(ends, ends[1:])], each
        ends = np.frombuffer(each.buffers()[1], np.int32, len(each) + 1, 4 * each.offset)[starts].tolist()
        ids = memoryview(each.buffers()[2] or b"")
        return [bytes(ids[a:b]) for a, b in zip(ends, ends[1:])], each

    def _by_stretches(self, column: pa.Array) -> list:
        parts = pc.split_pattern(column, " ")
        starts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [distinct[k] for k in coded.indices.take(pa.array(starts[:-1])).to_pylist()]
        self._learn(self.first, {s for s in heads if s not in self.first}, "")
        held = [self.later.get(s, _ABSENT) for s in distinct]
        new = [s for s, v in zip(distinct, held, strict=True) if v is _ABSENT]
        self.again.update(s for s, v in zip(distinct, held, strict=True) if v is not _ABSENT)
        self._learn(self.later, new, " ")
        # what begins a text is an entry of its own behind all others
        found = [self.later[s] if v is _ABSENT else v for s, v in zip(distinct, held, strict=True)] + [self.first[s] for s in heads]
        at = coded.indices.to_numpy().copy()
        at[starts[:-1]] = np.arange(len(distinct), len(found))
        out, each = self._joined(found, pa.array(at), starts)
        if each.null_count:
            odd = np.unique(np.searchsorted(starts, np.flatnonzero(each.is_null().to_numpy(zero_copy_only=False)), side="right") - 1)
            for k in odd.tolist():
                text = column[k].as_py()
                out[k] = self._carefully(text.split(" "), text)
        return out


def _bytes_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a column without nulls in a row, and where each begins."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    size = int(offsets[-1] - offsets[0])
    return (column.buffers()[2].slice(int(offsets[0]), size).to_pybytes() if size else b""), offsets - offsets[0]


def _bare_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of Latin-1 texts by ``_BARE``, in small letters, and the first of each text, with an end: by marks on all bytes at once."""
    data, offsets = _bytes_of(pc.binary_join_element_wise(column, "", " "))  # so that no piece reaches into the next text
    kinds = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    small = np.frombuffer(bytearray(data.translate(_SMALL)), np.uint8)
    del data
    wide = np.flatnonzero(small >= 0xC2)
    code = ((small[wide] & 1) << 6) + (small[wide + 1] & 63)
    kinds[wide] = kinds[wide + 1] = _LATIN_KINDS[code]
    small[wide + 1] = _LATIN_SMALL[code]
    begins = kinds == _NUMBER
    begins[wide + 1] = False
    begins[0] = True
    begins[1:] |= kinds[1:] != kinds[:-1]
    solid = kinds != _WHITE
    begins &= solid
    quotes = np.flatnonzero(small == ord("'"))
    quotes = quotes[begins[quotes]]
    one, two = small[quotes + 1], small[np.minimum(quotes + 2, len(small) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
    begins[quotes[short | long] + 1] = False
    after = np.append(quotes[short] + 2, quotes[long] + 3)
    begins[after] = solid[after]
    inside = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(inside) - 1, pa.py_buffer(inside), pa.py_buffer(small[solid]))
    return pieces, np.searchsorted(np.flatnonzero(begins), offsets)


def in_slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most_bytes`` of text each, at least a row."""
    size = max(1, batch.column(column).nbytes)
    rows = max(1, batch.num_rows * most_bytes // size)
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 12 << 20, most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches joined, and large ones cut, to about ``most_bytes`` of text: the more at once, the fewer times a stretch is met."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        for part in in_slices(batch, column, most_bytes):
            held.append(part)
            size, rows = size + part.column(column).nbytes, rows + part.num_rows
            if size >= most_bytes or rows >= most_rows:
                yield pa.concat_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.concat_batches(held)


class Splitter:
    """Cuts texts into pre-tokens and counts them; see the module. Strings of special tokens are pre-tokens of their own.

    Pre-tokens that begin with a space are counted without it, in ``later``;
    all others in ``first``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        #: Whether special strings are cut out of a text as they are; if not, a text that has one is a pre-token itself.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.pattern = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def count(self, text: str, later: Counter[str], first: Counter[str]) -> None:
        if self.pattern is not None and self.pattern.search(text):
            if not self.plain:
                self._put(text, later, first)
                return
            for k, part in enumerate(self.pattern.split(text)):
                if k % 2:
                    first[part] += 1
                else:
                    self._cut(part, later, first)
        else:
            self._cut(text, later, first)

    @staticmethod
    def _put(stretch: str, later: Counter[str], first: Counter[str]) -> None:
        if stretch.startswith(" "):
            later[stretch[1:]] += 1
        elif stretch:
            first[stretch] += 1

    def _cut(self, text: str, later: Counter[str], first: Counter[str]) -> None:
        parts = text.split(" ")
        if not _RUN.search(text):
            if parts[0]:
                first[parts[0]] += 1
            later.update(parts[1:])
            return
        start = 0
        for i in range(1, len(parts) + 1):  # what begins with white space belongs to the stretch before it
            if i == len(parts) or parts[i] and not parts[i][0].isspace():
                self._put((" " if start else "") + " ".join(parts[start:i]), later, first)
                start = i

    def sizes(self, stretches: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        out: list[int] = []
        for k in range(0, len(stretches), 2000):
            out += [len(e.ids) for e in self.library.encode_batch(stretches[k : k + 2000], add_special_tokens=False)]
        return out


#: A space before white space or at the end.
_RUN = re.compile(r" (?=\s|\Z)")
#: Pre-tokens whose counts each task holds, the most frequent ones; all others come by a join, so this bounds memory and not what is counted.
MOST_HELD = 300_000


def pre_token_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``piece, n, size``: every distinct pre-token of all texts, how often it occurs, and how many pieces it has, counted once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        later: Counter[str] = Counter()
        first: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*(" " + s for s in later), *first], pa.string()), pa.array([*later.values(), *first.values()], pa.int64())], ["piece", "n"])
            later.clear()
            first.clear()
            return out

        for batch in batches:
            for part in in_slices(batch, 0):
                for text in part.column(0).to_pylist():
                    splitter.count(text, later, first)
                if len(later) + len(first) > 200_000:
                    yield rows()
        yield rows()

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        for batch in batches:
            for part in in_slices(batch, 0):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(splitter.sizes(part.column(0).to_pylist()), pa.int64())], ["piece", "n", "size"])

    found = map_arrow(only(docs, text=text_col).where(F.col("text") != ""), step, "piece string, n long")
    return map_arrow(found.groupBy("piece").agg(F.sum("n").alias("n")), sized, "piece string, n long, size long")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of every row.

    Pieces are counted once for each distinct pre-token of the corpus; that
    table meets the pre-token frequencies of each document, and the products
    are summed, so no ids are made. The ``MOST_HELD`` most frequent pre-tokens
    meet in the tasks (they are most of all occurrences, and no key is hot after
    that); only pairs of a document and a rarer pre-token are shuffled.

    Null and empty texts have no bytes and no tokens; repeated rows and null
    ids are counted like others; an empty table gives an empty result.
    """
    table = staged(pre_token_table(docs, path, text_col), "pre-tokens")
    least = least_count(table, MOST_HELD)
    frequent = table.where(F.col("n") >= least).select("piece", "size").toArrow()
    held = dict(zip(frequent.column("piece").to_pylist(), frequent.column("size").to_pylist(), strict=True))
    sent = docs.sparkSession.sparkContext.broadcast(held)
    own = only(docs, id=id_col, text=text_col).select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("nth"), "text")
    schema = T.StructType([*own.schema.fields[:3], *T.StructType.fromDDL("known long, piece array<string>, times array<long>").fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = Splitter(path), sent.value
        after = {s[1:]: n for s, n in held.items() if s.startswith(" ")}
        for batch in batches:
            for part in in_slices(batch, 3):
                sums: list[int] = []
                others: list[list[str]] = []
                times: list[list[int]] = []
                for text in part.column(3).to_pylist():
                    later: Counter[str] = Counter()
                    first: Counter[str] = Counter()
                    splitter.count(text or "", later, first)
                    known, far, often = 0, [], []
                    for counts, sizes, lead in ((later, after, " "), (first, held, "")):
                        for s, n in counts.items():
                            size = sizes.get(s)
                            if size is None:
                                far.append(lead + s)
                                often.append(n)
                            else:
                                known += n * size
                    sums.append(known)
                    others.append(far)
                    times.append(often)
                columns = [pa.array(sums, pa.int64()), pa.array(others, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], schema.names)

    met = map_arrow(own, step, schema)
    if least <= 1:  # all are held
        return met.select("id", "n_bytes", F.col("known").alias("n_tokens"))
    met = staged(met, "met")
    rarer = table.where(F.col("n") < least).select("piece", "size")
    asked = met.select("nth", F.explode(F.arrays_zip("piece", "times")).alias("w")).select("nth", F.col("w.piece").alias("piece"), F.col("w.times").alias("times"))
    more = asked.join(rarer, "piece").groupBy("nth").agg(F.sum(F.col("times") * F.col("size")).alias("more"))
    return met.select("id", "n_bytes", "nth", "known").join(more, "nth", "left").select("id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
