"""Chat formatting with a grammar round trip.

A formatted conversation is a run of turns ``<s>ROLE[INST]TEXT[/INST]</s>``.
Inside roles and texts, the characters of control strings are escaped only as
far as needed: a turn is formatted with what it has escaped so far, parsed by
the grammar again, and escaped further until the parse gives back the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, staged

#: The template's control strings, in the order in which a turn has them.
OPEN, BODY, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, BODY, END, CLOSE)
#: What an escape begins with; the letter after it says what stood there.
ESCAPE = "\\"
_LETTERS = {ESCAPE: "e", OPEN: "a", BODY: "b", END: "c", CLOSE: "d"}
_BACK = {letter: control for control, letter in _LETTERS.items()}


class NotATurn(ValueError):
    """The grammar does not accept the text."""


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    begin: int  # where the text stands in what was parsed, escapes and all
    end: int


def escape(text: str, controls: tuple[str, ...]) -> str:
    """``text`` with the escape character and the given control strings replaced by escapes."""
    for control in (ESCAPE, *controls):
        text = text.replace(control, ESCAPE + _LETTERS[control])
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    head, *rest = text.split(ESCAPE)
    out = [head]
    for piece in rest:
        if not piece or piece[0] not in _BACK:
            raise NotATurn("an escape that the grammar does not know")
        out += [_BACK[piece[0]], piece[1:]]
    return "".join(out)


def parse(text: str, at: int = 0) -> Iterator[Turn]:
    """The turns of a formatted text; deterministic, for each control string ends what comes before it at its first place."""
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise NotATurn("a turn begins with " + OPEN)
        body = text.find(BODY, at + len(OPEN))
        begin = body + len(BODY)
        end = text.find(END + CLOSE, begin)
        if body < 0 or end < 0:
            raise NotATurn("a turn is not whole")
        role, content = text[at + len(OPEN) : body], text[begin:end]
        for inner in (role, content):
            if any(c in inner for c in CONTROLS):
                raise NotATurn("a control string inside a turn")
        yield Turn(unescape(role), unescape(content), begin, end)
        at = end + len(END) + len(CLOSE)


def render(role: str, text: str) -> str:
    """One formatted turn from which ``parse()`` gets ``role`` and ``text`` back.

    It starts from the escape character alone and adds one control string
    after the other until the round trip is exact; if a new one appears where
    an escape meets what follows, the next round catches it.
    """
    escaped: tuple[str, ...] = ()
    while True:
        turn = OPEN + escape(role, escaped) + BODY + escape(text, escaped) + END + CLOSE
        try:
            if [(t.role, t.text) for t in parse(turn)] == [(role, text)]:
                return turn
        except NotATurn:
            pass
        if len(escaped) == len(CONTROLS):
            raise NotATurn("no escape makes the turn unambiguous")
        escaped = CONTROLS[: len(escaped) + 1]


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, nth, formatted``: each turn formatted, escaped and checked by reparsing, where it stands.

    A conversation's formatted text is its ``formatted`` in the order of
    ``turn`` (nulls first), ``role`` and ``text``; the grammar closes every
    turn, so turns can be formatted and read apart and a conversation of any
    length is never in memory. Null roles and texts are empty; rows without a
    conversation are one conversation of their own; repeated rows are turns.
    """
    own = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("nth"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([own.schema["conv"], own.schema["nth"], T.StructField("formatted", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], schema.names)

    return map_arrow(own, step, schema)


def read_chats(formatted: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation, from its formatted text alone: ``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Turns are parsed where they are; what is digested streams through one task
    for each conversation in sorted order, for SHA-256 is sequential. A task
    holds one batch of turns at a time and sorts on disk, so a conversation
    may be of any length.
    """
    conv, nth = formatted.schema["conv"], formatted.schema["nth"]
    turns = T.StructType([conv, nth, *T.StructType.fromDDL("role string, text string, chars long").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            found = [next(parse(t)) for t in texts]
            columns = [pa.array([f.role for f in found], pa.string()), pa.array([f.text for f in found], pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("nth"), *columns], turns.names)

    out = T.StructType([conv, *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Digest | None = None
        for batch in batches:
            done: list[_Digest] = []
            for key, role, text, chars in zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), batch.column("chars").to_pylist(), strict=True):
                if state is None or state.key != key:
                    if state is not None:
                        done.append(state)
                    state = _Digest(key)
                state.add(role, text, chars, role in loss_roles)
            yield _rows(done, batch.schema.field("conv").type, out)
            kind = batch.schema.field("conv").type
        if state is not None:
            yield _rows([state], kind, out)

    parsed = map_arrow(formatted, read, turns)
    ordered = parsed.repartition("conv").sortWithinPartitions("conv", "nth", "role", "text")
    return map_arrow(ordered, digest, out)


class _Digest:
    def __init__(self, key):
        self.key, self.turns, self.loss = key, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str, chars: int, learned: bool) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        if learned:
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.n += 1
        self.chars += chars


def _rows(done: list[_Digest], kind: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    columns = [pa.array([d.key for d in done], kind)]
    for get, t in ((lambda d: d.n, pa.int64()), (lambda d: d.turns.hexdigest(), pa.string()), (lambda d: d.loss_chars, pa.int64()), (lambda d: d.loss.hexdigest(), pa.string()), (lambda d: d.chars, pa.int64())):
        columns.append(pa.array([get(d) for d in done], t))
    return pa.RecordBatch.from_arrays(columns, schema.names)


def write(rows: DataFrame, **columns: str) -> DataFrame:
    """``format_chats()`` written to the shared folder, as a table of its files."""
    return staged(format_chats(rows, **columns), "chats")
