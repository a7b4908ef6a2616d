"""Token ids of a corpus in files of range-coded blocks, and reading them back.

A file is a Parquet part: a row for each block, in the order of ids. Besides
the block itself (see ``rangecoder``), a row says which documents it holds and
how many ids of each, so that a block can be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, only, prefix_sums, staged
from .rangecoder import MOST, decode_blocks, encode_blocks
from .tokens import PieceTable, gathered

END_ID = 2
#: Bytes of text in a part: at least the first, so that its blocks are no small ones, if that leaves all cores something to do; at most the second.
LEAST_PART, MOST_PART = 4 << 20, 96 << 20


def _parts(own: DataFrame) -> int:
    """How many parts to write: full blocks cost least for each id, so parts have some where all cores still get a share."""
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cores = own.sparkSession.sparkContext.defaultParallelism
    return max(1, size // MOST_PART, min(-(-size // LEAST_PART), 4 * cores))


def encode(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus as rows ``part, block, n, coded, ids, before, counts``, parts and blocks in ascending order of id.

    Documents are dealt by ranges of (id, hash of text), so neither a frequent
    id nor frequent nulls (which come first) fill one part; texts travel once.
    ``coded`` holds ``n`` token ids of the documents ``ids``; ``counts`` of
    each are here and ``before`` of it were in earlier blocks. Null and empty
    texts are the end id alone; an empty table has no blocks.
    """
    own = only(docs, id=id_col, text=text_col)
    id_type = own.schema["id"].dataType
    ordered = own.withColumn("hash", F.xxhash64("text")).repartitionByRange(_parts(own), "id", "hash").sortWithinPartitions("id", "hash", "text").drop("hash")
    schema = T.StructType.fromDDL("part int, block int, n int, coded binary, before array<long>, counts array<int>").add("ids", T.ArrayType(id_type))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = PieceTable.of(path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        writer = _Writer(part)
        for batch in gathered(batches, 1):
            for key, ids in zip(batch.column(0), table.look_up(batch.column(1)), strict=True):
                writer.add(key.as_py(), ids + end)
            id_type = batch.schema.field(0).type
            if writer.blocks:
                yield writer.rows(id_type)
        writer.cut()
        if writer.blocks:
            yield writer.rows(id_type)

    return map_arrow(ordered, step, schema)


class _Writer:
    """Gathers documents into blocks of ``MOST`` ids."""

    def __init__(self, part: int):
        self.part, self.number = part, 0
        self.blocks: list[np.ndarray] = []
        self.notes: list[tuple[list, list[int], list[int]]] = []
        self._begin()

    def _begin(self) -> None:
        self.held: list[bytes] = []
        self.size = 0
        self.note: tuple[list, list[int], list[int]] = ([], [], [])

    def add(self, key, ids: bytes) -> None:
        done, n = 0, len(ids) // 4
        while done < n:
            here = min(n - done, MOST - self.size)
            self.held.append(ids[4 * done : 4 * (done + here)])
            for column, value in zip(self.note, (key, done, here), strict=True):
                column.append(value)
            done, self.size = done + here, self.size + here
            if self.size == MOST:
                self.cut()

    def cut(self) -> None:
        if self.size:
            self.blocks.append(np.frombuffer(b"".join(self.held), "<u4"))
            self.notes.append(self.note)
            self._begin()

    def rows(self, id_type: pa.DataType) -> pa.RecordBatch:
        blocks, notes = self.blocks, self.notes
        self.blocks, self.notes = [], []
        numbers = range(self.number, self.number + len(blocks))
        self.number += len(blocks)
        columns = [
            pa.array([self.part] * len(blocks), pa.int32()), pa.array(numbers, pa.int32()), pa.array([len(b) for b in blocks], pa.int32()), pa.array(encode_blocks(blocks), pa.binary()),
            pa.array([x[1] for x in notes], pa.list_(pa.int64())), pa.array([x[2] for x in notes], pa.list_(pa.int32())), pa.array([x[0] for x in notes], pa.list_(id_type)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "n", "coded", "before", "counts", "ids"])


def write(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode()`` written to the shared folder, as a table of its files."""
    return staged(encode(docs, path, end_id, id_col, text_col), "token-files")


def read(files: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from decoded and checked blocks.

    Blocks are decoded where they are read. A document's parts in several
    blocks meet as checksums, not as ids. ``start`` counts the ids of all
    documents before it.
    """
    id_type = files.schema["ids"].dataType.elementType
    schema = T.StructType.fromDDL("part int, start long, before long, n long, crc long").add("id", id_type)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, block, coded, before, counts, ids = (batch.column(c) for c in ("part", "block", "coded", "before", "counts", "ids"))
            out: list[list] = [[], [], [], [], []]
            for p, b, words, earlier, sizes in zip(part.to_pylist(), block.to_pylist(), decode_blocks(coded.to_pylist()), before.to_pylist(), counts.to_pylist(), strict=True):
                raw, at = memoryview(words).cast("B"), 0
                for had, n in zip(earlier, sizes, strict=True):
                    row = (p, b * MOST + at - had, had, n, zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    at += n
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types, strict=True)), ids.flatten()], schema.names)

    sizes = files.groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("size"))
    starts = prefix_sums(sizes, [], "part", "size", "first").drop("size")
    found = map_arrow(files.select("part", "block", "coded", "before", "counts", "ids"), step, schema)
    joined = found.groupBy("part", "start", "id").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("before", "n", "crc"))).alias("all"))
    joined = joined.withColumn("ids_crc32", F.when(F.size("all") == 1, F.col("all")[0]["crc"]).otherwise(_combined(F.when(F.size("all") > 1, F.col("all")))))
    return joined.join(starts, "part").select("id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _combined(column: Column):
    """The crc32 of texts in a row from the crc32 and length of each: shifting by n zero bytes is a matrix over bits, and such matrices are squared."""

    def combine(all_):
        import pandas as pd

        return pd.Series([None if parts is None else _fold([(int(x["n"]), int(x["crc"])) for x in parts]) for parts in all_], dtype="Int64")

    return F.pandas_udf(combine, "long")(column)


def _fold(parts: list[tuple[int, int]]) -> int:
    crc = parts[0][1]
    for n, more in parts[1:]:
        crc = _zeros(crc, 4 * n) ^ more
    return crc


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


_POWERS: list[list[int]] = []


def _zeros(crc: int, n: int) -> int:
    """What a crc becomes by ``n`` zero bytes, without its pre- and post-conditioning."""
    if not _POWERS:
        bit = [0xEDB88320, *(1 << k for k in range(31))]
        for _ in range(3):
            bit = [_times(bit, x) for x in bit]
        _POWERS.append(bit)
    k = 0
    while n:
        if k == len(_POWERS):
            _POWERS.append([_times(_POWERS[-1], x) for x in _POWERS[-1]])
        if n & 1:
            crc = _times(_POWERS[k], crc)
        n >>= 1
        k += 1
    return crc
