"""Best-fit packing of token sequences by exact-complement hashing.

Texts become ids and an end id; longer ones are cut into pieces. Only the
histogram of piece lengths, at most ``capacity`` numbers, goes to the driver,
where the packing is solved on counts; a piece then finds its place from its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, only, prefix_sums, staged
from .tokens import PieceTable, gathered

CAPACITY, END_ID = 1024, 2


def complements(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each pattern.

    First, combinations that fill a sequence exactly: single lengths, then
    pairs, then triples, whose complement is looked up in the table of lengths
    still available, each used as often as availability allows. Every such use
    exhausts a length, so there are at most ``capacity`` of them. What is left
    goes, longest first, into the fullest open sequence that has room.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    runs: list[tuple[tuple[int, ...], int]] = []

    def use(*pattern: int) -> None:
        n = min(left[x] // pattern.count(x) for x in set(pattern))
        if n:
            for x in pattern:
                left[x] -= n
            runs.append((pattern, n))

    use(capacity)
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        if left[a]:
            use(a, capacity - a)
    for a in range(capacity - 2, 0, -1):
        rest = capacity - a
        for b in range(min(a, rest - 1), (rest - 1) // 2, -1):
            if not left[a]:
                break
            if left[b] and left[rest - b]:
                use(a, b, rest - b)

    open_: dict[int, list[list]] = {}  # room left -> [pattern, how many sequences]
    rooms: list[int] = []

    def add(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, n])

    for length in range(capacity, 0, -1):
        while left[length]:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                fits = capacity // length
                n = left[length] // fits or 1
                add((length,) * min(fits, left[length]), n)
                left[length] -= n * min(fits, left[length])
                continue
            same = open_[rooms[k]]
            pattern, n = same[-1]
            used = min(n, left[length])
            if used == n:
                same.pop()
                if not same:
                    del open_[rooms.pop(k)]
            else:
                same[-1][1] -= used
            left[length] -= used
            add((*pattern, length), used)
    return runs + [(p, n) for same in open_.values() for p, n in same]


def placements(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): ranks of a length go to sequences in a row."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in runs:
        offset = 0
        for length in pattern:
            lo = ranks.get(length, 0)
            ranks[length] = lo + n
            rows.append((length, lo, lo + n, sequence, offset))
            offset += length
        sequence += n
    return rows


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``capacity`` ids: ``id, piece, start, length, ids`` (little-endian unsigned 32-bit).

    A longer text is cut so that every piece but its first one is full. Null
    and empty texts are the end id alone; repeated rows are pieces of their own.
    ``part`` and ``nth`` say where a piece stands among its part's pieces of
    the same length. The result is staged, for two later steps read it.
    """
    own = only(docs, id=id_col, text=text_col)
    extra = "piece int, start long, length int, part int, nth long, ids binary"
    schema = T.StructType([own.schema["id"], *T.StructType.fromDDL(extra).fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = PieceTable.of(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        for rows in gathered(batches, 1):
            picked: list[int] = []
            columns: list[list] = [[], [], [], [], []]
            for k, ids in enumerate(table.look_up(rows.column(1))):
                ids += end
                n = len(ids) // 4
                begin, stop, number = 0, n % capacity or capacity, 0
                while begin < n:
                    size = stop - begin
                    picked.append(k)
                    for column, value in zip(columns, (number, begin, size, seen[size], ids[4 * begin : 4 * stop]), strict=True):
                        column.append(value)
                    seen[size] += 1
                    begin, stop, number = stop, stop + capacity, number + 1
            number, begin, size, nth, ids = columns
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(picked, pa.int64())), pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(size, pa.int32()), pa.array([part] * len(size), pa.int32()), pa.array(nth, pa.int64()), pa.array(ids, pa.binary())],
                schema.names,
            )

    return staged(map_arrow(own, step, schema), "pieces")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (columns ``length, part, nth``).

    Ranks come from one row per part and length, so no piece is sorted. The
    plan that is broadcast has a few rows per length: its size is bounded by
    ``capacity``, not by the table.
    """
    spark = cut.sparkSession
    counts = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(placements(complements(totals, capacity)), "length int, lo long, hi long, first_sequence long, offset long")
    starts = prefix_sums(counts, ["length"], "part", "n", "before").drop("n")
    ranked = cut.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    fits = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"])
    kept = [ranked[c] for c in cut.columns if c not in ("part", "nth")]
    return ranked.join(F.broadcast(plan), fits).select(*kept, (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All texts as pieces with their ids, sequence and place: ``id, piece, start, length, ids, sequence_id, offset``."""
    return place(pieces(docs, path, capacity, end_id, id_col, text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``length`` and ``ids`` of every sequence, from ``pack()``; a sequence has at most ``capacity`` pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(ordered.alias("all")).select(
        "sequence_id", F.aggregate("all", F.lit(0), lambda n, x: n + x["length"]).alias("length"), F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
