"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree has two storeys. The upper one is fitted on a bounded sample and cuts
space into cells; below each cell, a task grows the cell's own subtree from the
rows that the cell has, so the tree gets deeper as the table grows. A query
opens nodes best bin first, through a priority queue of distances to centres.
How many leaves it visits is calibrated on the whole table: visits are widened
until a set of queries has met its exact neighbours often enough.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_arrow, only, staged

#: Cells are fitted on at most so many vectors (those with the lowest hash), and visits on so many queries from all over the table.
MOST_SAMPLE, MOST_QUERIES = 20_000, 200
#: A cell's subtree is grown from at most so many of its rows; all leaves together are at most ``MOST_LEAVES``, so what is broadcast is bounded.
MOST_GROWN, MOST_LEAVES, MOST_CELLS = 5_000, 65_536, 256
BRANCHES, LEAF, RECALL = 8, 16, 0.94
#: Rows of a cell that are searched together, and queries in one block of a search.
BLOCK_ROWS, BLOCK_QUERIES = 4_000, 1_024


@dataclass
class Tree:
    """Inner nodes have ``centres`` and children; leaves have a number, from 0 in the order of the tree."""

    centres: np.ndarray | None = None
    children: list[Tree] = field(default_factory=list)
    leaf: int = -1

    def leaves(self) -> list[Tree]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        if not self.children:
            return np.full(len(x), self.leaf, np.int64)
        nearest = _squares(x, self.centres).argmin(axis=1)
        out = np.empty(len(x), np.int64)
        for k, child in enumerate(self.children):
            at = np.flatnonzero(nearest == k)
            if len(at):
                out[at] = child.assign(x[at])
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves for a query, best first: the queue holds unopened nodes by the distance to their centre."""
        queue: list[tuple[float, int, Tree]] = [(0.0, 0, self)]
        out, tie = [], 0
        while queue and len(out) < visits:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                out.append(node.leaf)
                continue
            for d, child in zip(_squares(q[None], node.centres)[0].tolist(), node.children, strict=True):
                tie += 1
                heapq.heappush(queue, (d, tie, child))
        return out


@dataclass
class Index:
    """The whole tree, the cell of each of its leaves (ascending), the vectors' length, and the leaves to visit."""

    tree: Tree
    cells: np.ndarray
    size: int
    visits: int = 1

    @property
    def leaves(self) -> int:
        return len(self.cells)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None]


def grow(x: np.ndarray, leaf: int, most: int, rng: np.random.Generator) -> Tree:
    """A tree whose leaves have at most ``leaf`` of the vectors, as long as they differ and there are at most about ``most`` leaves."""
    if len(x) > leaf and most > 1:
        k = min(BRANCHES, most, -(-len(x) // leaf))
        centres = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(6):
            nearest = _squares(x, centres).argmin(axis=1)
            sizes = np.bincount(nearest, minlength=k)
            for c in np.flatnonzero(sizes):
                centres[c] = x[nearest == c].mean(axis=0)
        nearest = _squares(x, centres).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=k)
        used = np.flatnonzero(sizes)
        if len(used) > 1:
            return Tree(centres[used], [grow(x[nearest == c], leaf, max(1, most * sizes[c] // len(x)), rng) for c in used])
    return Tree()


def _numbered(tree: Tree) -> Tree:
    for k, x in enumerate(tree.leaves()):
        x.leaf = k
    return tree


def _packed(tree: Tree) -> list:
    """A tree as lists that travel: how many children each node has, in depth-first order, and its centres."""
    counts, centres = [], []

    def walk(t: Tree) -> None:
        counts.append(len(t.children))
        if t.children:
            centres.append(t.centres)
        for c in t.children:
            walk(c)

    walk(tree)
    return [counts, np.concatenate(centres).astype(np.float32).tobytes() if centres else b""]


def _unpacked(counts: list[int], raw: bytes, size: int) -> Tree:
    flat = np.frombuffer(raw, np.float32).reshape(-1, size).astype(float) if raw else np.zeros((0, size))
    at = [0, 0]

    def walk() -> Tree:
        n = counts[at[0]]
        at[0] += 1
        if not n:
            return Tree()
        own = flat[at[1] : at[1] + n]
        at[1] += n
        return Tree(own, [walk() for _ in range(n)])

    return walk()


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of one length as rows."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of the rows whose vectors take part: not null or zero, all components finite."""
    v = F.col("v")
    own = only(rows, id=id_col, v=vector_col)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def build(distinct: DataFrame, k: int, recall: float = RECALL, seed: int = 3) -> Index:
    """An index for a (staged) table of distinct vectors ``v``: cells from a sample, subtrees from each cell's rows, visits from all rows.

    Vectors of the most frequent length make the tree; others are beside it.
    """
    spark = distinct.sparkSession
    lengths = distinct.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not lengths:
        return Index(_numbered(Tree()), np.zeros(1, np.int64), 0)
    size, n = lengths[0]["size"], lengths[0]["n"]
    own = distinct.where(F.size("v") == size).select("v")
    # A part of the hash's range has about as many vectors as are wanted, so a sample is no sort of the table.
    share = min(1.0, 0.97 * MOST_SAMPLE / n)
    low = own.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(MOST_SAMPLE).toArrow()
    sample = _matrix(low.column(0).combine_chunks())
    cells = max(1, min(MOST_CELLS, n // 200))
    rng = np.random.default_rng(seed)
    upper = _numbered(grow(sample[np.lexsort(sample.T[::-1])], max(1, len(sample) // cells), cells, rng))
    count = len(upper.leaves())
    leaf = max(LEAF, n // MOST_LEAVES)
    sent = spark.sparkContext.broadcast(upper)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.assign(_matrix(batch.column(0))), pa.int64())], ["v", "cell"])

    placed = map_arrow(own, celled, T.StructType([own.schema["v"], T.StructField("cell", T.LongType())]))
    most = max(1, MOST_LEAVES // count)
    totals = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("total"))
    # Of a cell with more rows than a task should hold, a part of the hash's range stands for it; vectors are distinct, so their hashes are even.
    dealt = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(MOST_GROWN * (1 << 30)) / F.col("total")

    def subtree(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks())
        total = table.column("total")[0].as_py()
        tree = grow(x[np.lexsort(x.T[::-1])], max(1, leaf * len(x) // total), most, np.random.default_rng(seed + key[0].as_py()))
        counts, raw = _packed(tree)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([counts], pa.list_(pa.int32())), "centres": pa.array([raw], pa.binary())})

    grown = placed.join(F.broadcast(totals), "cell").where(dealt).groupBy("cell").applyInArrow(subtree, "cell long, counts array<int>, centres binary")
    found = {r["cell"]: _unpacked(r["counts"], bytes(r["centres"]), size) for r in grown.collect()}
    sent.destroy()
    owner: list[int] = []

    def joined(node: Tree) -> Tree:
        if node.children:
            return Tree(node.centres, [joined(c) for c in node.children])
        below = found.get(node.leaf, Tree())
        owner.extend([node.leaf] * len(below.leaves()))
        return below

    tree = joined(upper)
    index = Index(_numbered(tree), np.array(owner, np.int64), size)
    index.visits = _calibrated(own, index, k, recall)
    return index


def _calibrated(own: DataFrame, index: Index, k: int, recall: float) -> int:
    """The visits at which queries from all over the table have met that share of their ``k`` exact nearest.

    The exact ones come from one pass over the table, in which each part keeps
    its nearest ``k`` for each query with the leaves they are in.
    """
    spark = own.sparkSession
    asked = own.orderBy(F.xxhash64("v", F.lit(1)), "v").limit(MOST_QUERIES).toArrow()
    q = _matrix(asked.column(0).combine_chunks())
    if index.leaves == 1 or len(q) < 2:
        return index.leaves
    sent = spark.sparkContext.broadcast((index, q))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, q = sent.value
        best, leaves = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            d = _squares(q, x)
            d[d < 1e-9 * (q * q).sum(axis=1)[:, None]] = np.inf  # itself
            both, places = np.hstack((best, d)), np.hstack((leaves, np.broadcast_to(index.tree.assign(x), d.shape)))
            at = np.argsort(both, axis=1, kind="stable")[:, :k]
            best, leaves = np.take_along_axis(both, at, 1), np.take_along_axis(places, at, 1)
        n = np.arange(len(q), dtype=np.int64).repeat(k)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(best.ravel()), pa.array(leaves.ravel().astype(np.int64))], ["n", "d", "leaf"])

    found = map_arrow(own, nearest, "n long, d double, leaf long").where("leaf >= 0")
    top = Window.partitionBy("n").orderBy("d", "leaf")
    rows = found.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k).select("n", "leaf").collect()
    sent.destroy()
    met = np.zeros(index.leaves + 1)
    near: dict[int, list[int]] = {}
    for r in rows:
        near.setdefault(r["n"], []).append(r["leaf"])
    for n, leaves in near.items():
        place = {x: m for m, x in enumerate(index.tree.best_bins(q[n], index.leaves), 1)}
        for x in leaves:
            met[place[x]] += 1 / (len(leaves) * len(near))
    return max(1, min(index.leaves, int(np.searchsorted(np.cumsum(met), recall - 1e-9))))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest rows found for every query, by Euclidean distance in double precision.

    Rows are indexed as distinct vectors with the ``k + 1`` smallest ids of
    each: with ties going to smaller ids no other copy can be among the ``k``
    nearest of a query that is not a candidate itself, so a vector that most
    rows share is no hot leaf, and nothing is lost. A cell is searched in
    blocks, a query goes to a block once with the leaves that it visits there,
    and blocks meet in a top-k. Vectors that are null, zero, or hold
    null or non-finite components take no part, as rows or as queries; vectors
    of another length than the query's are no candidates, and those of other
    lengths than the tree's are compared with all of theirs. An id with several
    vectors is found once, by its nearest. Fewer candidates than ``k`` give as
    many rows; an empty table gives none.
    """
    spark = rows.sparkSession
    good = staged(usable(rows, id_col, vector_col), "vectors")
    first = Window.partitionBy("v").orderBy("id")
    distinct = good.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = staged(distinct, "distinct-vectors")
    sent = spark.sparkContext.broadcast(index or build(distinct, k, recall))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells and leaves of rows; vectors of another length have a cell below 0 by it."""
        index = sent.value
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            cells, leaves = -lengths.astype(np.int64), np.zeros(len(lengths), np.int64)
            fits = np.flatnonzero(lengths == index.size)
            if len(fits):
                leaves[fits] = index.tree.assign(_matrix(batch.column(0).take(pa.array(fits))))
                cells[fits] = index.cells[leaves[fits]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(leaves)], [*batch.schema.names, "cell", "leaf"])

    indexed = staged(map_arrow(distinct, placed, T.StructType([*distinct.schema.fields, *T.StructType.fromDDL("cell long, leaf long").fields])), "leaves")

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that each query visits, and the leaves there."""
        index = sent.value
        for batch in batches:
            out: tuple[list[int], list[int], list[np.ndarray]] = ([], [], [])
            for n, v in enumerate(batch.column(1).to_pylist()):
                if len(v) != index.size:
                    cells, cuts = [-len(v)], [np.zeros(1, np.int64)]
                else:
                    bins = np.sort(np.array(index.tree.best_bins(np.array(v, float), index.visits)))
                    cells, begins = np.unique(index.cells[bins], return_index=True)
                    cuts = np.split(bins, begins[1:])
                out[0].extend([n] * len(cells))
                out[1].extend(int(c) for c in cells)
                out[2].extend(cuts)
            some = batch.take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["query_id", "q", "cell", "leaves"])

    asked = usable(queries, id_col, vector_col)
    kinds = [asked.schema[c].dataType.simpleString() for c in ("id", "v")]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = map_arrow(asked.repartition(parts), visiting, "query_id {}, q {}, cell long, leaves array<long>".format(*kinds))
    return _nearest(staged(asked, "visits"), indexed, k)


def _dealt(df: DataFrame, by: str, most: int) -> DataFrame:
    """Adds ``deal``: so many hashed parts of each cell that a part has about ``most`` rows. There are at most ``MOST_CELLS`` cells to count, and one for each other length."""
    parts = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    return df.join(parts, "cell").withColumn("deal", F.pmod(F.xxhash64(by), F.col("parts"))).drop("parts")


def _closest(q: np.ndarray, visited: list[np.ndarray], x: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the rows of visited leaves that may be among a query's ``k`` nearest.

    A product of matrices for each leaf finds them, with room for its rounding;
    distances are then taken from differences of the vectors themselves.
    """
    order = np.argsort(leaf, kind="stable")
    names, begins = np.unique(leaf[order], return_index=True)
    ends = np.append(begins[1:], len(order))
    who = np.repeat(np.arange(len(q)), [len(v) for v in visited])
    what = np.concatenate(visited) if visited else np.zeros(0, np.int64)
    by_leaf = np.argsort(what, kind="stable")
    who, what = who[by_leaf], what[by_leaf]
    own = (x * x).sum(axis=1), (q * q).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for name, begin, end in zip(names, begins, ends, strict=True):
        a, b = np.searchsorted(what, (name, name + 1))
        if a == b:
            continue
        at, rows = who[a:b], order[begin:end]
        squares = own[1][at][:, None] - 2 * (q[at] @ x[rows].T) + own[0][rows][None]
        found.append((np.repeat(at, len(rows)), np.tile(rows, len(at)), squares.ravel()))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    query, row, square = (np.concatenate(c) for c in zip(*found, strict=True))
    by_query = np.lexsort((square, query))
    query, row, square = query[by_query], row[by_query], square[by_query]
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    sizes = np.diff(np.append(starts, len(query)))
    far = square[starts + np.minimum(k, sizes - 1)] + 1e-9 * (own[1][query[starts]] + own[0].max())
    near = square <= np.repeat(far, sizes)
    query, row = query[near], row[near]
    return query, row, np.sqrt(((x[row] - q[query]) ** 2).sum(axis=1))


def _nearest(asked: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """Joins queries to the blocks of their cells and keeps the ``k`` nearest of each."""
    kind = indexed.schema["ids"].dataType.elementType.simpleString()
    rows = _dealt(indexed, "v", BLOCK_ROWS).groupBy("cell", "deal").agg(F.collect_list(F.struct("v", "ids", "leaf")).alias("rows"))
    groups = _dealt(asked, "query_id", BLOCK_QUERIES).groupBy("cell", "deal").agg(F.collect_list(F.struct("query_id", "q", "leaves")).alias("asked"))
    pairs = groups.drop("deal").join(rows.drop("deal"), "cell").select("asked", "rows")
    query_kind = asked.schema["query_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}  # numbers of the queries that this task has met
        names: list = []
        best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # query, distance, place in ids
        ids: list = []
        types = None

        def kept(best, ids):
            """Of each query the ``k`` nearest ids so far; an id that comes again counts once."""
            query, far, place = best
            rank = {x: n for n, x in enumerate(sorted({ids[p] for p in place.tolist()}))}
            number = np.array([rank[ids[p]] for p in place.tolist()], np.int64)
            order = np.lexsort((number, far, query))
            query, far, number = query[order], far[order], number[order]
            once = np.unique(np.stack((query, number)), axis=1, return_index=True)[1]
            once.sort()
            query, far, number = query[once], far[once], number[once]
            starts = np.flatnonzero(np.diff(query, prepend=-1))
            nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
            own = nth < k
            return (query[own], far[own], number[own]), list(rank)

        for batch in batches:
            asked_, every = batch.column(0), batch.column(1)
            types = (asked_.type.value_type.field("query_id").type, every.type.value_type.field("ids").type.value_type, pa.float64())
            for n in range(batch.num_rows):
                queries, block = asked_[n].values, every[n].values
                own = queries.field("query_id").to_pylist()
                visited = [np.asarray(v, np.int64) for v in queries.field("leaves").to_pylist()]
                q, row, far = _closest(_matrix(queries.field("q")), visited, _matrix(block.field("v")), block.field("leaf").to_numpy(), k)
                copies = block.field("ids").take(pa.array(row, pa.int64()))
                times = copies.value_lengths().to_numpy(zero_copy_only=False)
                number = np.array([keys.setdefault(x, len(keys)) for x in own], np.int64)
                names.extend(list(keys)[len(names) :])
                place = np.arange(len(ids), len(ids) + int(times.sum()))
                ids.extend(copies.flatten().to_pylist())
                query, far = np.repeat(number[q], times), np.repeat(far, times)
                itself = np.array([ids[p] == names[x] for p, x in zip(place.tolist(), query.tolist(), strict=True)], bool)
                best = tuple(np.concatenate((a, b[~itself])) for a, b in zip(best, (query, far, place), strict=True))
                if len(best[0]) > 300_000:
                    best, ids = kept(best, ids)
        if types:
            best, ids = kept(best, ids)
            for a in range(0, len(best[0]), 50_000):
                query, far, place = (c[a : a + 50_000].tolist() for c in best)
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in query], types[0]), pa.array([ids[p] for p in place], types[1]), pa.array(far, types[2])], ["query_id", "id", "score"])

    found = map_arrow(pairs, compare, f"query_id {query_kind}, id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
