"""An index for ranked search: postings of words and of trigrams as tables, so that a query reads only what its terms need.

``words`` has postings, one for each (term, message): how often and where the term
stands, the message's number of tokens, and the *level* of the posting, which grows
with what it can add to a score. ``grams`` has one for each (trigram of the
lower-case text, message). Postings are made where texts are read, and those of a
term (and level) among some thousand messages are one row of arrays, so what is
shuffled and written is little more than numbers. ``blocks`` tells of each term and level how many rows
there are and the most that one of them adds, and ``gram_counts`` how
many messages have a trigram. All lie in folders by a term's first character and
are sorted by term (and level) inside: a query prunes folders when it is planned
and row groups by their ranges, and a term that most messages have is spread over
many files.

Each table has a folder for each *segment*. What counts is the last manifest, a
small file that names the live segments, the sets of dead messages and the
totals that ranking needs; it comes into being by a rename. A run that is lost
before that leaves folders that nobody reads. Adding messages writes one more
segment and notes the messages' earlier rows as dead. Segments of about the same
size are merged, so there are few of them and a row is rewritten a logarithmic
number of times; ``compact`` makes one segment of all and forgets the dead.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.porter import stem
from ..plans.grammar import substring_items, word_items
from ..storage import file_system, names, read_text, ship, write_new
from .search import LEAST_IDF, SUBSTRING_WEIGHT, B, K1, phrase_tokens, substring_frequency

GRAM = 3
#: Segments of about one size (within this factor) that are merged into one, manifests that are kept for readers at work, levels of postings.
FANOUT, KEPT, LEVELS = 4, 3, 64
#: Postings of a page of a file: what a query can skip inside the files that it opens. A row has some of them.
PAGE_ROWS, ROW_POSTINGS = 2_000, 10
#: Tokens or characters of which a task makes postings at a time; characters for each range that rows are sorted in.
TAKEN, RANGE_CHARACTERS = 1_000_000, 16_000_000
#: Rows that what is left of a term's postings is packed into when dead ones have gone.
PACKS = 64
FORMAT = 2
#: Rarest trigrams of a part that are met; what has them all is looked at.
RAREST = 3
_TABLES = {
    "words": "term string, mids array<long>, tfs array<int>, sizes array<int>, positions array<array<int>>, segment long, level int, run string, lead string",
    "grams": "term string, mids array<long>, segment long, run string, lead string",
    "blocks": "term string, level int, n long, best double, run string, lead string",
    "gram_counts": "term string, n long, run string, lead string",
    "sizes": "mid long, tokens int, characters int, segment long, run string",
    "dead": "mid long, before long, run string",
}
_ARRAYS = {"words": {"mids": "mid", "tfs": "tf", "sizes": "size", "positions": "positions"}, "grams": {"mids": "mid"}}
_MANIFEST = "manifest-"


def _lead(term: Column) -> Column:
    """The folder of a term: its first character if that is a digit or letter of ASCII, or else one of sixteen."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise(F.concat(F.lit("x"), F.pmod(F.xxhash64(first), F.lit(16)).cast("string")))


def _leads(spark: SparkSession, terms: set[str]) -> list[str]:
    rows = spark.createDataFrame([(t,) for t in sorted(terms)], "term string").select(_lead(F.col("term")).alias("lead")).distinct().collect()
    return sorted(r["lead"] for r in rows)


def postings(messages: DataFrame, stems: bool, mean: float) -> DataFrame:
    """``term, level, mids, tfs, sizes, positions`` of messages (``mid, content``), with levels by their ``mean`` number of tokens."""
    ship(messages.sparkSession)
    tokens = messages.select("mid", F.array_join(X.tokens(F.col("content")), " ").alias("line"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mids, numbers, taken = [], [], 0
        vocabulary = _Numbers()
        for batch in batches:
            for mid, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = line.as_py().split(" ") if line.is_valid and len(line.as_py()) else []
                if not words:
                    continue
                mids.append(mid)
                numbers.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
                taken += len(words)
                if taken >= TAKEN:
                    yield from _packed(mids, numbers, list(vocabulary), stems, mean)
                    mids, numbers, taken, vocabulary = [], [], 0, _Numbers()
        yield from _packed(mids, numbers, list(vocabulary), stems, mean)

    return tokens.mapInArrow(step, "term string, level int, mids array<long>, tfs array<int>, sizes array<int>, positions array<array<int>>")


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]


def _packed(mids: list[int | None], numbers: list[np.ndarray], words: list[str], stems: bool, mean: float) -> Iterator[pa.RecordBatch]:
    if not mids:
        return
    terms = _Numbers()
    term_of = np.array([terms[stem(w) if stems else w] for w in words], np.int64)
    lengths = np.array([len(n) for n in numbers], np.int64)
    owner = np.repeat(np.arange(len(mids)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # A posting is a run of tokens of one term and message, in the text's order.
    key = term_of[np.concatenate(numbers)] * len(mids) + owner
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    at = _begins(key)
    term, owner, tf = key[at[:-1]] // len(mids), key[at[:-1]] % len(mids), np.diff(at)
    size = lengths[owner]
    levels = np.minimum(LEVELS * tf / (tf + K1 * (1 - B + B * size / mean)), LEVELS - 1).astype(np.int64)
    by_level = np.argsort(term * LEVELS + levels, kind="stable")
    rows = _begins((term * LEVELS + levels)[by_level])
    head = by_level[rows[:-1]]
    # The tokens' places in the postings' new order.
    moved = np.repeat(at[:-1][by_level] - np.r_[0, np.cumsum(tf[by_level])[:-1]], tf[by_level]) + np.arange(len(place))
    known = pa.array(mids, pa.int64())
    each = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tf[by_level])], pa.int32()), pa.array(place[moved], pa.int32()))
    lists = [known.take(pa.array(owner[by_level])), pa.array(tf[by_level], pa.int32()), pa.array(size[by_level], pa.int32()), each]
    found = list(terms)
    whole = pa.RecordBatch.from_arrays(
        [pa.array([found[t] for t in term[head].tolist()], pa.string()), pa.array(levels[head], pa.int32()), *(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), x) for x in lists)],
        ["term", "level", "mids", "tfs", "sizes", "positions"],
    )
    yield from (whole.slice(k, 10_000) for k in range(0, whole.num_rows, 10_000))


def gram_postings(messages: DataFrame) -> DataFrame:
    """``term, mids``: the distinct trigrams of the messages' (``mid, content``) lower-case texts."""
    ship(messages.sparkSession)
    low = messages.where("mid is not null").select("mid", F.lower("content").alias("low")).where(F.char_length("low") >= GRAM)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mids, grams, taken = [], [], 0
        for batch in batches:
            for mid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # A character has 21 bits, so three are one number.
                c = np.frombuffer(text.as_py().encode("utf-32-le"), "<u4").astype(np.int64)
                mids.append(mid)
                grams.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
                taken += len(c)
                if taken >= 4 * TAKEN:
                    yield from _packed_grams(mids, grams)
                    mids, grams, taken = [], [], 0
        yield from _packed_grams(mids, grams)

    return low.mapInArrow(step, "term string, mids array<long>")


def _packed_grams(mids: list[int], grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not mids:
        return
    owner, every = np.repeat(np.array(mids, np.int64), [len(g) for g in grams]), np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    begins = _begins(every)
    terms = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in every[begins[:-1]].tolist()]
    lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(owner))
    whole = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), lists], ["term", "mids"])
    yield from (whole.slice(k, 10_000) for k in range(0, len(terms), 10_000))


def _flat(rows: DataFrame, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each posting, of the arrays ``columns`` or of all."""
    arrays = {c: one for c, one in _ARRAYS[name].items() if columns is None or c in columns}
    others = [c for c in rows.columns if c not in _ARRAYS[name]]
    each = rows.select(*others, F.explode(F.arrays_zip(*arrays)).alias("p"))
    return each.select(*others, *(F.col(f"p.{c}").alias(one) for c, one in arrays.items()))


def _repacked(flat: DataFrame, name: str) -> DataFrame:
    """Postings in rows again, those of a term in as many as ``PACKS``."""
    arrays = _ARRAYS[name]
    keys = [c for c in flat.columns if c not in arrays.values()]
    packed = flat.groupBy(*keys, F.pmod(F.xxhash64("mid"), F.lit(PACKS)).alias("pack")).agg(F.sort_array(F.collect_list(F.struct(*arrays.values()))).alias("p"))
    return packed.select(*keys, *(F.col(f"p.{one}").alias(c) for c, one in arrays.items()))


def _part(tf: Column, size: Column, mean: Column) -> Column:
    """What a posting adds to a score, as a share of the most that its term can add."""
    return tf / (tf + K1 * (1 - B + B * size / mean))


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; nothing has changed by this one."""


def _totals(sizes: DataFrame) -> dict:
    found = sizes.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "characters"))).first()
    return found.asDict()


class SearchIndex:
    """An index below ``path``. ``stems`` is fixed when it is made, and so is ``kinds``: with postings of words alone it answers no substrings, with those of grams no words."""

    def __init__(self, spark: SparkSession, path: str, stems: bool = True, kinds: tuple[str, ...] = ("words", "grams")):
        self.spark, self.path, self.stems, self.kinds = spark, path.rstrip("/"), stems, kinds
        self._parts = 1

    # -- writing --

    def manifest(self) -> dict:
        """What the last commit says: ``number``, ``segments`` (run and rows each), ``dead`` runs and totals."""
        found = [int(n.removeprefix(_MANIFEST)) for n in names(self.spark, self.path) if n.startswith(_MANIFEST)]
        return json.loads(read_text(self.spark, f"{self.path}/{_MANIFEST}{max(found)}")) if found else {"number": 0, "format": FORMAT, "segments": [], "dead": [], "rows": 0, "tokens": 0, "characters": 0}

    def add(self, messages: DataFrame) -> SearchIndex:
        """Indexes messages (``mid, content``), in place of what is indexed under their ids. Contents that are null are empty."""
        return self.update(messages, None)

    def remove(self, mids: DataFrame) -> SearchIndex:
        """Takes messages (column ``mid``) out of the index."""
        return self.update(None, mids)

    def update(self, messages: DataFrame | None, removed: DataFrame | None) -> SearchIndex:
        """Adds and removes messages in one commit, and merges segments if there are enough of one size."""
        now, run = self.manifest(), uuid.uuid4().hex
        number = now["number"] + 1
        after = dict(now, number=number)
        gone = None if removed is None else removed.select("mid")
        if messages is not None:
            own = messages.select("mid", F.coalesce("content", F.lit("")).alias("content"))
            sizes = self._write(own, number, run)
            gone = own.select("mid") if gone is None else gone.unionByName(own.select("mid"))
            after["segments"] = [*now["segments"], *([{"run": run, "rows": sizes["rows"], "mean": sizes["mean"]}] if sizes["rows"] else [])]
            after |= {k: now[k] + sizes[k] for k in ("rows", "tokens", "characters")}
        if now["segments"] and gone is not None:
            dead = self._alive(now, "sizes").join(gone.distinct(), "mid", "left_semi").select("mid", "tokens", "characters", F.lit(number).cast("long").alias("before"))
            dead = self._put(dead, "dead", run)
            lost = _totals(dead)
            if lost["rows"]:
                after["dead"] = [*now["dead"], run]
                after |= {k: after[k] - lost[k] for k in ("rows", "tokens", "characters")}
        self._commit(after)
        return self._merge_like_sized()

    def apply(self, before: DataFrame, after: DataFrame) -> SearchIndex:
        """Follows a table, or the part of it that has changed, from one version to the next (``mid, content``): only what differs is touched."""
        old, new = (m.select("mid", F.coalesce("content", F.lit("")).alias("content")).withColumn("digest", F.xxhash64("content")) for m in (before, after))
        return self.update(new.join(old.select("mid", "digest"), ["mid", "digest"], "left_anti"), old.join(new.select("mid"), "mid", "left_anti"))

    def compact(self) -> SearchIndex:
        """Makes one segment of all and forgets the dead."""
        now = self.manifest()
        return self._merge(now, now["segments"]) if now["segments"] else self

    def needs_rebuild(self, messages: DataFrame) -> bool:
        """Whether messages are missing from the index, or are gone from the table, or an earlier version has written it."""
        now = self.manifest()
        if now.get("format") != FORMAT:
            return True
        known = self._alive(now, "sizes").select("mid")
        return bool(messages.select("mid").join(known, "mid", "left_anti").limit(1).count() or known.join(messages.select("mid"), "mid", "left_anti").limit(1).count())

    def rebuild(self, messages: DataFrame) -> SearchIndex:
        """Makes the index anew from all messages, as one more commit."""
        now, run = self.manifest(), uuid.uuid4().hex
        sizes = self._write(messages.select("mid", F.coalesce("content", F.lit("")).alias("content")), now["number"] + 1, run)
        self._commit({"number": now["number"] + 1, "format": FORMAT, "segments": [{"run": run, "rows": sizes["rows"], "mean": sizes["mean"]}], "dead": []} | {k: sizes[k] for k in ("rows", "tokens", "characters")})
        return self

    def _put(self, rows: DataFrame, name: str, run: str, order: tuple[str, ...] = ()) -> DataFrame:
        """Writes a table's part of a segment and reads it back."""
        at = f"{self.path}/{name}/run={run}"
        if order:
            rows = rows.repartitionByRange(self._parts, *order).sortWithinPartitions(*order)
        page = max(1, PAGE_ROWS // ROW_POSTINGS)
        writer = rows.write.option("parquet.page.row.count.limit", page).option("parquet.page.size.row.check.min", min(page, 100))
        (writer.partitionBy("lead") if "lead" in rows.columns else writer).parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _write(self, own: DataFrame, number: int, run: str) -> dict:
        segment = F.lit(number).cast("long").alias("segment")
        sizes = own.select("mid", F.size(X.tokens(F.col("content"))).alias("tokens"), F.greatest(F.char_length("content") - 2, F.lit(0)).alias("characters"), segment)
        totals = _totals(self._put(sizes, "sizes", run))
        mean = max(1.0, totals["tokens"] / max(1, totals["rows"]))
        made = {"words": lambda: postings(own, self.stems, mean), "grams": lambda: gram_postings(own)}
        self._postings({name: made[name]().select("*", segment, _lead(F.col("term")).alias("lead")) for name in self.kinds}, run, mean, totals["characters"])
        return totals | {"mean": mean}

    def _postings(self, rows: dict[str, DataFrame], run: str, mean: float, characters: int) -> None:
        """Writes a segment's postings and what tells of them."""
        self._parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")), characters // RANGE_CHARACTERS)
        if "words" in rows:
            words = self._put(rows["words"], "words", run, ("lead", "term", "level", "mids"))
            best = F.array_max(F.zip_with("tfs", "sizes", lambda tf, size: _part(tf, size, F.lit(mean))))
            told = words.select("lead", "term", "level", F.size("mids").cast("long").alias("n"), best.alias("best"))
            self._put(told.groupBy("lead", "term", "level").agg(F.sum("n").alias("n"), F.max("best").alias("best")), "blocks", run, ("lead", "term", "level"))
        if "grams" in rows:
            grams = self._put(rows["grams"], "grams", run, ("lead", "term", "mids"))
            self._put(grams.groupBy("lead", "term").agg(F.sum(F.size("mids")).alias("n")), "gram_counts", run, ("lead", "term"))

    def _merge_like_sized(self) -> SearchIndex:
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in now["segments"]:
                tiers.setdefault(int(math.log(max(1, s["rows"]), FANOUT)), []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FANOUT), None)
            if full is None:
                return self
            self._merge(now, full)

    def _merge(self, now: dict, some: list[dict]) -> SearchIndex:
        """One segment in place of some; rows keep the number of the commit that brought them, so the dead of later ones stay dead."""
        run, runs = uuid.uuid4().hex, [s["run"] for s in some]
        rows = self._put(self._alive(now, "sizes", runs=runs).drop("run"), "sizes", run).count()
        mean = max(1.0, now["tokens"] / max(1, now["rows"]))
        whole = (lambda name: _repacked(self._alive(now, name, runs=runs).drop("run"), name)) if now["dead"] else lambda name: self._table(name, runs).drop("run")
        self._postings({name: whole(name) for name in self.kinds}, run, mean, now["characters"])
        left = [s for s in now["segments"] if s["run"] not in runs]
        self._commit(dict(now, number=now["number"] + 1, segments=[*left, {"run": run, "rows": rows, "mean": mean}], dead=now["dead"] if left else []))
        return self

    def _commit(self, manifest: dict) -> None:
        if not write_new(self.spark, f"{self.path}/{_MANIFEST}{manifest['number']}", json.dumps(manifest)):
            raise Conflict(f"commit {manifest['number']} of {self.path} is there already")
        self._forget(manifest["number"])

    def _forget(self, number: int) -> None:
        """Removes old manifests, and the segments of theirs that none of the last ``KEPT`` names. What a lost run has left stays until ``sweep``."""
        def runs(n: int) -> set[str]:
            m = json.loads(read_text(self.spark, f"{self.path}/{_MANIFEST}{n}"))
            return {s["run"] for s in m["segments"]} | set(m["dead"])

        there = [int(n.removeprefix(_MANIFEST)) for n in names(self.spark, self.path) if n.startswith(_MANIFEST)]
        kept = set().union(*(runs(n) for n in there if n > number - KEPT))
        for n in (n for n in there if n <= number - KEPT):
            for run in runs(n) - kept:
                self._drop(run)
            fs, at = file_system(self.spark, f"{self.path}/{_MANIFEST}{n}")
            fs.delete(at, False)

    def _drop(self, run: str) -> None:
        for name in _TABLES:
            fs, at = file_system(self.spark, f"{self.path}/{name}/run={run}")
            fs.delete(at, True)

    def sweep(self) -> int:
        """Removes what lost runs have left; only while no other writer is at work. Gives how many runs there were."""
        there = [int(n.removeprefix(_MANIFEST)) for n in names(self.spark, self.path) if n.startswith(_MANIFEST)]
        named = set()
        for n in there:
            m = json.loads(read_text(self.spark, f"{self.path}/{_MANIFEST}{n}"))
            named |= {s["run"] for s in m["segments"]} | set(m["dead"])
        lost = {d.removeprefix("run=") for name in _TABLES for d in names(self.spark, f"{self.path}/{name}")} - named
        for run in lost:
            self._drop(run)
        return len(lost)

    # -- reading --

    def _table(self, name: str, runs: list[str]) -> DataFrame:
        at = [f"{self.path}/{name}/run={r}" for r in runs]
        return self.spark.read.schema(_TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(*at) if at else self.spark.createDataFrame([], _TABLES[name])

    def _live(self, now: dict, name: str) -> DataFrame:
        """A table's rows of all segments that are named."""
        if now.get("format") != FORMAT:
            raise RuntimeError(f"{self.path} was written by an earlier version: rebuild it")
        if name in _ARRAYS and name not in self.kinds:
            raise RuntimeError(f"{self.path} has no postings of {name}")
        return self._table(name, [s["run"] for s in now["segments"]])

    def _alive(self, now: dict, name: str, where: Column | None = None, runs: list[str] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
        """Rows of a table, one for each posting, but those that are dead: of a commit before the one that replaced or removed their message."""
        rows = self._live(now, name) if runs is None else self._table(name, runs)
        rows = rows if where is None else rows.where(where)
        rows = _flat(rows, name, columns) if name in _ARRAYS else rows
        if not now["dead"]:
            return rows
        dead = self._table("dead", now["dead"]).groupBy("mid").agg(F.max("before").alias("before"))
        return rows.join(dead, "mid", "left").where("before is null or segment >= before").drop("before")

    def word_hits(self, query: str) -> DataFrame | None:
        """``mid, score`` of the messages with all words and phrases; ``None`` if the query has none with a token."""
        phrases = [p for p in ((phrase_tokens(i, self.stems), i.prefix) for i in word_items(query)) if p[0]]
        if not phrases:
            return None
        found, now = [], self.manifest()
        for tokens, prefix in phrases:
            wanted = [F.col("term") == t for t in tokens]
            if prefix:
                wanted[-1] = F.startswith("term", F.lit(tokens[-1]))
            where = F.col("lead").isin(_leads(self.spark, set(tokens))) & functools.reduce(operator.or_, wanted)
            rows = self._alive(now, "words", where, columns=("mids", "sizes", "tfs" if len(tokens) == 1 else "positions"))
            if len(tokens) == 1:
                found.append(rows.groupBy("mid").agg(F.sum("tf").alias("f"), F.first("size").alias("size")))
                continue
            # A phrase begins where each of its tokens stands as far on as it should: as many rows as tokens meet there.
            slots = [rows.where(w).select("mid", "size", F.explode("positions").alias("pos")).select("mid", "size", (F.col("pos") - k).alias("begin")) for k, w in enumerate(wanted)]
            whole = functools.reduce(DataFrame.unionByName, slots).groupBy("mid", "size", "begin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(tokens))
            found.append(whole.groupBy("mid").agg(F.count(F.lit(1)).alias("f"), F.first("size").alias("size")))
        return self._ranked(now, found, "tokens")

    def substring_hits(self, query: str, messages: DataFrame) -> DataFrame | None:
        """``mid, score`` of the messages with all substrings: those that have all trigrams are looked at in ``messages`` (``mid, content``)."""
        parts = [i.text.lower() for i in substring_items(query)]
        if not parts:
            return None
        found, now = [], self.manifest()
        for part in parts:
            grams = {part[k : k + GRAM] for k in range(len(part) - GRAM + 1)}
            rare = self.rarest(now, grams)
            rows = self._alive(now, "grams", F.col("lead").isin(_leads(self.spark, set(rare))) & F.col("term").isin(rare))
            maybe = rows.groupBy("mid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare))
            seen = messages.select("mid", F.lower("content").alias("low")).join(maybe, "mid")
            size = F.greatest(F.char_length("low") - 2, F.lit(0)).alias("size")
            found.append(seen.select("mid", substring_frequency(F.col("low"), part).alias("f"), size).where("f > 0"))
        return self._ranked(now, found, "characters").withColumn("score", F.col("score") * SUBSTRING_WEIGHT)

    def rarest(self, now: dict, grams: set[str]) -> list[str]:
        """The trigrams worth meeting: the rarest, as long as one more keeps out most of what the ones before let through. Counts are of all rows, the dead included, so they only guide."""
        counts = self._live(now, "gram_counts").where(F.col("lead").isin(_leads(self.spark, grams)) & F.col("term").isin(sorted(grams)))
        known = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        order = sorted(grams, key=lambda g: (known.get(g, 0), g))
        out, left = order[:1], known.get(order[0], 0)
        for g in order[1:RAREST]:
            if known.get(g, 0) > 4 * left:  # its postings would cost more than the texts it keeps out
                break
            out.append(g)
        return out

    def top_word_hits(self, query: str, k: int) -> DataFrame | None:
        """The ``k`` best messages (``mid, score``; ties by ``mid``) with all words of a query, as :meth:`word_hits` has them, by reading few postings.

        A message's score is at most the sum of its blocks' bounds. The best
        blocks are scored first; the k-th score found so bounds what a row of
        any other block must reach, together with the other words' best blocks,
        and blocks that cannot reach it are not read. Phrases and prefixes are
        scored in full.
        """
        items = [(phrase_tokens(i, self.stems), i.prefix) for i in word_items(query)]
        items = [p for p in items if p[0]]
        if not items:
            return None
        now = self.manifest()
        if now["dead"] or any(prefix or len(tokens) > 1 for tokens, prefix in items):
            return self.word_hits(query).orderBy("score", "mid").limit(k)
        times: dict[str, int] = {}
        for tokens, _ in items:
            times[tokens[0]] = times.get(tokens[0], 0) + 1
        mean = now["tokens"] / max(1, now["rows"])
        leads = F.col("lead").isin(_leads(self.spark, set(times)))
        told = self._live(now, "blocks").where(leads & F.col("term").isin(list(times))).groupBy("term", "level", "run").agg(F.sum("n").alias("n"), F.max("best").alias("best")).collect()
        # Where messages have become longer since a segment was written, its parts have grown, but by no more than the mean.
        grown = {s["run"]: max(1.0, mean / s["mean"]) for s in now["segments"]}
        weights = {t: self._idf(now["rows"], sum(r["n"] for r in told if r["term"] == t)) * n for t, n in times.items()}
        blocks: dict[str, list[tuple[float, int, int]]] = {t: [] for t in times}
        for term, at in sorted({(r["term"], r["level"]) for r in told}):
            own = [r for r in told if (r["term"], r["level"]) == (term, at)]
            blocks[term].append((weights[term] * (K1 + 1) * max(r["best"] * grown[r["run"]] for r in own), at, sum(r["n"] for r in own)))
        if not all(blocks.values()):
            return self.spark.createDataFrame([], "mid long, score double")
        best = {t: max(b for b, _, _ in blocks[t]) for t in times}
        first = {t: {lv for _, lv, _ in sorted(blocks[t], reverse=True)[: self._enough(blocks[t], k * len(times) ** 2)]} for t in times}
        probe = [r["score"] for r in self._scored(now, first, weights, mean, leads).orderBy("score").limit(k).collect()]
        least = -probe[-1] if len(probe) == k else 0.0
        # Scores are negative; a little room is left for rounding.
        wanted = {t: {lv for b, lv, _ in blocks[t] if b + sum(best.values()) - best[t] >= least * (1 - 1e-9)} for t in times}
        return self._scored(now, wanted, weights, mean, leads).orderBy("score", "mid").limit(k)

    @staticmethod
    def _idf(rows: int, n: int) -> float:
        found = math.log((rows - n + 0.5) / (n + 0.5))
        return found if found > 0 else LEAST_IDF

    @staticmethod
    def _enough(blocks: list[tuple[float, int, int]], k: int) -> int:
        """How many of the best blocks have ``k`` rows."""
        seen = 0
        for m, (_, _, n) in enumerate(sorted(blocks, reverse=True), 1):
            seen += n
            if seen >= k:
                return m
        return len(blocks)

    def _scored(self, now: dict, levels: dict[str, set[int]], weights: dict[str, float], mean: float, leads: Column) -> DataFrame:
        """``mid, score`` of the messages that have all terms in the given levels, or between the lowest and the highest of them."""
        where = functools.reduce(operator.or_, ((F.col("term") == t) & F.col("level").between(min(some), max(some)) for t, some in levels.items()))
        rows = _flat(self._live(now, "words").where(leads & where), "words", ("mids", "tfs", "sizes"))
        weight = functools.reduce(lambda c, t: c.when(F.col("term") == t, weights[t]), levels, F)
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
        whole = rows.select("mid", part.alias("part")).groupBy("mid").agg(F.sum("part").alias("whole"), F.count(F.lit(1)).alias("n"))
        return whole.where(F.col("n") == len(levels)).select("mid", (-F.col("whole")).alias("score"))

    def _ranked(self, now: dict, found: list[DataFrame], measure: str) -> DataFrame:
        """BM25 over the whole index: a phrase's messages are counted before the phrases meet."""
        totals = self.spark.range(1).select(F.lit(now["rows"]).alias("rows"), F.lit(now[measure] / max(1, now["rows"])).alias("mean_size"))
        hits = None
        for k, rows in enumerate(found):
            totals = totals.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(f"n{k}"))))
            own = rows.select("mid", F.col("f").alias(f"f{k}"), *(["size"] if not k else []))
            hits = own if hits is None else hits.join(own, "mid")
        hits = hits.crossJoin(F.broadcast(totals))
        norm = K1 * (1 - B + B * F.col("size") / F.col("mean_size"))
        score = F.lit(0.0)
        for k in range(len(found)):
            idf = F.ln((F.col("rows") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
            score -= F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + norm)
        return hits.select("mid", score.alias("score"))
