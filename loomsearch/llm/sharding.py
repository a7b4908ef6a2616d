"""Shards of near equal bytes by k-d partitioning of the texts' metadata.

A node is split at the weighted median along the dimension in which it is
widest, until a leaf has the bytes of one shard. Equal texts stay together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, only, staged

#: Bins of one look at a node, and how near a split comes to its aim, as a share of a shard.
BINS, NEARNESS = 1024, 0.0005
DIMENSIONS = ("bytes", "characters", "lines")


@dataclass
class Node:
    """A cell with its number of shards; once split, texts at or below ``(value, key)`` along ``dim`` go left."""

    shards: int
    dim: str = ""
    value: float = 0.0
    key: int = 0
    children: list[Node] = field(default_factory=list)
    number: int = -1

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def pick(self) -> Column:
        if not self.children:
            return F.lit(self.number)
        left, right = self.children
        below = (F.col(self.dim) < self.value) | ((F.col(self.dim) == self.value) & (F.col("key") <= self.key))
        return F.when(below, left.pick()).otherwise(right.pick())


def _split(groups: DataFrame, nodes: list[Node], slack: float) -> None:
    """Splits all ``nodes`` (numbered in their order) at once; every look is one aggregate of a bounded number of bins."""
    ranges = groups.groupBy("node").agg(F.sum("weight").alias("w"), *(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)))
    seen = {r["node"]: r for r in ranges.collect()}
    whole = {d: max(1.0, max((r[f"max_{d}"] for r in seen.values()), default=0) - min((r[f"min_{d}"] for r in seen.values()), default=0)) for d in DIMENSIONS}
    looks: dict[int, dict] = {}
    for k, node in enumerate(nodes):
        node.children = [Node(node.shards // 2), Node(node.shards - node.shards // 2)]
        node.dim, node.key = DIMENSIONS[0], (1 << 63) - 1
        if r := seen.get(k):
            node.dim = max(DIMENSIONS, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d])
            lo, hi = float(r[f"min_{node.dim}"]), float(r[f"max_{node.dim}"])
            looks[k] = {"by": node.dim, "lo": lo, "hi": hi, "before": 0.0, "aim": r["w"] * (node.shards // 2) / node.shards, "end": False}
    while open_ := {k: x for k, x in looks.items() if not x["end"]}:
        in_cell, at, low, width = F.lit(False), F.lit(None), F.lit(None), F.lit(None)
        for k, x in open_.items():
            here = (F.col("node") == k) & ((F.col(nodes[k].dim) == nodes[k].value) if x["by"] == "key" else F.lit(True))
            here &= (F.col(x["by"]) >= F.lit(x["lo"])) & (F.col(x["by"]) <= F.lit(x["hi"]))
            in_cell |= here
            own = F.col(x["by"]).cast("double")
            at, low = F.when(here, own).otherwise(at), F.when(here, F.lit(float(x["lo"]))).otherwise(low)
            width = F.when(here, F.lit(max((float(x["hi"]) - float(x["lo"])) / BINS, 5e-324))).otherwise(width)
        bins = groups.where(in_cell).withColumn("bin", F.least(F.floor((at - low) / width), F.lit(BINS - 1)))
        value = F.lit(None).cast("double")
        for k, x in open_.items():
            if x["by"] != "key":
                value = F.when(F.col("node") == k, F.col(x["by"])).otherwise(value)
        bins = bins.withColumn("value", value).groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("key").alias("key_lo"), F.max("key").alias("key_hi"))
        found: dict[int, list] = {}
        for r in bins.collect():
            found.setdefault(r["node"], []).append(r)
        for k, x in open_.items():
            for r in sorted(found[k], key=lambda r: r["bin"]):
                by_key = x["by"] == "key"
                lo, hi = (r["key_lo"], r["key_hi"]) if by_key else (r["lo"], r["hi"])
                last = r["bin"] == max(y["bin"] for y in found[k])
                if x["before"] + r["w"] < x["aim"] and not last:
                    x["before"] += r["w"]
                    x["under"] = hi
                    continue
                short, over = x["aim"] - x["before"], x["before"] + r["w"] - x["aim"]
                if r["w"] > slack and lo < hi:
                    x |= {"lo": lo, "hi": hi}
                elif r["w"] > slack and not by_key and r["key_lo"] < r["key_hi"]:
                    nodes[k].value = lo
                    x |= {"by": "key", "lo": r["key_lo"], "hi": r["key_hi"], "under": r["key_lo"] - 1 if r["key_lo"] > -(1 << 63) else r["key_lo"]}
                else:
                    edge = x.get("under", lo) if short < over and "under" in x else hi
                    x["end"] = True
                    if by_key:
                        nodes[k].key = edge
                    else:
                        nodes[k].value = edge
                break


def shards_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` of every row; sizes of shards near equal, equal texts in one shard.

    A text's size is its UTF-8 bytes (null: none) plus 1; null and empty texts
    are one group. Dimensions are a text's bytes, characters and lines, so a
    row finds its leaf from its own text: rows are not joined to groups, and a
    group of any size makes no hot key. A group that is larger than a fair
    share gets a shard of its own (they are the only ones that cannot be made
    equal) and the others share the rest evenly. ``slot`` numbers a shard's
    rows from 0. Fewer groups than shards leave shards empty; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, id=id_col, text=text_col).select(
        "id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.octet_length(text).cast("double").alias("bytes"), F.char_length(text).cast("double").alias("characters"), (F.regexp_count(text, F.lit("\n")) + 1).cast("double").alias("lines"), F.monotonically_increasing_id().alias("nth"),
    )
    rows = staged(rows, "shard-rows")
    groups = staged(rows.groupBy("key", *DIMENSIONS).agg(F.sum("size").alias("weight")), "shard-groups")
    left = groups.agg(F.sum("weight").alias("w")).collect()[0]["w"] or 0
    shards, alone = n_shards, []
    for r in groups.orderBy(F.desc("weight"), "key").limit(n_shards - 1).select("key", "weight").collect():
        if shards > 1 and r["weight"] >= left / shards:
            alone.append(r["key"])
            left, shards = left - r["weight"], shards - 1
    root = Node(shards)
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    while nodes := [x for x in root.leaves() if x.shards > 1]:
        for x in root.leaves():
            x.number = -1
        for k, x in enumerate(nodes):
            x.number = k
        _split(rest.withColumn("node", root.pick()).where("node >= 0"), nodes, NEARNESS * left / shards)
    for k, x in enumerate(root.leaves()):
        x.number = len(alone) + k
    shard = root.pick()
    for k, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(k)).otherwise(shard)
    dealt = rows.select("id", "size", "text_crc32", shard.cast("int").alias("shard"), "nth", F.shiftright("nth", 33).cast("int").alias("part"))
    return numbered(dealt, ["shard"], "part", "nth", "slot").select("id", "size", "text_crc32", "shard", "slot")
