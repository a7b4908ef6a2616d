"""A corpus pipeline: toxic texts go, one text of each group of near copies stays, benchmark passages go, the rest is packed.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir), works on all that its predecessor kept and returns a table that is
written as Parquet and read again as the next one's ``docs``.

Nulls may be in any column. A null text scores like an empty one, is near
nothing, has no passages and is packed as an end id; null and empty texts stay.
Exact copies, those of empty texts included, are one group, of which one row
stays. Very long texts are worked on whole. Further columns, whatever they are
called, are left behind by the first stage; an empty table goes through all
stages and gives an empty result. Passages of items of fewer than ten words are
not cut, for they stand in clean texts too; they only count towards the half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.llm import decontamination, neardup, packing, toxicity
from loomsearch.llm.common import staged
from loomsearch.llm.queries import held_out, table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = ("lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("doc_id"), "text", *(F.col(f"kept_{c}").alias(c) for c in _REST))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score 0.5 or more."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return _columns(toxicity.score(docs, machine, keep=_REST).where("score < 0.5"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each class of near copies."""
    return _columns(neardup.near_duplicates(docs, keep=_REST).where("nth = label"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts, and drops texts of which more than half are such passages."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=_REST)
    cut = F.exists("spans", lambda s: s[1] - s[0] >= decontamination.WINDOW)
    left = decontamination.remove_leaks(found.withColumn("cut", cut))
    return _columns(left.withColumn("kept_n_chars", F.when(F.col("cut"), F.char_length("text").cast("long")).otherwise(F.col("kept_n_chars"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 1024 tokens."""
    cut = packing.pieces(docs, vocabulary("byte_bpe_50k.json"))
    placed = packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_copies), ("decontamination", without_leaks), ("packing", packed)]

#: Neither the machine, nor alignment, nor tokens can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
