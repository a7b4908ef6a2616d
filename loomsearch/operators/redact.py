"""Redaction: secrets become ``[REDACTED:id]``, one rule after the other on what the rules before have left.

Texts travel in Arrow batches, of which a part at a time is held as Python
strings. Of a text, only the rules run whose hints it has, and those only where
they can match; one automaton finds the hints of all rules in a pass over the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import arrow_function, in_parts
from .redact_rules import Rule, default_rules
from .spots import Spots, lower


#: Hexadecimal digits become 1, all other bytes 0.
_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))


class Redactor:
    def __init__(self, rules: Iterable[Rule] | None = None):
        self.rules = list(default_rules() if rules is None else rules)
        self._spots: dict[int, Spots] = {}
        self._finder: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return {"rules": self.rules, "_spots": {}, "_finder": None}

    def spots(self, n: int) -> Spots:
        """Compiled once in each process, when a text first meets the rule; classes and word ends are those of ASCII, as the rules mean them."""
        if n not in self._spots:
            self._spots[n] = Spots(self.rules[n].pattern, self.rules[n].group)
        return self._spots[n]

    @property
    def finder(self) -> ahocorasick.Automaton:
        """All hints at once, each with the numbers of the rules that have it."""
        if self._finder is None:
            by_hint: dict[str, list[int]] = {}
            for n, rule in enumerate(self.rules):
                for hint in rule.hints:
                    by_hint.setdefault(hint, []).append(n)
            self._finder = ahocorasick.Automaton()
            for hint, numbers in by_hint.items():
                self._finder.add_word(hint, tuple(numbers))
            if by_hint:
                self._finder.make_automaton()
            self._others = [n for n, r in enumerate(self.rules) if not r.hints]
        return self._finder

    def _due(self, text: str) -> list[int]:
        low, finder = text.lower(), self.finder
        due = {n for _, numbers in finder.iter(low) for n in numbers} if len(finder) else set()
        if self._others:
            due.update(n for n in self._others if self._has_run(self.rules[n], low))
        return sorted(due)

    def _has_run(self, rule: Rule, low: str) -> bool:
        return not rule.run or b"1" * rule.run in low.encode("utf-8", "replace").translate(_HEX)

    def _matches(self, n: int, text: str, low: str) -> Iterator[re.Match]:
        """A rule's matches in a text as the rules before have left it; the run that it needs may have gone with these."""
        return self.spots(n).matches(text, low) if self._has_run(self.rules[n], low) else iter(())

    def redact(self, text: str) -> str:
        """All rules in order, and again while that changes anything: a secret may begin only where another one has gone."""
        return self.redact_and_tell(text)[0]

    def redact_and_tell(self, text: str) -> tuple[str, bool]:
        """``redact`` and ``has_secret`` at once: the first rule that finds anything meets the text as it came."""
        seen: set[str] = set()
        secret = False
        # A round that changes anything takes a character that the text came with, so there are no more rounds than those.
        for _ in range(len(text) + 1):
            if text in seen:
                break
            seen.add(text)
            text, found = self._once(text)
            secret |= found
        return text, secret

    def _once(self, text: str) -> tuple[str, bool]:
        low, found = lower(text), False
        for n in self._due(text):
            parts, end, rule = [], 0, self.rules[n]
            for m in self._matches(n, text, low):
                group = rule.group if m.re.groups >= rule.group and m.start(rule.group) >= 0 else 0
                parts += text[end : m.start(group)], f"[REDACTED:{rule.id}]"
                end = m.end(group)
            if parts:
                text, found = "".join(parts) + text[end:], True
                low = lower(text)
        return text, found

    def has_secret(self, text: str) -> bool:
        low = lower(text)
        return any(True for n in self._due(text) for _ in self._matches(n, text, low))

    def column(self, text: Column) -> Column:
        """``text`` redacted; null stays null."""
        return arrow_function(in_parts(self.redact, pa.string()), "string")(text)

    def flag(self, text: Column) -> Column:
        return F.coalesce(arrow_function(in_parts(self.has_secret, pa.bool_()), "boolean")(text), F.lit(False))

    def both(self, text: Column) -> Column:
        """``column`` and ``flag`` of a text that is read once: a struct of ``text`` and ``secret``, null for null."""
        kind = pa.struct([("text", pa.string()), ("secret", pa.bool_())])
        return arrow_function(in_parts(self.redact_and_tell, kind), "text string, secret boolean")(text)


def redact_columns(df: DataFrame, columns: tuple[str, ...], rules: Iterable[Rule] | None = None) -> DataFrame:
    """``df`` with these text columns redacted."""
    redactor = Redactor(rules)
    return df.withColumns({c: redactor.column(F.col(c)) for c in columns})


def write_redacted(spark: SparkSession, pattern: str, target: str, rules: Iterable[Rule] | None = None) -> DataFrame:
    """A redacted copy of the lines of text files below ``target``, in a folder for each source file; sources themselves are never rewritten.

    Lines keep their order: a file is read whole by one task or in stretches,
    and its stretches are sorted by where they begin. Gives the lines back
    (``source_path, line, value``, ``line`` from 0).
    """
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("nth"), "value")
    place = Window.partitionBy("source_path").orderBy("begin", "nth")
    redacted = redact_columns(lines, ("value",), rules).withColumn("line", (F.row_number().over(place) - 1).cast("long"))
    redacted.select("source_path", "line", "value").write.mode("overwrite").partitionBy("source_path").parquet(target)
    return spark.read.parquet(target).select("source_path", "line", "value")
