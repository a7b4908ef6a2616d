"""Tokens, truncation and other scalar functions of text."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import arrow_function, pandas_function
from .porter import stem

#: Words that ``stem_lists`` takes at a time.
MOST_WORDS = 200_000


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Letters with diacritics, and the same without; from the Unicode decompositions up to Latin Extended Additional and Greek Extended."""
    pairs = []
    for code in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and all(unicodedata.category(c) == "Mn" for c in whole[1:]):
            pairs.append((chr(code), whole[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), *_folds()), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters, folded."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def stemmed(words: Column) -> Column:
    """Stems of an array of tokens. Arrow batches, of which only the distinct tokens become Python strings; each worker keeps the latest stems."""
    return arrow_function(stem_lists, "array<string>")(words)


def stem_lists(lists: pa.Array) -> pa.Array:
    """The same lists with stems; ``MOST_WORDS`` words or so at a time, each distinct one of them stemmed once."""
    rows = max(1, len(lists) * MOST_WORDS // max(1, len(lists.flatten())))
    parts = []
    for k in range(0, len(lists), rows):
        part = lists.slice(k, rows)
        coded = part.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(part), 0).cast(pa.int32()))
        parts.append(pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stems, mask=part.is_null()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def fold_char(c: str) -> str:
    return unicodedata.normalize("NFD", c.lower())[:1] if not c.isascii() else c.lower()


def word_spans(text: str) -> list[tuple[int, int, str]]:
    """(from, to, folded token) of the tokens of a text, as ``tokens()`` cuts them."""
    out, begin, word = [], -1, []
    for i, c in enumerate(text + " "):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co" or kind == "Mn" and begin >= 0:
            if begin < 0:
                begin, word = i, []
            if kind != "Mn":
                word.append(fold_char(c))
        elif begin >= 0:
            out.append((begin, i, "".join(word)))
            begin = -1
    return out


def truncate_runes(text: Column, n: int, ellipsis: str = "…") -> Column:
    """The first ``n`` characters, and an ellipsis if there were more."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(ellipsis))).otherwise(text)


def truncate_bytes(text: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8 without a partial character at the end, and no ellipsis."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, 1, n)
    whole = F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) > n, whole).otherwise(text)


def cut_runes(text: str, n: int, ellipsis: str = "…") -> str:
    return text if len(text) <= n else text[:n] + ellipsis


def cut_bytes(text: str, n: int) -> str:
    raw = text.encode()
    return text if len(raw) <= n else raw[:n].decode("utf-8", "ignore")


def one_line(text: Column, n: int = 180) -> Column:
    return truncate_runes(F.translate(text, "\n\r", "  "), n)


def title_line(text: Column, n: int) -> Column:
    """At most ``n`` characters in all, line breaks as spaces; an ellipsis stands for what is cut."""
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def first_line(text: Column, n: int = 200) -> Column:
    return truncate_runes(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), n)


def unix_seconds(text: Column) -> Column:
    """Seconds of an RFC 3339 time, 0 for what is none."""
    ok = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), text)
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(ok)), F.lit(0)).cast("long")


def minute_text(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` in the session's time zone; empty for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")).otherwise("")


def age_text(seconds: int) -> str:
    """A duration in its largest unit of seconds, minutes, hours or days."""
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60)):
        if seconds >= size:
            return f"{seconds // size}{unit}"
    return f"{max(0, seconds)}s"


def file_path(uri: Column) -> Column:
    """The decoded path of a ``file://`` URI; anything else as it is."""
    path = F.try_url_decode(F.regexp_replace(F.regexp_extract(uri, r"^file://[^/]*(/[^?#]*)", 1), r"\+", "%2B"))
    return F.when(uri.startswith("file://"), F.coalesce(path, uri)).otherwise(uri)


def compact_json(value) -> str:
    """JSON with sorted keys and no spaces, ``<``, ``>``, ``&`` and line separators escaped, whole floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, int) and not isinstance(x, bool) and abs(x) > 1 << 53:
            x = float(x)
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e21 else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def compact_json_text(text: Column | str) -> Column:
    """``compact_json`` of JSON texts; what is not JSON stays as it is."""

    def one(text):
        try:
            return compact_json(json.loads(text))
        except (TypeError, ValueError):
            return text

    return pandas_function(lambda texts: texts.map(one), "string")(text)
