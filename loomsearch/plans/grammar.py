"""Query text to phrases: bare words are prefixes, quoted ones exact, and a message must have all of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

_ITEM = re.compile(r'"([^"]*)(?:"|$)|(\S+)')
#: Substrings shorter than this match nothing in particular and are left out.
LEAST_SUBSTRING = 3


@dataclass(frozen=True)
class Item:
    """A word or phrase of a query; ``prefix`` for words that were not quoted."""

    text: str
    prefix: bool


def clean_token(text: str) -> str:
    """Keeps ASCII letters and digits, ``_``, and everything beyond ASCII."""
    return "".join(c for c in text if c == "_" or c > "\x7f" or c.isascii() and c.isalnum())


def clean_phrase(text: str) -> str:
    return text.replace('"', "").strip()


def _runs(query: str) -> list[tuple[str, bool]]:
    """(text, quoted) of each item. A quote opens a phrase only where an item begins; elsewhere it is dropped."""
    out, at, query = [], 0, query.strip()
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        m = _ITEM.match(query, at)
        out.append((m[1], True) if m[2] is None else (m[2], False))
        at = m.end()
    return out


def word_items(query: str) -> list[Item]:
    """The items of the word search. All white space separates, upper-case operator words are plain words."""
    items = [Item(clean_phrase(t), False) if quoted else Item(clean_token(t), True) for t, quoted in _runs(query)]
    return [i for i in items if i.text]


def substring_items(query: str) -> list[Item]:
    """The items of the substring search: those of three characters or more."""
    items = [Item(clean_phrase(t) if quoted else clean_token(t), False) for t, quoted in _runs(query)]
    return [i for i in items if len(i.text) >= LEAST_SUBSTRING]


def word_match(query: str) -> str:
    """The word items as a match expression, ``""`` for none."""
    return " ".join(f"{i.text}*" if i.prefix else f'"{i.text}"' for i in word_items(query)) or '""'


def substring_match(query: str) -> str:
    """The substring items as a match expression, empty for none."""
    return " ".join(f'"{i.text}"' for i in substring_items(query))
