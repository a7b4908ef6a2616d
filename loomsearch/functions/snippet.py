"""Snippets: the window of tokens that shows most of a query, with matches between « and »."""

from __future__ import annotations

from .porter import stem
from .text import word_spans

TOKENS, BEGIN, END, MORE = 12, "«", "»", "…"


def _sentence_starts(text: str, begins: list[int]) -> list[int]:
    """Numbers of the tokens that begin a sentence: the first, and those after white space after a full stop or colon."""
    out = []
    for k, at in enumerate(begins):
        before = text[:at].rstrip(" \t\n\r") if k else ""
        if not k or len(before) < at and before[-1:] in (".", ":"):
            out.append(k)
    return out


def _window(n: int, found: list[tuple[int, int, int]], starts: list[int]) -> int:
    """The first token of the window. ``found``: (token, phrase, length) of all matches, by token.

    A window's worth is 1000 for each phrase in it and 1 for each repeat; one
    that begins a sentence gets 100 more, the text's first one 120.
    """
    best, begin = -1, 0
    for at, _, _ in found:
        seen: set[int] = set()
        worth, first, last = 0, -1, -1
        for o, phrase, length in found:
            if at <= o < at + TOKENS:
                worth += 1 if phrase in seen else 1000
                seen.add(phrase)
                first = o if first < 0 else first
                last = max(last, o + length)
        centred = max(0, min(first - int((TOKENS - (last - first)) / 2), n - TOKENS))
        if worth > best:
            best, begin = worth, centred
        sentence = max((s for s in starts if s <= at), default=at)
        if n > TOKENS and sentence < at:
            seen, worth = set(), 120 if sentence == 0 else 100
            for o, phrase, _ in found:
                if sentence <= o < sentence + TOKENS:
                    worth += 1 if phrase in seen else 1000
                    seen.add(phrase)
            if worth > best:
                best, begin = worth, sentence
    return begin


def _show(text: str, spans: list[tuple[int, int]], found: list[tuple[int, int, int]], starts: list[int]) -> str:
    n = len(spans)
    if not n:
        return text
    begin = _window(n, found, starts)
    end = min(n, begin + TOKENS)
    ranges: list[list[int]] = []
    for at, _, length in found:
        if ranges and at <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], at + length - 1)
        else:
            ranges.append([at, at + length - 1])
    marks = [(a, min(b, end - 1)) for a, b in ranges if begin <= a < end]
    at = spans[begin][0] if begin else 0
    out = [MORE] if begin else []
    for a, b in marks:
        if at <= spans[a][0]:
            out += [text[at : spans[a][0]], BEGIN]
        else:
            out.append(BEGIN)
        out += [text[max(at, spans[a][0]) : spans[b][1]], END]
        at = spans[b][1]
    out += [text[at : spans[end - 1][1]], MORE] if end < n else [text[at:]]
    return "".join(out)


def word_snippet(text: str, phrases: list[tuple[list[str], bool]], stems: bool = True) -> str:
    cut = word_spans(text)
    words = [stem(w) if stems else w for _, _, w in cut]
    found = []
    for k, (tokens, prefix) in enumerate(phrases):
        for at in range(len(words) - len(tokens) + 1):
            here = words[at : at + len(tokens)]
            if here[:-1] == tokens[:-1] and (here[-1].startswith(tokens[-1]) if prefix else here[-1] == tokens[-1]):
                found.append((at, k, len(tokens)))
    spans = [(a, b) for a, b, _ in cut]
    return _show(text, spans, sorted(found), _sentence_starts(text, [a for a, _ in spans]))


def substring_snippet(text: str, parts: list[str]) -> str:
    """The same over overlapping runs of three characters."""
    low = "".join(c.lower()[:1] for c in text)
    spans = [(k, k + 3) for k in range(len(text) - 2)]
    found = []
    for k, part in enumerate(parts):
        at = low.find(part)
        while at >= 0:
            found.append((at, k, len(part) - 2))
            at = low.find(part, at + 1)
    return _show(text, spans, sorted(found), _sentence_starts(text, [a for a, _ in spans]))
