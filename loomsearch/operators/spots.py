"""Where a pattern can match: each match has some fixed characters, so many characters after its begin.

Patterns are tried at the places of such characters alone, with the matches that a search of the whole text finds.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from re import _compiler, _constants, _parser

_REPEATS = (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT)
_ONE = (_constants.IN, _constants.ANY, _constants.NOT_LITERAL)
_NOTHING = (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT)
#: Ends a path of which no more is known.
_END = object()
#: Paths through a pattern, beyond which the rest of it counts as unknown.
MOST_PATHS = 64
#: Characters that are looked at together for the begin of a run.
STRETCH = 256


@dataclass(frozen=True)
class Anchor:
    """``text`` (in lower case, if ``folded``) stands ``least`` to ``most`` characters after a match's begin; with no ``most``, only ``run`` is before it."""

    text: str
    folded: bool
    least: int
    most: int | None
    run: str | None

    def begins(self, text: str, low: str) -> Iterator[int]:
        """Where matches can begin, in order."""
        where, done = low if self.folded else text, 0
        p = where.find(self.text)
        while p >= 0:
            first = self._run_before(text, p, done) if self.most is None else max(done, p - self.most)
            yield from range(first, p - self.least + 1)
            done = max(done, p - self.least + 1)
            p = where.find(self.text, p + 1)

    def _run_before(self, text: str, p: int, done: int) -> int:
        while p > done:
            head = max(done, p - STRETCH)
            kept = len(text[head:p].rstrip(self.run))
            if kept:
                return head + kept
            p = head
        return p


class Spots:
    """A pattern (classes and word ends of ASCII) and its anchors, of which every match has one; without any it is searched for."""

    def __init__(self, pattern: str, group: int):
        tree = _parser.parse(pattern, re.ASCII)
        if tree.getwidth()[0] and _certain(tree, group) and _without_lead(tree):
            self.pattern = _compiler.compile(tree, re.ASCII)
        else:
            self.pattern = re.compile(pattern, re.ASCII)
        self.anchors = _anchors(tree)

    def matches(self, text: str, low: str) -> Iterator[re.Match]:
        """Matches from left to right that do not overlap; ``low`` is the text in lower case, character for character."""
        if not self.anchors:
            yield from self.pattern.finditer(text)
            return
        end, match = 0, self.pattern.match
        begins = [a.begins(text, low) for a in self.anchors]
        for begin in begins[0] if len(begins) == 1 else heapq.merge(*begins):
            if begin >= end and (m := match(text, begin)):
                yield m
                end = m.end()


def lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else text.replace("İ", "ı").lower()


def _certain(tree, group: int) -> bool:
    """Whether every match has the group."""
    for op, arg in tree:
        if op is _constants.SUBPATTERN:
            if arg[0] == group or _certain(arg[3], group):
                return True
        elif op in _REPEATS and arg[0] > 0 and _certain(arg[2], group):
            return True
    return False


def _without_lead(tree) -> bool:
    """Takes away lazy runs of a class (``[ab]{0,50}?``) that a pattern begins with, and tells whether there were any.

    They only move a match's begin to the left: the first place where the rest matches is that of the leftmost begin, and the shortest run is taken
    from there. So what follows them, and the groups in it, are the same, at a fiftieth of the work.
    """
    found = False
    while len(tree) and tree[0][0] is _constants.MIN_REPEAT and tree[0][1][0] == 0 and len(tree[0][1][2]) == 1 and tree[0][1][2][0][0] is _constants.IN:
        del tree[0]
        found = True
    if len(tree) and tree[0][0] is _constants.SUBPATTERN and tree[0][1][0] is None:
        found |= _without_lead(tree[0][1][3])
    if found:
        tree.width = None
    return found


def _chars(tree, flags: int) -> str | None:
    """The characters of a class, if they are listed and of ASCII."""
    if len(tree) != 1 or tree[0][0] is not _constants.IN:
        return None
    out = ""
    for op, arg in tree[0][1]:
        if op is _constants.LITERAL:
            arg = (arg, arg)
        elif op is not _constants.RANGE:
            return None
        if arg[1] > 127:
            return None
        out += "".join(map(chr, range(arg[0], arg[1] + 1)))
    return out + out.swapcase() if flags & re.IGNORECASE else out


def _paths(tree, flags: int) -> list[list]:
    """What stands one after the other in a match, for each way through the pattern: characters and gaps (least, most, characters in it)."""
    out = [[]]
    for op, arg in tree:
        if op is _constants.LITERAL:
            ways = [[(chr(arg), bool(flags & re.IGNORECASE))]]
        elif op in _NOTHING:
            ways = [[]]
        elif op is _constants.IN and len(arg) == 2 and {o for o, _ in arg} == {_constants.LITERAL} and 2 * len(out) <= MOST_PATHS:
            ways = [[(chr(c), bool(flags & re.IGNORECASE))] for _, c in arg]
        elif op in _ONE:
            ways = [[(1, 1, _chars([(op, arg)], flags))]]
        elif op is _constants.SUBPATTERN and not (arg[1] | arg[2]) & re.UNICODE:
            ways = _paths(arg[3], (flags | arg[1]) & ~arg[2])
        elif op is _constants.BRANCH:
            ways = [way for tree in arg[1] for way in _paths(tree, flags)]
        elif op in _REPEATS and arg[:2] == (0, 1):
            ways = [[], *_paths(arg[2], flags)]
        elif op in _REPEATS:
            least, most = arg[2].getwidth()
            ends = arg[1] is _constants.MAXREPEAT or most >= _constants.MAXREPEAT
            ways = [[(arg[0] * least, None if ends else arg[1] * most, _chars(arg[2], flags))]]
        else:
            ways = [[_END]]
        if len(out) * len(ways) > MOST_PATHS:
            ways = [[_END]]
        open_ = [path + way for path in out if path[-1:] != [_END] for way in ways]
        out = [path + [_END] * _enough(path) for path in open_] + [path for path in out if path[-1:] == [_END]]
    return out


def _enough(path: list) -> bool:
    """Whether more of a path would only split it further: three characters in a row have passed, or any and a gap without a fixed width."""
    if len(path) < 2 or path[-1] is _END or len(path[-1]) == 2:
        return False
    wide = path[-1][1] is None or path[-1][1] > 20 and path[-1][0] < path[-1][1]
    return any(all(len(x) == 2 for x in path[k : k + (1 if wide else 3)]) for k in range(len(path) - (1 if wide else 3)))


def _anchors(tree) -> tuple[Anchor, ...]:
    """An anchor for each path; none at all if a path has none."""
    out = {_anchor(path) for path in _paths(tree, tree.state.flags)}
    return () if None in out else tuple(out)


def _anchor(path: list) -> Anchor | None:
    """The rarest of a path's anchors: the longer its characters, and the fewer places it leaves for a begin, the better."""
    best, least, most, run, i = (0.0, None), 0, 0, "", 0
    while i < len(path) and path[i] is not _END:
        if len(path[i]) == 3:
            a, b, chars = path[i]
            least, most = least + a, None if most is None or b is None else most + b
            run = None if run is None or chars is None else run + chars
            i += 1
            continue
        j = i
        while j < len(path) and path[j] is not _END and len(path[j]) == 2:
            j += 1
        text, folded = "".join(c for c, _ in path[i:j]), any(f for _, f in path[i:j])
        if text.isascii() and (most is not None or run):
            cost = log(100 if most is None else most - least + 1) - 3 * len(text)
            best = min(best, (cost, Anchor(text.lower() if folded else text, folded, least, most, run if most is None else None)), key=lambda b: b[0])
        run = None if run is None or not text.isascii() else run + text + text.swapcase()
        least, most = least + j - i, None if most is None else most + j - i
        i = j
    return best[1]
