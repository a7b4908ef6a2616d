"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), for lower-case ASCII words."""

from __future__ import annotations

from functools import lru_cache

# The suffix rules of the published algorithm's steps 2, 3 and 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowels(word: str) -> list[bool]:
    out: list[bool] = []
    for c in word:
        out.append(c in "aeiou" or c == "y" and bool(out) and not out[-1])
    return out


def _measure(stem: str) -> int:
    """How many times vowels are followed by consonants."""
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:], strict=False))


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _vowels(word)[-3:] == [False, True, False] and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1]


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural_and_past(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and any(_vowels(w[: -len(suffix)])):
            w = w[: -len(suffix)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double_end(w) and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if _measure(w) == 1 and _short_end(w) else w
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem; words of fewer than three or over 63 characters, or with anything but a to z, are their own stems."""
    if not 3 <= len(word) <= 63 or not (word.isascii() and word.isalpha()):
        return word
    w = _plural_and_past(word)
    if w.endswith("y") and any(_vowels(w[:-1])):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        if (s := _longest(w, rules)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    if s := _longest(w, _STEP4):
        head = w[: -len(s)]
        if _measure(head) > 1 and (s != "ion" or head.endswith(("s", "t"))):
            w = head
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double_end(w) and w.endswith("l") else w
