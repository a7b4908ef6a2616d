"""The grammar against a reading of it character by character, and references, ages and aliases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.model import normalize_agent, normalize_role, parse_ref, parse_since
from loomsearch.plans.grammar import clean_phrase, clean_token, substring_items, substring_match, word_items, word_match


def read(query):
    """(text, quoted) of the items: a state machine over characters."""
    items, now, quoted = [], None, False
    for c in query:
        if quoted:
            if c == '"':
                items.append((now, True))
                now, quoted = None, False
            else:
                now += c
        elif now is None:
            if c == '"':
                now, quoted = "", True
            elif not c.isspace():
                now = c
        elif c.isspace():
            items.append((now, False))
            now = None
        else:
            now += c
    return items if now is None else [*items, (now, quoted)]


def kept(text):
    return "".join(c for c in text if ord(c) > 127 or c in "_0123456789" or "a" <= c.lower() <= "z")


QUERIES = st.text(st.sampled_from('abZ09_ \t\n"():*-^.éß日') | st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=24)


@settings(max_examples=400, deadline=None)
@given(QUERIES)
def test_items_are_those_of_a_reading_by_characters(query):
    found = read(query.strip())
    words = [(t.strip(), False) if q else (kept(t), True) for t, q in found]
    assert [(i.text, i.prefix) for i in word_items(query)] == [w for w in words if w[0]]
    assert [i.text for i in substring_items(query)] == [t for t, _ in words if len(t) >= 3]


@settings(max_examples=200, deadline=None)
@given(QUERIES)
def test_match_expressions_say_the_items(query):
    assert word_match(query) == (" ".join(i.text + "*" if i.prefix else f'"{i.text}"' for i in word_items(query)) or '""')
    assert substring_match(query) == " ".join(f'"{i.text}"' for i in substring_items(query))
    assert clean_token(clean_token(query)) == clean_token(query) and '"' not in clean_phrase(query)


@pytest.mark.parametrize(
    ("query", "words", "parts"),
    [
        ('grain "oat bran" mill', 'grain* "oat bran" mill*', '"grain" "oat bran" "mill"'), ("NOT OR (AND", "NOT* OR* AND*", '"NOT" "AND"'), ("x-ray y2k_ok", "xray* y2k_ok*", '"xray" "y2k_ok"'),
        ('five"six"', "fivesix*", '"fivesix"'), ('"open end', '"open end"', '"open end"'), ("straße\r\nöl", "straße* öl*", '"straße"'), ("- : *", '""', ""),
    ],
)
def test_examples(query, words, parts):
    assert (word_match(query), substring_match(query)) == (words, parts)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["", "cc/", "cdx/", "cur/"]), st.text("0123456789abcdef-", min_size=1, max_size=36), st.none() | st.integers(0, 10**6), st.sampled_from(["", " ", "\t"]))
def test_references_come_apart_as_they_were_put_together(code, uid, ordinal, blank):
    ref = blank + code + uid + ("" if ordinal is None else f":{ordinal}") + blank
    found = parse_ref(ref)
    assert (found.uid, found.ordinal) == (uid, ordinal)


def test_references_that_name_no_message():
    assert [(r.uid, r.ordinal) for r in map(parse_ref, (" ", "cur/9f:last", "9f:-3", "a:b:7"))] == [("", None), ("9f:last", None), ("9f", None), ("a:b", 7)]


def test_parse_since():
    now = 1_700_000_000
    assert parse_since("", now) == 0
    assert parse_since("7d", now) == now - 7 * 86400
    assert parse_since("90m", now) == now - 5400
    assert parse_since("2024-01-02", now) == 1704153600
    assert parse_since("2024-01-02T00:00:01Z", now) == 1704153601
    for bad in ("0d", "7xd", "soon", "2024-01-02T00:00:01"):
        with pytest.raises(ValueError):
            parse_since(bad, now)


def test_aliases():
    assert [normalize_agent(a) for a in ("CC", "all", "cdx", "cur", "", "other")] == ["claude_code", "", "codex", "cursor", "", "other"]
    assert [normalize_role(r) for r in (" Human ", "ai", "thnk", "all", "system")] == ["user", "assistant", "thinking", "", "system"]
