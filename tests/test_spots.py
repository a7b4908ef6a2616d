"""Patterns that are tried only where they can match: the matches of a search of the whole text, at a part of its work."""

import re
import time

import duckdb
import pytest

from loomsearch.operators.redact import Redactor
from loomsearch.operators.redact_rules import default_rules
from loomsearch.operators.spots import Spots, lower
from loomsearch.plans import catalogue

KEY = "0a" * 16
#: Patterns and texts whose matches are easy to get wrong: leads, alternatives, overlaps, runs before an anchor, characters that change in lower case.
CASES = [
    (r"(?i)[\w.-]{0,3}?(?:key|k)=([0-9]+);", ["a.b-KEY=1;key=2;", "xxxxkey=1;k=2", "KEY=1;", "ſkey=3;İk=4;"]),
    (r"(?i:[\w.-]{0,3}?key=([a-f]{2})|\b(XYZ[a-z=]{8}))", ["XYZakey=abccc", "key=ab XYZakey=aa", "-key=ab-key=ab"]),
    (r"[\w.-]{0,3}?(?i:[\w.-]{0,3}?key)=(a)?", ["aaaaaaakey=", "aaaaaaaKEY=a"]),
    (r"(?i)[ab]{0,2}?()", ["ab", ""]),
    (r"(?i)\b[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s/@]+)@", ["x a.b+c://u:p@h y://u:p@ 9://u:p@", "://u:p@", "a" * 700 + "://u:p@h"]),
    (r"(?i:\b(\d{2,3}(\||%)[a-z]{2,4})(?:;|\Z))", ["123|ab;12%abcd", "1234|ab 12|ab"]),
    (r"aa(a*)b?", ["aaaaabaab", "aAaa"]),
    (r"(?:ab|a[bc]d)x{1,2}", ["abdxxabxacdx"]),
]


@pytest.mark.parametrize(("pattern", "texts"), CASES)
def test_matches_are_those_of_a_search(pattern, texts):
    spots = Spots(pattern, 1)

    def place(m):
        return m.span(1 if m.re.groups and m.start(1) >= 0 else 0)

    for text in texts:
        assert [place(m) for m in spots.matches(text, lower(text))] == [place(m) for m in re.finditer(pattern, text, re.ASCII)]


def test_nearly_all_rules_have_places():
    assert [r.id for r in default_rules() if not Spots(r.pattern, r.group).anchors] == ["sourcegraph-access-token"]


def test_lower_case_keeps_places():
    assert lower("İKſA") == "ıkſa" and len(lower("aİ" * 50)) == 100


def test_what_is_told_is_what_was_found_in_the_text_as_it_came():
    r = Redactor()
    for text in ("", "plain", f"adafruit={KEY};", "a://u:[REDACTED:url-password]@h", f"snyk {KEY}"):
        assert r.redact_and_tell(text) == (r.redact(text), r.has_secret(text))
    assert r.has_secret("a://u:[REDACTED:url-password]@h")


def test_a_long_text_is_not_searched_once_for_each_rule():
    """All of its rules together take about the time in which one of them searches the text, for their words are few; it was that of thirty searches."""
    rules = default_rules()
    names = ("adafruit", "snyk_token", "nytimes", "mailchimp", "privateai", "heroku", "twitter", "okta")
    text = "so it was said of the sea and the hills beyond " * 4000 + " ".join(f"{n} = {KEY} " for n in names)
    redactor = Redactor(rules)
    assert redactor.redact(text).count("[REDACTED:") >= 3
    one = next(re.compile(r.pattern, re.ASCII) for r in rules if r.id == "heroku-api-key")
    begin = time.process_time()
    assert not one.search(text)
    middle = time.process_time()
    redactor.redact_and_tell(text)
    assert time.process_time() - middle < 8 * (middle - begin)


def test_made_secrets_are_read_once_and_are_those_of_the_sql(spark, tmp_path):
    at = str(tmp_path)
    texts = ["", "A house, ünder trees; " * 300, "password is a message of task and path", "it is.\n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    query = catalogue.QUERIES["redact_made_secrets"](spark, at)
    assert sorted(tuple(r) for r in query.collect()) == sorted(connection.execute(catalogue.ORACLE_SQL["redact_made_secrets"]).fetchall())
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("run(concat(") == 1, plan
