"""Redaction of secrets that are made from the rules' own shapes: no literal secret stands in this file."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomsearch.operators.redact import Redactor
from loomsearch.operators.redact_rules import Rule, default_rules, load_rules, scoped_flags

RULES = default_rules()
R = Redactor(RULES)


def secret_of(rule, text):
    m = re.search(rule.pattern, text, re.ASCII)
    return m[rule.group] if m.re.groups >= rule.group and m[rule.group] else m[0]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.id)
def test_made_secrets_do_not_leak(rule):
    """Two strings that the rule's pattern generates: the rule alone puts its label there, and all rules together leave nothing of the secret."""

    @settings(max_examples=2, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.pattern, re.ASCII)))
    def check(text):
        assert not rule.hints or any(h in text.lower() for h in rule.hints)
        assert f"[REDACTED:{rule.id}]" in Redactor([rule]).redact(text)
        out = R.redact(text)
        assert R.has_secret(text) and out != text and R.redact(out) == out
        secret = secret_of(rule, text)
        assert len(secret) < 12 or secret not in out or secret.startswith("[REDACTED")

    check()


def test_only_the_secret_of_an_assignment_goes():
    for name, sign in (("ADAFRUIT_KEY", "="), ("my-adafruit.io", ":="), ("adafruit", " => ")):
        secret = "q7" * 16
        assert R.redact(f"{name}{sign}{secret};") == f"{name}{sign}[REDACTED:adafruit-api-key];"


def test_headers_and_addresses_keep_their_names():
    token = "".join(chr(97 + k % 26) for k in range(30))
    assert R.redact(f"> authorization:  BEARER {token}\n") == "> authorization:  BEARER [REDACTED:bearer-token]\n"
    assert R.redact(f"Authorization: basic {token[:9]}==,") == "Authorization: basic [REDACTED:basic-auth],"
    assert R.redact(f"amqps://queue:{token}@mq.internal:5671/v") == "amqps://queue:[REDACTED:url-password]@mq.internal:5671/v"
    signed = ".".join(("ey" + "J" + token, "ey" + "J" + token[::-1], token))
    assert R.redact(f"cookie={signed}; path=/") == "cookie=[REDACTED:jwt]; path=/"


@pytest.mark.parametrize("kind", ["", "EC ", "RSA ", "ENCRYPTED "])
def test_key_blocks_go_whole_and_apart(kind):
    block = "\n".join((f"-----BEGIN {kind}PRIVATE KEY-----", "TUlJ" * 8, "QUJD" * 3 + "==", f"-----END {kind}PRIVATE KEY-----"))
    assert R.redact(f"first\r\n{block}\nbetween\n{block}") == "first\r\n[REDACTED:private-key]\nbetween\n[REDACTED:private-key]"


@pytest.mark.parametrize("text", ["", "Der Schlüssel liegt unter der Matte.", "call me at https://example.org/a:b@c?", "git commit -m 'rename basic authorization helpers'", "x = [1, 2, 3]  # tokens"])
def test_what_has_no_secret_stays(text):
    assert R.redact(text) == text and not R.has_secret(text)


PARTS = ["ghp_" + "Zz9" * 12, "AKIA" + "QRST" * 4, "redis://u:", "pw@host", "authorization: bearer ", "v" * 20, " ", "\n", '"', "=", "ß", "[REDACTED:x]", "npm_" + "k3" * 18]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8).map("".join))
def test_redacting_again_changes_nothing(text):
    once = R.redact(text)
    assert R.redact(once) == once


def test_columns_with_nulls_and_empty_texts(spark):
    found = "deploy with ghp_" + "7a" * 18
    df = spark.createDataFrame([(10, found), (11, None), (12, ""), (13, "deploy")], "k int, t string")
    rows = df.select("k", R.column(df["t"]).alias("t"), R.flag(df["t"]).alias("f")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(10, "deploy with [REDACTED:github-pat]", True), (11, None, False), (12, "", False), (13, "deploy", False)]


def test_several_rules_in_one_text_by_sql_and_by_column(spark):
    """The hints of a text decide which rules it meets; one without any hint is not handed to Python."""
    own = Redactor([Rule("one", "aa(b+)", ("aab",)), Rule("two", "c{3}", ("ccc",))])
    df = spark.createDataFrame([("xaabbcccy",), ("XAABX",), ("ccaab",)], "t string")
    assert [r["t"] for r in df.select(own.column(df["t"]).alias("t")).collect()] == ["xaa[REDACTED:one][REDACTED:two]y", "XAABX", "ccaa[REDACTED:one]"]


def test_public_rule_files():
    toml = """
[[rules]]
id = "two-groups"
regex = '''(user|pass)=(\\d{6})'''
secretGroup = 2
keywords = ["PASS", "user"]
[[rules]]
id = "flags"
regex = '''Xy(?i)z{4}$'''
[[rules]]
id = "jwt"
regex = "x"
[[rules]]
id = "no-python"
regex = "(?<=x*)y"
"""
    rules = load_rules(toml)
    assert [r.id for r in rules] == ["flags", "two-groups"]
    assert Redactor(rules).redact("pass=123456 XyzZzZ") == "pass=[REDACTED:two-groups] [REDACTED:flags]"
    assert scoped_flags("p[(?i)](?m)q(r(?s)s)") == "p[(?i)](?m:q(r(?s:s)))"
