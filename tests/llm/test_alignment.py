"""Alignment against a brute-force version that expands every link of every document."""

import bisect
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomsearch.llm import alignment
from loomsearch.llm.tokens import _byte_letters

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
FIRST, SECOND = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
FIRST.encode_special_tokens = True
BYTE = {chr(c): b for b, c in _byte_letters().items()}
ODD = [
    None, "", " ", "  a", "a  b", "a \n b ", "x<|endoftext|> y</s>", "<0x41> <s>", "a▁b c", "日本語 テスト。", "é ß 🙂", "a" * 300 + " b", "    " * 30, "=" * 90 + " -" * 9, "\x00 a", "tab\tx y",
    "the the cat sat", "the cat", "sitting bittersweet indistinguishable",
]


def groups(text):
    """The groups of a whole text, from both libraries' ids of the whole text and sets of their byte offsets."""
    if not text:
        return []
    a, b, raw = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text), (" " + text).encode()
    left = [bytes(BYTE[c] for c in FIRST.id_to_token(k)) for k in a]
    right = [bytes([int(SECOND.id_to_piece(k)[3:5], 16)]) if SECOND.is_byte(k) else SECOND.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if b"".join(left) != raw or b"".join(right) != raw:
        return []

    def ends(parts):
        out = [0]
        for p in parts:
            out.append(out[-1] + len(p))
        return out[1:]

    ea, eb = ends(left), ends(right)
    both = sorted(set(ea) & set(eb))
    found = [([], []) for _ in both]
    for side, ids, at in ((0, a, ea), (1, b, eb)):
        for k, e in zip(ids, at):
            found[bisect.bisect_left(both, e)][side].append(k)
    return found


def brute_force(texts):
    held = [groups(t) for t in texts]
    counts = Counter(p for g in held for p in {(x, y) for a, b in g for x in a for y in b})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for g in held:
        links = [counts[x, y] == most[x] and (counts[x, y], 1) or (counts[x, y], 0) for a, b in g for x in a for y in b]
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(k for _, k in links), sum(n for n, _ in links), written))
    return out


def rows(df):
    return sorted(tuple(r[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=10), st.sampled_from([" ", "  ", "\n", "▁", "the", "ing", "é", "12", "===", "<s>", "\x1c", "\x85"])), max_size=10).map("".join))
def test_stretches_have_the_groups_of_whole_texts(text):
    known = alignment.Aligner.of(A, B)
    read = known.read([text])
    got = ";".join(known.keys[g] for g in alignment._Tables(known).groups(read[0]))
    assert got == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups(text))


@pytest.mark.parametrize(("held", "kept"), [(100_000, 100_000), (7, 100_000), (0, 5)])
def test_counts_are_those_of_all_links(spark, monkeypatch, prose, held, kept):
    """With all groups held by the tasks, with few, and with none and workers that forget after every slice."""
    monkeypatch.setattr(alignment, "MOST_HELD", held)
    monkeypatch.setattr(alignment, "MOST_KEPT", kept)
    texts = [*ODD, *(prose(30) for _ in range(25)), *(prose(3) for _ in range(40))]
    texts += texts[20:30]
    want = sorted((k, *r) for k, r in enumerate(brute_force(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows(alignment.align(df, A, B)) == want


def test_odd_rows(odd_docs, no_docs):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = sorted(((k or 0), *r) for (k, _), r in zip(texts, brute_force([t for _, t in texts]), strict=True))
    df = alignment.align(odd_docs, A, B)
    assert rows(df.na.fill(0, ["id"])) == want
    assert alignment.align(no_docs, A, B).count() == 0
    digests = alignment.align(odd_docs, A, B, digest=True).where("id = 1").collect()
    assert {r["groups_sha256"] for r in digests} == {hashlib.sha256(next(w[-1] for w in want if w[0] == 1).encode()).hexdigest()}


def test_link_counts_are_a_table_of_their_own(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the")], "doc_id long, text string")
    read = alignment.read_groups(df, A, B)
    found = alignment.link_counts(read, alignment.dictionary(read)).collect()
    the = FIRST.encode(" the", add_special_tokens=False).ids[0]
    assert [(r["n"], r["best"]) for r in found if r["a"] == the] == [(3, True)]
