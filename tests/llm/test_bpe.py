"""Ids and texts of the rank-array encoder against the library's."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomsearch.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.ByteBPE(PATH)
ODD = ["", " ", "  a", "a  b ", "\n \n", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "don't we'll", "日本語 テスト。", "é   b", "ß½²ªº  x", "\x00\x1c a\x85b", "🙂🙂 🙂", "a" * 500, "ab" * 300 + " c"]


def want(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids_of(text):
    return np.frombuffer(OWN.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = want(text)
    assert ids_of(text) == ids and OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", "<|endoftext|>", "the", "'s", "é", "12", "==="])), max_size=12).map("".join))
def test_any_text(text):
    ids = want(text)
    assert ids_of(text) == ids and OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_400), max_size=20))
def test_any_ids_decode_as_by_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinrst é", min_size=1, max_size=60), max_size=20))
def test_the_scan_and_the_queue_agree(words):
    raw = [w.encode() for w in words]
    queued = [bpe.queue_merge(OWN.letters[np.frombuffer(w, np.uint8)].tolist(), OWN.ranks, OWN.merged) for w in raw]
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.merge(raw)] == queued


def test_every_pair_has_its_rank():
    left, right = np.array(list(OWN.ranks)).T
    assert OWN.table.of(left, right).tolist() == list(OWN.ranks.values())
    assert (OWN.table.of(left, right + 60_000) == bpe._NONE).all() and (OWN.table.of(np.full(3, -1), left[:3]) == bpe._NONE).all()


def test_blocks_and_what_is_forgotten_change_nothing(prose, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "MOST_KEPT", 40)
    for text in [prose(300), "  ".join(ODD), prose(40) + " \n " + "x" * 3000 + prose(50), "日本 語" * 40]:
        assert ids_of(text) == want(text)


def test_a_long_word_without_spaces():
    text = "".join(np.random.default_rng(0).choice(list("etaoinshrdlu"), 60_000))
    assert ids_of(text) == want(text)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBPE(str(public_tokenizers.path("word_bpe_49k.json")))


def test_odd_rows(odd_docs, no_docs, spark):
    rows = bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect())
    assert sorted((r["id"] or 0, r["text"]) for r in rows) == texts
    assert all(list(r["ids"]) == want(r["text"]) for r in rows)
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
    got = bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [72, None, 99_999_999, 72])], "id long, ids array<int>"), PATH)
    assert [r["text"] for r in got.orderBy("id").collect()] == [None, "", OWN.decode([72, 72])]
