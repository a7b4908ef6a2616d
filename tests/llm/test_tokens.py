import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomsearch.llm import packing, rangecoder, tokenfiles, tokens
from loomsearch.llm.tokens import PieceTable, count_tokens

BYTES, WORDS = (str(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [
    "", " ", "  a", "a  b", "a \n b", "a\n\n b", " \n", "x<|endoftext|> y", "x  <|endoftext|>  y", "ΑΣ ΑΣ. İİ é é ́x", "don't we'll I'M 'S", "a" * 100 + " b", "ab\x1c cd \x1c ef", "ﬁ ﬀ. 12,5 x3 _a_ a_b",
    "日本語 テスト。", "a\u2003 b \u3000c", "ß ẞ Ω K Å", "naïve… «ok»!", "a. .b ,, ., ;", "tab\tx \tq\t ", "½ ² ª º µ",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_library_s(path, prose):
    texts = ODD + [prose(200) for _ in range(20)] + [" ".join(ODD)]
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, counts = PieceTable(path), PieceTable(path, counts=True)
    for _ in range(2):  # from the library and from the tables
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.look_up(texts)] == want
        assert counts.look_up(texts) == [len(w) for w in want]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("held", [100_000, 7])
def test_counts_are_the_library_s(spark, path, held, prose, monkeypatch):
    """With all pre-tokens held by the tasks, and with most of them met in the join."""
    monkeypatch.setattr(tokens, "MOST_HELD", held)
    texts = [None, *ODD, *(prose(60) for _ in range(30)), " ".join(ODD), prose(5) + "  \n " + prose(5), "<|endoftext|>", " <|endoftext|><|endoftext|> a", "x<|endoftext|>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = sorted((r["id"], r["n_tokens"], r["n_bytes"]) for r in tokens.count_tokens(df, path).collect())
    assert got == sorted((k, n, len((texts[k] or "").encode())) for k, n in enumerate(want) for _ in range(2))


def test_counts_of_odd_rows(odd_docs, no_docs):
    rows = count_tokens(odd_docs, BYTES).collect()
    assert len(rows) == odd_docs.count()
    by = {r["id"]: (r["n_bytes"], r["n_tokens"]) for r in rows}
    assert by[2] == (0, 0) == by[3] and by[1] == (16, 3) and by[4][0] == 2
    assert count_tokens(no_docs, BYTES).count() == 0


def least_sequences(counts, capacity):
    """No packing has fewer: all tokens need room, and no two of the lengths over half of it share a sequence."""
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))


def test_complements_use_everything_once():
    rng = np.random.default_rng(0)
    for capacity in (7, 16, 64):
        for _ in range(60):
            counts = {int(k): int(n) for k, n in zip(rng.integers(1, capacity + 1, 12), rng.integers(1, 30, 12), strict=True)}
            runs = packing.complements(dict(counts), capacity)
            used = {}
            for pattern, n in runs:
                assert n > 0 and sum(pattern) <= capacity
                for x in pattern:
                    used[x] = used.get(x, 0) + n
            assert used == counts
            n = sum(n for _, n in runs)
            assert least_sequences(counts, capacity) <= n <= 1.3 * least_sequences(counts, capacity) + 1
    assert sum(n for _, n in packing.complements({600: 5, 300: 5, 124: 5}, 1024)) == 5


def test_packing_of_odd_rows(odd_docs, no_docs, spark):
    got = packing.pack(odd_docs, BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    want = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in odd_docs.collect()}
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["id"]][r["start"] : r["start"] + r["length"]]
    for key, n in ((5, 1), (1, 3)):
        assert sum(r["length"] for r in got if r["id"] == key) == n * len(want[key])
    assert all(r["length"] == 1024 for r in got if r["id"] == 5 and r["piece"] > 0)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    whole = {r["sequence_id"]: r for r in packing.sequences(packing.pack(odd_docs, BYTES)).collect()}
    assert len(whole) == len(places) and all(len(r["ids"]) == 4 * r["length"] for r in whole.values())
    assert packing.pack(no_docs, BYTES).count() == 0


def test_blocks_round_trip_and_say_when_they_are_corrupt():
    rng = np.random.default_rng(1)
    blocks = [np.array([], "<u4"), np.array([0]), np.full(10, 65535), rng.integers(0, 50_000, 700), np.tile(rng.integers(0, 99, 30), 40), rng.integers(0, 2**32, 300), rng.zipf(1.3, 2000) % 49_000]
    coded = rangecoder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(rangecoder.decode_blocks(coded), blocks, strict=True))
    assert rangecoder.decode_blocks([coded[3]])[0].tolist() == blocks[3].tolist()  # a block alone
    assert len(coded[4]) < 4 * len(blocks[4]) / 8
    for bad in (coded[3][:40] + bytes([coded[3][40] ^ 1]) + coded[3][41:], b"xxxx" + coded[3][4:], coded[3][:9], coded[3][:4] + b"\x09" + coded[3][5:]):
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.decode_blocks([bad])


def test_blocks_are_smaller_than_order_0_and_zlib():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.frombuffer(b"".join(PieceTable(WORDS).look_up(texts)), "<u4")
    blocks = [ids[k : k + rangecoder.BLOCK] for k in range(0, len(ids) - rangecoder.BLOCK, rangecoder.BLOCK)][:16]
    coded = rangecoder.encode_blocks(blocks)
    shares = [np.unique(block, return_counts=True)[1] / len(block) for block in blocks]
    order_0 = sum(-(p * np.log2(p)).sum() * len(block) for p, block in zip(shares, blocks, strict=True))
    assert 8 * sum(map(len, coded)) < 0.97 * order_0
    assert sum(map(len, coded)) < 0.85 * sum(len(zlib.compress(block.astype("<u2").tobytes(), 9)) for block in blocks)
    assert np.array_equal(rangecoder.decode_blocks(coded[:1])[0], blocks[0])


def test_orders_1_and_2_are_mixed_in():
    rng = np.random.default_rng(3)
    follows = rng.permutation(500)  # what follows an id is nearly always the same
    ids = [0]
    while len(ids) < 6000:
        ids.append(int(follows[ids[-1]]) if rng.random() < 0.9 else int(rng.integers(0, 500)))
    out = rangecoder.encode_blocks([np.array(ids), rng.integers(0, 500, 6000)])
    assert len(out[0]) < 0.5 * len(out[1])


def test_files_of_odd_rows(odd_docs, no_docs):
    got = sorted((r["start"], r["id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read(tokenfiles.write(odd_docs, WORDS)).collect())
    library, at, ids = Tokenizer.from_file(WORDS), 0, []
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for start, key, n, crc in got:
        raw = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (start, n, crc) == (at, len(raw) // 4, zlib.crc32(raw))
        at += n
        ids.append(key)
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == odd_docs.count()
    assert tokenfiles.read(tokenfiles.write(no_docs, WORDS)).count() == 0


def test_checksums_of_parts_combine():
    a, b, c = b"abcd" * 5, b"efgh" * 1, b"ijkl" * 7
    assert tokenfiles._fold([(len(x) // 4, zlib.crc32(x)) for x in (a, b, c)]) == zlib.crc32(a + b + c)


def test_printable_latin_is_cut_as_the_library_cuts_it():
    """By every pair and many longer stretches of printable Latin-1; and no stretch of it goes through the slower pattern."""
    import itertools
    import random

    import public_tokenizers

    from loomsearch.llm import tokens

    table = tokens.PieceTable(public_tokenizers.path("byte_bpe_50k.json"))
    signs = [c for k in range(33, 256) if (c := chr(k)).isprintable()]
    rng = random.Random(5)
    stretches = ["".join(p) for p in itertools.product(signs, repeat=2)] + signs + ["".join(rng.choices("aZ09'strevmld.,-_$éßµ²¾×÷ª¡", k=rng.randint(3, 14))) for _ in range(20_000)]
    slow, tokens._SPACED = tokens._SPACED, None
    try:
        for s in stretches + [" " + s for s in stretches] + [" "]:
            assert table._cut(s) == [p for p, _ in table.library.pre_tokenizer.pre_tokenize_str(s)]
    finally:
        tokens._SPACED = slow


def test_a_large_block_is_coded_in_stretches_that_share_a_model():
    """Stretches of unequal numbers of words, ids that are new late, ids beyond 16 bits, and predictions that are always wrong."""
    rng = np.random.default_rng(11)
    blocks = [np.concatenate((np.full(150_000, 9), rng.integers(0, 2**16, 150_001))), rng.zipf(1.2, 100_000) % 49_000, np.arange(70_000), rng.integers(0, 2**32, 40_000), np.tile([1, 2, 1, 3], 20_000)]
    coded = rangecoder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(rangecoder.decode_blocks(coded), blocks, strict=True))
    assert len(coded[0]) < 1.2 * 2 * 150_001 and len(coded[4]) < 80_000 / 10
    for k in range(40):
        bad = bytearray(coded[1])
        bad[20 + k * len(bad) // 45] ^= 0x55
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.decode_blocks([bytes(bad)])


def test_stretches_met_again_stay_when_the_table_is_full(monkeypatch):
    """And texts may come as a slice of an Arrow array."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MOST_KEPT", 50)
    table, library = PieceTable(BYTES), Tokenizer.from_file(BYTES)
    often = "the end, of\nall ünd größe."
    texts = [None, *(f"{often} new{k} x{k}.\ny, q\n\nr{k} \n" for k in range(60))]
    for k in range(1, 61, 6):
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[k : k + 6]]
        assert table.look_up(pa.array(texts).slice(k, 6)) == want == PieceTable(BYTES).look_up(texts[k : k + 6]) if k == 1 else table.look_up(texts[k : k + 6]) == want
        assert k == 1 or {"end,", "of\nall", "größe."} <= table.again & table.later.keys()
    assert table.look_up(pa.array(texts).slice(0, 1)) == [b""] and table.look_up([]) == []


def test_bare_pieces_of_latin_1_are_the_library_s():
    """Every pair of characters and many longer texts; none of them goes through the pattern for stretches."""
    import itertools
    import random

    table = PieceTable(WORDS)
    rng = random.Random(9)
    texts = ["".join(p) for p in itertools.product(map(chr, range(256)), repeat=2)] + ["", "'", "x'", "'l", "'ll"]
    texts += ["".join(rng.choices("aZ09'\"'strevmldSTL.,-_$éÉßµ²¾×÷ª¡ \n\t\x00\x1c\x85\xa0'", k=rng.randint(3, 30))) for _ in range(30_000)]
    want = [e.ids for e in table.library.encode_batch(texts, add_special_tokens=False)]
    bare, tokens._BARE = tokens._BARE, None
    try:
        assert [np.frombuffer(x, "<u4").tolist() for x in table.look_up(texts)] == want
        assert PieceTable(WORDS, counts=True).look_up(texts) == [len(w) for w in want]
        assert table.look_up(["", None, "  "]) == [b"", b"", b""]
    finally:
        tokens._BARE = bare


def test_a_bare_word_is_asked_once_whatever_stands_around_it():
    """And in texts next to ones that are not all Latin-1, or hold a special token's string."""
    table, asked = PieceTable(WORDS), []
    tokenize = table.tokenize
    table.tokenize = lambda p: asked.append(p) or tokenize(p)
    for texts in (["Größe of Words, words.\nWORDS größe", "words' GRÖSSE"], ["(of) größe!", "of; 日本語", "of日 <|endoftext|> x"]):
        want = [e.ids for e in table.library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in table.look_up(texts)] == want
    assert [p for p in asked if p.startswith(("gr", "words"))] == ["grÃ¶ÃŁe", "words", "grÃ¶sse"]


def test_a_full_block_is_coded_by_many_ids_a_step(monkeypatch):
    """What a step costs beyond its ids is shared by some thousands of them; and stretches may take many more words than others."""
    rng = np.random.default_rng(3)
    block = rng.zipf(1.2, rangecoder.MOST) % 49_000
    block[1_000_000:1_100_000] = rng.integers(0, 2**16, 100_000)
    steps, predict = [], rangecoder._Model.predict
    monkeypatch.setattr(rangecoder._Model, "predict", lambda self, k: steps.append(k) or predict(self, k))
    coded = rangecoder.encode_blocks([block])
    assert np.array_equal(rangecoder.decode_blocks(coded)[0], block)
    assert sum(steps) == 2 * len(block) and len(steps) * 6000 <= 2 * len(block)
    short = rangecoder.encode_blocks([block[:1000]])
    assert np.array_equal(rangecoder.decode_blocks(short)[0], block[:1000])
