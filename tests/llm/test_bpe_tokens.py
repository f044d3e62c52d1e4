import random

import numpy as np
import pytest
from helpers import sample_documents

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")

from sievelight.llm import bpe, tokens  # noqa: E402

WORDS = vocabularies.path("word_bpe_49k.json")
BYTES = vocabularies.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n x", "a" * 5000, "ing" * 2000, "!?" * 1500, "İΣς ﬁ 한국 😀👍🏽", "é é ̈́ Å", "it's I'LL 'S",
    "<|endoftext|><|startoftext|>a<|endoftext|", "\x1c\x1d\x85  ​", "1234 ½ Ⅷ", "\x00�", "a  b   c \t ",
]


def texts():
    rng = random.Random(6)
    parts = ["a", "the", "ing", "é", "'s", "!!", " ", "\n", "1", "Σ", "한", "<|endoftext|>", "xyz", "’", "😀", "́"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return [*ODD, *mixed, *[r[1] or "" for r in sample_documents()]]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(WORDS)


def ids_of(parts):
    return [int(i) for part in parts for i in part]


def test_encoding_equals_the_library(encoder):
    for text in texts():
        assert ids_of(encoder.encode(text)) == encoder.library.encode(text, add_special_tokens=False).ids


def test_pieces_equal_the_whole(encoder):
    rng = random.Random(1)
    for text in texts()[:300]:
        stream, got, rest = bpe.StreamEncoder(encoder), [], text
        if "<|" in text:
            continue
        while rest:
            n = rng.randint(1, 9)
            got += ids_of(stream.feed(rest[:n]))
            rest = rest[n:]
        assert got + ids_of(stream.close()) == ids_of(encoder.encode(text))


def test_long_words_stream_with_bounded_memory(encoder):
    rng = random.Random(9)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeiou"):
        word = "".join(rng.choice(letters) for _ in range(12_000))
        machine, got, most = bpe.Transducer(encoder.merges), [], 0
        for i in range(0, len(word), 997):
            for some in machine.feed(word[i : i + 997].encode()):
                got += some
            most = max(most, len(machine.held))
        got += machine.close()
        assert got == encoder.library.encode(word, add_special_tokens=False).ids
        assert most < 3 * machine.limit


def small_merges():
    rng = random.Random(3)
    for _ in range(150):
        known, merges = list("abc"), []
        for _ in range(rng.randint(1, 9)):
            pair = rng.choice(known), rng.choice(known)
            if pair[0] + pair[1] not in known and len(pair[0] + pair[1]) < 7:
                merges.append(pair)
                known.append(pair[0] + pair[1])
        yield merges


def plain(text, merges):
    symbols = list(text)
    for u, v in merges:
        i, out = 0, []
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == (u, v):
                out.append(u + v)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def test_lookahead_is_sufficient():
    """No longer text changes the tokens that end before the bound, for many small merge lists."""
    rng = random.Random(8)
    for merges in small_merges():
        bound = bpe.sufficient_lookahead(merges)
        for _ in range(60):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 24)))
            cut = rng.randint(1, len(text))
            part, whole = plain(text[:cut], merges), plain(text, merges)
            end, stable = 0, []
            for token in part:
                end += len(token)
                if end <= cut - bound:
                    stable.append(token)
            assert whole[: len(stable)] == stable, (merges, text, cut)


def test_decoding_equals_the_library(encoder):
    encoded = [ids_of(encoder.encode(t)) for t in texts()]
    flat = np.array([i for ids in encoded for i in ids], dtype=np.int32)
    ends = np.cumsum([len(ids) for ids in encoded]).tolist()
    got = bpe.decoded(encoder.merges, flat, ends, False).to_pylist()
    for ids, text in zip(encoded, got, strict=True):
        assert text == encoder.library.decode(ids, skip_special_tokens=False)
        decoder = bpe.Decoder(encoder.merges)
        assert "".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) == text


def test_bytes_to_text_is_incremental(encoder):
    for text in ("naïve 😀 日本", "é" * 50):
        ids = ids_of(encoder.encode(text))
        decoder = bpe.Decoder(encoder.merges, as_text=True)
        pieces = [decoder.feed([i]) for i in ids]
        assert ("".join(pieces) + decoder.close()).replace(" ", "") == text.replace(" ", "")
        assert "�" not in "".join(pieces)
    decoder = bpe.Decoder(encoder.merges, as_text=True)
    broken = [encoder.merges.inner[0xC3], encoder.merges.inner[0x41]]
    assert decoder.feed(broken) + decoder.close() == "�A"


def test_encode_documents(spark, encoder):
    rows = [(1, "Some text", "k"), (1, "Some text", "k"), (None, None, None), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = bpe.encode_documents(df, WORDS)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    want = encoder.library.encode("Some text", add_special_tokens=False).ids
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got.collect()) == [
        (0, [], ""), (1, want, encoder.library.decode(want)), (1, want, encoder.library.decode(want)), (2, [], ""),
    ]
    assert bpe.encode_documents(df.where("false"), WORDS).count() == 0
    both = bpe.encode_documents(df, WORDS, text_as="as_text").where("doc_id = 1").first()
    assert both.as_text.rstrip(" ") == "some text" and both.decoded == encoder.library.decode(want)


def test_decoder_pieces(monkeypatch, encoder):
    """Pieces of any size give the same text, in both forms."""
    ids = np.array(ids_of(encoder.encode("naïve 😀 日本 <|endoftext|> " * 40)), dtype=np.int32)
    for as_text in (False, True):
        whole = bpe.decoded(encoder.merges, ids, [0, len(ids)], as_text).to_pylist()
        monkeypatch.setattr(bpe, "_IDS", 3)
        assert bpe.decoded(encoder.merges, ids, [0, len(ids)], as_text).to_pylist() == whole
        monkeypatch.undo()


def test_counts_equal_the_library():
    counter = tokens.PieceCounter(BYTES)
    found = counter.counts([*texts(), None])
    assert found == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in [*texts(), ""]]


def test_alike_characters_are_alike():
    """Every character of the fast way is split as the library splits it."""
    counter, encoder = tokens.PieceCounter(BYTES), bpe.Encoder(WORDS)
    for code in [*range(0x700), *range(0x2000, 0x2070), *range(0x3000, 0x3100), 0x4E00, 0x9FA5, 0xAC00, 0xD7A3]:
        c = chr(code)
        text = f"aB {c}A1 1{c} {c}{c} .{c}'s{c}"
        assert counter.counts([text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)], hex(code)
        assert ids_of(encoder.encode(text)) == encoder.library.encode(text, add_special_tokens=False).ids, hex(code)


def test_token_counts_of_a_table(spark):
    rows = [(1, "Hello there"), (1, "Hello there"), (None, None), (2, ""), (3, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as key")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tokens.token_counts(df, BYTES).collect())
    assert got == [(0, 0), (1, 2), (1, 2), (2, 0), (3, 1)]
    assert tokens.token_counts(df.where("false"), BYTES).count() == 0
