"""The streaming transducer against the tokenizers library."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opinara.llm import bpestream, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def encoder():
    return bpestream.Encoder(WORDS)


def texts():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCDE'!?,.0123 \n\té́ßΣ日가한ᅡᆨ👍 <|>"
    fixed = ["", " ", "a", "Don't STOP!! it's 1234", "<|endoftext|>x<|startoftext|>", "x\n\n\ty z\u0085w\x1fv\x0bu",
             "ÉCOLE İΣΑΣ straße", "éé", "́a", "word,word.", "a\0b", "'s'S 'T'tell '", "x" * 9000, "12" * 6000, "!?" * 5000,
             "日本語" * 3000, "각" * 4000, "é" * 5000, "👍🏽" * 3000, "ab'" * 4000]
    mixed = ["".join(rng.choice(letters) for _ in range(n)) for n in (20, 300, 9000) for _ in range(30)]
    runs = ["".join(rng.choice(["the", "ing", "re", "er", "in", "an"]) for _ in range(n)) for n in (10, 400, 5000) for _ in range(10)]
    return fixed + mixed + runs


def test_ids_and_text_equal_the_library(library, encoder):
    decoder = bpestream.Decoder(WORDS)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert got == want, text[:80]
        assert decoder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_byte_level_decoding_equals_the_library():
    library, decoder, rng = Tokenizer.from_file(BYTES), bpestream.Decoder(BYTES), random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(40))]
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decoder_emits_blocks_and_restores_words(encoder, monkeypatch):
    monkeypatch.setattr(bpestream, "STRIDE", 3)
    text = "été 👍 it's " * 5
    ids = np.frombuffer(encoder.encode(text), "<u4")
    assert bpestream.Decoder(WORDS, words=True).decode(ids) == "été 👍 it 's " * 5
    assert len(list(bpestream.Decoder(WORDS).blocks(ids))) == -(-len(ids) // 3) + 1


def brute_merge(pairs, word):
    rank = {p: i for i, p in enumerate(pairs)}
    parts = list(word)
    while True:
        known = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not known:
            return parts
        i = min(known)[1]
        parts[i: i + 2] = [parts[i] + parts[i + 1]]


def vocabulary(rng, rules, letters="abc"):
    pairs, made = [], list(letters)
    for _ in range(rules * 4):
        a, b = rng.choice(made), rng.choice(made)
        if len(pairs) < rules and a + b not in made:
            pairs.append((a, b))
            made.append(a + b)
    return pairs, {"type": "BPE", "vocab": {t: i for i, t in enumerate(made)}, "merges": pairs}


def test_lookahead_suffices_on_small_vocabularies():
    """Tokens that end `lookahead` before the end of a prefix are tokens of the whole."""
    rng = random.Random(11)
    for _ in range(150):
        pairs, model = vocabulary(rng, rng.randrange(1, 9))
        merges = bpestream.Merges(model)
        names = {i: t for t, i in model["vocab"].items()}
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
            want = brute_merge(pairs, word)
            assert [names[i] for i in merges.merge(merges.symbols(word, True))] == want
            assert [names[i] for i in merges._queue(merges.symbols(word, True))] == want
            run = bpestream.Transducer(merges)
            run.window = merges.lookahead + rng.randrange(1, 4)
            symbols = merges.symbols(word, True)
            assert [names[i] for i in [*run.feed(symbols), *run.finish()]] == want
            assert len(run.held) == 0


def test_lookahead_follows_chains_of_rules():
    assert bpestream.lookahead([]) == 0
    assert bpestream.lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3      # d changes whether a meets b
    assert bpestream.lookahead([("a", "b"), ("b", "c"), ("c", "d")]) == 1
    with pytest.raises(ValueError):
        bpestream.lookahead([("ab", "c"), ("a", "b")])


def test_the_window_stays_bounded(encoder):
    merges = encoder.merges
    assert merges.lookahead == 145
    run, most = bpestream.Transducer(merges), 0
    for symbol in merges.symbols("ab" * 20_000, False):
        list(run.feed([symbol]))
        most = max(most, len(run.held))
    assert most <= run.window


def test_vocabularies_that_keep_white_space_are_refused():
    with pytest.raises((ValueError, AttributeError)):
        bpestream.Encoder(BYTES)


def test_every_kind_of_row(spark, library):
    rows = [(1, "One two"), (None, "one two"), (1, "One two"), (2, None), (3, ""), (4, "z" * 200_000), (5, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as _id", "3 as n_tokens")
    out = bpestream.encode_documents(docs, WORDS, decoded=True)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted(map(str, out.collect()))
    want = []
    for own, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((own, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(map(str, spark.createDataFrame(
        want, "doc_id long, n_tokens long, ids array<int>, decoded string").collect()))
    text = bpestream.decode_documents(out, WORDS).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in text) == sorted((w[0] or 0, w[3]) for w in want)
    assert bpestream.encode_documents(docs.limit(0), WORDS).collect() == []
    named = bpestream.encode_documents(spark.createDataFrame([("k", "a b")], "doc_id string, text string"), WORDS)
    assert named.first()["doc_id"] == "k"


def test_query_equals_the_library_row_by_row(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_bpe_stream"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                    hashlib.sha256(text.encode()).hexdigest())


def test_joining_characters_follow_the_standard():
    assert "́" in bpestream._joining() and "ᅡ" in bpestream._joining()
    assert unicodedata.normalize("NFC", "가" + "ᆨ") == "각" and not bpestream._starts("ᆨ")
    assert bpestream._starts("日") and bpestream._starts("a")
