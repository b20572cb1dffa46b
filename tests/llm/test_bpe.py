"""The trie encoder against the tokenizer's own library."""
import hashlib
import random
import time
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, queries
from quarry.sources.tables import load

PARTS = list("  \t\n\r▁aabcdeé漢字ßlothegin0123.,;{}()<>/=-_'\x00😀ñ\xa0　\x1c\x85") + [
    "the", "ing", "    ", "\n\n", "==", "<|endoftext|>", "<|endoftext", "'s", "'ll", "'S", "aaaa", "hhhh", "0000",
    "՘", "Ᲊ", "\U0001e5d0", "\U0001e5f1", "\U000323b0"]  # letters and numbers of several Unicode versions


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def ids_of(encoder, texts):
    return [list(array("i", raw)) for raw in encoder.encode(texts)]


def test_random_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 13)  # texts are taken in several blocks
    monkeypatch.setattr(bpe, "MAX_WORDS", 500)
    encoder, rnd = bpe.Encoder(bpe.load_encoder().vocab), random.Random(5)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for k in range(0, len(texts), 50):
        some = texts[k:k + 50]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert ids_of(encoder, some) == want
    assert len(encoder.known) < 1000


def test_decoding_takes_any_ids(library):
    decoder, rnd = bpe.load_decoder(), random.Random(6)
    for _ in range(500):  # most of these are no UTF-8
        ids = [rnd.choice([rnd.randrange(300), rnd.randrange(50257)]) for _ in range(rnd.randint(0, 12))]
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode([10 ** 9, -1]) == ""


def test_a_shared_prefix_is_computed_once(monkeypatch):
    vocab, steps = bpe.load_encoder().vocab, []
    extend = vocab.extend
    monkeypatch.setattr(vocab, "extend", lambda data, states: (steps.append(len(data) + 1 - len(states)), extend(data, states)))
    words = [b"", b"inter", b"interest", b"interested", b"interesting", b"into", b"x", b"interest"]
    got = bpe.encode_words(vocab, words)
    assert set(got) == set(words)
    assert sum(steps) == len("interest") + len("ed") + len("ing") + len("o") + len("x")
    for w in words:
        assert got[w] == bpe.encode_words(vocab, [w])[w]


def test_only_a_tokenizer_of_this_kind_is_taken():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.load_encoder("word_bpe_49k.json")


def test_very_long_words_and_texts(library):
    encoder = bpe.Encoder(bpe.load_encoder().vocab)
    text = "a" * 300_000 + " " + "bcd" * 100_000 + "\n" * 5000 + "the end " * 100_000
    t = time.time()
    assert ids_of(encoder, [text])[0] == library.encode(text, add_special_tokens=False).ids
    assert time.time() - t < 30
    assert max(map(len, encoder.known)) <= bpe.MAX_KEPT_CHARS


def test_whole_table_equals_the_library(spark, sf_small, library):
    docs = load(spark, sf_small, "documents")
    got = {r.doc_id: r for r in queries.op11_bpe(spark, sf_small).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        have = got[r.doc_id]
        assert have.n_tokens == len(ids)
        assert have.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert have.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_clashing_names_and_an_empty_table(spark):
    docs = spark.createDataFrame(
        [(1, None, "x", "y"), (None, "", "x", "y"), (2, "a b", "x", "y"), (2, "a b", "x", "y")],
        "doc_id long, text string, ids string, decoded string")
    out = bpe.decode(bpe.encode(docs))
    assert out.columns == ["doc_id", "ids", "decoded"]
    rows = sorted((r.doc_id or 0, r.ids, r.decoded) for r in out.collect())
    assert [(a, c) for a, _, c in rows] == [(0, ""), (1, ""), (2, "a b"), (2, "a b")]
    assert [len(b) for _, b, _ in rows] == [0, 0, 2, 2]
    assert bpe.digest(bpe.decode(bpe.encode(docs.limit(0)))).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == ""
    named = bpe.encode(docs.withColumn("text", F.lit("a")), id_col="ids")
    assert named.schema["doc_id"].dataType.simpleString() == "string"
