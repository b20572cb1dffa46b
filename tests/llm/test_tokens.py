"""The transducer against the tokenizer's own library."""
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import tokens
from quarry.sources.tables import load


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))


def test_random_texts_in_chunks_of_any_size(library):
    machine = tokens.load_transducer()
    rnd = random.Random(5)
    parts = list("  \t\n▁aabcdeé漢字ßlothegin0123.,;{}()<>/=-_\r\x00😀ñ") + ["the", "ing", "    ", "\n\n", "==", "<s>", "</s>"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50)))
        want = len(library.encode(text))
        assert machine.count(text, rnd.choice([1, 2, 3, 7, 16, 1 << 14])) == want, repr(text)


def test_prefix_scan_gives_the_count_at_every_chunk(library):
    machine = tokens.load_transducer()
    text = "the  quick brown fox" * 5 + "=" * 40 + " a b"
    counts = machine.counts(text, 7)
    marked = len(text) + 1
    assert len(counts) == -(-marked // 7)
    for k, n in enumerate(counts):
        assert n == len(library.encode(text[:max(0, 7 * (k + 1) - 1)]))


def test_composition_is_associative():
    m = tokens.load_transducer()
    a, b, c = (m.chunk_map(x) for x in ("▁the▁qu", "ick", "▁brown▁f"))
    assert m.compose(m.compose(a, b), c) == m.compose(a, m.compose(b, c))


def test_tables_stay_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    m = tokens.Transducer(tokens.load_transducer().pieces)
    for k in range(300):
        text = f"word{k} some text {k * 7} {'xyz' * (k % 5)}"
        assert m.count(text) == len(library.encode(text))
    assert len(m.words) <= 20 and len(m.states) <= 60


def test_whole_table(spark, sf_small, library):
    docs = load(spark, sf_small, "documents")
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect()}
    got = tokens.token_counts(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_nulls_empty_long_and_repeated_rows(spark, library):
    long = "lorem ipsum " * 60_000 + "x" * 50_000 + " " * 9_000
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("n_tokens", T.StringType())])
    docs = spark.createDataFrame([Row(1, None, "a"), Row(None, "", "b"), Row(2, long, "c"), Row(2, long, "c")], schema)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect()), key=str)
    n = len(library.encode(long))
    assert got == sorted([(1, 0, 0, False), (None, 0, 0, False), (2, len(long), n, True), (2, len(long), n, True)], key=str)
    assert tokens.token_counts(docs.limit(0)).count() == 0


def _spaceless(n):
    rnd = random.Random(11)
    parts = ["漢字仮名交じり文", "QWxhZGRpbjpvcGVu", "a" * 40, "word\tword\n", "=" * 30, "中文", "zz9Plural"]
    out, size = [], 0
    while size < n:
        out.append(rnd.choice(parts))
        size += len(out[-1])
    return "".join(out)[:n]


def test_spaceless_texts_in_chunks_of_any_size(library):
    machine = tokens.load_transducer()
    for text in (_spaceless(6_000), "a" * 5_000, "=" * 3_001, "漢字" * 2_000, "\x00\x01" * 500):
        want = len(library.encode(text))
        for chunk_chars in (1, 5, 64, 1 << 14):
            assert machine.count(text, chunk_chars) == want
            assert machine.counts(text, chunk_chars)[-1] == want


def test_a_chunk_without_spaces_resets_where_no_piece_goes_on():
    m = tokens.load_transducer()
    head, count, state = m.chunk_map("word\nword\x00漢")
    assert len(head) <= 5 and count and state is not None


@pytest.mark.parametrize("unit", ["QWxhZGRpbjpvcGVu", "a", "漢字仮名", "word\n"])
def test_spaceless_text_of_ten_million_characters(unit, monkeypatch):
    """Prefixes hold no text, and each character is run once."""
    m = tokens.load_transducer()
    text = unit * (10_000_000 // len(unit))
    ran, heads = [], []
    run, compose = m.run, m.compose

    def composed(a, b):
        out = compose(a, b)
        heads.append(len(out[0]))
        return out

    monkeypatch.setattr(m, "run", lambda state, part: (ran.append(len(part)), run(state, part))[1])
    monkeypatch.setattr(m, "compose", composed)
    n = m.count(text)
    assert sum(ran) == len(text) + 1
    assert len(heads) == -(-(len(text) + 1) // tokens.CHUNK_CHARS) and max(heads) == 0
    assert 0 < n <= 4 * len(text)


def test_frequent_words_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    m = tokens.Transducer(tokens.load_transducer().pieces)
    ran, run = [], m.run
    m.run = lambda state, text: (ran.append(text), run(state, text))[1]
    for k in range(100):
        assert m.words["frequent"] == m.words["often"] + run(m.start, "▁frequent")[1] - run(m.start, "▁often")[1]
        m.words[f"rare{k}"]
        assert len(m.words) + len(m.words.older) <= 20
    assert ran.count("▁frequent") == ran.count("▁often") == 1 and len(ran) == 102
