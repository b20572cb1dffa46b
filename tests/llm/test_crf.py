"""Quality rules: base statistics, Viterbi and gradients against brute force."""
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import base, crf
from quarry.sources.tables import load


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    cover = [0] * len(words)
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            cover[i:i + 3] = [1, 1, 1]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            sum(cover))


EDGES = [None, "", "\n", "\n\n a\n a\n\n", "a b c a b c", "x\x00y z\n\x0b\x0c q", "  ", "é è é è\n" * 20, "word",
         "# $ %\n| | |", "a\r\nb\r\nb\r\n"]


def stats(texts, limit=base.BLOCK_BYTES):
    data, offsets = base.byte_rows(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    out = []
    for i, j in base.row_blocks(offsets, limit):
        s = crf.block_stats(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        out += zip(*[s[c].tolist() for c in crf.LONGS])
    return out


def test_base_statistics(spark, sf_small):
    texts = [r.text for r in load(spark, sf_small, "documents").select("text").collect()] + EDGES
    want = [brute(t) for t in texts]
    assert stats(texts) == want
    assert stats(texts, 100) == want


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for n in range(1, 8):
        field = crf.Field(moves=rng.normal(size=(2, 2)))
        scores = rng.normal(size=n)

        def value(labels):
            return sum(scores[k] * y for k, y in enumerate(labels)) + sum(
                field.moves[a, b] for a, b in zip(labels, labels[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(field.viterbi(scores.tolist())) == best
    assert crf.Field().viterbi([]) == []


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 4, len(crf.FEATURES)))
    y = np.array([[0] * 4, [1] * 4, [0, 1, 1, 0]])
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], dtype=bool)
    w, m = rng.normal(size=len(crf.FEATURES)), rng.normal(size=(2, 2))
    _, gw, gm = crf.log_likelihood(w, m, x, y, mask)
    value = lambda w, m: crf.log_likelihood(w, m, x, y, mask)[0]
    for k in range(len(w)):
        e = np.zeros(len(w))
        e[k] = 1e-5
        assert abs((value(w + e, m) - value(w - e, m)) / 2e-5 - gw[k]) < 1e-4
    for a, b in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[a, b] = 1e-5
        assert abs((value(w, m + e) - value(w, m - e)) / 2e-5 - gm[a, b]) < 1e-4
    # the likelihoods of all labellings of one sequence sum to one
    total = sum(np.exp(crf.log_likelihood(w, m, x[:1], np.array([ys]), mask[:1])[0])
                for ys in itertools.product((0, 1), repeat=4))
    assert abs(total - 1) < 1e-9


def test_labels_agree_on_documents_that_the_fit_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    field = crf.train(docs, labels.where("doc_id % 2 = 0"))
    got = crf.quality_rules(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and not r.base_failed]
    junk = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_nulls_empty_extra_columns(spark):
    long = "\n".join(f"This is line number {k} of a very long text, it has words." for k in range(30_000))
    schema = T.StructType([T.StructField("n_words", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("kept", T.IntegerType())])
    docs = spark.createDataFrame([Row("a", None, 1, 1), Row("b", "", None, 2), Row("c", long, 2, 3),
                                  Row("c", long, 2, 3)], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = crf.train(docs, labels)
    assert (field.weights == crf.PRIOR).all()
    got = crf.quality_rules(docs, field).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [
        (0, 0, False), (1, 0, False), (2, 390_000, got[-1].kept), (2, 390_000, got[-1].kept)]
    kept = crf.keep_quality(docs, field)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert all(r.text for r in kept.collect())
    assert crf.quality_rules(docs.limit(0), field).count() == 0
