"""Substring dedup against a brute-force count of all strings."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import suffix
from quarry.sources.tables import load


def brute(rows, length, keep="none"):
    """rows in order of (doc_id, ...) -> sorted (doc_id, n_bytes, n_removed, n_spans, sha)"""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = defaultdict(int)
    for _, b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] += 1
    out, before = [], set()
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if (s in before) if keep == "first" else seen[s] > 1:
                gone[p:p + length] = b"\1" * length
            before.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, **params):
    return sorted(map(tuple, suffix.digest(suffix.substring_dedup(df, **params)).collect()), key=repr)


def test_window_minima():
    v = np.random.default_rng(1).integers(0, 99, 50, dtype=np.uint64)
    for w in (1, 3, 7, 50):
        assert suffix.window_minima(v, w).tolist() == [min(v[k:k + w]) for k in range(len(v) - w + 1)]


def test_previous_smaller():
    v = np.random.default_rng(2).permutation(200)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
    assert suffix.previous_smaller(v).tolist() == want


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_arrays_on_random_groups(keep):
    rnd = random.Random(7)
    for _ in range(30):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(12, 60))).encode() for _ in range(6)]
        groups = np.array([0, 0, 0, 1, 1, 1])
        marks = suffix.repeats(texts, groups, 12, keep)
        for g in (0, 1):
            before, count = set(), defaultdict(int)
            for k in np.flatnonzero(groups == g):
                for p in range(len(texts[k]) - 11):
                    count[texts[k][p:p + 12]] += 1
            for k in np.flatnonzero(groups == g):
                for p in range(len(texts[k]) - 11):
                    s = texts[k][p:p + 12]
                    assert marks[k][p] == (s in before if keep == "first" else count[s] > 1)
                    before.add(s)


def test_whole_table(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows, suffix.LENGTH)


def test_hot_groups_are_split_and_stay_exact(spark):
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    passage = word(60)
    texts = [word(rnd.randint(0, 30)) + passage + word(rnd.randint(0, 30)) for _ in range(40)]
    texts += ["a" * 200, "ab" * 90, passage[:35], passage[10:] + passage, texts[0], texts[0]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        want = brute(rows, 24, keep)
        assert got(docs, length=24, gram=8, group_runs=2, keep=keep) == want
        assert got(docs, length=24, gram=8, keep=keep) == want


def test_long_rows_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 300)
    rnd = random.Random(13)
    long = "".join(rnd.choice("abcdefgh") for _ in range(2000))
    rows = [(1, long), (2, long[500:1500]), (3, "x" + long[100:130]), (4, long[1990:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, length=24, gram=8) == brute(rows, 24)


def test_nulls_ties_empty_and_clashing_columns(spark):
    text = "é" * 500
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("start", T.StringType()), T.StructField("text_key", T.IntegerType())])
    rows = [Row(None, text, "s", 1), Row(3, None, "s", 1), Row(4, "", None, 1), Row(5, "short", "s", None),
            Row(6, "z" * 401, "s", 2), Row(7, "unique " + "".join(map(str, range(300))), "s", 2),
            Row(7, "unique " + "".join(map(str, range(300))), "s", 2)]
    docs = spark.createDataFrame(rows, schema)
    assert got(docs) == brute([(r[0], r[1]) for r in rows], suffix.LENGTH)
    assert got(docs.limit(0)) == []
    with pytest.raises(ValueError):
        suffix.substring_dedup(docs, keep="last")


def test_runs_are_counted_by_a_digest_of_their_bytes(spark):
    text = bytes(rnd % 251 for rnd in range(3000)) * 2
    docs = spark.createDataFrame([(1, 7, bytearray(text))], "doc_id long, text_key long, text binary")
    rows = suffix.runs(docs).collect()
    assert rows and sum(r.n for r in rows) == len(text) - suffix.LENGTH + 1
    for r in rows:
        assert bytes(r.span) == hashlib.blake2b(text[r.at:r.at + r.n - 1 + suffix.LENGTH], digest_size=16).digest()


def test_a_hot_anchor_is_joined_from_written_tables(spark):
    part = spark.createDataFrame([(1, 2, k, 5, 3, 9, bytearray(b"x%d" % (k % 50)), 1) for k in range(200)] + [(1, 2, 900, 5, 3, 8, bytearray(b"y"), 1)],
                                 "doc_id long, text_key long, at long, n int, off int, core long, span binary, seen long")
    kinds, mixed = suffix._kinds(part, 40)
    assert kinds.count() == 51 and mixed.count() == 50 and mixed.where("not hot").count() == 0
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("parquet") == 2
