"""Containment search against brute force over all documents and items."""
import random

import pytest
from oracle import same_as_sql
from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import decontam
from quarry.sources.tables import load


def brute(docs, items, shingle=5, threshold=0.8):
    out = []
    for d, text in docs:
        words = decontam.fold((text or "").encode())
        for i, q in sorted(set(items), key=repr):
            w = decontam.fold((q or "").encode())
            n = min(shingle, len(w))
            if not n:
                continue
            want = decontam.shingles(w, n)
            found = len(want & decontam.shingles(words, n))
            if found >= threshold * len(want) - 1e-9:
                out.append((d, i, len(want), found))
    return sorted(out, key=repr)


def got(docs, items, **params):
    rows = decontam.contained_items(docs, items, **params).collect()
    assert all(r.containment == r.n_found / r.n_shingles for r in rows)
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in rows), key=repr)


def test_whole_table_equals_sql(spark, sf_small):
    df = decontam.contained_items(load(spark, sf_small, "documents"), load(spark, sf_small, "benchmark"))
    same_as_sql(df, decontam.ORACLE_SQL, documents=f"{sf_small}/documents.parquet",
                benchmark=f"{sf_small}/benchmark.parquet")


def test_no_item_is_lost_whatever_words_are_missing(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + rnd.choice("uvwxyz")
    items = [(k, " ".join(word() for _ in range(rnd.randint(1, 70)))) for k in range(60)]
    docs = []
    for k in range(300):
        _, q = rnd.choice(items)
        w = q.split()
        for _ in range(rnd.randint(0, 3)):  # damage some words
            w[rnd.randrange(len(w))] = word()
        around = [" ".join(word() for _ in range(rnd.randint(0, 400))) for _ in range(2)]
        docs.append((k, f"{around[0]} {' '.join(w).upper()}, {around[1]}"))
    want = brute(docs, items)
    assert 30 < len(want)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(d, i) == want
    assert got(d, i, block_bytes=700) == want  # many blocks of items
    for t in (0.3, 0.5, 1.0):
        assert got(d, i, threshold=t) == brute(docs, items, threshold=t)


def test_nulls_short_items_ties_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("containment", T.IntegerType())])
    q = "one two three four five six seven"
    rows = [Row("x", None, 1, 1), Row("x", "", 2, 1), Row(None, "Alpha, BETA!", None, 1), Row("y", "w " * 50_000 + q, 3, 2),
            Row("y", q, 4, None), Row("y", q, 4, None), Row("z", "beta alpha", 5, 0)]
    docs = spark.createDataFrame(rows, schema)
    items = [(1, q), (1, q), (2, "alpha beta"), (None, "beta"), (3, None), (4, "... !"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(docs, bench) == brute([(r[2], r[1]) for r in rows], items)
    clean = decontam.decontaminate(docs, bench)
    assert clean.schema == docs.schema
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2]
    assert got(docs.limit(0), bench) == [] and got(docs, bench.limit(0)) == []
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 7


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_decontaminate_drops_what_the_search_finds(spark, sf):
    docs, bench = (load(spark, f"/root/testdata/{sf}", t) for t in ("documents", "benchmark"))
    hit = {r.doc_id for r in decontam.contained_items(docs, bench).collect()}
    left = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert hit and left == {r.doc_id for r in docs.collect()} - hit
