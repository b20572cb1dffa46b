"""The divergence audit against SQL, and its arithmetic against whole numbers."""
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import divergence as D
from oracle import same_as_sql

SCHEMA = "text string, lang string, source string, rank int, item string"


def audit(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    table = pa.table({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(("text", "lang", "source"))})
    return D.divergence(docs, **kw), table


def test_whole_table_equals_sql(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    same_as_sql(D.divergence(docs), D.ORACLE_SQL, documents=f"{sf_small}/documents.parquet")


def test_nulls_ties_repeats_and_groups_without_terms(spark):
    rnd = random.Random(3)
    words = ["Äpfel", "zoo", "Zoo", "a", "b", "été", "漢字", "c-d", "x1y", "😀", "É"]
    rows = []
    for k in range(400):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))
        rows.append((text, rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", None])))
    rows += [(None, "en", "s9"), ("", "xx", "s1"), ("few words", "xx", "s2"), ("1 2 3", "xx", None)] + [("tie one two", "en", "s1")] * 40
    df, table = audit(spark, rows)
    out = df.collect()
    assert {(r.source, r.item, r.value, r["rank"]) for r in out if r.lang == "xx" and r.source == "s1"} == {("s1", "", 0, 1), ("s1", "s2", 0, 2)}
    assert all(r.value > 0 for r in out if r.part == "term")
    same_as_sql(df, D.ORACLE_SQL, documents=table)


def test_ranks_stop_inside_a_cell_of_equal_values(spark):
    # sixty terms with one pair of counts: one cell, of which fifty ranks are shown in UTF-8 order
    terms = [f"{chr(0x61 + k % 26)}{chr(0x100 + k)}" for k in range(60)]
    rows = [(" ".join(terms), "en", "a")] * 30 + [("other words", "en", "b")] * 30 + [("other", "en", "a")]
    df, table = audit(spark, rows)
    got = [r.item for r in df.where("part = 'term' AND source = 'a'").orderBy("rank").collect()]
    assert got == sorted(terms, key=str.encode)[:50]
    same_as_sql(df, D.ORACLE_SQL, documents=table)


def test_large_counts_are_exact(spark):
    cases = [(9 * 10 ** 12, 10 ** 13, 10 ** 7), (0, 10 ** 13, 10 ** 7), (7, 8, 1), (10 ** 18, 9 * 10 ** 18, 3)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", D.probability(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10 ** 9 * (r.c + 5) // (r.n + 5 * r.v)


def test_sums_of_pairs_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CELLS", 8)
    monkeypatch.setattr(D, "HELD_CELLS", 20)
    rnd = np.random.default_rng(1)
    rows, want = [], {}
    for lang, s in (("a", 3), ("b", 4), ("c", 1)):
        empty = rnd.integers(1, 100, s)
        for _ in range(50):
            held = [(int(k), int(rnd.integers(1, 10 ** 9))) for k in np.flatnonzero(rnd.random(s) < 0.6)]
            rows.append((lang, [int(e) for e in empty], held))
            p = empty.copy()
            for k, v in held:
                p[k] = v
            for i in range(s):
                for j in range(i + 1, s):
                    want[lang, i, j] = want.get((lang, i, j), 0) + abs(int(p[i]) - int(p[j]))
    rnd.shuffle(rows)
    by_term = spark.createDataFrame([(str(a), b, c) for a, b, c in rows], "lang string, empty array<long>, held array<struct<no int, p long>>")
    out = D._pair_sums(by_term).groupBy("lang", "a", "b").agg(F.sum("value").alias("v"))
    assert {(r.lang, r.a, r.b): r.v for r in out.collect()} == want


def test_empty_table_and_very_long_text(spark):
    df, _ = audit(spark, [])
    assert df.count() == 0 and df.columns == ["lang", "source", "part", "item", "value", "rank"]
    df, table = audit(spark, [("word Other " * 200_000, "en", "a"), ("q " * 1_000_000, "en", "b")] * 15)
    df = D.divergence(spark.createDataFrame(table.to_pandas(), "text string, lang string, source string"), min_docs=15)
    got = {(r.source, r.part, r.item): r["rank"] for r in df.collect()}
    assert got == {("a", "pair", "b"): 1, ("b", "pair", "a"): 1, ("a", "term", "other"): 1, ("a", "term", "word"): 2, ("b", "term", "q"): 1}


def test_a_tied_value_is_cut_before_it_is_shuffled(spark):
    docs = spark.createDataFrame([("a b", "en", "s")], "text string, lang string, source string")
    plan = D.divergence(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # values and terms, partial and final
