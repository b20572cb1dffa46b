"""Line dedup against SQL and a small brute-force version."""
import hashlib
from collections import Counter

import pyarrow as pa
from oracle import same_as_sql
from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import linededup
from quarry.sources.tables import load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(BLANK).translate(LOWER)


def brute(rows, min_docs=10, min_chars=1):
    texts = [(d, (t or "").split("\n")) for d, t in rows]
    seen = Counter(k for _, ls in texts for k in {key(x) for x in ls})
    out = []
    for d, ls in texts:
        kept = [x for x in ls if not (len(key(x)) >= min_chars and seen[key(x)] >= min_docs)]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **params):
    return sorted(map(tuple, linededup.digest(df, **params).collect()), key=repr)


def test_whole_table_equals_sql(spark, sf_small):
    same_as_sql(linededup.digest(load(spark, sf_small, "documents")), linededup.ORACLE_SQL,
                documents=f"{sf_small}/documents.parquet")


def test_any_batching_gives_the_same_runs(spark):
    rows = [(k, "\n".join(f"{'Line' if k % 2 else 'line '} {j}" for j in range(k % 7, k % 7 + 5))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout, min_docs in ((1, 2, 10), (3, 2, 10), (5, 3, 25), (4, 2, 3)):
        assert got(docs, batches=batches, fanout=fanout, min_docs=min_docs) == brute(rows, min_docs)


def test_runs_are_compacted_by_level(spark):
    runs = linededup.LineRuns(spark, min_docs=2)
    from pyspark.sql import functions as F
    for k in range(4):
        runs.add(F.col("text"), spark.createDataFrame([(f"a\nb{k}",)], "text string"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    n = {(r.a, r.b): r.n for r in runs.levels[2][0].collect()}
    # the line a was frequent after the second batch and was not counted again
    assert sorted(n.values()) == [1, 1, 1, 1, 2]
    assert runs.frequent().count() == 1


def test_beyond_the_broadcast_bound(spark, sf_small, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", 0)
    docs = load(spark, sf_small, "documents")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_ties_empty_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("n_lines", T.StringType()), T.StructField("doc_id", T.LongType()),
                           T.StructField("text", T.StringType()), T.StructField("gone", T.IntegerType())])
    long = "\n".join(f"row {k}" for k in range(20_000)) + "\nSame"
    rows = [Row("q", None, " \tsame\r", 1), Row("q", 1, None, 1), Row("q", 2, "", 1), Row("q", 2, "", 1),
            Row("q", 3, "SAME\nother\n\n \n\x0bsame", None), Row("q", 3, "SAME\nother\n\n \n\x0bsame", None),
            Row(None, 5, long, 2), Row("q", 6, "é same É", 3), Row("q", None, " same", 3)]
    docs = spark.createDataFrame(rows, schema)
    want = brute([(r[1], r[2]) for r in rows], 3)
    assert got(docs, min_docs=3) == want
    out = linededup.line_dedup(docs, min_docs=3)
    assert out.columns[:4] == docs.columns and len(out.columns) == 6
    assert got(docs.limit(0)) == []
    table = pa.table({"doc_id": pa.array([r[1] for r in rows], pa.int64()), "text": [r[2] for r in rows]})
    same_as_sql(linededup.digest(docs, min_docs=3), linededup.ORACLE_SQL.replace(">= 10", ">= 3"), documents=table)
